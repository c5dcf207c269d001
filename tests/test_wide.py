"""The wide ring against Python's whole numbers."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sketchframe.operators import shares, wide

RING = 2**120
VALUES = [0.0, 1.0, -1.0, 0.5, -0.5, 1e-9, -3.75e10, 2.0**53 + 2, -(2.0**60), 2.0**60 - 2**8, 1e-250, -1e-201, 123456.789]


def number(limbs):
    return limbs["hi"] * wide.LIMB + limbs["lo"]


def frame(spark, values):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, x double")


@pytest.mark.parametrize("exponent", [0, 4, 13])
def test_encoding_and_decoding(spark, exponent):
    coded = frame(spark, VALUES).select("x", wide.wide_encode(F.col("x"), exponent).alias("e"))
    for r in coded.select("*", wide.wide_decode(F.col("e"), exponent).alias("back")).collect():
        whole = round(r["x"] * 16.0**exponent) if abs(r["x"]) >= 1e-200 else 0
        assert number(r["e"]) == whole % RING
        assert r["back"] == whole / 16**exponent


def test_own_exponents_keep_the_leading_digits(spark):
    """A value's own exponent is a whole power of 16, so at most three of its 53 bits fall off."""
    values = [v for v in VALUES if abs(v) < 1e30]
    coded = frame(spark, values).select("x", wide.wide_encode(F.col("x")).alias("e"))
    for r in coded.select("x", "e.exponent", wide.wide_decode(F.col("e"), F.col("e.exponent")).alias("back")).collect():
        assert r["back"] == (round(r["x"] * 16.0 ** r["exponent"]) / 16.0 ** r["exponent"] if abs(r["x"]) >= 1e-200 else 0.0)
        assert r["back"] == pytest.approx(r["x"], rel=2**-50, abs=1e-200)


def test_values_beyond_the_ring_are_refused(spark):
    with pytest.raises(Exception, match="does not fit"):
        frame(spark, [2.0**119]).select(wide.wide_encode(F.col("x"), 0).alias("e")).collect()


def test_sums_differences_and_shifts(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(RING), rng.randrange(RING), rng.randrange(0, 35)) for _ in range(200)] + [(RING - 1, 1, 0), (0, 1, 15), (2**60, RING - 2**60, 30)]
    rows = [(a >> 60, a % 2**60, b >> 60, b % 2**60, s) for a, b, s in pairs]
    df = spark.createDataFrame(rows, "ah bigint, al bigint, bh bigint, bl bigint, s int")
    a = F.struct(F.col("ah").alias("hi"), F.col("al").alias("lo"))
    b = F.struct(F.col("bh").alias("hi"), F.col("bl").alias("lo"))
    made = df.select(
        "ah", "al", "bh", "bl", "s", wide.wide_add(a, b).alias("sum"), wide.wide_subtract(a, b).alias("less"),
        wide.wide_negative(a).alias("minus"), wide.wide_align(a, F.lit(3), F.col("s") + 3).alias("up"),
    )
    for r in made.collect():
        x, y = r["ah"] * 2**60 + r["al"], r["bh"] * 2**60 + r["bl"]
        assert number(r["sum"]) == (x + y) % RING and number(r["less"]) == (x - y) % RING
        assert number(r["minus"]) == -x % RING and number(r["up"]) == x * 16 ** r["s"] % RING
    total = wide.wide_sum(df.select(F.lit(1).alias("k"), a.alias("e")), "e", ["k"]).first()
    assert number(total["e"]) == sum(x for x, _, _ in pairs) % RING


@pytest.mark.parametrize("secret", [None, "held"])
def test_shares_hide_and_recombine(cells, secret):
    x = cells({r: {f: (r - 5) * 1e12 + f / 3 for f in range(4)} for r in range(12)})
    a, b = wide.wide_split(x, 9, secret=secret)
    got = {(r["row_id"], r["f"]): r["v"] for r in wide.wide_reconstruct(a, b, 9).collect()}
    assert got == {(r["row_id"], r["f"]): round(r["v"] * 16.0**9) / 16**9 for r in x.collect()}
    shown = {number(r["share"]) for r in a.collect()} | {number(r["share"]) for r in b.collect()}
    assert len(shown) == 96 and min(shown) > 2**90


def test_exponents_from_precision(spark):
    x = frame(spark, [3.0, 1e-250])
    made = x.select(
        shares.fixed_encode(F.col("x"), precision=256.0).alias("p"), shares.fixed_encode(F.col("x"), precision=0.01).alias("q"),
        shares.fixed_encode(F.col("x"), precision=1.0, max_exponent=5).alias("m"),
    ).collect()
    assert [(r["p"]["encoding"], r["p"]["exponent"]) for r in made] == [(768, 2), (0, 2)]
    assert made[0]["q"]["exponent"] == -2 and (made[0]["m"]["encoding"], made[0]["m"]["exponent"]) == (3 * 16**5, 5)
    with pytest.raises(ValueError):
        shares.fixed_encode(F.col("x"), 4, precision=2.0)
