import math

import numpy as np
import pytest
import xxhash
from conftest import as_dict
from pyspark.sql import functions as F

from sketchframe.functions.hashing import stream_key
from sketchframe.operators import expand, sketch
from sketchframe.plans.sketching import SketchConfig, sketch_width

MASK = 2**64 - 1


def spark_hash(*numbers: int) -> int:
    seed = 42
    for n in numbers:
        seed = xxhash.xxh64_intdigest((n & MASK).to_bytes(8, "little"), seed=seed)
    return seed


def uniform(seed, stream, f, j, party=""):
    bits = spark_hash(f ^ stream_key(seed, stream, party), j)
    return ((bits >> 12) + 0.5) / 2**52


def brute_minhash(row: dict[int, float], k: int, seed: int) -> list[int]:
    out = []
    for j in range(k):
        scores = [(-math.log(uniform(seed, "u", f, j)) / v, f) for f, v in row.items() if v > 0]
        out.append(min(scores)[1] if scores else -1)
    return out


def brute_cws(row, k, seed):
    """The sampling formula as published, without the logarithm of the score."""
    out = []
    for j in range(k):
        scores = []
        for f, v in row.items():
            if v <= 0:
                continue
            beta, v1, v2, u1, u2 = (uniform(seed, s, f, j) for s in ("beta", "v1", "v2", "u1", "u2"))
            g = -math.log(u1 * u2)
            y = math.exp(g * (math.floor(math.log(v) / g + beta) - beta))
            scores.append((-math.log(v1 * v2) * u1 * u2 / y, f))
        out.append(min(scores)[1] if scores else -1)
    return out


def samples_of(df):
    out: dict[int, list[int]] = {}
    for r in sorted(df.collect(), key=lambda r: (r["row_id"], r["j"])):
        assert r["j"] == len(out.setdefault(r["row_id"], []))
        out[r["row_id"]].append(r["s"])
    return out


ROWS = {
    0: {0: 1.5, 3: 2.0, 7: 0.25},
    1: {},
    2: {5: 3.0},
    3: {1: -1.0, 2: -4.0},
    4: {1: -1.0, 2: 4.0, 9: 1e-3, 8: 1e6},
}


@pytest.mark.parametrize("draw, brute", [(sketch.p_minhash, brute_minhash), (sketch.cws_0bit, brute_cws)])
@pytest.mark.parametrize("k, settle_ties", [(5, True), (130, True), (130, False)])
def test_samples_match_brute_force(cells, rows_of, draw, brute, k, settle_ties):
    got = samples_of(draw(cells(ROWS), rows_of(ROWS), k, seed=3, settle_ties=settle_ties))
    assert got == {r: brute(fv, k, 3) for r, fv in ROWS.items()}


def test_repeat_doubles_the_seed(cells, rows_of):
    x, rows = cells(ROWS), rows_of(ROWS)
    assert samples_of(sketch.p_minhash(x, rows, 6, 2, repeat=3)) == samples_of(sketch.p_minhash(x, rows, 6, 8))


def test_ties_go_to_the_least_feature(cells, rows_of):
    x = cells({0: {9: math.inf, 4: math.inf, 6: math.inf, 1: 1.0}})
    assert samples_of(sketch.p_minhash(x, rows_of([0]), 8)) == {0: [4] * 8}


def test_more_draws_extend_fewer(cells, rows_of):
    x, rows = cells(ROWS), rows_of(ROWS)
    few, many = samples_of(sketch.p_minhash(x, rows, 20)), samples_of(sketch.p_minhash(x, rows, 150))
    assert all(many[r][:20] == s for r, s in few.items())


def test_scaling_a_row_keeps_its_samples(cells, rows_of):
    row = {f: float(f % 5 + 1) for f in range(30)}
    got = samples_of(sketch.p_minhash(cells({0: row, 1: {f: 4 * v for f, v in row.items()}}), rows_of([0, 1]), 64))
    assert got[0] == got[1]


@pytest.mark.parametrize("parts", [1, 8])
def test_partitions_do_not_matter(cells, rows_of, parts):
    x = cells({r: {f: float((r * f) % 7 + 1) for f in range(r, r + 20)} for r in range(40)})
    base = samples_of(sketch.cws_0bit(x, rows_of(range(40)), 16))
    assert samples_of(sketch.cws_0bit(x.repartition(parts), rows_of(range(40)), 16)) == base


def test_agreement_estimates_similarity(cells, rows_of):
    a = {f: 1.0 + f % 3 for f in range(20)}
    b = {f: 1.0 + f % 4 for f in range(5, 25)}
    k = 4000
    x, rows = cells({0: a, 1: b}), rows_of([0, 1])
    both = set(a) & set(b)
    jaccard = sum(1 / sum(max(a.get(g, 0) / a[f], b.get(g, 0) / b[f]) for g in set(a) | set(b)) for f in both)
    got = samples_of(sketch.p_minhash(x, rows, k))
    assert abs(np.mean(np.array(got[0]) == np.array(got[1])) - jaccard) < 4 / math.sqrt(k)
    minmax = sum(min(a.get(f, 0), b.get(f, 0)) for f in both) / sum(max(a.get(f, 0), b.get(f, 0)) for f in set(a) | set(b))
    got = samples_of(sketch.cws_0bit(x, rows, k))
    share = np.mean(np.array(got[0]) == np.array(got[1]))
    assert minmax - 4 / math.sqrt(k) < share < minmax + 0.1


def test_a_heavy_row_is_split(spark):
    """One row holds half of all cells; its partition is cut and the answer stays."""
    keys = ["spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize"]
    old = {key: spark.conf.get(key) for key in keys}
    try:
        for key in keys:
            spark.conf.set(key, "64k")
        x = spark.range(200_000).selectExpr(
            "if(id % 2 = 0, 0L, id) as row_id", "id as f", "cast(id % 5 + 1 as double) as v"
        )
        rows = x.select("row_id").distinct()
        out = sketch.p_minhash(x, rows, 4)
        hot = {r["j"]: r["s"] for r in out.collect() if r["row_id"] == 0}
        final = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        merge, pieces = final.index("SortAggregate"), final.index("partial_min")
        assert merge < final.index("Exchange hashpartitioning(row_id") < pieces
        reads = final[pieces : final.index("REBALANCE_PARTITIONS_BY_COL")]
        assert "AQEShuffleRead" in reads and "skewed" in reads
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)
    keep = {f: f % 5 + 1.0 for f in range(0, 200_000, 2)}
    for j in range(4):
        best = min((-math.log(uniform(1, "u", f, j)) / v, f) for f, v in keep.items())
        assert hot[j] == best[1]


def test_fourier_features_estimate_the_kernel(cells, rows_of):
    x, y = {0: 0.3, 1: -0.5, 4: 0.1}, {0: 0.1, 1: 0.4, 2: 0.2}
    k, gamma = 4000, 0.7
    got = as_dict(sketch.rff(cells({0: x, 1: y, 2: {}}), rows_of(range(3)), k, gamma), column="j")
    assert len(got) == 3 * k
    vectors = np.array([[got[r, j] for j in range(k)] for r in range(3)])
    points = np.array([[p.get(f, 0.0) for f in range(5)] for p in (x, y, {})])
    for a, b in ((0, 1), (0, 2), (1, 1)):
        wanted = math.exp(-gamma * ((points[a] - points[b]) ** 2).sum())
        assert abs(vectors[a] @ vectors[b] - wanted) < 4 / math.sqrt(k)


@pytest.mark.parametrize("degree", [1, 2, 3])
def test_tensor_sketch_estimates_the_polynomial(cells, rows_of, degree):
    x, y = {0: 0.6, 1: -0.5, 2: 0.1}, {0: 0.5, 1: 0.4, 2: 0.2}
    k, gamma = 4096, 0.5
    frame = sketch.tensor_sketch(cells({0: x, 1: y, 2: {}}), rows_of(range(3)), k, gamma, n=3, degree=degree)
    got = as_dict(frame, column="j")
    assert len(got) == 3 * k
    vectors = np.array([[got[r, j] for j in range(k)] for r in range(3)])
    dot = sum(x[f] * y[f] for f in x)
    assert abs(vectors[0] @ vectors[1] - (gamma * dot + 1) ** degree) < 4 / math.sqrt(k)
    assert abs(vectors[2] @ vectors[2] - 1.0) < 4 / math.sqrt(k)


# --- expansion -----------------------------------------------------------------


@pytest.fixture(scope="module")
def tiny(spark):
    data = [(0, 0, 1), (0, 1, 4), (1, 0, 0), (1, 1, 0), (2, 0, 3), (2, 1, 3)]
    return spark.createDataFrame(data, "row_id bigint, j bigint, s bigint")


def columns(df):
    out: dict[int, set[int]] = {}
    for r in df.collect():
        assert r["v"] == 1
        out.setdefault(r["row_id"], set()).add(r["col"])
    return out


def test_plain_columns_by_hand(tiny):
    assert columns(expand.sketch_plain(tiny, 4)) == {0: {3, 4}, 2: {1, 5}}


def test_low_bit_columns_by_hand(tiny):
    assert columns(expand.sketch_bbit(tiny, 1)) == {0: {0, 3}, 2: {0, 2}}


def test_count_columns_follow_the_coefficients(spark, tiny):
    c = 5
    h = {r["j"]: (r["a"], r["b"]) for r in expand.hash_coefficients(spark.range(2).withColumnRenamed("id", "j"), c).collect()}
    assert all(1 <= a < c and 0 <= b < c for a, b in h.values())
    wanted: dict[int, set[int]] = {}
    for r in tiny.where("s > 0").collect():
        a, b = h[r["j"]]
        wanted.setdefault(r["row_id"], set()).add(c * r["j"] + c - ((a * r["s"] + b) % c + 1))
    assert columns(expand.sketch_count(tiny, c)) == wanted


def test_coefficients_stay_in_range(spark):
    h = expand.hash_coefficients(spark.range(5000).withColumnRenamed("id", "j"), 3)
    assert {(r["a"], r["b"]) for r in h.collect()} == {(a, b) for a in (1, 2) for b in (0, 1, 2)}


def test_bad_parameters(tiny):
    with pytest.raises(ValueError):
        expand.sketch_count(tiny, 1)
    with pytest.raises(ValueError):
        expand.expand(tiny, 4, b=1, c=2)
    with pytest.raises(ValueError):
        expand.expand_two_party_blocks(tiny, tiny, 4, 4, 2, b=1, c=2)
    with pytest.raises(ValueError):
        SketchConfig("XX", 4).sampled


def test_two_party_global_is_one_id_space(tiny):
    got = columns(expand.expand_two_party_global(tiny, tiny, 4, 6, 2))
    assert got == {0: {10 - 1, 10 + 10 - 4, 20 + 10 - 5, 30 + 10 - 8}, 2: {10 - 3, 10 + 10 - 3, 20 + 10 - 7, 30 + 10 - 7}}


def test_two_party_blocks_skip_hashing_of_small_domains(tiny):
    got = columns(expand.expand_two_party_blocks(tiny, tiny, 4, 100, 2, c=8))
    first = {r: {c for c in cols if c < 8} for r, cols in got.items()}
    assert first == columns(expand.sketch_plain(tiny, 4))
    second = {r: {c - 8 for c in cols if c >= 8} for r, cols in got.items()}
    assert second == columns(expand.sketch_count(tiny, 8, offset=2))


def test_resplit_off_by_one_and_aligned(spark):
    z = spark.createDataFrame([(0, 2455), (0, 2456), (0, 2457)], "row_id bigint, col bigint").withColumn("v", F.lit(1))
    left, right = expand.resplit_sketch(z, 8 * 1024, 0.3)
    assert (left.count(), [r["col"] for r in right.collect()]) == (2, [0])
    left, right = expand.resplit_sketch(z, 8 * 1024, 0.3, align="party", boundary=307 * 8)
    assert (left.count(), sorted(r["col"] for r in right.collect())) == (1, [0, 1])


def test_sample_budgets_and_widths():
    for portion, k1 in ((0.3, 307), (0.4, 409)):
        assert SketchConfig("SM", 27648, 1024, portion=portion).k1 == k1
    assert sketch_width(SketchConfig("SM", 27648, 1024, c=16, portion=0.3)) == 16 * 1024
    assert sketch_width(SketchConfig("SM", 100, 10, c=40, portion=0.3)) == 30 * 3 + 40 * 7
    assert sketch_width(SketchConfig("SM", 100, 10)) == 1000
    assert sketch_width(SketchConfig("RBF", 100, 10)) == 10
