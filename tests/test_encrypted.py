"""Products of plain tables with encrypted vectors against plain sums."""

from __future__ import annotations

import random

import pytest

from sketchframe.operators import encrypted, paillier
from sketchframe.queries.sharing import TEST_KEY

KEY = TEST_KEY.public


def sealed(spark, values, name, exponent=4):
    frame = spark.createDataFrame([(i, float(v)) for i, v in values.items()], f"{name} bigint, w double")
    return paillier.encrypt_column(frame, "w", [name], KEY, b"secret", exponent)


def opened(df, name):
    return {r[name]: r["v"] for r in paillier.decrypt_column(df, TEST_KEY).collect()}


def test_power_product_equals_single_powers():
    rng, square = random.Random(3), KEY.square
    product, want = encrypted.PowerProduct(square), 1
    for _ in range(40):
        c, a = pow(rng.randrange(2, KEY.n), 1, square), rng.randrange(-(16**6), 16**6)
        product.add(c, a, 2)
        want = want * pow(c, a, square) % square
    assert product.close() == (want, 2)


def test_zero_powers_are_the_neutral_element():
    product = encrypted.PowerProduct(KEY.square)
    product.add(12345, 0, 3)
    assert product.close() == (1, 3)


@pytest.mark.parametrize("few", [True, False])
def test_product_equals_the_plain_one(spark, cells, few, monkeypatch):
    """Negative, zero and fractional cells, a heavy row, entries of two exponents, columns the vector lacks."""
    if not few:
        monkeypatch.setattr(encrypted, "BROADCAST_BYTES", 0)
    rng = random.Random(1)
    rows = {r: {f: rng.randrange(-64, 64) / 16 for f in rng.sample(range(50), 7)} for r in range(20)}
    rows[7] = {f: rng.randrange(-999, 999) / 4 for f in range(50)}
    w = {f: rng.randrange(-512, 512) / 256 for f in range(45)}
    fine = sealed(spark, {f: v for f, v in w.items() if f % 2}, "f", 5)
    coarse = sealed(spark, {f: v for f, v in w.items() if not f % 2}, "f", 2)
    got = opened(encrypted.encrypted_matvec(cells(rows).repartition(5), fine.unionByName(coarse), KEY, bound=2.0), "row_id")
    want = {r: sum(v * w.get(f, 0.0) for f, v in fv.items()) for r, fv in rows.items()}
    want = {r: z for r, z in want.items() if any(v and f in w for f, v in rows[r].items())}
    assert got == want


def test_transposed_product(spark, cells):
    rows = {0: {0: 1.5, 2: -2.0}, 1: {0: 4.0}, 2: {2: 0.25}}
    d = sealed(spark, {0: 0.5, 1: -1.0, 2: 8.0}, "row_id")
    assert opened(encrypted.encrypted_matvec_t(cells(rows), d, KEY, bound=8.0), "f") == {0: -3.25, 2: 1.0}


def test_products_beyond_the_key_are_refused(spark, cells):
    w = sealed(spark, {0: 1.0}, "f")
    with pytest.raises(ValueError, match="fit"):
        encrypted.encrypted_matvec(cells({0: {0: 1.0}}), w, KEY, bound=1e80)


def test_empty_tables(spark, cells):
    w = sealed(spark, {0: 1.0}, "f")
    assert encrypted.encrypted_matvec(cells({}), w, KEY, bound=1.0).count() == 0
    assert encrypted.encrypted_matvec(cells({0: {0: 1.0}}), w.where("f > 5"), KEY, bound=1.0).count() == 0


def test_columns_are_added_row_by_row(spark):
    a, b = sealed(spark, {1: 2.0, 2: -3.5}, "id", 2), sealed(spark, {2: 0.0625, 3: 7.0}, "id", 6)
    assert opened(encrypted.encrypted_add(a, b, ["id"], KEY), "id") == {1: 2.0, 2: -3.4375, 3: 7.0}


def test_opening_by_both_primes_equals_the_textbook():
    import math

    rng, n, square = random.Random(5), KEY.n, KEY.square
    order = math.lcm(TEST_KEY.p - 1, TEST_KEY.q - 1)
    opener = paillier.Opener(TEST_KEY)
    for plain in [0, 1, n - 1, n // 2, *(rng.randrange(n) for _ in range(20))]:
        c = (1 + n * plain) * pow(rng.randrange(2, n), n, square) % square
        assert opener.plain(c) == plain == (pow(c, order, square) - 1) // n * pow(order, -1, n) % n


@pytest.mark.parametrize("held", [50_000, 3])
def test_weighted_sums_take_powers_together(spark, monkeypatch, held):
    """Keys of one and of many rows, negative and zero weights, two exponents; many rows of a key take no power of their own."""
    monkeypatch.setattr(paillier, "HELD_KEYS", held)
    rng = random.Random(2)
    rows = {i: (rng.randrange(-99, 99) / 4, rng.randrange(-64, 64) / 16 if i % 9 else 0.0, "one" if i == 5 else "ab"[i % 2] if i < 60 else "c") for i in range(64)}
    frame = spark.createDataFrame([(i, *r) for i, r in rows.items()], "id bigint, w double, a double, k string").repartition(2)
    fine, coarse = (paillier.encrypt_column(frame.where(f"id % 2 = {r}"), "w", ["id"], KEY, b"secret", e) for r, e in ((0, 3), (1, 5)))
    got = opened(paillier.paillier_weighted_sum(fine.unionByName(coarse), "a", ["k"], KEY, exponent=2), "k")
    want = {}
    for v, a, k in rows.values():
        want[k] = want.get(k, 0.0) + v * a
    assert got == want
    product = paillier.PowerProduct(KEY.square)
    for c in range(2, 200):
        product.add(c, c % 7 - 3, 0)
    assert sum(map(len, product.buckets)) <= 6  # one bucket a digit, however many rows


def test_a_task_sorts_a_bounded_number_of_cells(spark, cells, monkeypatch):
    """A broadcast vector's cells come in parts that grow in number with them, and a heavy group in pieces; the sums are the same."""
    monkeypatch.setattr(encrypted, "CELLS_PER_TASK", 10)
    seen, merge = [], encrypted.paillier_sum
    monkeypatch.setattr(encrypted, "paillier_sum", lambda df, by, key: seen.append(df) or merge(df, by, key))
    rows = {r: {f: (r + f) % 5 / 4 - 0.25 for f in ([0, 1 + r] if r else range(40))} for r in range(60)}
    d = sealed(spark, {r: r % 7 - 3 for r in rows}, "row_id")
    got = opened(encrypted.encrypted_matvec_t(cells(rows).repartition(3), d, KEY, bound=4.0), "f")
    want = {}
    for r, fv in rows.items():
        for f, v in fv.items():
            if v:
                want[f] = want.get(f, 0.0) + v * (r % 7 - 3)
    assert got == want
    assert seen[0].rdd.getNumPartitions() >= sum(len(fv) for fv in rows.values()) // 10
    assert seen[0].where("f = 0").count() > 1


def test_many_values_are_sealed_as_single_ones():
    rng, n, blinder = random.Random(6), KEY.n, paillier.Blinder(KEY)
    plains = [0, 1, n - 1, *(rng.randrange(n) for _ in range(paillier.TABLE_FROM))]
    blinds = [bytes(32), b"\xff" * 32, *(rng.randbytes(32) for _ in plains[2:])]
    want = [(1 + n * x) * blinder.power(b) % KEY.square for x, b in zip(plains, blinds)]
    assert blinder.sealed(plains, blinds) == want
    assert blinder.sealed(plains[:5], blinds[:5]) == want[:5]
    assert sum(t.nbytes for t in blinder.table) <= paillier.TABLE_BYTES


@pytest.mark.parametrize("large", [None, 0, 1999])
def test_many_are_opened_by_one_prime_and_checked_by_the_other(monkeypatch, large):
    """The second prime opens one product of all; a number it has to tell apart makes it open them all."""
    rng, n, blinder = random.Random(7), KEY.n, paillier.Blinder(KEY)
    plains = [rng.randrange(-(10**20), 10**20) % n for _ in range(paillier.TOGETHER_OPENED)]
    if large is not None:
        plains[large] = [TEST_KEY.p, n // 2][large % 2]
    opened, side = [], paillier.Opener._side
    monkeypatch.setattr(paillier.Opener, "_side", lambda self, cs, which: opened.append((len(cs), which)) or side(self, cs, which))
    cs = blinder.sealed(plains, [rng.randbytes(32) for _ in plains])
    assert paillier.Opener(TEST_KEY).plains(cs) == plains
    assert opened == [(2000, 0), (1, 1)] + [(2000, 1)] * (large is not None)


def test_products_of_sorted_keys_are_aligned_together(monkeypatch):
    """A power for every ciphertext that is to be aligned by as much, however frames cut the keys."""
    import pandas as pd

    rng, n, blinder = random.Random(8), KEY.n, paillier.Blinder(KEY)
    ids, exponents = [i // 2 for i in range(200)] + [100] * 7, [i % 2 * 8 for i in range(200)] + [3, 1, 4, 1, 5, 0, 2]
    plains = [rng.randrange(1000) * 16**e for e in exponents]
    blinder.seen = paillier.TABLE_FROM
    cs = [KEY.pack(c) for c in blinder.sealed(plains, [rng.randbytes(32) for _ in plains])]
    frame, calls, powers = pd.DataFrame({"id": ids, "c": cs, "exponent": exponents}), [], paillier.powers
    monkeypatch.setattr(paillier, "powers", lambda *a: calls.append(len(a[0])) or powers(*a))
    opener = paillier.Opener(TEST_KEY)
    for cuts in ([0, 207], [0, 1, 1, 50, 51, 203, 207]):
        calls.clear()
        frames = paillier._multiply_sorted([frame[a:b] for a, b in zip(cuts, cuts[1:])], ["id"], KEY)
        rows = [row for f in frames for row in f.itertuples(index=False)]
        got = {r.id: opener.plain(int.from_bytes(r.c, "big")) / 16**r.exponent for r in rows}
        assert len(rows) == 101 and got == {i: sum(p / 16**e for k, p, e in zip(ids, plains, exponents) if k == i) for i in range(101)}
        if len(cuts) == 2:
            assert calls[0] == 100


def test_added_columns_are_exchanged_once(spark, capsys):
    a, b = sealed(spark, {1: 2.0, 2: -3.5}, "id", 2), sealed(spark, {2: 0.0625, 3: 7.0}, "id", 6)
    encrypted.encrypted_add(a, b, ["id"], KEY).explain()
    assert capsys.readouterr().out.count("Exchange hashpartitioning") == 1


def test_added_columns_with_frequent_keys(spark):
    """A key of most rows, null keys and rows of one side, in one batch and in several."""
    rows = [(i, "hot" if i % 3 else None if i % 2 else f"k{i}", i / 8 - 50) for i in range(900)]
    left, right = (spark.createDataFrame(rows[a:], "id int, k string, w double").repartition(3) for a in (0, 300))
    a, b = (paillier.encrypt_column(x, "w", ["id"], KEY, s, e) for x, s, e in ((left, b"a", 3), (right, b"b", 1)))
    want = {}
    for i, k, w in rows:
        want[k] = want.get(k, 0.0) + w + (i >= 300) * round(w * 16) / 16
    assert opened(encrypted.encrypted_add(a, b, ["k"], KEY), "k") == want
