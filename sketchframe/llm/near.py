"""Near duplicates of weighted word shingles: ProbMinHash, banding, verification, classes.

The similarity is the probability Jaccard index of the two weighted shingle sets.  A shingle of weight w
is a Poisson process of rate w; every arrival picks one of ``registers`` registers at random, which keeps the first
arrival it sees.  A shingle stops as soon as its next arrival is later than what every register of its text
holds already.  Two texts agree in a register with a probability equal to their similarity.

1. One pass gives every text a fingerprint of its whole shingle set, its bands and its signature.
   Equal sets are one node from here on, so thousands of copies cost one row.
2. A bucket (band, hash) links each member to one leader, never member to member.  The leader is the member that
   meets most others, over all bands; in a group of edited copies that is the one nearest to their origin.
3. These pairs, at most one per member and band, are verified on their texts, exactly, and linked into components.
4. Members of one bucket that are still in different components are compared with each other.  Before such a
   pair becomes a row, two bounds turn it away: distances (one less the similarity) obey the triangle inequality, so two
   members whose exact distances to their leader differ by more than the threshold's are no link; and the
   signatures must agree in as many registers as a link does but for ``slack`` standard deviations, which
   a true link misses about once in 300,000 times.  Members of such buckets, and only they, get ``further`` registers
   for this, so that a group of edited copies that are nearly links leaves few pairs.  A pair becomes a row in the first
   bucket that both are in.  What is left is verified too.  No other pair of a bucket is left out.

Defined cases: a null text is an empty one.  A text of fewer than five words is one shingle; one without a
word is like no other text, but equal ones are one class.  The class id is the least id of the class
(null only if all its ids are), and that document stays; rows that repeat id and text share all values.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sketchframe.llm.common import in_bitmap, only, text_key, texts
from sketchframe.llm.components import stars
from sketchframe.llm.text import Flat, flat, lean, mix, salted, shingles, uniform
from sketchframe.session import in_parts, write_out

BANDS, ROWS, REGISTERS, FURTHER = 20, 4, 160, 512
HELD = 2_000_000  # shingles that a verifying task keeps at hand


# --- in a task --------------------------------------------------------------


def weighted(piece: Flat, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, weight); a shingle that occurs n times weighs 1 + ln n."""
    row, shingle, n = shingles(*piece.words(), piece.n, size)
    return row, shingle, 1.0 + np.log(n)


def prob_minhash(row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, rows: int, m: int) -> np.ndarray:
    """The shingle that each of ``m`` registers of each row keeps."""
    first, owner = np.full(rows * m, np.inf), np.zeros(rows * m, np.uint64)
    limit = np.full(rows, np.inf)
    clock, turn = np.zeros(len(shingle)), 0
    while len(shingle):
        clock = clock - np.log(uniform(salted(shingle, 2 * turn + 1))) / weight
        going = clock < limit[row]
        row, shingle, weight, clock = row[going], shingle[going], weight[going], clock[going]
        at = row * m + (salted(shingle, 2 * turn + 2) % np.uint64(m)).astype(np.int64)
        np.minimum.at(first, at, clock)
        won = first[at] == clock
        owner[at[won]] = shingle[won]
        open_ = np.unique(row)
        limit[open_] = first.reshape(rows, m)[open_].max(axis=1)
        turn += 1
    return owner.reshape(rows, m)


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Sum over common elements d of 1 / sum over e of max(x_e / x_d, y_e / y_d); ids are sorted."""
    common, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    ratio = x[i] / y[j]
    order = np.argsort(ratio)
    ratio, xs, ys = ratio[order], x[i][order], y[j][order]
    x_above = np.append(np.cumsum(xs[::-1])[::-1][1:], 0.0) + (x.sum() - xs.sum())  # larger ratio, or in a only
    y_upto = np.cumsum(ys) + (y.sum() - ys.sum())
    # equal ratios: each may count on either side, as both give the same maximum
    return float((1.0 / (x_above / xs + y_upto / ys)).sum())


def _signed(bands: int, rows: int, size: int, m: int):

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in flat(batch.column("text"), 512 << 10):
                row, shingle, weight = weighted(piece, size)
                per_row = np.bincount(row, minlength=piece.n)
                owner = prob_minhash(row, shingle, weight, piece.n, m)
                keys = np.zeros((piece.n, bands), np.uint64)
                for r in range(rows):
                    keys = mix(keys ^ salted(owner[:, r : bands * rows : rows], r + 1))
                scaled = np.rint(weight * 2.0**32).astype(np.uint64)  # whole numbers add up alike in any order
                marks = []
                for salt in (101, 102):
                    total = np.append(np.uint64(0), np.cumsum(salted(shingle, salt) * scaled))
                    end = np.cumsum(per_row)
                    marks.append(total[end] - total[end - per_row])
                marks = np.stack(marks, axis=1)
                prints = [marks[i].tobytes().hex() if per_row[i] else hashlib.md5(piece.raw(i)).hexdigest() for i in range(piece.n)]
                has = per_row > 0
                offsets = np.append(0, np.cumsum(np.where(has, bands, 0))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[has].view(np.int64).ravel()))
                at = slice(piece.first, piece.first + piece.n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[at], batch.column("key")[at], pa.array(prints, pa.string()), lists, _codes(owner)],
                    ["doc_id", "key", "print", "bands", "signature"],
                )

    return run


def _codes(owner: np.ndarray) -> pa.Array:
    """The registers of each row as a list of longs, a byte of each."""
    rows, m = owner.shape
    packed = np.ascontiguousarray((mix(owner) & np.uint64(0xFF)).astype(np.uint8)).view("<i8")
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * (m // 8)), pa.array(packed.ravel()))


def _further(size: int, m: int):
    """``m`` registers of other arrivals than those of the signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in flat(batch.column("text"), 256 << 10):
                row, shingle, weight = weighted(piece, size)
                owner = prob_minhash(row, salted(shingle, 977), weight, piece.n, m)
                at = slice(piece.first, piece.first + piece.n)
                yield pa.RecordBatch.from_arrays([batch.column("print")[at], _codes(owner)], ["print", "further"])

    return run


def _verified(size: int):
    def sets(column: pa.Array, names: list[str], held: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        """Add the shingles of texts that are not held yet; members of one group come again and again."""
        new = list({name: i for i, name in enumerate(names) if name not in held}.values())
        for piece in flat(column.take(pa.array(new, pa.int64()))):
            row, shingle, weight = weighted(piece, size)
            cut = np.searchsorted(row, np.arange(piece.n + 1))
            for i in range(piece.n):
                held[names[new[piece.first + i]]] = shingle[cut[i] : cut[i + 1]], weight[cut[i] : cut[i + 1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                if sum(len(x) for x, _ in held.values()) > HELD:
                    held.clear()
                a, b = part.column("a").to_pylist(), part.column("b").to_pylist()
                sets(part.column("text_a"), a, held)
                sets(part.column("text_b"), b, held)
                value = [probability_jaccard(*held[x], *held[y]) for x, y in zip(a, b, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(value, pa.float64())], ["a", "b", "similarity"])

    return run


# --- Spark ------------------------------------------------------------------


def _same_bytes(x: Column, y: Column) -> Column:
    """In how many bytes two longs agree."""
    t = x.bitwiseXOR(y)
    for shift in (4, 2, 1):
        t = t.bitwiseOR(F.shiftrightunsigned(t, shift))
    return F.lit(8) - F.bit_count(t.bitwiseAND(F.lit(0x0101010101010101)))


def _agreeing(x: Column, y: Column, words: int) -> Column:
    """In how many bytes two signatures of ``words`` longs agree."""
    total = F.lit(0)
    for i in range(words):
        total = total + _same_bytes(x[i], y[i])
    return total


def _agreeing_long(x: Column, y: Column) -> Column:
    """The same for signatures of any width, as a loop: written out they would be too large to compile."""
    return F.aggregate(F.zip_with(x, y, _same_bytes), F.lit(0), lambda total, n: total + n)


def _met_before(x: Column, y: Column, band: Column, bands: int) -> Column:
    """Whether two lists of buckets agree in a band before ``band``."""
    met = F.lit(False)
    for b in range(bands - 1):
        met = met | ((band > b) & (x[b] == y[b]))
    return met


def _similarities(pairs: DataFrame, bodies: DataFrame, size: int) -> DataFrame:
    left = bodies.select(F.col("print").alias("a"), F.col("text").alias("text_a"))
    right = bodies.select(F.col("print").alias("b"), F.col("text").alias("text_b"))
    # b first: the leaders of star pairs are few, and the rows that then bear their text are spread by member
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
    return write_out(both.mapInArrow(lean(_verified(size)), "a string, b string, similarity double"), "similarities")


def near_classes(
    docs: DataFrame, threshold: float = 0.8, size: int = 5, bands: int = BANDS, rows: int = ROWS, registers: int = REGISTERS, slack: float = 4.5, further: int = FURTHER
) -> DataFrame:
    """doc_id, class_id, class_size, kept and ``key`` of every row of ``docs``."""
    if registers % 8 or further % 8 or registers < bands * rows:
        raise ValueError("registers must be multiples of 8 and at least bands * rows")
    least, least_of_all = (int(np.floor(n * threshold - slack * np.sqrt(n * threshold * (1 - threshold)))) for n in (registers, registers + further))
    base = texts(docs).withColumn("key", text_key())
    schema = "doc_id bigint, key string, print string, bands array<bigint>, signature array<bigint>"
    signed = write_out(base.mapInArrow(lean(_signed(bands, rows, size, registers)), schema), "signed")
    one = F.min(F.struct("key", "doc_id", "bands", "signature")).alias("one")
    of_docs = signed.count()
    nodes = write_out(in_parts(signed.groupBy("print").agg(one).select("print", "one.*"), of_docs), "nodes")

    # members of a bucket against its leader
    members = nodes.select("print", F.posexplode("bands").alias("band", "h"))
    of_members = bands * nodes.count()
    sizes = write_out(in_parts(members.groupBy("band", "h").agg(F.count("*").alias("n")).where("n > 1"), of_members), "sizes")
    met = write_out(in_parts(members.join(sizes, ["band", "h"]), of_members), "met")
    of_met = met.count()  # none of the tables of members has more rows
    degrees = met.groupBy("print").agg(F.sum("n").alias("degree")).join(nodes.select("print", "key", "doc_id"), "print")
    wanted = write_out(in_parts(degrees.select("print", "degree", F.col("key").alias("_key"), F.col("doc_id").alias("_id")), of_met), "wanted")
    leaders = met.join(wanted.select("print", "degree"), "print").groupBy("band", "h").agg(F.max(F.struct("degree", "print")).alias("most")).select("band", "h", F.col("most.print").alias("lead"))
    leaders = write_out(in_parts(leaders, of_met), "leaders")
    led = write_out(in_parts(met.drop("n").join(leaders, ["band", "h"]), of_met), "led")
    star = led.where("print <> lead").select(F.col("print").alias("a"), F.col("lead").alias("b")).distinct()
    some = in_bitmap(base.withColumn("_hash", F.xxhash64("key", "doc_id")), "_hash", wanted.select(F.xxhash64("_key", "_id").alias("id")))
    same = (some["key"] == wanted["_key"]) & some["doc_id"].eqNullSafe(wanted["_id"])
    bodies = write_out(some.join(wanted, same).select("print", "text").dropDuplicates(["print"]), "bodies")
    found = _similarities(star, bodies, size)
    links = found.where(F.col("similarity") >= threshold - 1e-9).select("a", "b")

    # members of a bucket in different components against each other
    roots = stars(links)  # without the roots themselves
    placed = led.join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    placed = write_out(in_parts(placed, of_met), "placed")
    mixed = placed.groupBy("band", "h").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    mixed = write_out(in_parts(mixed.select("band", "h"), of_met), "mixed")
    apart = placed.join(mixed, ["band", "h"])
    known = found.select(F.col("a").alias("print"), F.col("b").alias("lead"), "similarity")
    apart = apart.join(known, ["print", "lead"], "left").withColumn("similarity", F.coalesce("similarity", F.lit(1.0)))
    apart = write_out(in_parts(apart, of_met), "split")
    unsure = bodies.join(apart.select("print").distinct(), "print").select("print", "text")
    more_bits = write_out(unsure.mapInArrow(lean(_further(size, further)), "print string, further array<bigint>"), "further")
    apart = in_parts(apart.join(more_bits, "print").join(nodes.select("print", "signature", "bands"), "print"), of_met)
    # of two members in different components one at least is not linked to the leader
    x, y = apart.where(F.col("similarity") < threshold - 1e-9).alias("x"), apart.alias("y")
    alike = _agreeing(F.col("x.signature"), F.col("y.signature"), registers // 8)
    likely = (
        (F.col("x.band") == F.col("y.band"))
        & (F.col("x.h") == F.col("y.h"))
        & (F.col("x.root") != F.col("y.root"))
        & ((F.col("y.similarity") >= threshold - 1e-9) | (F.col("x.print") < F.col("y.print")))
        & (F.col("y.print") != F.col("y.lead"))
        & (F.abs(F.col("x.similarity") - F.col("y.similarity")) <= 1.0 - threshold + 1e-9)
        & ~_met_before(F.col("x.bands"), F.col("y.bands"), F.col("x.band"), bands)
        & (alike >= least)
        & (alike + _agreeing_long(F.col("x.further"), F.col("y.further")) >= least_of_all)
    )
    cross = x.join(y, likely).select(F.greatest("x.print", "y.print").alias("a"), F.least("x.print", "y.print").alias("b")).distinct()
    more = _similarities(cross, bodies, size).where(F.col("similarity") >= threshold - 1e-9).select("a", "b")
    if not more.isEmpty():
        roots = stars(roots.toDF("a", "b").unionByName(more))

    named = signed.select("doc_id", "key", "print").join(roots.withColumnRenamed("node", "print"), "print", "left")
    named = write_out(in_parts(named.select("doc_id", "key", F.coalesce("root", "print").alias("root")), of_docs), "named")
    groups = named.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    groups = write_out(in_parts(groups, of_docs), "groups")
    kept = F.col("doc_id").eqNullSafe(F.col("class_id"))
    return named.join(groups, "root").select("doc_id", "class_id", "class_size", kept.alias("kept"), "key", "root")


def deduplicate(docs: DataFrame, **options: object) -> DataFrame:
    """The rows of ``docs``, all columns, one for each class.

    Several rows may bear the least id of a class; then the one with the least text key stays.
    """
    found = write_out(near_classes(docs, **options), "found")
    pairs = write_out(found.groupBy("root", "key", "doc_id").agg(F.count("*").alias("rows"), F.max("kept").alias("least")), "pairs")
    best = write_out(pairs.where("least").groupBy("root").agg(F.min("key").alias("best")), "best")
    stays = F.col("least") & (F.col("key") == F.col("best"))
    return only(docs, pairs.join(best, "root").select("doc_id", "key", "rows", stays.alias("kept")))
