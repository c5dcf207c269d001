"""Near duplicates by SimHash fingerprints, found with pigeonring filtering.

A text's fingerprint has a bit for each place of the 64-bit hashes of its word shingles that is set in over half of them.
Fingerprints link at ``THRESHOLD`` or fewer differing bits.

A fingerprint is a ring of eight segments of eight bits.  If two of them differ in at most four bits, then some segment
of the ring starts chains of 1, 2, ... 8 consecutive segments whose differences stay within their share of
the four, half a bit a segment: 0, 1, 1, 2, 2, 3, 3, 4.

1. Equal fingerprints are one node, so thousands of copies cost one row.
2. The chain from its start is also what the index is made of: the first segment is equal, one of the next two is,
   and two of the next four are.  Each start has five choices of two such segments, so a node
   stands in 40 buckets of 24 bits, and every link's nodes meet in one of them.
3. A bucket links each member to one leader, never member to member: that which meets most others over all
   buckets.  A pair passes the chain of its bucket's start step by step before the whole ring is counted.
4. Buckets whose members are in different components after that are settled exactly.  Up to ``DIRECT`` members,
   those in different components are compared as above, which is at most ``DIRECT`` comparisons a member.  Members of larger ones are
   spread to all fingerprints within two bits: two that differ in at most four bits have one of these in common, and any
   that have one differ in at most four, so each such point links what meets there to its least member.  That is a fixed
   number of rows a member, however large the bucket.

Defined cases: a null text is an empty one; texts without a word have the fingerprint zero, which is linked like any
other.  A text of fewer than four words is one shingle.  Long texts are hashed in pieces of bounded size.  The component id is the
least id of the component (null only if all its ids are).  Every row of the table gives one row, also
where rows repeat.  An empty table gives none.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sketchframe.llm.common import in_bitmap, texts
from sketchframe.llm.components import components
from sketchframe.llm.text import Flat, flat
from sketchframe.session import write_out

SHINGLE, SEED, THRESHOLD = 4, 42, 4
SEGMENT_BITS = 8
SEGMENTS = 64 // SEGMENT_BITS
# Two equal segments behind an equal first one: one of the next two, and both of the next four.
CHOICES = [(a, b) for a in (1, 2) for b in (2, 3, 4) if a < b]
DIRECT = 64
PIECE = 1 << 16  # shingles hashed at once

_bytes = np.arange(256, dtype=np.uint8)
_IS_WORD = ~((_bytes == 32) | ((_bytes >= 9) & (_bytes <= 13)))
_LOWER = np.where((_bytes >= 65) & (_bytes <= 90), _bytes + 32, _bytes).astype(np.uint8)


# --- in a task --------------------------------------------------------------


def _set_bits(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, the highest first."""
    total = np.zeros(64, np.int64)
    for start in range(0, len(h), 255):  # 255 ones fit in a byte
        bits = np.unpackbits(h[start : start + 255].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.uint8)
    return total


def _spaced(piece: Flat) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased words of some texts with one blank between those of a text: bytes, starts, ends, row of each word."""
    starts, ends = piece._edges(_IS_WORD[piece.data].astype(np.uint8))
    row = np.searchsorted(piece.offsets, starts, side="right") - 1
    data, keep = _LOWER[piece.data], _IS_WORD[piece.data]
    inner = ends[:-1][row[1:] == row[:-1]]
    data[inner], keep[inner] = 32, True
    place = np.append(0, np.cumsum(keep))
    return data[keep].tobytes(), place[starts], place[ends], row


def fingerprints_of(piece: Flat, size: int = SHINGLE) -> np.ndarray:
    """The fingerprint of every text, as unsigned 64-bit numbers."""
    data, starts, ends, row = _spaced(piece)
    words = np.bincount(row, minlength=piece.n)
    first = np.cumsum(words) - words
    made = np.zeros(piece.n, np.uint64)
    digest = xxhash.xxh64_intdigest
    for i in np.flatnonzero(words):
        n = max(int(words[i]) - size + 1, 1)
        at, length = int(first[i]), min(size, int(words[i]))
        total = np.zeros(64, np.int64)
        for begin in range(0, n, PIECE):
            some = slice(at + begin, at + min(begin + PIECE, n))
            till = slice(some.start + length - 1, some.stop + length - 1)
            h = [digest(data[s:e], SEED) for s, e in zip(starts[some].tolist(), ends[till].tolist(), strict=True)]
            total += _set_bits(np.array(h, np.uint64))
        made[i] = np.packbits(2 * total > n).view(">u8")[0]
    return made


def _printed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in flat(batch.column("text")):
                made = fingerprints_of(piece, size).view(np.int64)
                ids = batch.column("doc_id")[piece.first : piece.first + piece.n]
                yield pa.RecordBatch.from_arrays([ids, pa.array(made)], ["doc_id", "print"])

    return run


# --- Spark ------------------------------------------------------------------


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, print) of every row; the 64 bits as a signed number."""
    return texts(docs).mapInArrow(_printed(size), "doc_id bigint, print bigint")


def _turned(value: Column, bits: Column) -> Column:
    """A ring of 64 bits turned to the left."""
    left = F.call_function("shiftleft", value, bits)
    right = F.call_function("shiftrightunsigned", value, F.lit(64) - bits)
    return F.when(bits == 0, value).otherwise(left.bitwiseOR(right))


def _segment(ring: Column, k: int) -> Column:
    return F.shiftrightunsigned(ring, 64 - SEGMENT_BITS * (k + 1)).bitwiseAND((1 << SEGMENT_BITS) - 1)


def _buckets(nodes: DataFrame) -> DataFrame:
    """(print, turn, ring, bucket): the buckets of every node; ``ring`` starts with the chain's first segment."""
    turned = nodes.select("print", F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS - 1))).alias("turn"))
    turned = turned.withColumn("ring", _turned(F.col("print"), F.col("turn") * SEGMENT_BITS))

    def number(choice: int, a: int, b: int) -> Column:
        name = F.col("turn").cast("bigint") * len(CHOICES) + choice
        for k in (0, a, b):
            name = F.shiftleft(name, SEGMENT_BITS).bitwiseOR(_segment(F.col("ring"), k))
        return name

    numbers = F.array(*[number(i, a, b) for i, (a, b) in enumerate(CHOICES)])
    return turned.select("print", "ring", F.explode(numbers).alias("bucket"))


def _linked(x: Column, y: Column) -> Column:
    """Whether two rings pass every chain from their first segment, the last of which is the whole ring."""
    differs = x.bitwiseXOR(y)
    passed = None
    for length in range(1, SEGMENTS + 1):
        within = F.bit_count(F.shiftrightunsigned(differs, 64 - SEGMENT_BITS * length)) <= length * THRESHOLD // SEGMENTS
        passed = within if passed is None else passed & within
    return passed


def _points(large: DataFrame) -> DataFrame:
    """(root, point): every ring within two bits of each of ``large(print, root)``, once each."""
    none = 64  # stands for no bit

    def bit(k: str) -> Column:
        return F.when(F.col(k) == none, F.lit(0).cast("bigint")).otherwise(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col(k)))

    one = large.select("print", "root", F.explode(F.sequence(F.lit(1), F.lit(none))).alias("i"))
    last = F.when(F.col("i") == none, F.lit(none)).otherwise(F.col("i") - 1)
    two = one.select("print", "root", "i", F.explode(F.sequence(F.lit(0), last)).alias("j"))
    return two.select("root", F.col("print").bitwiseXOR(bit("i")).bitwiseXOR(bit("j")).alias("point"))


def _links(nodes: DataFrame, direct: int) -> DataFrame:
    """(node, root) of all nodes that are linked to another."""
    sizes = _buckets(nodes).groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    sizes = write_out(sizes, "sizes")
    some = in_bitmap(_buckets(nodes), "bucket", sizes.select(F.col("bucket").alias("id")))
    met = write_out(some.join(sizes, "bucket"), "met")
    degrees = write_out(met.groupBy("print").agg(F.sum("n").alias("degree")), "degrees")
    lead = F.max(F.struct("degree", "print", "ring")).alias("lead")
    leaders = met.join(degrees, "print").groupBy("bucket").agg(lead).select("bucket", F.col("lead.print").alias("lead"), F.col("lead.ring").alias("lead_ring"))
    led = met.join(write_out(leaders, "leaders"), "bucket")
    near = led.where((F.col("print") != F.col("lead")) & _linked(F.col("ring"), F.col("lead_ring")))
    links = write_out(near.select(F.col("print").alias("a"), F.col("lead").alias("b")).distinct(), "star")
    roots = write_out(components(links), "roots")

    placed = met.join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    placed = write_out(placed, "placed")
    open_ = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    apart = write_out(placed.join(write_out(open_.select("bucket"), "open"), "bucket"), "apart")
    x, y = apart.where(F.col("n") <= direct).alias("x"), apart.alias("y")
    met_again = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.root") < F.col("y.root")) & _linked(F.col("x.ring"), F.col("y.ring"))
    pairs = x.join(y, met_again).select(F.col("x.root").alias("a"), F.col("y.root").alias("b"))
    large = apart.where(F.col("n") > direct).select("print", "root").distinct()
    points = _points(large)
    meeting = points.groupBy("point").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    # the least root of a point links every other one that meets there
    least = write_out(meeting.select("point", F.col("low").alias("b")), "points")
    spread = points.join(least, "point").where("root <> b").select(F.col("root").alias("a"), "b")
    more = write_out(pairs.unionByName(spread).distinct(), "more")
    if more.isEmpty():
        return roots
    return write_out(components(links.unionByName(more)), "roots")


def classes(docs: DataFrame, size: int = SHINGLE, direct: int = DIRECT) -> DataFrame:
    """(doc_id, fingerprint, component_id, component_size) of every row of ``docs``.

    ``direct`` is the size of a bucket from which on its members meet at points between them; it does not change the result.
    """
    printed = write_out(fingerprints(docs, size), "prints")
    nodes = write_out(printed.groupBy("print").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")), "nodes")
    roots = _links(nodes.select("print"), direct).withColumnRenamed("node", "print")
    rooted = write_out(nodes.join(roots, "print", "left").withColumn("root", F.coalesce("root", "print")), "rooted")
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("rows").alias("component_size"))
    named = write_out(rooted.join(write_out(groups, "groups"), "root").select("print", "component_id", "component_size"), "named")
    text = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return printed.join(named, "print").select("doc_id", text.alias("fingerprint"), "component_id", "component_size")
