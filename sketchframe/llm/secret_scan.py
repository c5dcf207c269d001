"""Secrets, told from copied examples by how many repositories and owners share them.

Detection reads a text once and gives spans: assignments, access keys and long hexadecimal
runs (the base), and elsewhere tokens that mix cases and digits with high entropy (``mixed``).  The hash of each candidate's
value is then counted over the whole corpus by distinct repositories and distinct owners.  A value that
``copied`` or more owners, or ``widely`` or more repositories have is a widely copied example; one that a single
owner has in fewer repositories looks live.  Base spans always stay; a mixed token is reported unless its value is a
copied one, since identifiers that so many share are no secrets.  By default a document counts as a repository and its source as the owner.

Counting takes distinct (hash, repository) and (hash, owner) pairs first, so that a value that a third of
all rows hold pre-aggregates in every task.  Values are stored and moved as hashes only.

Defined cases: a null text is an empty one.  A null repository or owner counts as one more of its kind.  Rows that
repeat are reported once each.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchframe.session import write_out

# The base patterns, which count only the letters of the assignment's name in either case.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of [0-9a-f]+ that have 24 or more
KINDS = ("assign", "access", "hex", "mixed")
MIXED = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
LEAST_BITS = 3.5
_NAMES = re.compile(r"pass|secret|token|api_?key", re.ASCII | re.IGNORECASE)


def entropy(value: str) -> float:
    """Bits per character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of every span, in order of start, then kind."""
    found = []
    if _NAMES.search(text):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    base = list(found)
    for m in MIXED.finditer(text):
        value = m[0]
        kinds = any(c.isdigit() for c in value) + any(c.islower() for c in value) + any(c.isupper() for c in value)
        if kinds == 3 and entropy(value) >= LEAST_BITS and all(m.end() <= s or e <= m.start() for s, _, e, _ in base):
            found.append((m.start(), 3, m.end(), value))
    return sorted(found)


def joined(spans: list[tuple[int, int, int, str]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end, _ in spans)


def _detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32()), ("hash", pa.string())])
    for batch in batches:
        counts, digests, spans = ([], [], []), [], []
        for text in batch.column("text"):
            found = candidates(text.as_py() or "")
            base = [x for x in found if x[1] < 3]
            for kind in range(3):
                counts[kind].append(sum(x[1] == kind for x in base))
            digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
            spans.append([{"start": s, "kind": k, "stop": e, "hash": hashlib.md5(v.encode()).hexdigest()} for s, k, e, v in found])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("repository"), batch.column("owner"), *(pa.array(c, pa.int64()) for c in counts),
             pa.array(digests, pa.string()), pa.array(spans, pa.list_(span))],
            ["doc_id", "repository", "owner", "n_assign", "n_access", "n_hex", "base_sha256", "found"],
        )


def ownership(found: DataFrame) -> DataFrame:
    """(hash, repositories, owners) of every candidate value in (hash, repository, owner)."""
    missing = F.lit("\u0000")
    repositories = found.select("hash", F.coalesce("repository", missing).alias("r")).distinct().groupBy("hash").agg(F.count("*").alias("repositories"))
    owners = found.select("hash", F.coalesce("owner", missing).alias("o")).distinct().groupBy("hash").agg(F.count("*").alias("owners"))
    return repositories.join(owners, "hash")


def scan(docs: DataFrame, repository: str = "doc_id", owner: str = "source", copied: int = 3, widely: int = 10) -> DataFrame:
    """Per row: doc_id, counts by base kind, base_sha256, spans, n_mixed, n_live, n_copied, and the ``findings``.

    A finding has start, stop, kind, repositories, owners and verdict: ``copied`` from
    ``copied`` owners or ``widely`` repositories on, else ``live`` for one owner, ``shared`` for more.
    """
    base = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("text"),
        F.col(repository).cast("string").alias("repository"),
        F.col(owner).cast("string").alias("owner"),
    )
    schema = (
        "doc_id bigint, repository string, owner string, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, "
        "found array<struct<start:int,kind:int,stop:int,hash:string>>"
    )
    rows = write_out(base.mapInArrow(_detect, schema).withColumn("row", F.monotonically_increasing_id()), "candidates")
    each = rows.select("row", "repository", "owner", F.inline("found"))
    known = write_out(ownership(each.select("hash", "repository", "owner")), "ownership")
    verdict = F.when((F.col("owners") >= copied) | (F.col("repositories") >= widely), "copied").when(F.col("owners") <= 1, "live").otherwise("shared")
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    judged = each.join(known, "hash").select("row", "start", "kind", F.struct("start", "stop", kind.alias("kind"), "repositories", "owners", verdict.alias("verdict")).alias("f"))
    judged = judged.where((F.col("kind") < 3) | (F.col("f.verdict") != "copied"))
    # a row's own findings
    listed = judged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "f"))).alias("l"))
    listed = listed.select("row", F.transform("l", lambda x: x["f"]).alias("findings"))
    none = F.array().cast("array<struct<start:int,stop:int,kind:string,repositories:bigint,owners:bigint,verdict:string>>")
    whole = rows.join(listed, "row", "left").withColumn("findings", F.coalesce("findings", none))
    spans = F.concat_ws(",", F.transform("findings", lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["stop"].cast("string"))))

    def count(column: str, value: str):
        return F.size(F.filter("findings", lambda f: f[column] == value)).cast("bigint")

    return whole.select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", spans.alias("spans"), count("kind", "mixed").alias("n_mixed"),
        count("verdict", "live").alias("n_live"), count("verdict", "copied").alias("n_copied"), "findings",
    )
