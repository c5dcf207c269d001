"""Byte-level BPE: encoding by a bucket queue over merge ranks, and decoding.

A pre-token is a linked list of parts.  Every adjacent pair that is in the vocabulary lies in the
bucket of its rank.  A bitmap in two levels of 256-bit words marks the buckets in use, so two
find-first-set steps give the lowest rank; its bucket gives the leftmost position.  Entries that
a merge has made stale are skipped when they come up.  A pre-token of n bytes thus takes
O(n log n) steps however long it is, with no scan over its parts.  The bitmap and buckets are empty after
each pre-token and are used again.  Short pre-tokens are remembered in two dictionaries of bounded size, the older of which is dropped
when the newer is full; this changes no result.

Defined cases: a null text is an empty one and has no tokens.  Repeated rows give equal rows; other
columns are not read.  A byte or merged part that the vocabulary lacks raises an error.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sketchframe.llm.common import texts
from sketchframe.llm.text import kept

REMEMBERED, LONGEST = 500_000, 48


class RankQueue:
    """Positions in buckets by rank; a two-level bitmap marks the ranks whose bucket is not empty.

    Two levels of 256 bits hold 65,536 ranks; the upper one grows beyond that.
    """

    def __init__(self, ranks: int):
        self.low = [0] * (-(-max(1, ranks) // 256))
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        self.low[rank >> 8] |= 1 << (rank & 255)
        self.top |= 1 << (rank >> 8)

    def pop(self) -> tuple[int, int] | None:
        """Remove the first entry, by rank, then position; None if there is none."""
        top = self.top
        if not top:
            return None
        word = (top & -top).bit_length() - 1
        bits = self.low[word]
        first = bits & -bits
        rank = (word << 8) + first.bit_length() - 1
        bucket = self.buckets[rank]
        if len(bucket) > 1:
            return rank, heappop(bucket)
        del self.buckets[rank]
        self.low[word] = bits = bits ^ first
        if not bits:
            self.top = top ^ (1 << word)
        return rank, bucket[0]


class Codec:
    """A vocabulary of byte strings by rank, and the pattern that cuts texts into pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.parts = {rank: part for part, rank in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.queue = RankQueue(max(ranks.values(), default=0) + 1)
        self.single = [ranks.get(bytes([b]), -1) for b in range(256)]
        # rank of two parts side by side: of every vocabulary entry, each cut whose halves are entries too
        self.width = max(ranks.values(), default=0) + 1
        self.pairs: dict[int, int] = {}
        for part, rank in ranks.items():
            for cut in range(1, len(part)):
                left, right = ranks.get(part[:cut]), ranks.get(part[cut:])
                if left is not None and right is not None:
                    self.pairs[left * self.width + right] = rank
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        single, width, get = self.single, self.width, self.pairs.get
        part = [single[b] for b in piece]  # id of the part that starts here
        if min(part) < 0:
            raise KeyError(f"byte {piece[part.index(-1)]} is not in the vocabulary")
        n, pair = len(part), [get(a * width + b, -1) for a, b in zip(part, part[1:])]  # noqa: B905  rank of the pair that starts here
        pair.append(-1)
        after, before = list(range(1, n + 1)), list(range(-1, n))
        # the steps of RankQueue.push and pop, in place: they are most of the work
        queue = self.queue
        low, buckets, top = queue.low, queue.buckets, 0
        for i, rank in enumerate(pair):
            if rank >= 0:
                if rank in buckets:
                    buckets[rank].append(i)  # ascending, so a heap
                else:
                    buckets[rank] = [i]
                    low[rank >> 8] |= 1 << (rank & 255)
                    top |= 1 << (rank >> 8)
        while top:
            word = (top & -top).bit_length() - 1
            bits = low[word]
            first = bits & -bits
            rank = (word << 8) + first.bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                low[word] = bits = bits ^ first
                if not bits:
                    top ^= 1 << word
            if pair[i] != rank:
                continue
            gone = after[i]
            after[i] = right = after[gone]
            part[i] = rank
            pair[gone] = fresh = -1
            if right < n:
                before[right] = i
                fresh = get(rank * width + part[right], -1)
            pair[i] = fresh
            moved = ((fresh, i),) if fresh >= 0 else ()
            if i:
                left = before[i]
                fresh = get(part[left] * width + rank, -1)
                if fresh >= 0 and fresh != pair[left]:
                    moved += ((fresh, left),)
                pair[left] = fresh
            for fresh, at in moved:
                if fresh in buckets:
                    heappush(buckets[fresh], at)
                else:
                    buckets[fresh] = [at]
                    low[fresh >> 8] |= 1 << (fresh & 255)
                    top |= 1 << (fresh >> 8)
        ids, i = [], 0
        while i < n:
            ids.append(part[i])
            i = after[i]
        return ids

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        get, out = self.known.get, []
        add = out.append
        for token in self.split(text):
            code = get(token)
            if code is None:
                code = self._remembered(token)
                get = self.known.get
            add(code)
        return np.frombuffer(b"".join(out), "<u4") if out else np.zeros(0, "<u4")

    def _remembered(self, token: str) -> bytes:
        """The packed ids of a token that the newer dictionary lacks."""
        code = self.older.get(token)
        if code is None:
            ids = self.merge(token.encode())
            code = struct.pack(f"<{len(ids)}I", *ids)
        if len(token) <= LONGEST:
            if len(self.known) >= REMEMBERED:
                self.older, self.known = self.known, {}
            self.known[token] = code
        return code

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.parts.__getitem__, ids.tolist()))


def load(path: str, pattern: str) -> Codec:
    """The codec of a rank file: a base64 part and its rank on each line."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(part): int(rank) for part, rank in map(bytes.split, lines)}
    return Codec(ranks, pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids): the ids of every text.  ``path`` is a file that every executor has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = kept((path, pattern), lambda: load(path, pattern))
        for batch in batches:
            column = batch.column("text")
            for start in range(0, len(column), 256):
                made = [codec.encode(text) for text in column[start : start + 256].to_pylist()]
                offsets = pa.array(np.append(0, np.cumsum([len(x) for x in made])).astype(np.int32))
                values = pa.array(np.concatenate(made).astype(np.int64))
                lists = pa.ListArray.from_arrays(offsets, values)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[start : start + 256], lists], ["doc_id", "ids"])

    return texts(docs).mapInArrow(run, "doc_id bigint, ids array<bigint>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, bytes) of (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = kept((path, pattern), lambda: load(path, pattern))
        for batch in batches:
            made = [codec.decode(np.array(ids or [], np.int64)) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, bytes binary")


DIGEST = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256, encoding and decoding in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = kept((path, pattern), lambda: load(path, pattern))
        for batch in batches:
            count, ids_sha, text_sha = [], [], []
            column = batch.column("text")
            for i in range(len(column)):
                ids = codec.encode(column[i].as_py())
                count.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return texts(docs).mapInArrow(run, f"doc_id bigint, {DIGEST}")


def with_tokens(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """All rows and columns of ``docs``, the text as decoded from its ids, then ``n_tokens`` and ``ids``.

    Columns of these names that ``docs`` has already are replaced.
    """
    fields = [f for f in docs.schema.fields if f.name not in ("n_tokens", "ids")]
    names = [f.name for f in fields]
    at = names.index("text")
    schema = T.StructType([*fields, T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = kept((path, pattern), lambda: load(path, pattern))
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                made, decoded = [], []
                for text in batch.column(at):
                    ids = codec.encode(text.as_py() or "")
                    made.append(ids)
                    decoded.append(codec.decode(ids).decode() if text.is_valid else None)
                offsets = pa.array(np.append(0, np.cumsum([len(x) for x in made])).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(made).astype(np.int32)))
                arrays = list(batch.columns)
                arrays[at] = pa.array(decoded, pa.string())
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([len(x) for x in made], pa.int64()), lists], [*names, "n_tokens", "ids"])

    return docs.select(names).mapInArrow(run, schema)


def public_vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[str, str]:
    """Path and pattern of one of the installed public vocabularies."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN

