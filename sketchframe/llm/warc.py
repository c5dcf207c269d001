"""WARC archives: writing, normalising of whole-file gzip streams, and reading back by an offset index.

``write`` lays pages out as WARC records, each task one archive that is a single gzip stream from end to end, as
naive tools write them; such a file cannot be entered in the middle.  ``normalise`` inflates each stream once, in
pieces, cuts it into records by their lengths, writes every record as a gzip member of its own and
beside each archive a sidecar index (``.idx.gz``, one JSON object a line with offset, length, type and id).  ``read`` opens members by
the index alone.

Files are named by attempt and reach the result only through the table of the task that ended well, so a lost
executor leaves at most an unused file.  Archives go to a folder that all executors share; local paths, HDFS
and object stores are opened by their URI.  No step holds more than one record and a piece of a stream.

Of records with equal payloads of at least ``least`` bytes, the one with the smallest id is a response and the others
are revisits that refer to it; these carry its digest and length but no payload.  Hashes are grouped with partial sums,
and pages meet their group in a join that adaptive execution may split.

Defined cases: a null html is an empty payload; a null url is recorded as ``about:blank``.  Rows that repeat the smallest id of
a group are all responses.  A null id loses to any other and, where a group has no other, is a response.  Other columns are not
read.  An archive that ends within a record raises an error.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchframe.session import fresh_path, write_out

HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "2000-01-01T00:00:00Z"
PIECE = 1 << 20
_ID = "urn:page:"


# --- records ----------------------------------------------------------------


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, length: int, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record with the two line ends that close it."""
    block = HTTP if revisit else HTTP + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_one_line(url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {length}",
        "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _one_line(url: str | None) -> str:
    return " ".join((url or "about:blank").split()) or "about:blank"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, block) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


def _inflated(source: BinaryIO) -> Iterator[bytes]:
    """The content of a gzip file, whether one member or many, in pieces of bounded size."""
    inflate, ended, any_ = zlib.decompressobj(31), False, False
    while data := source.read(PIECE):
        while data:
            if ended:
                inflate, ended = zlib.decompressobj(31), False
            any_ = True
            yield inflate.decompress(data, PIECE)
            data = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
            ended = inflate.eof
    while any_ and not ended and (more := inflate.decompress(b"", PIECE)):
        yield more
        ended = inflate.eof
    if any_ and not (ended or inflate.eof):
        raise ValueError("the gzip stream ends early")


def records(source: BinaryIO) -> Iterator[bytes]:
    """Whole records of an inflated stream, in order."""
    held, need = bytearray(), None
    for piece in _inflated(source):
        held += piece
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                head = bytes(held[:end]).decode("utf-8")
                sizes = [line.partition(":")[2] for line in head.split("\r\n") if line.lower().startswith("content-length:")]
                if not head.startswith("WARC/") or len(sizes) != 1:
                    raise ValueError(f"not a WARC record: {head[:40]!r}")
                need = end + 4 + int(sizes[0]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held:
        raise ValueError("the archive ends within a record")


# --- files ------------------------------------------------------------------


def _place(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace(":/", ":///", 1))


def _open_to_write(path: str) -> BinaryIO:
    system, inner = _place(path)
    system.create_dir(inner.rpartition("/")[0], recursive=True)
    return system.open_output_stream(inner, compression=None)


def marked(pages: DataFrame, least: int = 100) -> DataFrame:
    """page_id, url, payload, digest, bytes, refers_to (null for a response) of every page."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    base = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    base = base.withColumn("digest", F.sha2("payload", 256)).withColumn("bytes", F.octet_length("payload").cast("bigint"))
    groups = base.where(F.col("bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    groups = write_out(groups.where("n > 1 and first is not null").select("digest", "first"), "payloads")
    own = F.col("page_id").eqNullSafe(F.col("first"))
    return base.join(groups, "digest", "left").withColumn("refers_to", F.when(~own, F.col("first"))).drop("first")


def write(pages: DataFrame, folder: str, least: int = 100) -> DataFrame:
    """One archive per task, each a single gzip stream below ``folder``; (path, records) of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, n, out = f"{folder}/raw/{uuid.uuid4().hex}.warc.gz", 0, None
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    raw = _open_to_write(path)
                    out = gzip.GzipFile(filename="", mode="wb", fileobj=raw, compresslevel=6, mtime=0)
                refers = row["refers_to"]
                out.write(record(row["page_id"], row["url"], row["payload"], row["digest"], row["bytes"], refers, refers is not None))
                n += 1
        if out is not None:
            out.close()
            raw.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["path", "records"])

    columns = marked(pages, least).select("page_id", "url", "payload", "digest", "bytes", "refers_to")
    return write_out(columns.mapInArrow(run, "path string, records bigint"), "archives")


INDEX = "archive string, at bigint, length bigint, type string, id string, uri string, digest string"


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite each archive of ``archives(path)`` with one member a record; the index of all as a table.

    Beside ``folder/<name>.warc.gz`` stands its sidecar ``folder/<name>.idx.gz``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, inner = _place(path)
                target, at = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                sidecar_path = target.removesuffix(".warc.gz") + ".idx.gz"
                rows: list[dict] = []
                with system.open_input_stream(inner, compression=None) as source, _open_to_write(target) as out, _open_to_write(sidecar_path) as side:
                    sidecar = gzip.GzipFile(filename="", mode="wb", fileobj=side, compresslevel=6, mtime=0)
                    for data in records(source):
                        member = gzip.compress(data, 6, mtime=0)
                        head, _ = parse(data)
                        line = {
                            "at": at, "length": len(member), "type": head["warc-type"], "id": head["warc-record-id"],
                            "uri": head.get("warc-target-uri"), "digest": head.get("warc-payload-digest"),
                        }
                        sidecar.write(json.dumps(line, ensure_ascii=False).encode() + b"\n")
                        out.write(member)
                        at += len(member)
                        rows.append(line | {"archive": target})
                        if len(rows) == 1000:
                            yield _index_batch(rows)
                            rows = []
                    sidecar.close()
                if rows:
                    yield _index_batch(rows)

    spread = archives.select("path").repartition(archives.sparkSession.sparkContext.defaultParallelism * 4, "path")
    return write_out(spread.mapInArrow(run, INDEX), "index")


def _index_batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = [("archive", pa.string()), ("at", pa.int64()), ("length", pa.int64()), *((k, pa.string()) for k in ("type", "id", "uri", "digest"))]
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))


READ = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, payload binary"


def read(index: DataFrame, payloads: bool = True) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url and payload (null for revisits) of every indexed record.

    The digest and length of a response are computed from what was read and must agree with its header.
    """

    def number(text: str | None) -> int | None:
        tail = (text or "").strip("<>").removeprefix(_ID)
        return int(tail) if tail else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for batch in batches:
            rows = []
            for entry in batch.to_pylist():
                if entry["archive"] != name:
                    name = entry["archive"]
                    system, inner = _place(name)
                    source = system.open_input_file(inner)
                head, block = parse(gzip.decompress(source.read_at(entry["length"], entry["at"])))
                digest, size = head["warc-payload-digest"].removeprefix("sha256:"), int(head["x-payload-length"])
                payload = None
                if head["warc-type"] == "response":
                    payload = block.partition(b"\r\n\r\n")[2]
                    if hashlib.sha256(payload).hexdigest() != digest or len(payload) != size:
                        raise ValueError(f"the payload of {head['warc-record-id']} is damaged")
                rows.append(
                    {"page_id": number(head["warc-record-id"]), "payload_bytes": size, "payload_digest": digest, "record_type": head["warc-type"],
                     "refers_to": number(head.get("warc-refers-to")), "url": head["warc-target-uri"], "payload": payload if payloads else None}
                )
                if len(rows) == 200:
                    yield _read_batch(rows)
                    rows = []
            if rows:
                yield _read_batch(rows)

    return index.select("archive", "at", "length").mapInArrow(run, READ)


def _read_batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = [
        ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
        ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary()),
    ]
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))


def round_trip(pages: DataFrame, least: int = 100) -> DataFrame:
    """Write, normalise and read back in the shared folder; one row a page."""
    folder = fresh_path(pages.sparkSession, "warc")
    return read(normalise(write(pages, folder, least), folder), payloads=False).drop("payload")
