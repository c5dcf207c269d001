import gzip
import hashlib
import io
import json
import random

import pyarrow.fs
import pytest

from sketchframe.llm import warc
from sketchframe.session import fresh_path

LONG = "<p>é\r\n\r\nWARC/1.1</p>" * 40
PAGES = [
    (5, "http://a/5", LONG), (3, "http://a/3", LONG), (9, None, LONG), (1, "http://a/1", "short"), (2, "http://a/2", "short"), (4, "http://a/4", None),
    (6, "", ""), (7, "http://é/ x\n y", "y" * 99), (8, "u", "y" * 99), (10, "u", "z" * 100), (11, "u", "z" * 100), (12, "big", "q é" * 900_000),
    (3, "http://again/3", LONG), (None, "u", LONG), (None, "u", "w" * 200), (None, "v", "w" * 200),
]


def expected(pages, least=100):
    groups = {}
    for i, _, html in pages:
        groups.setdefault(html or "", []).append(i)
    out = []
    for i, url, html in pages:
        data = (html or "").encode()
        ids = [k for k in groups[html or ""] if k is not None]
        first = min(ids) if ids and len(data) >= least else None
        revisit = first is not None and i != first
        line = " ".join((url or "about:blank").split()) or "about:blank"
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None, line))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id bigint, url string, html string, digest string, n int")


def test_round_trip(spark, pages):
    assert sorted(map(tuple, warc.round_trip(pages).collect()), key=str) == expected(PAGES)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_files(spark, pages):
    """Raw archives are one stream; normalised ones open at every offset of the sidecar."""
    folder = fresh_path(spark, "warc")
    archives = warc.write(pages, folder)
    assert sum(r.records for r in archives.collect()) == len(PAGES)
    system, _ = pyarrow.fs.FileSystem.from_uri(archives.first().path if "://" in archives.first().path else "file://" + archives.first().path)
    index = warc.normalise(archives, folder).collect()
    assert len(index) == len(PAGES)
    by_archive = {}
    for r in index:
        by_archive.setdefault(r.archive, []).append(r)
    for path, rows in by_archive.items():
        read = lambda p: system.open_input_stream(warc._place(p)[1], compression=None).read()
        data = read(path)
        lines = [json.loads(x) for x in gzip.decompress(read(path.replace(".warc.gz", ".idx.gz"))).splitlines()]
        assert [(x["at"], x["length"], x["id"]) for x in lines] == sorted((r.at, r.length, r.id) for r in rows)
        assert sum(x["length"] for x in lines) == len(data)
        for x in lines:
            head, _ = warc.parse(gzip.decompress(data[x["at"] : x["at"] + x["length"]]))
            assert head["warc-record-id"] == x["id"] and head["warc-type"] == x["type"]
    full = warc.read(warc.normalise(archives, folder)).collect()
    assert {bytes(r.payload).decode() for r in full if r.record_type == "response"} == {h or "" for _, _, h in PAGES}
    assert all(r.payload is None for r in full if r.record_type == "revisit")


def test_streams():
    rng = random.Random(1)
    made = [warc.record(i, f"http://x/{i}", f"<p>{i}\r\n\r\n".encode() * rng.randrange(0, 3000), "0" * 64, 5, None, False) for i in range(120)]
    whole = b"".join(made)
    for blob in (gzip.compress(whole), b"".join(map(gzip.compress, made)), gzip.compress(whole[:5000]) + gzip.compress(whole[5000:])):
        assert list(warc.records(io.BytesIO(blob))) == made
    assert list(warc.records(io.BytesIO(b""))) == []
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(gzip.compress(whole[:-9]))))
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(gzip.compress(whole)[:-20])))
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(gzip.compress(b"HTTP/1.1 200 OK\r\n\r\n"))))
