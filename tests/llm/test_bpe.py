import base64
import hashlib
import random
import tracemalloc
import weakref

import numpy as np
import pyarrow as pa
import pytest
import tiktoken

from sketchframe.llm import bpe
from sketchframe.llm.text import flat, kept, lean

PATH, PATTERN = bpe.public_vocabulary()


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(3)
    plain = ["", " ", "a", "It's 12 o'clock,  isn't it?\n\n\tyes ", "naïve Straße 東京 🙂🙂 İ\x1c\x85 x", "<|endoftext|>"]
    long = ["ab" * 20_000, "".join(rng.choice("abcdeth") for _ in range(30_000)), "é" * 5000, " " * 9000, "7" * 4000]
    mixed = ["".join(rng.choice("abc é'ß1.\n") for _ in range(rng.randrange(200))) for _ in range(200)]
    return plain + long + mixed


def test_same_ids_as_the_reference_and_back(reference):
    codec = bpe.load(PATH, PATTERN)
    for text in texts():
        ids = codec.encode(text)
        assert ids.tolist() == reference.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()
    assert not codec.queue.buckets and not codec.queue.top and not any(codec.queue.low)


def test_every_character_is_cut_as_the_pattern_says(reference):
    codec = bpe.load(PATH, PATTERN)
    for start in range(0, 0x3000, 7):
        text = "".join(f"a{chr(c)} {chr(c)}{chr(c)}1" for c in range(start, start + 7))
        assert codec.encode(text).tolist() == reference.encode_ordinary(text)


def test_queue_is_ordered():
    queue, rng = bpe.RankQueue(300_000), random.Random(1)
    entries = [(rng.randrange(300_000) if rng.random() < 0.5 else rng.randrange(70), rng.randrange(1000)) for _ in range(5000)]
    for entry in entries:
        queue.push(*entry)
    queue.push(299_999, 5)
    entries.append((299_999, 5))
    got = []
    while (entry := queue.pop()) is not None:
        got.append(entry)
    assert got == sorted(entries)


def test_ranks_that_are_not_monotone():
    """A pair that a merge makes may rank before the merge itself."""
    ranks = {bytes([b]): i for i, b in enumerate(b"abcd")} | {b"bc": 9, b"abc": 5, b"cd": 7, b"abcd": 20, b"bcd": 6}
    codec, other = bpe.Codec(ranks, ".+"), tiktoken.Encoding("t", pat_str=".+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 40)))
        assert codec.encode(text).tolist() == other.encode_ordinary(text)


def test_tables(documents, reference):
    rows = [(1, "hello world"), (1, "hello world"), (2, None), (3, ""), (None, "x " * 500)]
    docs = documents(rows)
    got = sorted((tuple(r) for r in bpe.digests(docs, PATH, PATTERN).collect()), key=str)
    want = []
    for i, t in rows:
        ids = np.array(reference.encode_ordinary(t or ""), "<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    again = bpe.decode(bpe.encode(docs, PATH, PATTERN), PATH, PATTERN).collect()
    assert sorted(((r.doc_id, bytes(r.bytes)) for r in again), key=str) == sorted([(i, (t or "").encode()) for i, t in rows], key=str)
    full = bpe.with_tokens(docs, PATH, PATTERN)
    assert full.columns == [*docs.columns, "n_tokens", "ids"]
    assert {(r.doc_id, r.text, r.n_tokens == len(r.ids)) for r in full.collect()} == {(i, t, True) for i, t in rows}
    assert bpe.digests(documents([]), PATH, PATTERN).count() == 0


def test_a_worker_that_goes_on_to_another_operator_drops_the_dictionaries():
    """A worker serves one operator after another; the codec of a task before must not stay beside a later one's arrays."""

    class Held:
        pass

    held = Held()
    seen = weakref.ref(held)
    assert kept("codec", lambda: held) is kept("codec", Held)
    del held
    batch = pa.RecordBatch.from_pydict({"x": [1, 2]})
    assert [b.num_rows for b in lean(lambda batches: batches)(iter([batch]))] == [2]
    assert seen() is None


def test_arrays_of_a_large_batch_stay_small():
    column = pa.array(["some words of a text, again and again. " * 100] * 1000)  # 4 MB
    tracemalloc.start()
    for piece in flat(column):
        piece.words_cut((4, 5, 6))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 30_000_000
