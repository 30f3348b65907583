from __future__ import annotations

import hashlib
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from fieldmosaic.llm import suffix_dedup as D

from .conftest import LONG


def brute(docs):
    texts = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(t[s : s + D.LEAST] for _, t in texts for s in range(len(t) - D.LEAST + 1))
    out = []
    for i, text in texts:
        gone = np.zeros(len(text) + 1, bool)
        for s in range(len(text) - D.LEAST + 1):
            if seen[text[s : s + D.LEAST]] > 1:
                gone[s : s + D.LEAST] = True
        kept = bytes(b for b, g in zip(text, gone) if not g)
        spans = sum(gone[j] and not (j and gone[j - 1]) for j in range(len(text)))
        out.append((i, len(text), int(gone.sum()), int(spans), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(table, **options):
    return sorted((tuple(r) for r in D.remove_repeats(table, digest=True, **options).collect()), key=repr)


def passages(seed):
    """Random texts with copied passages of about the least length, periodic runs and whole copies."""
    rng = np.random.default_rng(seed)
    make = lambda n: "".join(rng.choice(list("abc é"), n))
    shared = [make(int(rng.integers(150, 320))) for _ in range(4)]
    docs = []
    for i in range(40):
        text = make(int(rng.integers(0, 300)))
        for _ in range(int(rng.integers(0, 3))):
            part = shared[int(rng.integers(4))]
            cut = int(rng.integers(0, 60))
            text += part[cut : len(part) - int(rng.integers(0, 40))] + make(int(rng.integers(0, 150)))
        docs.append((i, text))
    docs += [(100, "xy" * 150), (101, "z" * 199), (102, "z" * 200), (103, "q" * 201), (104, docs[3][1]), (104, docs[3][1]), (None, docs[5][1]), (105, None), (106, "")]
    return docs


@pytest.mark.parametrize("seed, cap", [(1, D.INDEX_CONTEXTS), (2, 3), (3, 0)])
def test_equals_brute_force(documents, seed, cap):
    docs = passages(seed)
    assert found(documents(docs), index_contexts=cap) == brute(docs)


def test_small_blocks_and_stretches(documents, monkeypatch):
    docs = passages(4)
    monkeypatch.setattr(D, "BLOCK_BYTES", 500)
    monkeypatch.setattr(D, "INDEX_SYMBOLS", 200)
    assert found(documents(docs)) == brute(docs)
    data = np.frombuffer("".join(t or "" for _, t in docs).encode(), np.uint8)
    starts = np.cumsum([0, *[len((t or "").encode()) for _, t in docs]])
    whole, parts = D.anchors(data, starts), D.anchors(data, starts, stretch=97)
    for field in ("place", "anchor", "context", "low", "high"):
        np.testing.assert_array_equal(getattr(whole, field), getattr(parts, field))


def test_every_string_has_an_anchor():
    rng = np.random.default_rng(5)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    starts = np.array([0, 700, 700, 750, 3000])
    place = D.anchors(data, starts).place
    for a, b in zip(starts[:-1], starts[1:]):
        for s in range(a, b - D.LEAST + 1):
            assert np.any((place >= s) & (place <= s + D.SIDE))


def test_run_index_is_a_run_compressed_transform():
    rng = np.random.default_rng(6)
    for _ in range(30):
        texts = [rng.integers(0, 2, int(rng.integers(1, 12))) for _ in range(4)]
        symbols = np.concatenate([np.append(t, 100 + i) for i, t in enumerate(texts)])
        starts = np.cumsum([0, *[len(t) + 1 for t in texts]])[:-1]
        index = D.run_index(symbols, starts, 12)
        order = sorted(range(len(symbols)), key=lambda i: symbols[i:].tolist())
        runs, previous = [], None
        for i in order:
            before = ("start", i) if i in starts else int(symbols[i - 1])
            if before != previous:
                runs.append([i, i])
            runs[-1][1], previous = i, before
        assert runs == np.stack([index.first, index.last], axis=1).tolist()
        for above, below, shared in index.boundaries():
            for a, b, n in zip(above, below, shared):
                same = 0
                while max(a, b) + same < len(symbols) and symbols[a + same] == symbols[b + same]:
                    same += 1
                assert n == same


def test_odd_tables(odd_documents, no_documents):
    docs = [(r.doc_id, r.text) for r in odd_documents.collect() if r.doc_id != 4]
    assert found(odd_documents.where("doc_id IS NULL OR doc_id <> 4")) == brute(docs)
    assert next(r for r in found(odd_documents) if r[0] == 4)[2:4] == (len(LONG), 1)
    assert found(no_documents) == []
    assert {r.kept for r in D.remove_repeats(odd_documents.where("doc_id IN (2, 3, 7)")).collect()} == {b"", b"a"}


def test_a_task_judges_one_bucket(documents):
    blocks = D._blocks(documents(passages(7) * 3).repartition(3))
    told = D._repeats(blocks, 16).select("block", "bucket", F.spark_partition_id().alias("task")).collect()
    assert {r.bucket for r in told} == set(range(16)) and len({r.block for r in told}) == 3
    assert len({(r.task, r.bucket) for r in told}) == len({r.task for r in told}) == 16


def test_buckets_of_hashes_are_even():
    data = np.random.default_rng(10).integers(97, 123, 1 << 20).astype(np.uint8)
    found = D.anchors(data, np.array([0, len(data)]))
    for hashes in (found.anchor, found.context):
        sizes = np.diff(D._cuts(np.unique(hashes), 64))
        assert sizes.max() < 2 * sizes.mean()


def test_judged_by_ranges(monkeypatch):
    rng = np.random.default_rng(8)
    lists = [np.unique(rng.integers(0, 300, n).astype(np.uint64) << np.uint64(55)) for n in (200, 0, 400, 5)]
    many = [rng.random(len(x)) < 0.2 for x in lists]
    times = Counter()
    for x, m in zip(lists, many):
        times.update(dict(zip(x.tolist(), (1 + m).tolist())))
    seen, expected = set(), []
    for x in lists:
        expected.append([(times[v] > 1, v not in seen) for v in x.tolist()])
        seen.update(x.tolist())
    for most in (1, 7, 1 << 18):
        monkeypatch.setattr(D, "JUDGED", most)
        assert [list(zip(a.tolist(), f.tolist())) for a, f in zip(*D._judged(lists, many))] == expected
    assert [len(x) for side in D._judged([lists[1]], [many[1]]) for x in side] == [0, 0]


def test_memory_of_tasks_stays_near_their_data():
    """Temporary arrays of a few bytes for each byte of a block, and for each hash of a bucket."""

    def peak(work):
        tracemalloc.start()
        try:
            work()
            return tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    data = np.random.default_rng(9).integers(97, 123, 6 << 20).astype(np.uint8)
    starts = np.arange(0, len(data) + 1, 4096)
    begin = np.arange(0, len(data) - 4000, 5000)
    rows = pa.RecordBatch.from_pylist([{
        "block": 1, "doc_ids": list(range(len(starts) - 1)), "starts": starts.tobytes(), "text": zstandard.compress(data.tobytes()),
        "whole": [np.stack([begin, begin + 300], axis=1).tobytes()], "found": [{"begin": int(b) + 1000, "end": int(b) + 1200} for b in begin],
    }])
    assert peak(lambda: D._kept(rows, 0)) < 6 * len(data)
    lists = [np.unique(np.random.default_rng(i).integers(0, 1 << 63, 1 << 16).astype(np.uint64)) for i in range(32)]
    many = [np.zeros(len(x), bool) for x in lists]
    assert peak(lambda: D._judged(lists, many)) < 16 * sum(map(len, lists))
