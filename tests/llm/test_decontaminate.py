from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from fieldmosaic.llm import decontaminate as D

ITEMS = "item_id string, text string, key long, size int"


def tokens(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    windows = {}
    for item, text in items:
        words = tokens(text)
        size = min(13, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            windows.setdefault(tuple(words[i : i + size]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        words, hit, found = tokens(text), set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                if mine := windows.get(tuple(words[i : i + size])):
                    hit.update(range(i, i + size))
                    found |= {m for m in mine if m is not None}
        out.append((doc_id, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)))
    return sorted(out, key=repr)


def found(docs, items):
    return sorted((tuple(r)[:6] for r in D.contamination(docs, items).collect()), key=repr)


def test_equals_brute_force(documents, rows):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(5)]
    make = lambda n: " ".join(rng.choice(words, n))
    items = [(str(i), make(int(rng.integers(0, 30)))) for i in range(25)] + [("3", make(20)), (None, make(16)), ("x", None), ("y", " -- ")]
    docs = []
    for i in range(60):
        text = make(int(rng.integers(0, 60)))
        if i % 3:
            item = tokens(items[int(rng.integers(25))][1])
            at = int(rng.integers(max(1, len(item) - 5)))
            text = f"{text} {' '.join(item[at : at + int(rng.integers(8, 25))])}, {make(int(rng.integers(0, 40)))}"
        docs.append((i, text))
    docs += [docs[1], docs[1], (None, docs[2][1]), (99, None), (98, "")]
    table = rows(ITEMS, [(a, b, 1, 1) for a, b in items])
    assert found(documents(docs), table) == brute(docs, items)


def test_every_span_of_a_window_has_a_common_fingerprint():
    rng = np.random.default_rng(2)
    for _ in range(50):
        span = rng.integers(0, 3, D.WINDOW)
        one, two = (np.concatenate([rng.integers(0, 3, rng.integers(20)), span, rng.integers(0, 3, rng.integers(20))]).astype(np.uint64) for _ in range(2))
        keys = [set(D.gram_hashes(x, D.GRAM)[D.winnowed(D.Words(x, np.array([0, len(x)])))].tolist()) for x in (one, two)]
        inner = set(D.gram_hashes(span.astype(np.uint64), D.GRAM).tolist())
        assert keys[0] & keys[1] & inner


def test_odd_tables(odd_documents, no_documents, rows):
    items = rows(ITEMS, [("a", "seven eight nine", 1, 1), (None, None, None, None)])
    docs = [(r.doc_id, r.text) for r in odd_documents.collect()]
    assert found(odd_documents, items) == brute(docs, [("a", "seven eight nine")])
    assert found(no_documents, items) == [] and found(odd_documents, items.limit(0)) == brute(docs, [])
    kept = D.uncontaminated(odd_documents, items)
    assert kept.columns == odd_documents.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([2, 3, 4, 5, 6, 7, 7, None], key=repr)
    assert D.uncontaminated(no_documents, items).where(F.lit(True)).count() == 0
