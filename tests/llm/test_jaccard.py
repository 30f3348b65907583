from __future__ import annotations

import numpy as np
import pytest

from fieldmosaic.llm import jaccard as J
from fieldmosaic.llm.arrays import SPACED, text_slices, words
from fieldmosaic.llm.components import components
import pyarrow as pa


def shingles(text, size):
    found = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
    return {tuple(found[i : i + size]) for i in range(len(found) - size + 1)} if len(found) >= size else {tuple(found)} if found else set()


def brute(docs, size, percent):
    sets = [shingles(t, size) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, one in enumerate(sets):
        for j in range(i):
            both = len(one & sets[j])
            if one and sets[j] and 100 * both >= percent * (len(one) + len(sets[j]) - both):
                root[find(i)] = find(j)
    low = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            low[find(i)] = min(low.get(find(i), doc_id), doc_id)
    return sorted(((doc_id, len(sets[i]), low.get(find(i))) for i, (doc_id, _) in enumerate(docs)), key=repr)


def found(table, size, percent):
    return sorted((tuple(r) for r in J.similar_documents(table, size, percent).collect()), key=repr)


def copies(seed, groups, each, edits):
    rng = np.random.default_rng(seed)
    docs = []
    for g in range(groups):
        base = [f"w{rng.integers(400)}" for _ in range(int(rng.integers(5, 150)))]
        for _ in range(each):
            text = list(base)
            for _ in range(int(rng.integers(0, edits))):
                at = int(rng.integers(len(text)))
                text[at : at + int(rng.integers(0, 2))] = [f"w{rng.integers(400)}"]
            docs.append((len(docs), " ".join(text)))
    order = rng.permutation(len(docs)).tolist()
    return [(i, docs[k][1]) for i, k in enumerate(order)]


@pytest.mark.parametrize("seed, groups, each, edits, size, percent", [(1, 12, 8, 6, 4, 85), (2, 2, 60, 12, 5, 80), (3, 30, 3, 3, 2, 60)])
def test_components_equal_brute_force(documents, seed, groups, each, edits, size, percent):
    docs = copies(seed, groups, each, edits)
    assert found(documents(docs), size, percent) == brute(docs, size, percent)


def test_frequent_shingles_and_longer_prefixes(documents, monkeypatch):
    docs = copies(5, 4, 25, 8)
    monkeypatch.setattr(J, "_levels", lambda profile, bits, shingles: np.random.default_rng(0).integers(0, 9, 1 << bits).astype(np.uint8))
    assert found(documents(docs), 4, 85) == brute(docs, 4, 85)


def test_small_buffers_keep_frequent_tokens(documents, monkeypatch):
    docs = copies(6, 3, 30, 8)
    monkeypatch.setattr(J, "COMPACT", 50)
    assert found(documents(docs), 4, 85) == brute(docs, 4, 85)


def test_prefix_lemma():
    rng = np.random.default_rng(7)
    levels = rng.integers(0, 5, 1 << 18).astype(np.uint8)
    for _ in range(300):
        base = rng.integers(0, 1 << 63, int(rng.integers(1, 60))).astype(np.uint64)
        one = np.unique(base)
        two = np.unique(np.concatenate([base[rng.random(len(base)) > 0.1], rng.integers(0, 1 << 63, int(rng.integers(0, 6))).astype(np.uint64)]))
        both = len(np.intersect1d(one, two))
        if len(two) and 100 * both >= 85 * (len(one) + len(two) - both):
            (p, l), (q, m) = (J.prefix(x, levels, 85) for x in (one, two))
            rest = max(J.needed(len(one), 85) - l, J.needed(len(two), 85) - m)
            need = max(min(l, m), -(-85 * (len(one) + len(two)) // 185) - rest)
            assert len(np.intersect1d(p, q)) >= need


def test_words_split_at_white_space_only():
    text = "A b  c\x0bd\x1fe\tÉ"
    piece = next(text_slices(pa.array([text, ""], pa.large_string())))
    assert np.diff(words(piece, SPACED).starts).tolist() == [len(text.encode().split()), 0]


def test_odd_documents(odd_documents, no_documents):
    docs = [(r.doc_id, r.text) for r in odd_documents.collect()]
    assert found(odd_documents, 5, 80) == brute(docs, 5, 80)
    assert found(no_documents, 5, 80) == []
    kept = J.keep_one(odd_documents, 5, 80)
    assert kept.columns == odd_documents.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([1, 2, 3, 4, 5, 6, 7, None], key=repr)
    assert J.keep_one(no_documents).count() == 0


def test_components_of_chains_and_stars(rows):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(300, 200), (200, 250), (7, 7), (None, 3)]
    low = {r.node: r.component for r in components(rows("a long, b long", links)).collect()}
    assert all(low[i] == 0 for i in range(41)) and all(low[100 + i] == 100 for i in range(30)) and low[250] == low[300] == 200
    assert components(rows("a long, b long", [])).count() == 0
