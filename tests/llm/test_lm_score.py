from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldmosaic.llm import lm_score as S


def tokens(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def kind(i, text):
    size = len(text or "")
    return "test" if size % 5 == 2 else "deleted" if size % 5 == 1 else "train"


def fold(number):
    return F.coalesce(F.length("text") % 5, F.lit(0)) == number


def brute(texts, weights):
    """Base score and model score with the learned weights, by plain dictionaries."""
    words, pairs, starts = Counter(), Counter(), 0
    for i, text in enumerate(texts):
        if kind(i, text) != "test":
            some = tokens(text)
            starts += 1
            words.update(some)
            pairs.update(zip(["begin", *some], some))
    total, distinct = sum(words.values()), len(words)
    out = []
    for i, text in enumerate(texts):
        some = tokens(text)
        base = sum(math.log10((words[w] + 1) / (total + distinct + 1)) for w in some)
        score, before = 0.0, "begin"
        for w in some:
            seen = starts if before == "begin" else words[before]
            mix = weights[min(int(math.floor(math.log2(max(seen, 0.5)))) + 1, S.LEVELS - 1)]
            score += math.log10(mix[0] * pairs[before, w] / max(seen, 1) + mix[1] * words[w] / total + mix[2] / (distinct + 1))
            before = w
        out.append((kind(i, text) == "test", len(some), sum(words[w] > 0 for w in some), total, base, score))
    return out


@pytest.mark.parametrize("block", [30, S.BLOCK_TOKENS])
def test_scores_equal_plain_counts(documents, monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK_TOKENS", block)
    rng = np.random.default_rng(block)
    texts = [" ".join(rng.choice(["a", "B", "c", "dd", "é", "of", "the"], int(rng.integers(0, 30)))) for _ in range(50)] + [None, "", "new words"]
    learned = []
    plain = S.learn
    monkeypatch.setattr(S, "learn", lambda *a: learned.append(plain(*a)) or learned[-1])
    found = S.score_documents(documents(list(enumerate(texts))), ~fold(2), fold(1), fold(2), buckets=5).collect()
    want = brute(texts, learned[0])
    assert len(found) == len(texts)
    for r in found:
        exact, close = want[r.doc_id][:4], want[r.doc_id][4:]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == exact
        assert (r.base_score, r.score) == pytest.approx(close)


def test_weights_are_learned_from_held_out_counts():
    table = np.zeros((S.LEVELS, S.CELLS, S.CELLS), np.int64)
    sure, rare = S._cell(np.array([0.5]))[0], S._cell(np.array([1e-4]))[0]
    table[3, sure, rare] = 90  # the bigram predicts well
    table[3, 0, rare] = 10
    table[5, 0, sure] = 50  # only the unigram does
    weights = S.learn(table, 1e-6)
    assert np.allclose(weights.sum(axis=1), 1)
    assert weights[3, 0] > 0.85 and weights[5, 1] > 0.95 and weights[0, 0] == 0
    assert np.array_equal(weights[4], weights[3])

    def likelihood(mix):
        cells = S._in_cell(np.array([sure, rare, 0]))
        return 90 * math.log(mix[0] * cells[0] + mix[1] * cells[1] + mix[2] * 1e-6) + 10 * math.log(mix[1] * cells[1] + mix[2] * 1e-6)

    rng = np.random.default_rng(0)
    assert all(likelihood(weights[3]) > likelihood(other) - 1e-2 for other in rng.dirichlet([1, 1, 1], 300))


def test_cells_keep_probabilities():
    chance = 10.0 ** np.linspace(-7, 0, 50)
    assert np.all(np.abs(np.log10(S._in_cell(S._cell(chance)) / chance)) <= S.STEP / 2 + 1e-9)
    assert S._cell(np.array([0.0]))[0] == 0


def test_a_better_model_than_the_base(spark):
    found = S.op10_lm_score(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert found[0] > 0.92 * found[1]


def test_odd_tables(odd_documents, no_documents):
    never = F.lit(False)
    found = S.score_documents(odd_documents, ~never, never, never, buckets=3).collect()
    assert len(found) == 11 and all(math.isfinite(r.score) and r.score <= 0 for r in found)
    assert all(r.n_tokens == 1 for r in found if r.doc_id in (2, 3, 5))
    assert S.score_documents(no_documents, ~never, never, never).collect() == []
    untrained = S.score_documents(odd_documents, never, never, ~never, buckets=3).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.score == 0 and r.base_score == 0 for r in untrained)
