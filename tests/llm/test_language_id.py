from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldmosaic.llm import language_id as L
from fieldmosaic.llm.arrays import text_slices
from fieldmosaic.llm.frames import in_fold, table


def normal(text):
    out = "".join(c.lower() if c.isalpha() else " " for c in text)
    return " ".join(out.split(" ")).split()


def kneser_ney(texts, order, alphabet):
    """Plain dictionaries: interpolated Kneser-Ney with one discount per order."""
    raw = [defaultdict(int) for _ in range(order + 1)]
    for text in texts:
        line = " " * (order - 1) + text
        for i in range(order - 1, len(line)):
            for n in range(1, order + 1):
                raw[n][line[i - n + 1 : i + 1]] += 1
    counts = [None] * (order + 1)
    counts[order] = raw[order]
    for n in range(order - 1, 0, -1):
        counts[n] = defaultdict(int)
        for gram in raw[n + 1]:
            counts[n][gram[1:]] += 1
    discount = [0.0] * (order + 1)
    for n in range(1, order + 1):
        one, two = (sum(1 for v in counts[n].values() if v == k) for k in (1, 2))
        discount[n] = min(max(one / max(one + 2 * two, 1), 0.1), 0.95)

    def chance(gram):
        n = len(gram)
        below = 1 / alphabet if n == 1 else chance(gram[1:])
        mass = sum(v for g, v in counts[n].items() if g[:-1] == gram[:-1])
        if not mass:
            return below
        kinds = sum(1 for g in counts[n] if g[:-1] == gram[:-1])
        return max(counts[n].get(gram, 0) - discount[n], 0) / mass + discount[n] * kinds / mass * below

    return chance


def test_probabilities_equal_plain_dictionaries():
    texts = {"x": ["abab cab", "bca aab"], "y": ["dede add", "ed da"]}
    model = L._counted([t for some in texts.values() for t in some], [0, 0, 1, 1], ["x", "y"])
    alphabet = len({c for some in texts.values() for t in some for c in t}) + 1
    asked = ["abde", "cab", "zzz a", "ed"]
    for piece in text_slices(pa.array(asked, pa.large_string())):
        found = model.score(L.characters(piece), len(asked))
    for k, name in enumerate(("x", "y")):
        chance = kneser_ney(texts[name], L.ORDER, alphabet)
        for i, text in enumerate(asked):
            line = "   " + text
            bits = -sum(math.log2(chance(line[j - 3 : j + 1])) for j in range(3, len(line))) / len(text)
            assert found[i, k] == pytest.approx(bits, rel=1e-5)


def test_characters_are_letters_and_single_spaces():
    text = "Ab, 12 ÇÀ!x"
    piece = next(text_slices(pa.array([text, "", "--"], pa.large_string())))
    found = L.characters(piece)
    assert "".join(map(chr, found.codes[found.scored][found.owner == 0])).split() == ["ab", "çà", "x"]
    assert found.letters.tolist() == [5, 0, 0]


def test_held_out_accuracy_and_rejection(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = L.train(docs, ~in_fold("doc_id", 4, 2), per_language=60)
    found = L.identify(docs, model, in_fold("doc_id", 4, 2)).join(docs.select(F.col("doc_id"), "lang"), "doc_id").where("held_out").toPandas()
    assert (found.lang_pred == found.lang).mean() > 0.97
    assert found.score.between(0, 1).all() and found.accepted.mean() > 0.9
    strange = spark.createDataFrame([(1, "ξψζ ωφθ χχ ζζ"), (2, "qqq xxzzk wwjj")], "doc_id long, text string")
    assert not any(r.accepted for r in L.identify(strange, model, F.lit(False)).collect())


def test_odd_texts(odd_documents, no_documents):
    model = L.fit(["the cat and the dog"] * 6, ["en"] * 6)
    found = L.identify(odd_documents, model, F.lit(False)).collect()
    assert len(found) == 11
    assert {r.lang_pred for r in found if r.doc_id in (2, 3, 5)} == {"und"} and all(r.score == 0 for r in found if r.doc_id in (2, 3, 5))
    assert all(r.lang_pred == "en" for r in found if r.doc_id in (1, 4, 7))
    assert L.identify(no_documents, model, F.lit(False)).collect() == []
    empty = L.train(no_documents, F.lit(True))
    assert {r.lang_pred for r in L.identify(odd_documents, empty, F.lit(False)).collect()} == {"und"}
    assert np.isinf(model.limits).sum() <= 1
