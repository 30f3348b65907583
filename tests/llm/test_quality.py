from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from fieldmosaic.llm import quality as Q
from fieldmosaic.llm.arrays import text_slices
from fieldmosaic.llm.frames import in_fold, table


def plain_score(net, text):
    """The network written out for one text."""
    data = text.encode()
    blocks = max(1, -(-len(data) // Q.BLOCK))
    data = data + bytes(blocks * Q.BLOCK - len(data)) + bytes(Q.KERNEL)
    best = np.full((blocks, Q.FILTERS), -np.inf)
    for b in range(blocks):
        for at in range(b * Q.BLOCK, (b + 1) * Q.BLOCK, Q.STRIDE):
            window = net.embedding[list(data[at : at + Q.KERNEL])].reshape(-1)
            best[b] = np.maximum(best[b], window @ net.filters + net.bias)
    chunks = np.array([np.maximum(np.maximum(best[b], best[min(b + 1, blocks - 1)]), 0) for b in range(blocks)])
    features = np.concatenate([chunks.mean(0), chunks.max(0), chunks.min(0), [np.log1p(len(text.encode())) / 4]])
    return 1 / (1 + np.exp(-(features @ net.combine + net.offset[0])))


def test_scores_equal_the_plain_network(monkeypatch):
    net = Q.Network.fresh(3)
    texts = ["", "short", "é" * 300, "word and word " * 90, "x" * Q.BLOCK, "y" * (2 * Q.BLOCK + 1)]
    want = [plain_score(net, t) for t in texts]
    for size in (Q.SLICE, 2 * Q.BLOCK):
        monkeypatch.setattr(Q, "SLICE", size)
        found = np.concatenate([Q.scores(net, p) for p in text_slices(pa.array(texts, pa.large_string()))])
        np.testing.assert_allclose(found, want, rtol=1e-4)


def test_gradients_equal_differences():
    net = Q.Network.fresh(5)
    for name in ("embedding", "filters", "bias", "combine", "offset"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    piece = next(text_slices(pa.array(["some words here " * 40, "AB!! " * 30], pa.large_string())))
    target, weight = np.array([1.0, 0.0]), np.array([1.0, 2.0])
    _, slopes = Q._gradients(net, piece, target, weight)
    rng = np.random.default_rng(0)
    for part, slope in zip(net.parts(), slopes):
        for _ in range(6):
            at = tuple(int(rng.integers(n)) for n in part.shape)
            old, change = part[at], 1e-5
            part[at] = old + change
            up = Q._gradients(net, piece, target, weight)[0]
            part[at] = old - change
            down = Q._gradients(net, piece, target, weight)[0]
            part[at] = old
            assert abs((up - down) / (2 * change) - slope[at]) < 1e-4


def test_held_out_accuracy(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    held_out = in_fold("doc_id", 4, 2)
    net = Q.train(docs, labels, ~held_out, per_class=500)
    found = Q.classify(docs, net, held_out).where("held_out").join(labels, "doc_id").where("quality IS NOT NULL").toPandas()
    assert found[found.quality == 1].predicted.mean() > 0.97
    assert found[found.quality == 0].predicted.mean() < 0.1


def test_odd_texts(odd_documents, no_documents, rows):
    labels = rows("doc_id long, quality int", [(1, 1), (4, 0), (None, 1), (7, None), (7, 1)])
    net = Q.train(odd_documents, labels, F.lit(True))
    found = Q.classify(odd_documents, net, F.lit(True)).collect()
    assert len(found) == 11 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found)
    assert len({r.score for r in found if r.doc_id in (2, 3)}) == 1
    kept = Q.accepted(odd_documents, net, 0.0)
    assert kept.columns == odd_documents.columns and kept.count() == 11
    assert Q.accepted(odd_documents, net, 1.1).count() == 0
    assert Q.classify(no_documents, Q.train(no_documents, labels.limit(0), F.lit(True)), F.lit(True)).collect() == []


def test_sample_sees_no_label_it_may_not_learn(documents, rows):
    docs = documents([(i, f"text {i}") for i in range(40)])
    usable = F.col("doc_id") % 8 == 0

    def found(other):
        labels = [(i, int(i % 16 == 0) if i % 8 == 0 else other) for i in range(40)] + [(i, other) for i in range(100, 140)]
        picked, share = Q.sample(docs, rows("doc_id long, quality int", labels), usable, 2, 1 << 15)
        return sorted(tuple(r) for r in picked), share

    assert found(0) == found(1)
    assert len(found(1)[0]) == 4 and found(1)[1] == 0.6
