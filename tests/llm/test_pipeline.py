from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as C
from fieldmosaic.llm import pii, quality
from fieldmosaic.llm.arrays import text_slices
from fieldmosaic.llm.frames import KeyFilter, in_fold, table, unused, written

from .test_decontaminate import brute as contaminated
from .test_jaccard import brute as grouped
from .test_packing import check

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The rows before and after every stage."""
    out = [table(spark, SF, "documents")]
    for _, stage in C.STAGES:
        out.append(written(stage(spark, out[-1], SF), "test-stage"))
    return out


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_quality_keeps_what_scores(spark, stages):
    net = quality.train(stages[0], table(spark, SF, "labels"), ~in_fold("doc_id", 4, 2))
    docs = pairs(stages[0])
    score = np.concatenate([quality.scores(net, p) for p in text_slices(pa.array([t for _, t in docs], pa.large_string()))])
    assert sorted(pairs(stages[1])) == sorted(d for d, s in zip(docs, score) if s >= 0.7)


def test_one_of_each_group_stays(stages):
    want = {doc_id for doc_id, _, component in grouped(pairs(stages[1]), 5, 80) if doc_id == component}
    assert sorted(pairs(stages[2])) == sorted(p for p in pairs(stages[1]) if p[0] in want)


def test_contaminated_go(spark, stages):
    items = [(str(r.item_id), r.text) for r in table(spark, SF, "benchmark").collect()]
    bad = {r[0] for r in contaminated(pairs(stages[2]), items) if r[-1]}
    assert bad and sorted(pairs(stages[3])) == sorted(p for p in pairs(stages[2]) if p[0] not in bad)


def test_entities_are_replaced(stages):
    before, after = dict(pairs(stages[3])), {r.doc_id: r for r in stages[4].collect()}
    assert before.keys() == after.keys()
    for doc_id, text in before.items():
        assert len(pii.detect(text)) == len(pii.detect(after[doc_id].text)) and (text == after[doc_id].text) == (not pii.detect(text))
        assert after[doc_id].n_chars == len(after[doc_id].text)


def test_packed(stages):
    assert check(pairs(stages[4]), stages[5].collect(), 2048) < 0.02


def test_run_equals_the_stages(spark, stages):
    key = lambda r: (r.doc_id, r.start)
    ran = sorted(C.run(spark, SF).collect(), key=key)
    assert [(r.doc_id, r.start, r.length, r.ids_crc32) for r in ran] == [(r.doc_id, r.start, r.length, r.ids_crc32) for r in sorted(stages[5].collect(), key=key)]


def test_odd_tables(spark, odd_documents, no_documents):
    for _, stage in C.STAGES[:-1]:
        assert stage(spark, odd_documents, SF).columns == odd_documents.columns
        assert stage(spark, odd_documents, SF).count() <= 11
        assert stage(spark, no_documents, SF).count() == 0
    assert C.packed(spark, no_documents, SF).count() == 0


def test_key_filter_and_names(rows):
    keys = np.random.default_rng(0).integers(-(1 << 62), 1 << 62, 2000)
    held = KeyFilter.of(rows("k long", [(int(k),) for k in keys[:1000]] + [(None,)]))
    assert held.holds(keys[:1000].view(np.uint64)).all() and held.holds(keys[1000:].view(np.uint64)).mean() < 0.01
    assert not KeyFilter.of(rows("k long", [])).holds(keys.view(np.uint64)).any()
    assert unused(rows("`__KEY` long, a int", []), "__key") == "__key_"
