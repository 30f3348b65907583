from __future__ import annotations

import hashlib
import random
from collections import namedtuple

import numpy as np
import pytest

from fieldmosaic.llm import edit_embedding as E
from fieldmosaic.llm.frames import table

Row = namedtuple("Row", "slice halo doc_id text")


def walk(text):
    """The walk of one text, step by step."""
    out, found, events = 0, np.zeros(E.SLOTS, np.uint8), E._events(2 * len(text))
    kinds = [((ord(c) * 2654435761 & 0xFFFFFFFF) >> 8) % 255 + 1 for c in text] + [0]
    for step in range(2 * len(text)):
        block = step - step % E._ROWS
        if step == block:
            moves = np.random.Generator(np.random.Philox(key=E.SEED, counter=block)).integers(0, 2, (E._ROWS, 256), dtype=np.uint8)
        seen = kinds[out]
        for slot, turn in events.get(step, ()):
            found[slot] = (int(found[slot]) * 167 + seen) % 256 if turn else seen
        out += int(moves[step - block][seen]) if seen else 0
    return found


def test_lockstep_equals_single_walks():
    rng = np.random.default_rng(0)
    texts = ["", "a", "\U0001f600", *["".join(rng.choice(list("abcdé漢 "), int(rng.integers(2, 1500)))) for _ in range(12)]]
    np.testing.assert_array_equal(E.embed(texts), [walk(t) for t in texts])


def test_likeness_falls_with_edits():
    rng = np.random.default_rng(1)
    base = ["".join(rng.choice(list("abcdefghij klmno"), 3000)) for _ in range(20)]

    def edited(text, share):
        kept = [c for c in text if rng.random() > share]
        return "".join(c if rng.random() > share else "z" + c for c in kept)

    own = E.embed(base)
    near = [E.likeness(own, E.embed([edited(t, s) for t in base])).mean() for s in (0, 0.001, 0.01, 0.2)]
    assert near[0] == 1 and near == sorted(near, reverse=True) and near[1] > 0.8
    assert E.likeness(own[:-1], own[1:]).mean() < 0.15


def test_query_equals_the_contract(spark):
    folder = "/root/testdata/sf0.001"
    docs = sorted(((r.doc_id, r.text or "") for r in table(spark, folder, "documents").select("doc_id", "text").collect()), reverse=True)
    found = {r.doc_id: r for r in E.op6_edit_embedding(spark, folder).collect()}
    assert len(found) == len(docs)
    prints = E.embed([t for _, t in docs])
    for i, (doc_id, text) in enumerate(docs):
        after = docs[(i + 1) % len(docs)][1]
        changed = E.edited_text(text, after)
        row = found[doc_id]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert row.fingerprint == prints[i].tobytes().hex()
        assert row.near_next == E.likeness(prints[i : i + 1], prints[(i + 1) % len(docs)][None])[0]
        assert row.near_edited == E.likeness(prints[i : i + 1], E.embed([changed]))[0]


def test_next_document_over_slices(documents, no_documents, odd_documents):
    pairs = [(i, f"t{i}") for i in range(40)] + [(7, "a"), (None, "null"), (7, "t7")]
    rows = [Row(r.slice, r.halo, r.doc_id, E.unpacked(r.text)) for r in E.with_next(documents(pairs), slice_bytes=9).collect()]
    own = sorted((r for r in rows if not r.halo), key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.text))
    assert [(r.doc_id, r.text) for r in own] == sorted(pairs, key=lambda p: (p[0] is None, -(p[0] or 0), p[1]))
    assert len({r.slice for r in rows}) > 3
    for part in {r.slice for r in rows}:
        mine = [r for r in own if r.slice == part]
        at = len(own) - 1 - own[::-1].index(mine[-1])
        halo = sorted((r for r in rows if r.halo and r.slice == part), key=lambda r: (-(r.doc_id or 0), r.text))
        assert halo[0].text == own[(at + 1) % len(own)].text
    assert E.with_next(no_documents).collect() == []
    assert sum(not r.halo for r in E.with_next(odd_documents).collect()) == 11


def test_near_documents(documents):
    rng = np.random.default_rng(4)
    base = ["".join(rng.choice(list("abcdefghij klmno"), 2000)) for _ in range(6)]
    pairs = [(10 * i, t) for i, t in enumerate(base)] + [(1, base[0]), (2, base[0]), (11, base[1][:1000] + "x" + base[1][1000:]), (99, None), (98, "")]
    found = {r.doc_id: r.component_id for r in E.near_documents(E.fingerprints(documents(pairs))).collect()}
    assert found[1] == found[2] == found[0] == 0 and found[11] == 10 and found[20] == 20 and found[99] == found[98] == 98


@pytest.mark.parametrize("crowd", [1, 32, 10_000])
def test_near_documents_whose_head_is_a_stranger(rows, crowd):
    """Slots of two values fill every bucket with strangers; likenesses lie on both sides of the limit."""
    rng = np.random.default_rng(9)
    prints = [rng.integers(0, 2, E.SLOTS, dtype=np.uint8) for _ in range(300)]
    for start in range(100):
        for _ in range(2):
            changed = prints[-1 if _ else start].copy()
            changed[rng.choice(E.SLOTS, int(rng.integers(15, 32)), replace=False)] ^= 1
            prints.append(changed)
    whole = np.array(prints)
    picks = np.random.default_rng(E.SEED)
    shared = np.zeros((len(whole), len(whole)), bool)
    for pick in [sorted(picks.choice(E.SLOTS, 4, replace=False).tolist()) for _ in range(32)]:
        shared |= (whole[:, None, pick] == whole[None, :, pick]).all(axis=2)
    linked = shared & ((whole[:, None] == whole[None]).mean(axis=2) >= 0.8)
    expected = np.arange(len(whole))
    while (lower := np.where(linked, expected[None], len(whole)).min(axis=1)).tolist() != expected.tolist():
        expected = lower
    assert 100 < len(set(expected.tolist())) < 400
    table_of_prints = rows("doc_id long, fingerprint string", [(i, p.tobytes().hex()) for i, p in enumerate(prints)])
    found = {r.doc_id: r.component_id for r in E.near_documents(table_of_prints, least=0.8, bands=32, rows=4, crowd=crowd).collect()}
    assert found == dict(enumerate(expected.tolist()))


def test_query_names_near_documents(spark):
    found = E.op6_edit_embedding(spark, "/root/testdata/sf0.001").select("doc_id", "fingerprint", "component_id").collect()
    near = {r.doc_id: r.component_id for r in E.near_documents(spark.createDataFrame(found)).collect()}
    assert {r.doc_id: r.component_id for r in found} == near


def test_query_on_odd_and_empty_tables(spark, odd_documents, no_documents, tmp_path):
    for name, df in (("odd", odd_documents), ("none", no_documents)):
        folder = str(tmp_path / name)
        df.write.parquet(f"{folder}/documents.parquet")
        found = E.op6_edit_embedding(spark, folder).collect()
        assert len(found) == df.count()
        for row in found:
            assert len(row.fingerprint) == 2 * E.SLOTS and 0 <= row.near_next <= 1
        empty = {r.component_id for r in found if not r.n_chars}
        assert empty <= {2} and all(r.component_id == r.doc_id for r in found if r.doc_id in (4, 5, 6))
        assert {r.component_id for r in found if r.n_chars == 48} <= {1}


def edited(text, edits, rng):
    """A text after so many single-character edits at random places."""
    out = list(text)
    for _ in range(edits):
        at, kind = rng.randrange(len(out)), rng.randrange(3)
        if kind == 1:
            out.insert(at, rng.choice("abcdefgh "))
        else:
            out[at : at + 1] = [rng.choice("abcdefgh ")] if kind else []
    return "".join(out)


def distance(one, two, most):
    """Edit distance, or more than ``most``: only a band around the diagonal is filled."""
    before = {j: j for j in range(most + 1)}
    for i, c in enumerate(one, 1):
        here = {}
        for j in range(max(0, i - most), min(len(two), i + most) + 1):
            best = before.get(j, most + 1) + 1
            if j:
                best = min(best, here.get(j - 1, most + 1) + 1, before.get(j - 1, most + 1) + (c != two[j - 1]))
            here[j] = best
        before = here
    return before.get(len(two), most + 1)


def test_recall_against_edit_distance(spark, documents):
    """Of texts within two edits in a thousand characters, at least nine in ten are linked; strangers are not."""
    texts = [r.text for r in table(spark, "/root/testdata/sf0.01", "documents").where("length(text) between 1500 and 6000").orderBy("doc_id").limit(120).collect()]
    rng = random.Random(1)
    near = [edited(t, max(1, round(0.002 * len(t))), rng) for t in texts]
    for one, two in zip(texts[:15], near):
        assert distance(one, two, 14) <= max(1, round(0.002 * len(one)))
    pairs = [(2 * i, t) for i, t in enumerate(texts)] + [(2 * i + 1, t) for i, t in enumerate(near)]
    found = {r.doc_id: r.component_id for r in E.near_documents(E.fingerprints(documents(pairs))).collect()}
    together = sum(found[2 * i] == found[2 * i + 1] for i in range(len(texts)))
    assert together >= 0.9 * len(texts)
    whole = E.embed(texts)
    for i in range(len(texts)):
        for j in range(i):
            if (whole[i] == whole[j]).mean() < 0.2:
                assert found[2 * i] != found[2 * j]


def test_components_joined_by_further_links(spark):
    from fieldmosaic.llm.components import components, joined

    rng = random.Random(3)
    for _ in range(3):
        one, two = ([(rng.randrange(60), rng.randrange(60)) for _ in range(n)] for n in (25, 12))
        schema = "a long, b long"
        parent = list(range(60))

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in one + two:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
        found = {r.node: r.component for r in joined(components(spark.createDataFrame(one, schema)), spark.createDataFrame(two, schema)).collect()}
        assert all(found[x] == root(x) for x in found)
        assert set(found) == {x for a, b in one + two if a != b for x in (a, b)}
