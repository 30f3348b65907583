from __future__ import annotations

import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fieldmosaic.llm import packing as P
from fieldmosaic.llm.frames import table

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain_ids(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, P.END]


def check(docs, pieces, length):
    """Every id in one piece, sequences gapless and never longer than allowed."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    want = defaultdict(list)
    for doc_id, text in docs:
        want[doc_id].append(plain_ids(text))
    assert set(by_doc) == set(want)
    for doc_id, some in by_doc.items():
        if len({tuple(ids) for ids in want[doc_id]}) > 1:
            continue  # texts that share an id cannot be told apart here
        ids = want[doc_id][0]
        spans = sorted((r.start, r.start + r.length) for r in some)
        copies = len(want[doc_id])
        covered = np.zeros(len(ids), int)
        for a, b in spans:
            covered[a:b] += 1
        assert (covered == copies).all()
        for r in some:
            assert r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for some in by_sequence.values():
        at = 0
        for r in sorted(some, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= length
    return sum(length - sum(r.length for r in some) for some in by_sequence.values()) / max(1, length * len(by_sequence))


def test_pieces_of_given_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert check(rows, P.pack(docs, PATH).collect(), P.LENGTH) < 0.02


def test_stretches_carry_over(spark, monkeypatch):
    docs = table(spark, "/root/testdata/sf0.001", "documents").limit(40)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    pieces = []
    packer = P.Packer(0, 128)
    for doc_id, text in rows:
        packer.add(doc_id, P.token_ids(text, PATH), P.encoder(PATH)[1])
        if packer.held > 700 and (out := packer.settle(False)) is not None:
            pieces.append(out)
    pieces.append(packer.settle(True))
    found = [type("Piece", (), dict(zip(b.schema.names, values))) for b in pieces for values in zip(*(c.to_pylist() for c in b.columns))]
    check(rows, found, 128)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 6), st.sampled_from([0, 2, 10])), min_size=1, max_size=9))
def test_cuts_cost_least(parts):
    length = 8
    places = np.cumsum([p for p, _ in parts])
    penalties = np.array([p for _, p in parts])
    penalties[-1] = 0
    ends = P.best_cuts(places, penalties, length, True)

    def cost(chosen):
        total, before = 0, 0
        for end in chosen:
            if end - before > length:
                return None
            total += length - (end - before) + int(penalties[np.searchsorted(places, end)])
            before = end
        return total

    options = [[p for p, use in zip(places.tolist(), mask) if use] + [int(places[-1])] for mask in product([0, 1], repeat=len(places) - 1)]
    assert cost(ends) == min(c for c in map(cost, options) if c is not None)


def test_candidates_end_with_the_document():
    ends = np.zeros(10, bool)
    ends[3] = True
    cuts, penalty = P.candidate_cuts(np.array([1, 3, 5, *[2] * (P.GRID + 3), 1], np.uint32), ends)
    assert cuts.tolist() == [2, 2 + P.GRID, P.GRID + 7] and penalty.tolist() == [P.SENTENCE_PENALTY, P.GRID_PENALTY, 0]


def test_odd_texts(odd_documents, no_documents):
    check([(r.doc_id, r.text) for r in odd_documents.collect()], P.pack(odd_documents, PATH).collect(), P.LENGTH)
    assert P.pack(no_documents, PATH).collect() == []


def test_added_tokens_are_one_id(documents):
    mark = "<|endoftext|>"
    texts = [
        mark, f"{mark}begins. And goes on", f"a{mark}b", f"ends\n{mark}", f"white space \n {mark}  around\t{mark} it", mark * 3,
        f"<{mark}>", "<|endoftext|", "|endoftext|>", "<|ENDOFTEXT|>", f"<|endof{mark}text|>", f"'ll{mark}'ll", f"漢{mark}\U0001f600", "plain",
    ]
    for text in texts:
        assert P.token_ids(text, PATH).tolist() == plain_ids(text)
    docs = list(enumerate(texts))
    check(docs, P.pack(documents(docs), PATH).collect(), P.LENGTH)
