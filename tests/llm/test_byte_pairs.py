from __future__ import annotations

import hashlib
import random
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldmosaic.llm import byte_pairs as B

FILES = ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"]


@lru_cache
def library(path):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=B.read_ranks(path), special_tokens={})


def own(path):
    return B.encoder(path, public_tokenizers.PATTERN)


@pytest.fixture(params=FILES)
def path(request):
    return public_tokenizers.path(request.param)


def test_neighbours_equal_the_definition(path):
    machine = own(path).transducer
    rng = random.Random(1)
    tokens = list(machine.tokens)
    for one, two in [(rng.choice(tokens), rng.choice(tokens[:4000])) for _ in range(3000)] + [(t, t) for t in rng.sample(tokens, 500)]:
        data = machine.tokens[one] + machine.tokens[two]
        assert machine.stay_apart(one, two) == (machine.merged(data) == [machine.tokens[one], machine.tokens[two]])


PARTS = ["a", "b", "aa", " ", "  ", "the", " the", "é", "漢字", "\U0001f600", "\n", "\r\n", "1", "''", "'ll", "'LL", "<|endoftext|>", "\x00", " ", "é"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PARTS), st.text(max_size=5)), max_size=40).map("".join))
def test_ids_equal_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    for name in FILES:
        path = public_tokenizers.path(name)
        ids = own(path).ids(text)
        assert ids.tolist() == library(path).encode_ordinary(text)
        assert b"".join(B.streamed(ids, B.vocabulary(path), 3)) == text.encode()


def test_long_pieces_and_texts(path, monkeypatch):
    rng = random.Random(2)
    texts = ["ab" * 20_000, "x" * 5_000, "".join(rng.choices("aeiourstln", k=4_000)), "word and 12 more, " * 4_000]
    want = [library(path).encode_ordinary(t) for t in texts]
    assert [own(path).ids(t).tolist() for t in texts] == want
    monkeypatch.setattr(B, "_LONG", 10)
    monkeypatch.setattr(B, "BLOCK", 7)
    assert [own(path).ids(t).tolist() for t in texts] == want


def test_states_and_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr(B, "STATES", 50)
    monkeypatch.setattr(B, "PIECES", 20)
    path = public_tokenizers.path(FILES[0])
    fresh = B.Encoder(B.read_ranks(path), public_tokenizers.PATTERN)
    rng = random.Random(4)
    for _ in range(200):
        text = " ".join("".join(rng.choices("etaoin shrdlu", k=9)) for _ in range(5))
        assert fresh.ids(text).tolist() == library(path).encode_ordinary(text)
        assert len(fresh.pieces) <= 20 and len(fresh.transducer.states) < 50 + 5 * 50


def test_small_vocabulary_against_merging():
    """Merges learned nowhere: a few ranks over two letters, all texts up to nine letters."""
    ranks = {bytes([b]): b for b in range(256)}
    for token in (b"ab", b"aa", b"ba", b"aab", b"abab", b"bb", b"aaaa", b"abb"):
        ranks[token] = len(ranks)
    machine = B.Transducer(ranks)
    for size in range(1, 10):
        for number in range(1 << size):
            data = bytes(97 + (number >> i & 1) for i in range(size))
            want = [ranks[p] for p in machine.merged(data)]
            assert np.frombuffer(machine.piece(data), "<u4").tolist() == want, data


def test_ranks_out_of_order_are_refused():
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"bc": 257}
    with pytest.raises(ValueError, match="order of merges"):
        B.Transducer(ranks).piece(b"abcabc")
    with pytest.raises(ValueError, match="every byte"):
        B.Transducer({b"a": 0})


def test_utf8_machine_ends_parts_between_characters():
    path = public_tokenizers.path(FILES[0])
    words, ranks = B.vocabulary(path), B.read_ranks(path)
    rng = random.Random(5)
    odd = [b"\xe6\xbc", b"\xf0\x9f\x98", b"\x80", b"\xc0\xaf", b"\xed\xa0\x80", b"\xf5", "漢é\U0001f600".encode(), b"abc", b"\xf0\x80", b"\xe0\x80\x80", b"\xff"]
    for _ in range(400):
        data = b"".join(rng.choices(odd, k=rng.randint(1, 8)))
        ids = np.array([ranks[data[i : i + 1]] for i in range(len(data))])
        decoder = B.Decoder(words)
        parts, at = [], 0
        while at < len(ids):
            size = rng.randint(1, 4)
            parts.append(decoder.feed(ids[at : at + size]))
            at += size
        parts.append(decoder.finish())
        assert b"".join(parts) == data
        assert "".join(p.decode("utf-8", "replace") for p in parts) == data.decode("utf-8", "replace")


def test_tables(documents, odd_documents, no_documents, spark):
    path = public_tokenizers.path(FILES[0])
    for df in (odd_documents, documents([(1, "<|endoftext|> a<|endoftext|>b")]), no_documents):
        texts = [(r["doc_id"], r["text"]) for r in df.collect()]
        encoded = B.encode(df, path)
        want = sorted(((i, library(path).encode_ordinary(t or "")) for i, t in texts), key=repr)
        assert sorted(((r["doc_id"], r["ids"]) for r in encoded.collect()), key=repr) == want
        assert sorted(((r["doc_id"], r["text"]) for r in B.decode(encoded, path).collect()), key=repr) == sorted(((i, t or "") for i, t in texts), key=repr)
        digest = lambda data: hashlib.sha256(data).hexdigest()
        rows = [(i, len(ids), digest(np.array(ids, "<u4").tobytes()), digest((t or "").encode())) for i, t in texts for ids in [library(path).encode_ordinary(t or "")]]
        assert sorted((tuple(r) for r in B.round_trips(df, path).collect()), key=repr) == sorted(rows, key=repr)
    nothing = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert sorted(tuple(r) for r in B.decode(nothing, path).collect()) == [(1, None), (2, "")]
    with pytest.raises(Exception, match="unknown id"):
        B.decode(spark.createDataFrame([(1, [60_000])], "doc_id long, ids array<int>"), path).collect()
