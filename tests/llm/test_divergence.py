from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from fieldmosaic.llm import divergence as D

SCHEMA = "doc_id long, text string, lang string, source string, part string, item string, tile int, ordinal string"


@pytest.fixture
def docs(rows):
    def make(triples):
        return rows(SCHEMA, [(i, text, lang, source, "p", None, 3, "o") for i, (lang, source, text) in enumerate(triples)])

    return make


def plain(triples, least, top):
    docs = [(lang or "", source or "", [
        w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")
    ]) for lang, source, text in triples]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        seen = Counter(w for d in mine for w in set(d[2]))
        kept = sorted((w for w, n in seen.items() if n >= least), key=lambda w: w.encode())
        count = defaultdict(Counter)
        for _, source, words in mine:
            count[source].update(w for w in words if w in set(kept))
        whole = Counter()
        for some in count.values():
            whole.update(some)

        def share(some):
            total = sum(some.values()) + 2 * len(kept)
            return {w: 1 + 1_000_000_000 * (some[w] + 2) // total for w in kept}

        q = share(whole)
        shares = {source: share(some) for source, some in count.items()}

        def apart(x, y):
            return (x - y) * (x - y) // (x + y)

        for source, p in shares.items():
            pairs = [(sum(apart(p[w], shares[o][w]) for w in kept), o) for o in shares if o != source]
            terms = [(apart(p[w], q[w]), w) for w in kept if count[source][w] and p[w] > q[w]]
            for part, some in (("pair", pairs), ("term", terms)):
                some.sort(key=lambda r: (-r[0], r[1].encode()))
                out += [(lang, source, part, item, value, i + 1) for i, (value, item) in enumerate(some) if part == "pair" or i < top]
    return sorted(out)


def found(df, **how):
    return sorted(tuple(r) for r in D.source_divergence(df, **how).collect())


def some_documents(n=120, seed=1):
    rng = random.Random(seed)
    words = ["Ant", "bee", "beetle", "été", "été's", "x1y", "漢字", "zebra", "zeb", "B", "b", "\U0001f600", "É", "bees", "a" * 300] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(5) for j in range(5)]
    return [
        (rng.choice(["en", "en", "de", None, ""]), rng.choice(["hot", "hot", "hot", "s1", "s2", None, "z", "ä"]), " ".join(rng.choices(words, k=rng.randint(0, 30))))
        for _ in range(n)
    ]


def test_equals_dictionaries(docs):
    triples = some_documents()
    assert found(docs(triples).repartition(5), least=4, top=3) == plain(triples, 4, 3)


def test_small_blocks_loads_and_tiles_give_the_same(docs):
    triples = some_documents(150, 2)
    df = docs(triples).repartition(4)
    assert found(df, least=3, top=4, block_terms=5, load_bytes=1, term_block=3, tile=2) == plain(triples, 3, 4)


def test_nulls_ties_repeated_rows_and_groups_without_terms(docs):
    triples = [(None, None, "same words here")] * 12 + [("en", "a", None), ("en", "b", ""), ("en", "c", "12 34 \x00"), ("de", "only", "Wort " * 40_000)]
    triples += [("en", s, "tie knot tie knot") for s in "xyz" for _ in range(4)]
    result = found(docs(triples), least=10)
    assert result == plain(triples, 10, 10)
    assert {r[1] for r in result if r[0] == "en" and r[2] == "pair"} == set("abcxyz")


def test_no_kept_terms_still_has_pairs(docs):
    assert found(docs([("en", "a", "one"), ("en", "b", "two")])) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_empty_table(docs):
    assert found(docs([])) == []


def test_transducer_is_minimal_and_numbers_terms():
    rng = random.Random(3)
    for size in (0, 1, 7, 400):
        terms = sorted({"".join(rng.choices("abcé漢", k=rng.randint(1, 7))).encode() for _ in range(size)})
        machine = D.transducer(terms)
        words = terms + [b"ab" + t for t in terms] + [t[:-1] for t in terms] + [b"", b"zzz", b"a" * 50]
        data = np.frombuffer(b"".join(words) or b"x", np.uint8)
        end = np.cumsum([len(w) for w in words])
        asked = machine.ordinals(data, end - [len(w) for w in words], end)
        assert asked.tolist() == [terms.index(w) if w in terms else -1 for w in words]
        # one state per distinct set of continuations
        tails = {frozenset(t[len(p):] for t in terms if t.startswith(p)) for t in [*terms, b""] for p in [t[:i] for i in range(len(t) + 1)]}
        assert len(machine.final) - 1 == len(tails)


def test_shares_are_exact():
    rng = np.random.default_rng(0)
    count = rng.integers(0, 1 << 50, 200)
    total = count + rng.integers(0, 1 << 50, 200)
    assert D.shares(count, total, 1000).tolist() == [1 + 10**9 * (int(c) + 2) // (int(t) + 2000) for c, t in zip(count, total)]
