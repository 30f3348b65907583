from __future__ import annotations

import numpy as np
import pytest

from fieldmosaic.llm import url_filter
from fieldmosaic.llm.url_filter import RULES, Block, Rule, url_verdicts, write_block

PAGES = "page_id long, url string, html string, host string, rule string, verdict string"


def judged(rows, urls, **options):
    data = [(i, u, None, "h", "r", "v") for i, u in enumerate(urls)]
    return [tuple(r)[1:] for r in sorted(url_verdicts(rows(PAGES, data), options.pop("rules", RULES), **options).collect(), key=lambda r: r.page_id)]


def test_parts_and_rules(rows):
    found = judged(rows, [
        "http://A.Example.ORG/en/123?q=1", "https://example.org/es/#x", "x://sub.example.org", "https://notexample.org/es/1",
        "http://a.com/fr/2", "http://a.com/de/2", "http://com/de/", None, "", "no scheme/de/", "a://b://c/d", "http://h.com?/de/", "http://É.com/de/",
    ])
    assert found == [
        ("a.example.org", "/en/123", "example.org/en/1", "block"), ("example.org", "/es/", "example.org/es/", "block"),
        ("sub.example.org", "", None, "allow"), ("notexample.org", "/es/1", "org/", "allow"),
        ("a.com", "/fr/2", "com/fr/", "allow"), ("a.com", "/de/2", "com/de/", "block"), ("com", "/de/", "com/de/", "block"),
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("b:", "//c/d", None, "allow"),
        ("h.com", "", None, "allow"), ("É.com", "/de/", "com/de/", "block"),
    ]


def test_blocks_of_a_long_list_agree_with_a_scan(rows):
    rng = np.random.default_rng(3)
    rules = [Rule(f"h{rng.integers(40)}.com", "/" + "ab"[rng.integers(2)] * int(rng.integers(4)), ("allow", "block")[rng.integers(2)]) for _ in range(200)]
    urls = [f"http://x.h{rng.integers(50)}.com/{'ab'[rng.integers(2)] * int(rng.integers(5))}" for _ in range(300)]

    def scan(url):
        host, _, path = url.split("://")[1].partition("/")
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and ("/" + path).startswith(r.path)]
        best = max(fits, key=lambda r: (len(r.text), r.verdict == "block"), default=None)
        return (None, "allow") if best is None else (best.text, best.verdict)

    for block in (7, 1000):
        assert [f[2:] for f in judged(rows, urls, rules=rules, block_entries=block)] == [scan(u) for u in urls]


def test_equal_keys_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda text: 5)
    write_block([Rule("a", "/", "block"), Rule("b", "/", "allow")], path := str(tmp_path / "list"))
    block = Block(path)
    found = block.find([b"a/", b"b/", b"c/"])
    assert sorted(found[:2].tolist()) == [0, 1] and found[2] == -1


def test_empty_tables_and_repeated_rows(rows):
    assert judged(rows, []) == []
    assert judged(rows, ["http://a.com/de/"] * 2, rules=[]) == [("a.com", "/de/", None, "allow")] * 2
    with pytest.raises(ValueError):
        judged(rows, ["x"], rules=[Rule("a", "/", "maybe")])
