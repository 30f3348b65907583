"""URL rules in a sorted digest array.

The rule list is kept as sorted 64-bit xxhash keys beside the full rule strings,
in files that workers memory-map. Every host suffix of a URL, joined with every
path prefix length that some rule has, is hashed and looked up by binary search;
the stored string decides whether a hit is real, so a collision cannot change a verdict.

Lists of any length work: they are cut into blocks of ``block_entries`` rules, one
file each. Workers hold the mapped pages they touch, not the list.
"""

from __future__ import annotations

import os
import struct
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import arrow_map, batch, table
from .registry import query

BLOCK_ENTRIES = 4_000_000
SCHEMA = "page_id long, host string, path string, rule string, verdict string"


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    host: str
    path: str
    verdict: str  # allow or block

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)


def write_block(rules: Sequence[Rule], path: str) -> None:
    """One file: entry count, sorted keys, text offsets, verdict bits, texts.

    Of rules with the same text, a block outranks an allow.
    """
    verdicts: dict[str, bool] = {}
    for rule in rules:
        verdicts[rule.text] = verdicts.get(rule.text, False) or rule.verdict == "block"
    texts = [t.encode() for t in verdicts]
    keys = np.array([xxhash.xxh64_intdigest(t) for t in texts], dtype=np.uint64)
    order = np.argsort(keys, kind="stable")
    sizes = np.array([len(texts[i]) for i in order], dtype=np.int64)
    blocked = np.array(list(verdicts.values()), dtype=np.uint8)[order] if texts else np.empty(0, np.uint8)
    lengths = np.array(sorted({len(r.path) for r in rules}), dtype=np.int64)
    with open(path, "wb") as out:
        out.write(struct.pack("<qq", len(texts), len(lengths)))
        for part in (lengths, keys[order], np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), blocked):
            out.write(part.tobytes())
        out.write(b"".join(texts[i] for i in order))


class Block:
    """A mapped block of the list."""

    def __init__(self, path: str):
        raw = np.memmap(path, dtype=np.uint8, mode="r")
        count, kinds = struct.unpack("<qq", raw[:16].tobytes())
        at = 16
        self.path_lengths = raw[at : at + 8 * kinds].view(np.int64).tolist()
        at += 8 * kinds
        self.keys = raw[at : at + 8 * count].view(np.uint64)
        at += 8 * count
        self.offsets = raw[at : at + 8 * (count + 1)].view(np.int64)
        at += 8 * (count + 1)
        self.blocked = raw[at : at + count]
        self.texts = raw[at + count :]

    def find(self, probes: list[bytes]) -> np.ndarray:
        """Entry of each probe, or -1. Equal keys are walked until the stored text agrees."""
        found = np.full(len(probes), -1, dtype=np.int64)
        if not len(self.keys) or not probes:
            return found
        digests = np.fromiter((xxhash.xxh64_intdigest(p) for p in probes), np.uint64, len(probes))
        first = np.searchsorted(self.keys, digests)
        for i in np.flatnonzero(self.keys[np.minimum(first, len(self.keys) - 1)] == digests):
            entry = int(first[i])
            while entry < len(self.keys) and self.keys[entry] == digests[i]:
                if self.texts[self.offsets[entry] : self.offsets[entry + 1]].tobytes() == probes[i]:
                    found[i] = entry
                    break
                entry += 1
        return found


def host_and_path(urls: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Host: behind the first ``://`` up to ``/ ? #``, A-Z lower-cased; path: from there up to ``? #``."""
    parts = pc.extract_regex(urls.cast(pa.string()), r"^(?s:(?P<lead>.*?)://(?P<host>[^/?#]*)(?P<path>[^?#]*))")
    host = pc.fill_null(pc.struct_field(parts, [1]), "")
    return pc.ascii_lower(host), pc.fill_null(pc.struct_field(parts, [2]), "")


def suffixes(host: str) -> Iterator[str]:
    """The host itself, then each parent domain."""
    while host:
        yield host
        host = host.partition(".")[2]


def judge(hosts: Sequence[str], paths: Sequence[str], blocks: Sequence[Block]) -> list[tuple[str | None, bool]]:
    """Longest fitting rule of each URL and whether it blocks; equal lengths: the block wins."""
    best: list[tuple[int, bool, str] | None] = [None] * len(hosts)
    for block in blocks:
        heads: dict[str, list[str]] = {}
        probes: dict[bytes, int] = {}
        wanted: list[list[int]] = []
        for host, path in zip(hosts, paths):
            if host not in heads:
                heads[host] = list(suffixes(host))
            starts = [path[:n] for n in block.path_lengths if n <= len(path)]
            wanted.append([probes.setdefault((h + s).encode(), len(probes)) for h in heads[host] for s in starts])
        texts = list(probes)
        entries = block.find(texts)
        for i, mine in enumerate(wanted):
            for probe in mine:
                entry = entries[probe]
                if entry >= 0:
                    rule = texts[probe].decode()
                    found = (len(rule), bool(block.blocked[entry]), rule)
                    if best[i] is None or found[:2] > best[i][:2]:
                        best[i] = found
    return [(None, False) if b is None else (b[2], b[1]) for b in best]


def url_verdicts(
    pages: DataFrame,
    rules: Iterable[Rule],
    id_column: str = "page_id",
    url_column: str = "url",
    default: str = "allow",
    block_entries: int = BLOCK_ENTRIES,
) -> DataFrame:
    """One row per page: host, path, the longest fitting rule and its verdict.

    A URL on no list gets ``default``. A null URL or one without ``://`` has an
    empty host and path and fits no rule. Repeated rows are judged each; other
    columns are ignored. An empty rule list gives every page the default.
    """
    spark = pages.sparkSession
    folder, names, part = tempfile.mkdtemp(), [], []

    def flush() -> None:
        name = f"url-rules-{uuid.uuid4().hex}.bin"
        write_block(part, os.path.join(folder, name))
        spark.sparkContext.addFile(os.path.join(folder, name))
        names.append(name)
        part.clear()

    for rule in rules:
        if rule.verdict not in ("allow", "block"):
            raise ValueError(f"verdict {rule.verdict!r}")
        part.append(rule)
        if len(part) == block_entries:
            flush()
    if part:
        flush()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [Block(SparkFiles.get(name)) for name in names]
        for rows in batches:
            hosts, paths = host_and_path(rows.column(1))
            found = judge(hosts.to_pylist(), paths.to_pylist(), blocks)
            yield batch(
                {
                    "page_id": rows.column(0),
                    "host": hosts,
                    "path": paths,
                    "rule": [rule for rule, _ in found],
                    "verdict": [default if rule is None else "block" if blocked else "allow" for rule, blocked in found],
                },
                rule=pa.string(),
                verdict=pa.string(),
            )

    narrow = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url"))
    return arrow_map(narrow, work, SCHEMA)


_SQL = r"""
WITH cut AS (
    SELECT page_id,
           CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
    FROM pages
), parts AS (
    SELECT page_id,
           translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
    FROM cut
), ruled AS (
    SELECT *, CASE
        WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
        WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
        WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
        WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
        WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/'
    END AS rule
    FROM parts
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""


@query("op5_url_filter", _SQL)
def op5_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_verdicts(table(spark, folder, "pages"), RULES)
