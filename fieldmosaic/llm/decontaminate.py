"""Benchmark decontamination by winnowing.

Words of documents and items are hashed. Of every ``WINDOW - GRAM + 1`` consecutive
word k-grams the lowest hash is kept (the rightmost of equal ones), so each shared
run of ``WINDOW`` words has a fingerprint in common. Items shorter than that are one
window: their whole hash is the fingerprint, looked up at every document position.

Document fingerprints first pass a fixed-size filter of the items' fingerprints; what
is left is joined exactly and every hit is extended word by word in its neighbourhood,
which travels with the fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrays import ALPHANUMERIC, Words, gram_hashes, mixed, owners, text_slices, words
from .frames import KeyFilter, arrow_map, batch, id_and_text, table, unused, written
from .registry import query

WINDOW = 13
GRAM = 7
REACH = WINDOW - GRAM  # words on either side that a window may need

_PRINTS = "array<struct<key:long,position:int,size:int,around:binary>>"


def _key(hashes: np.ndarray, size: int) -> np.ndarray:
    return mixed(hashes ^ np.uint64(size * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


def _inside(owner: np.ndarray, size: int) -> np.ndarray:
    """For each run of ``size`` words: whether one text holds it."""
    count = max(0, len(owner) - size + 1)
    return owner[:count] == owner[size - 1 : size - 1 + count]


def winnowed(found: Words) -> np.ndarray:
    """Positions of the kept k-grams of every text, ascending."""
    owner = owners(found.starts)
    grams = gram_hashes(found.hashes, GRAM)
    width = WINDOW - GRAM + 1
    if len(grams) < width:
        return np.empty(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(grams, width)[:, ::-1]
    lowest = np.arange(len(windows)) + (width - 1) - windows.argmin(axis=1)
    return np.unique(lowest[_inside(owner, WINDOW)])


def _around(found: Words, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the words from REACH before to REACH behind each k-gram; 0 outside the text."""
    place = at[:, None] + np.arange(-REACH, GRAM + REACH)
    safe = np.clip(place, 0, max(len(owner) - 1, 0))
    return np.where((place == safe) & (owner[safe] == owner[at][:, None]), found.hashes[safe], np.uint64(0))


def prints(found: Words, short: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(window size, keys, positions) of a slice's fingerprints."""
    at = winnowed(found)
    yield WINDOW, _key(gram_hashes(found.hashes, GRAM)[at], WINDOW), at
    owner = owners(found.starts)
    for size in short:
        at = np.flatnonzero(_inside(owner, size))
        yield size, _key(gram_hashes(found.hashes, size)[at], size), at


def _item_prints(items: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Fingerprints of the items: item, key, window size, word neighbourhood."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            ids = rows.column(0)
            for piece in text_slices(rows.column(1)):
                found = words(piece, ALPHANUMERIC)
                owner, sizes = owners(found.starts), np.diff(found.starts)
                for size, key, at in prints(found, sorted({int(n) for n in sizes if 0 < n < WINDOW})):
                    if size < WINDOW:
                        whole = sizes[owner[at]] == size
                        key, at = key[whole], at[whole]
                        around = [b""] * len(at)
                    else:
                        around = [r.tobytes() for r in _around(found, owner, at)]
                    if len(at):
                        yield batch(
                            {"item_id": ids.take(pa.array(piece.first + owner[at])), "key": key.view(np.int64),
                             "size": np.full(len(at), size, np.int32), "around": around}
                        )

    narrow = items.select(F.col(id_column).cast("string").alias("item_id"), F.col(text_column).cast("string").alias("text"))
    return arrow_map(narrow, work, "item_id string, key long, size int, around binary").distinct()


def _document_prints(docs: DataFrame, wanted: KeyFilter, short: list[int]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for piece in text_slices(rows.column(1)):
                found = words(piece, ALPHANUMERIC)
                owner = owners(found.starts)
                lists: list[list] = [[] for _ in range(piece.last - piece.first)]
                for size, key, at in prints(found, short):
                    hit = shared.value.holds(key)
                    key, at = key[hit], at[hit]
                    around = _around(found, owner, at) if size == WINDOW else None
                    for i, (k, a) in enumerate(zip(key.view(np.int64).tolist(), at.tolist())):
                        text = int(owner[a])
                        lists[text].append(
                            {"key": k, "position": a - int(found.starts[text]), "size": size,
                             "around": b"" if around is None else around[i].tobytes()}
                        )
                part = rows.slice(piece.first, piece.last - piece.first)
                yield batch(
                    {"doc_id": part.column(0), "row_key": part.column(2), "n_words": np.diff(found.starts), "prints": lists},
                    prints=pa.list_(pa.struct([("key", pa.int64()), ("position", pa.int32()), ("size", pa.int32()), ("around", pa.binary())])),
                )

    narrow = id_and_text(docs, F.xxhash64("doc_id", "text").alias("row_key"))
    return arrow_map(narrow, work, f"doc_id long, row_key long, n_words long, prints {_PRINTS}")


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal words around each joined fingerprint that are long enough for a window."""
    width = GRAM + 2 * REACH
    for rows in batches:
        size = rows.column("size").to_numpy()
        begin = rows.column("position").to_numpy().astype(np.int64)
        end = begin + size
        long = np.flatnonzero(size == WINDOW)
        keep = size < WINDOW
        if len(long):
            one, two = (
                np.frombuffer(b"".join(rows.column(c).take(pa.array(long)).to_pylist()), np.uint64).reshape(-1, width)
                for c in ("around", "item_around")
            )
            same = (one == two) & (one != 0)
            left = np.cumprod(same[:, :REACH][:, ::-1], axis=1).sum(axis=1)
            right = np.cumprod(same[:, REACH + GRAM :], axis=1).sum(axis=1)
            keep[long] = same[:, REACH : REACH + GRAM].all(axis=1) & (left + right >= REACH)
            end[long] = begin[long] + GRAM + right
            begin[long] -= left
        pick = pa.array(np.flatnonzero(keep))
        yield batch(
            {"row_key": rows.column("row_key").take(pick), "item_id": rows.column("item_id").take(pick),
             "begin": begin[keep], "end": end[keep]}
        )


def contamination(
    docs: DataFrame,
    items: DataFrame,
    item_id: str = "item_id",
    item_text: str = "text",
    share: Column | None = None,
) -> DataFrame:
    """Per document: words, words inside any item window, items found, and the verdict.

    Null and empty texts have no words and are clean. Items without words are
    ignored; an item without an id still marks words but is neither counted nor
    listed. Equal texts of one id are the same document and each repeated row is
    returned. Empty tables give no rows, or clean rows where only the items are missing.
    """
    item_prints = written(_item_prints(items, item_id, item_text), "item-prints")
    short = sorted(r["size"] for r in item_prints.where(F.col("size") < WINDOW).select("size").distinct().collect())
    wanted = KeyFilter.of(item_prints.select("key"))
    marked = written(_document_prints(docs, wanted, short), "document-prints")
    hits = marked.select("row_key", F.inline("prints"))
    joined = hits.join(item_prints.withColumnRenamed("around", "item_around"), ["key", "size"]).select(
        "row_key", "position", "size", "around", "item_id", "item_around"
    )
    spans = arrow_map(joined, _extend, "row_key long, item_id string, begin long, end long")
    order = Window.partitionBy("row_key").orderBy("begin", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    found = (
        spans.withColumn("fresh", F.col("end") - F.greatest(F.col("begin"), F.coalesce(reached, F.lit(0))))
        .groupBy("row_key")
        .agg(F.sum(F.greatest(F.col("fresh"), F.lit(0))).alias("n_hit"), F.array_sort(F.collect_set("item_id")).alias("items"))
    )
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    dirty = (n_hit > 0) & (20 * n_hit >= F.col("n_words")) if share is None else (n_hit > 0) & (n_hit >= share * F.col("n_words"))
    items_found = F.coalesce("items", F.array().cast("array<string>"))
    return marked.select("doc_id", "row_key", "n_words").join(found, "row_key", "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items_found).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items_found).cast("binary"), 256).alias("items_sha256"),
        dirty.alias("contaminated"),
        "row_key",
    )


def uncontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of documents that are not contaminated, with all their columns."""
    key, bad = unused(docs, "__key"), unused(docs, "__dirty")
    dirty = written(contamination(docs, items).where("contaminated").select(F.col("row_key").alias(bad)).distinct(), "dirty")
    marked = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    return marked.join(dirty, F.col(key) == F.col(bad), "left_anti").select(*docs.columns)


_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORDS}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_WORDS}') AS w FROM benchmark),
iw AS (
    SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
    FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
          FROM (SELECT *, least(13, len(w)) AS n FROM b WHERE len(w) > 0))
),
dw AS (
    SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
          FROM d JOIN (SELECT DISTINCT n FROM iw) ON len(w) >= n)
),
hit AS (SELECT DISTINCT doc_id, i, dw.n, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
word AS (SELECT doc_id, count(*) AS n_hit FROM (
    SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
item AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
         FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN word ON d.doc_id = word.doc_id LEFT JOIN item ON d.doc_id = item.doc_id
"""


@query("op3_decontamination", _SQL)
def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("row_key")
