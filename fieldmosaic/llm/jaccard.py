"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct word shingles; documents of equal sets are one
class. Shingles are ordered rare first by a frequency sketch, which has a slot for every
SHINGLES_PER_SLOT shingles up to ``1 << MOST_BITS`` slots (16 MB in a task); the order
decides about speed only. Two sets of
the wanted similarity share at least l shingles of their l-prefixes, and an l-prefix is
``n - t + l`` long, where t is the overlap that any partner needs. Every class chooses
its l by estimated cost: where the prefix holds frequent shingles, a longer prefix and
more required matches save verifications.

Links are found in two steps, so that a large group of near copies costs little:

1. per shared shingle, every class is paired with the class that shares most of its own
   prefix, which in a group of copies is the one least edited; pairs with enough
   matches are verified and linked into components;
2. pairs of classes in different components. A class keeps the prefix shingles that other
   components hold, ordered by their exact number of holders. A pair that needs m matches
   has one among the rarest r - m + 1 of the r shingles that either side keeps, so
   only there it is looked for.

Every link between classes either is verified or joins classes already connected, so
components are exact.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrays import SPACED, Words, gram_hashes, mixed, text_slices, words
from .components import components
from .frames import KeyFilter, arrow_map, batch, buckets_for, id_and_text, input_bytes, table, unused, written
from .registry import query

LEAST_BITS, MOST_BITS = 16, 24
SHINGLES_PER_SLOT = 16
SKETCH_PARTS = 64
LONGEST = 8  # of l
VERIFY_COST = 4  # of one candidate, in scanned postings
COMPACT = 1 << 21
FLUSH = 1 << 20  # postings that a task gathers before it sends them
MOST_BUCKETS = 1 << 14


def shingle_sets(found: Words, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a shorter text is one shingle."""
    grams = gram_hashes(found.hashes, size)
    for first, last in zip(found.starts[:-1].tolist(), found.starts[1:].tolist()):
        if last - first >= size:
            yield np.unique(grams[first : last - size + 1])
        elif last > first:
            yield gram_hashes(found.hashes[first:last], last - first)
        else:
            yield np.empty(0, np.uint64)


def class_key(shingles: np.ndarray) -> int:
    """Key of a set, the same in whatever order; as a signed 64-bit number."""
    total = mixed(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(mixed(np.array([total + np.uint64(len(shingles))]))[0].astype(np.int64))


def needed(size: int, percent: int) -> int:
    """Overlap that a set of this size needs with any partner."""
    return -(-percent * size // 100)


def sketch_bits(text_bytes: int) -> int:
    """Slots of the sketch as a power of two; a shingle is taken for six bytes of text."""
    return min(max(int(text_bytes / 6 / SHINGLES_PER_SLOT).bit_length(), LEAST_BITS), MOST_BITS)


def _slots(shingles: np.ndarray, bits: int) -> np.ndarray:
    return (shingles >> np.uint64(64 - bits)).astype(np.int64)


def _profile(docs: DataFrame, size: int, bits: int) -> DataFrame:
    """Rows ``(doc_id, n, class)``, and per task the parts of its frequency sketch."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << bits, dtype=np.uint32)
        empty = True
        for rows in batches:
            empty = False
            for piece in text_slices(rows.column(1)):
                counts, keys = [], []
                for shingles in shingle_sets(words(piece, SPACED), size):
                    counts.append(len(shingles))
                    keys.append(class_key(shingles) if len(shingles) else None)
                    np.add.at(sketch, _slots(shingles, bits), 1)
                some = len(counts)
                yield batch(
                    {"doc_id": rows.column(0).slice(piece.first, some), "n": counts, "class": keys, "part": [None] * some, "counts": [None] * some},
                    n=pa.int32(), part=pa.int32(), counts=pa.binary(), **{"class": pa.int64()},
                )
        if not empty:
            none = [None] * SKETCH_PARTS
            yield batch(
                {"doc_id": none, "n": none, "class": none, "part": np.arange(SKETCH_PARTS, dtype=np.int32),
                 "counts": [zlib.compress(p.tobytes(), 1) for p in np.minimum(sketch, 0xFFFF).astype(np.uint16).reshape(SKETCH_PARTS, -1)]},
                doc_id=pa.int64(), n=pa.int32(), **{"class": pa.int64()},
            )

    return arrow_map(id_and_text(docs), work, "doc_id long, n int, class long, part int, counts binary")


def _levels(profile: DataFrame, bits: int, shingles: int) -> np.ndarray:
    """Per sketch slot: 0 for the usual, else how many doublings its count lies above it."""
    usual = 2 * max(shingles / (1 << bits), 1.0)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for rows in batches:
            for part, counts in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                counts = np.frombuffer(zlib.decompress(counts), np.uint16).astype(np.int64)
                found[part] = found[part] + counts if part in found else counts
        levels = [np.maximum(np.floor(np.log2(np.maximum(c, 1) / usual)), 0).astype(np.uint8).tobytes() for c in found.values()]
        if found:
            yield batch({"part": np.array(list(found), np.int32), "levels": levels})

    parts = profile.where(F.col("part").isNotNull()).select("part", "counts").repartition("part")
    out = np.zeros((SKETCH_PARTS, (1 << bits) // SKETCH_PARTS), np.uint8)
    for row in arrow_map(parts, add, "part int, levels binary").collect():  # a byte a slot, 16 MB at most
        out[row["part"]] = np.frombuffer(row["levels"], np.uint8)
    return out.reshape(-1)


def prefix(shingles: np.ndarray, levels: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The rare-first prefix that costs least by estimate, and its l."""
    size = len(shingles)
    level = levels[_slots(shingles, len(levels).bit_length() - 1)]
    ordered = np.argsort(level, kind="stable")
    short = size - needed(size, percent)
    most = min(LONGEST, size - short)
    cost = np.cumsum(np.where(level > 0, 2.0 ** level.astype(float), 0.0)[ordered])[short : short + most]
    l = 1 + int(np.argmin(cost * (1 + VERIFY_COST / np.arange(1, most + 1))))
    return shingles[ordered[: short + l]], l


def _postings(docs: DataFrame, levels: np.ndarray, size: int, percent: int, buckets: int) -> DataFrame:
    """Prefix shingles held by two classes at least: ``(token, class, n, l)``."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        parts: list[tuple[np.ndarray, int, int, int]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            tokens = np.concatenate([p[0] for p in parts])
            lengths = [len(p[0]) for p in parts]
            keys = np.repeat(np.array([p[1] for p in parts], np.int64), lengths)
            sizes = np.repeat(np.array([p[2] * 16 + p[3] for p in parts], np.int64), lengths)
            bucket = (tokens % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1)).astype(np.int32)
            used = np.flatnonzero(np.diff(cuts))
            cut = pa.array(np.append(cuts[used], cuts[-1]))
            lists = [
                pa.ListArray.from_arrays(cut, pa.array(c[order])) for c in (tokens.view(np.int64), keys, sizes)
            ]
            return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *lists], ["bucket", "tokens", "classes", "sizes"])

        for rows in batches:
            for piece in text_slices(rows.column(0)):
                for shingles in shingle_sets(words(piece, SPACED), size):
                    key = class_key(shingles) if len(shingles) else None
                    if key is not None and key not in seen:
                        seen.add(key)
                        tokens, l = prefix(shingles, shared.value, percent)
                        parts.append((tokens, key, len(shingles), l))
                        held += len(tokens)
                if held >= FLUSH:
                    yield flush()
                    parts.clear(), seen.clear()
                    held = 0
        if parts:
            yield flush()

    def shared_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows are kept per distinct token; the run of a frequent token leaves as it
        # grows and only one row of it stays, marked as sent.
        held = [np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)]
        fresh: list[list[np.ndarray]] = []

        def compact() -> pa.RecordBatch | None:
            nonlocal held
            token, key, sizes, sent = (np.concatenate([h, *(f[i] for f in fresh)]) for i, h in enumerate(held))
            fresh.clear()
            order = np.lexsort((~sent, key, token))
            token, key, sizes, sent = token[order], key[order], sizes[order], sent[order]
            new = np.r_[True, (token[1:] != token[:-1]) | (key[1:] != key[:-1])] if len(token) else np.empty(0, bool)
            token, key, sizes, sent = token[new], key[new], sizes[new], sent[new]
            if not len(token):
                return None
            first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            length = np.diff(np.append(first, len(token)))
            group = np.repeat(np.arange(len(first)), length)
            many = (length > 1) | np.logical_or.reduceat(sent, first)
            out = many[group] & ~sent
            # of a run that leaves, the row already sent or else the first stays
            ahead = np.where(sent, np.arange(len(token)), len(token))
            stay = np.minimum.reduceat(ahead, first)
            stay = np.where(stay < len(token), stay, first)
            held = [token[stay], key[stay], sizes[stay], many.copy()]
            return batch(
                {"token": token[out].view(np.int64), "class": key[out], "n": (sizes[out] >> 4).astype(np.int32), "l": (sizes[out] & 15).astype(np.int32)}
            )

        waiting = 0
        for rows in batches:
            part = [rows.column(c).flatten().to_numpy() for c in (1, 2, 3)]
            fresh.append([part[0].view(np.uint64), part[1], part[2], np.zeros(len(part[0]), bool)])
            waiting += len(part[0])
            if waiting >= COMPACT + len(held[0]):
                if (out := compact()) is not None:
                    yield out
                waiting = 0
        if (out := compact()) is not None:
            yield out

    lists = "bucket int, tokens array<long>, classes array<long>, sizes array<long>"
    rows = arrow_map(docs.select(F.col("text").cast("string").alias("text")), index, lists).repartition(buckets, "bucket")
    return arrow_map(rows, shared_only, "token long, class long, n int, l int")


def _overlap(a: str, b: str, percent: int) -> Column:
    """Overlap that two sets of these sizes need."""
    return F.ceil(F.lit(percent) * (F.col(a) + F.col(b)) / F.lit(100 + percent)).cast("int")


def _matches(a: dict[str, str], b: dict[str, str], percent: int) -> Column:
    """Shared prefix shingles without which the pair cannot be similar.

    Shingles shared beyond the prefix that ends first all lie in that set's rest,
    which has t - l shingles.
    """
    rest = F.greatest(*[F.ceil(F.lit(percent) * F.col(x["n"]) / F.lit(100)).cast("int") - F.col(x["l"]) for x in (a, b)])
    return F.greatest(F.least(F.col(a["l"]), F.col(b["l"])), _overlap(a["n"], b["n"], percent) - rest)


def _sized(a: str, b: str, percent: int) -> Column:
    return F.least(F.col(a), F.col(b)) * 100 >= F.greatest(F.col(a), F.col(b)) * percent


_A = {"n": "n", "l": "l"}
_B = {"n": "other_n", "l": "other_l"}


def _hub_pairs(postings: DataFrame, percent: int) -> DataFrame:
    kept = F.ceil(F.lit(100 - percent) * F.col("n") / F.lit(100)) + F.col("l")
    shares = postings.groupBy("class").agg((F.count("*") / F.first(kept)).alias("share"))
    known = postings.join(shares, "class")
    heads = known.groupBy("token").agg(F.max(F.struct("share", "class", "n", "l")).alias("head"))
    met = known.join(heads, "token").select(
        "class", "n", "l", F.col("head.class").alias("other"), F.col("head.n").alias("other_n"), F.col("head.l").alias("other_l")
    )
    met = met.where((F.col("class") != F.col("other")) & _sized("n", "other_n", percent))
    return (
        met.groupBy("class", "other", "n", "l", "other_n", "other_l").agg(F.count("*").alias("matches"))
        .where(F.col("matches") >= _matches(_A, _B, percent))
        .select(F.least("class", "other").alias("a"), F.greatest("class", "other").alias("b"))
        .distinct()
    )


def _cross_pairs(postings: DataFrame, joined: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components with enough matches."""
    placed = postings.join(joined.select(F.col("node").alias("class"), "component"), "class", "left").withColumn(
        "component", F.coalesce("component", "class")
    )
    tokens = placed.groupBy("token").agg(F.count("*").alias("holders"), F.min("component").alias("x"), F.max("component").alias("y"))
    placed = placed.join(tokens.where("x <> y").select("token", "holders"), "token")
    one = Window.partitionBy("class")
    placed = placed.withColumn("rank", F.row_number().over(one.orderBy("holders", "token"))).withColumn("reach", F.count("*").over(one).cast("int"))
    # shingles behind this one, itself included: what a match here may still be part of
    placed = written(placed.select("token", "class", "n", "l", "component", (F.col("reach") - F.col("rank") + 1).alias("ahead")), "cross-postings")
    other = placed.select("token", *[F.col(c).alias(f"other_{c}" if c != "class" else "other") for c in ("class", "n", "l", "component", "ahead")])
    pairs = (
        placed.join(other, "token")
        .where(
            (F.col("class") < F.col("other")) & (F.col("component") != F.col("other_component")) & _sized("n", "other_n", percent)
            & (F.least("ahead", "other_ahead") >= _matches(_A, _B, percent))
        )
        .select("class", "n", "l", "other", "other_n", "other_l")
        .distinct()
    )
    lists = placed.groupBy("class").agg(F.collect_list("token").alias("tokens"))
    both = pairs.join(lists, "class").join(lists.select(F.col("class").alias("other"), F.col("tokens").alias("other_tokens")), "other")
    return both.where(F.size(F.array_intersect("tokens", "other_tokens")) >= _matches(_A, _B, percent)).select(
        F.col("class").alias("a"), F.col("other").alias("b")
    )


def _verified(docs: DataFrame, pairs: DataFrame, shown: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs whose whole sets are similar. ``shown`` has for each class the document that shows its set."""
    pairs = written(pairs, "candidates")
    asked = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
    wanted = KeyFilter.of(asked.join(shown, "class").select(F.col("class").bitwiseXOR(F.col("shown"))))
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            ids = rows.column(0).fill_null(0).to_numpy()
            for piece in text_slices(rows.column(1)):
                some = list(shingle_sets(words(piece, SPACED), size))
                keys = np.array([class_key(s) if len(s) else 0 for s in some], np.int64)
                hit = shared.value.holds((keys ^ ids[piece.first : piece.last]).view(np.uint64)) & (keys != 0)
                if hit.any():
                    yield batch({"class": keys[hit], "shingles": [some[i].tobytes() for i in np.flatnonzero(hit)]})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            keep = []
            for i, (x, y) in enumerate(zip(rows.column("x"), rows.column("y"))):
                one, two = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(one, two, assume_unique=True))
                if 100 * both >= percent * (len(one) + len(two) - both):
                    keep.append(i)
            picked = pa.array(keep, pa.int64())
            yield batch({"a": rows.column("a").take(picked), "b": rows.column("b").take(picked)})

    found = written(arrow_map(id_and_text(docs), sets, "class long, shingles binary"), "sets", "uncompressed")
    whole = pairs.join(found.select(F.col("class").alias("a"), F.col("shingles").alias("x")), "a").join(
        found.select(F.col("class").alias("b"), F.col("shingles").alias("y")), "b"
    )
    return written(arrow_map(whole.select("a", "b", "x", "y"), compare, "a long, b long"), "verified")


def similar_documents(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` over links of Jaccard similarity ``percent`` / 100.

    Words are runs of bytes that are no white space, with A-Z lower-cased. A null or
    empty text has no shingles, links with nothing and is a component of its own.
    Rows that repeat an id are returned as often; equal texts share their component
    whatever their ids, also when an id is null. The component id is the smallest
    non-null id in the component. An empty table gives no rows.
    """
    spark = docs.sparkSession
    bits = sketch_bits(input_bytes(id_and_text(docs)))
    profile = written(_profile(docs, size, bits), "profile")
    sets = profile.where(F.col("part").isNull()).select("doc_id", F.col("n"), "class")
    total = sets.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0
    buckets = buckets_for(spark, total * (100 - percent) // 100, 1 << 20, MOST_BUCKETS)
    postings = written(_postings(docs, _levels(profile, bits, total), size, percent, buckets), "postings")
    shown = sets.where(F.col("class").isNotNull()).groupBy("class").agg(F.min(F.coalesce("doc_id", F.lit(0))).alias("shown"))
    near = _verified(docs, _hub_pairs(postings, percent), shown, size, percent)
    far = _verified(docs, _cross_pairs(postings, components(near), percent), shown, size, percent)
    joined = components(near.unionByName(far))
    classes = sets.where(F.col("class").isNotNull()).groupBy("class").agg(F.min("doc_id").alias("first_id"))
    placed = classes.join(joined, F.col("class") == F.col("node"), "left").select(
        "class", "first_id", F.coalesce("component", "class").alias("component")
    )
    lowest = placed.groupBy("component").agg(F.min("first_id").alias("component_id"))
    member = placed.join(lowest, "component").select(F.col("class").alias("member"), "component_id")
    return sets.join(member, F.col("class") == F.col("member"), "left").select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The row of the smallest id (then of the smallest hash) of each component, with all its columns.

    Rows of equal id and text are one; documents without text are kept.
    """
    key = F.xxhash64(F.col("doc_id"), F.col("text"))
    rows = docs.select(key.alias("row_key"), F.col("doc_id").alias("row_id"), "text")
    found = similar_documents(rows.select(F.col("row_key").alias("doc_id"), "text"), size, percent)
    ids = rows.select("row_key", F.col("row_id").cast("long").alias("row_id")).distinct()
    placed = found.select(F.col("doc_id").alias("row_key"), F.col("component_id")).distinct().join(ids, "row_key")
    first = placed.groupBy("component_id").agg(F.min_by("row_key", F.struct(F.col("row_id").isNull(), "row_id", "row_key")).alias("__kept"))
    first = written(first.select("__kept"), "kept")
    name = unused(docs, "__key")
    first = first.withColumnRenamed("__kept", kept := unused(docs, "__kept"))
    rows = docs.withColumn(name, key).join(first, F.col(name) == F.col(kept), "left_semi")
    return rows.dropDuplicates([name]).select(*docs.columns)


@query("op1_jaccard_join")
def op1_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return similar_documents(table(spark, folder, "documents"), size=4, percent=85)
