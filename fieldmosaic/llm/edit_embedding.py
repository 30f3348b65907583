"""Document fingerprints by a randomised edit embedding.

All texts take the same random walk: at step j the walk writes the character under
its pointer, and a shared random bit for (j, character) says whether the pointer
moves on. Texts at a small edit distance fall back into step soon after each edit,
so edit distance becomes Hamming distance between the written sequences. A
fingerprint keeps ``SLOTS`` sampled places of that sequence; slot f takes the lowest
of a shared random order among the first ``2 * length`` steps, so the sampled places
of texts of similar length mostly agree. Each place is read over ``RUN`` steps.

Walks are advanced in lockstep for all texts of a batch.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrays import strings
from .components import components, joined
from .frames import arrow_map, batch, buckets_for, discard, id_and_text, input_bytes, table, written
from .registry import query

SLOTS = 128
RUN = 4
SEED = 20_240_607
# Links: this share of equal slots, in a band of equal slots. Texts of some thousand characters with two
# random edits in a thousand are linked at a recall above 0.9; unrelated ones agree in about 2 % of slots.
LEAST = 0.5
BANDS = 16
BAND_SLOTS = 5
CROWD = 32  # classes beside a bucket's largest component whose pairs are listed as they are
MOST_SLICES = 20_000  # of the id range; their edges are known to the driver
_ROWS = 1024  # steps whose random bits are drawn at once


def _records(slot: int, limit: int) -> list[int]:
    """Steps below ``limit`` that are the lowest so far in the slot's random order."""
    rng = np.random.default_rng([SEED, slot])
    found, at = [], 1
    while at <= limit:
        found.append(at - 1)
        at = int(np.ceil((at + 1e-9) / max(rng.random(), 1e-12)))
        at = max(at, found[-1] + 2)
    return found


def _events(limit: int) -> dict[int, list[tuple[int, int]]]:
    """Per step: the slots that read there, with the number of the read."""
    events: dict[int, list[tuple[int, int]]] = {}
    for slot in range(SLOTS):
        records = _records(slot, limit)
        for step, anew in zip(records, [*records[1:], limit + RUN]):
            # a slot that starts anew does not go on with what it read before
            for turn in range(min(RUN, anew - step)):
                events.setdefault(step + turn, []).append((slot, turn))
    return events


def embed(texts: Sequence[str]) -> np.ndarray:
    """Fingerprints, texts x SLOTS bytes. An empty text has zeros."""
    out = np.zeros((SLOTS, len(texts)), dtype=np.uint8)
    if not len(texts):
        return out.T
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes + 1) - 1
    kinds = np.zeros(int(ends[-1]) + 1, dtype=np.uint8)
    for text, end in zip(texts, ends.tolist()):
        # 255 character classes; 0 stands for the end, where the pointer stays
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds[end - len(text) : end] = ((codes * np.uint32(2654435761)) >> np.uint32(8)) % np.uint32(255) + np.uint32(1)
    order = np.argsort(-sizes, kind="stable")
    pointer = (ends - sizes)[order]
    steps = 2 * sizes[order]
    longest = int(steps[0])
    active_at = len(texts) - np.searchsorted(steps[::-1], np.arange(longest + 1), side="right")
    events = _events(longest)
    found = np.zeros((SLOTS, len(texts)), dtype=np.uint8)
    for begin in range(0, longest, _ROWS):
        moves = np.random.Generator(np.random.Philox(key=SEED, counter=begin)).integers(0, 2, (_ROWS, 256), dtype=np.uint8)
        moves[:, 0] = 0
        for step in range(begin, min(begin + _ROWS, longest)):
            active = active_at[step]
            here = pointer[:active]
            seen = kinds[here]
            here += moves[step - begin][seen]
            for slot, turn in events.get(step, ()):
                if turn:
                    found[slot, :active] = found[slot, :active] * np.uint8(167) + seen
                else:
                    found[slot, :active] = seen
    out[:, order] = found
    return out.T


def likeness(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Share of equal slots, row by row."""
    return (one == two).mean(axis=1)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fingerprint)``: hexadecimal, equal for equal texts. Null texts count as empty."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            prints = embed(strings(rows.column(1)))
            yield batch({"doc_id": rows.column(0), "fingerprint": [p.tobytes().hex() for p in prints]}, fingerprint=pa.string())

    return arrow_map(id_and_text(docs), work, "doc_id long, fingerprint string")


def _verified(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Pairs of classes whose whole fingerprints are alike."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            one, two = (np.frombuffer(b"".join(some.column(c).to_pylist()), np.uint8).reshape(len(some), SLOTS) for c in ("x", "y"))
            keep = pa.array(np.flatnonzero(likeness(one, two) >= least))
            yield batch({"a": some.column("a").take(keep), "b": some.column("b").take(keep)})

    whole = pairs.join(classes.select(F.col("class").alias("a"), F.col("fingerprint").alias("x")), "a").join(
        classes.select(F.col("class").alias("b"), F.col("fingerprint").alias("y")), "b"
    )
    return written(arrow_map(whole.select("a", "b", "x", "y"), verify, "a long, b long"), "verified")


def _mixed(rows: DataFrame) -> DataFrame:
    """The rows of keys that several components hold, with the component most of the key's rows have and the number of others.

    Of a pair of different components one at least is such another, so pairs are listed from those.
    """
    counted = rows.groupBy("key", "component").agg(F.count("*").alias("n"))
    most = F.max(F.struct("n", "component"))
    keys = counted.groupBy("key").agg(most.getField("component").alias("main"), F.sum("n").alias("holders"), (F.sum("n") - F.max("n")).alias("others"))
    return rows.join(keys.where("others > 0"), "key")


def _listed(mixed: DataFrame) -> DataFrame:
    """``(a, b)``: pairs of different components under one key."""
    other = mixed.select("key", F.col("class").alias("y"), F.col("component").alias("other_component"))
    pairs = mixed.where("component <> main").select("key", F.col("class").alias("x"), "component").join(other, "key").where("component <> other_component")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _narrowed(crowded: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Rows of large buckets under finer keys that every link between components still shares.

    Slots are taken in runs. A link differs in ``SLOTS - least`` slots at most, so it agrees in
    ``share`` whole runs at least, all of them held in the bucket by several components; of the r
    such runs that a class has, one among the rarest r - share + 1 is shared.
    """
    differing = SLOTS - math.ceil(least * SLOTS)
    size = max(1, min(3, SLOTS // (differing + 1)))
    runs = SLOTS // size
    share = runs - differing
    if share < 1:
        return crowded.select("class", "component", "key")
    parts = F.transform(F.sequence(F.lit(0), F.lit(runs - 1)), lambda i: F.substring("fingerprint", size * i + 1, F.lit(size)))
    finer = (
        crowded.select("class", "component", "key").join(classes.select("class", "fingerprint"), "class")
        .select("class", "component", F.col("key").alias("bucket"), F.posexplode(parts).alias("place", "part"))
        .select("class", "component", "bucket", F.xxhash64("bucket", "place", "part").alias("key"))
    )
    one = Window.partitionBy("class", "bucket")
    return (
        _mixed(finer)
        .withColumn("rank", F.row_number().over(one.orderBy("holders", "key")))
        .withColumn("reach", F.count("*").over(one))
        .where(F.col("rank") <= F.col("reach") - share + 1)
        .select("class", "component", "key")
    )


def near_classes(prints: DataFrame, least: float = LEAST, bands: int = BANDS, rows: int = BAND_SLOTS, crowd: int = CROWD) -> DataFrame:
    """``(fingerprint, component_id)`` over links of likeness ``least`` that agree in a bit-sampled band.

    ``prints(doc_id, fingerprint)`` has fingerprints of ``SLOTS`` bytes; only those that several rows
    hold, or that have a link, are returned. Rows of equal fingerprints are one class. First, every
    class of a bucket is compared with one class of the bucket, so a group of near copies costs its
    size and not its square. Then the pairs of different components in a bucket are looked for:
    those of its largest component with up to ``crowd`` classes of others, and under finer keys where
    there are more others. Each pair is verified on the whole fingerprint, so components are those of
    all links that share a band. Null fingerprints are left out; repeated rows add nothing; an empty
    table gives no rows.
    """
    found = prints.where(F.col("fingerprint").isNotNull()).groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("rows"))
    classes = written(found.select(F.xxhash64("fingerprint").alias("class"), "fingerprint", "first_id", "rows"), "classes")
    rng = np.random.default_rng(SEED)
    picks = [sorted(rng.choice(SLOTS, rows, replace=False).tolist()) for _ in range(bands)]
    keys = [F.xxhash64(F.lit(i), *[F.substring("fingerprint", s + 1, 1) for s in pick]) for i, pick in enumerate(picks)]
    banded = classes.select("class", F.explode(F.array(*keys)).alias("key"))
    # few bands are held by two classes: those are written, so that the join knows their size
    heads = written(banded.groupBy("key").agg(F.min("class").alias("head"), F.max("class").alias("last")).where("head < last").select("key", "head"), "heads")
    met = written(banded.join(heads, "key"), "buckets")
    involved = written(classes.join(met.select("class").distinct(), "class", "left_semi"), "involved")
    pairs = met.where("head <> class").select(F.col("head").alias("a"), F.col("class").alias("b")).distinct()
    near = _verified(pairs, involved, least)
    placed = components(near, keep_rounds=False)
    own = met.join(placed, F.col("class") == F.col("node"), "left").select(
        "class", "key", F.coalesce("component", "class").alias("component")
    )
    apart = written(_mixed(own), "apart")
    finer = written(_mixed(_narrowed(apart.where(F.col("others") > crowd), involved, least)), "finer")
    pairs = _listed(apart.where(F.col("others") <= crowd)).unionByName(_listed(finer)).distinct()
    far = _verified(pairs, involved, least)
    whole = joined(placed, far)
    named = classes.join(whole, F.col("class") == F.col("node"), "left").where("rows > 1 OR node IS NOT NULL").select(
        "fingerprint", "first_id", F.coalesce("component", "class").alias("component")
    )
    lowest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    result = written(named.join(lowest, "component").select("fingerprint", "component_id"), "near")
    discard(classes, heads, met, involved, apart, finer, near, far)
    return result


def with_components(prints: DataFrame, **how) -> DataFrame:
    """Rows with ``component_id``: the smallest id of their component in ``near_classes``, otherwise the row's own id."""
    near = near_classes(prints.select("doc_id", "fingerprint"), **how)
    return prints.join(near, "fingerprint", "left").select(*prints.columns, F.coalesce("component_id", "doc_id").alias("component_id"))


def near_documents(prints: DataFrame, **how) -> DataFrame:
    """``(doc_id, component_id)`` of the rows of ``fingerprints``; takes what ``near_classes`` takes.

    A null id has the component of its fingerprint's other rows, or null; repeated rows are returned
    each; an empty table gives no rows.
    """
    return with_components(prints.select("doc_id", F.unhex("fingerprint").alias("fingerprint")), **how).select("doc_id", "component_id")


def with_next(docs: DataFrame, slice_bytes: int = 1 << 23) -> DataFrame:
    """Rows ``(slice, halo, doc_id, text)``, partitioned and sorted so that the next document follows.

    The order is descending by id, equal ids by compressed text, null ids last. Documents are cut into
    slices of the id range; the first document of each slice is also sent, as ``halo``, to the
    slice before it, and the very first one to the last slice. Texts travel compressed: ``text``
    is a frame for ``unpacked``. Null texts count as empty; an empty table gives no rows.
    """
    spark = docs.sparkSession
    low = F.lit(-(1 << 63))
    keyed = id_and_text(docs).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("rank", F.coalesce("doc_id", low))
    slices = buckets_for(spark, input_bytes(keyed), slice_bytes, MOST_SLICES)
    bounds = sorted(set(keyed.approxQuantile("rank", [i / slices for i in range(1, slices)], 0.25 / slices))) if slices > 1 else []
    keyed = keyed.withColumn("__position", F.col("rank").cast("double"))
    cut = Bucketizer(splits=[-float("inf"), *[b for b in bounds if abs(b) < 2.0**63], float("inf")], inputCol="__position", outputCol="slice")
    if len(cut.getSplits()) > 2:
        keyed = cut.transform(keyed)
    else:
        keyed = keyed.withColumn("slice", F.lit(0.0))
    keyed = keyed.withColumn("slice", F.col("slice").cast("int"))
    # one row per slice, as many as the plan has slices
    tops = [tuple(r) for r in keyed.groupBy("slice").agg(F.max("rank")).orderBy("slice").collect()]
    uppers = [tops[i + 1][0] if i + 1 < len(tops) else tops[0][0] for i in range(len(tops))]
    edges = spark.createDataFrame(
        [(s, top, upper) for (s, top), upper in zip(tops, uppers)], "edge_slice int, edge_rank long, upper int"
    )
    targets = F.expr(
        "if(upper IS NULL, array(struct(slice, false AS halo)), array(struct(slice, false AS halo), struct(upper AS slice, true AS halo)))"
    )
    spread = (
        keyed.join(F.broadcast(edges), (F.col("slice") == F.col("edge_slice")) & (F.col("rank") == F.col("edge_rank")), "left")
        .select("doc_id", "text", "rank", F.explode(targets).alias("to"))
        .select("to.slice", "to.halo", "doc_id", "text")
    )
    small = arrow_map(spread, _packed, "slice int, halo boolean, doc_id long, text binary")
    return small.repartition(slices, "slice").sortWithinPartitions("slice", "halo", F.col("doc_id").desc_nulls_last(), "text")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    work = zstandard.ZstdCompressor(level=3)
    for rows in batches:
        frames = [work.compress(t.encode("utf-8", "surrogatepass")) for t in strings(rows.column(3))]
        yield batch({"slice": rows.column(0), "halo": rows.column(1), "doc_id": rows.column(2), "text": pa.array(frames, pa.binary())})


def unpacked(frame: bytes) -> str:
    return zstandard.decompress(frame).decode("utf-8", "surrogatepass")


def edited_text(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _pairs(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[list[tuple[int | None, str, str]]]:
    """Lists of (id, text, next text) of about ``limit`` characters."""
    held, out, size = None, [], 0
    for rows in batches:
        for part, halo, doc_id, text in zip(*(rows.column(i).to_pylist() for i in range(3)), map(unpacked, rows.column(3).to_pylist())):
            if held is not None and held[0] == part:
                out.append((held[1], held[2], text))
                size += len(held[2])
                if size >= limit:
                    yield out
                    out, size = [], 0
            held = None if halo else (part, doc_id, text)
    if out:
        yield out


@query("op6_edit_embedding")
def op6_edit_embedding(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint of every document, of its text with the second half taken from the next one, and its component of near documents.

    Null texts count as empty, and empty ones are near each other. Repeated rows are documents of their own, each the
    next one of the other; a single document follows itself; an empty table gives no rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _pairs(batches, 3 << 20):
            ids, texts, following = (list(x) for x in zip(*some))
            edited = [edited_text(t, n) for t, n in zip(texts, following)]
            prints = embed([*texts, *edited, following[-1]])
            own, changed = prints[: len(texts)], prints[len(texts) : 2 * len(texts)]
            # the next text is the next row's own, except where a slice of documents ended
            after = np.concatenate([own[1:], prints[-1:]])
            breaks = [i for i in range(len(texts) - 1) if following[i] is not texts[i + 1]]
            if breaks:
                after[breaks] = embed([following[i] for i in breaks])
            yield batch(
                {"doc_id": ids, "n_chars": [len(t) for t in texts],
                 "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
                 "fingerprint": [p.tobytes() for p in own], "edited_fingerprint": [p.tobytes() for p in changed],
                 "near_edited": likeness(own, changed), "near_next": likeness(own, after)},
                doc_id=pa.int64(), n_chars=pa.int64(), fingerprint=pa.binary(), edited_fingerprint=pa.binary(),
            )

    made = written(arrow_map(
        with_next(table(spark, folder, "documents")), work,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double",
    ), "fingerprints")
    text = {c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")}
    return with_components(made).withColumns(text)
