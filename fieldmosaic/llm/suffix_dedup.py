"""Removal of long repeated byte strings by a run-length index.

Any string of ``LEAST`` bytes contains an anchor: a ``CORE``-byte substring whose hash is
the lowest of the string's CORE-byte substrings. Equal strings have equal anchors, so only
places whose anchor occurs twice can be repeated. What surrounds an anchor, as far as
any string of LEAST bytes around it reaches, is its context.

Contexts that occur twice as a whole are repeated throughout. The other contexts of a
repeated anchor are indexed, an anchor's contexts together: the anchor is one symbol, as in
prefix-free parsing, which keeps the index short. The Burrows-Wheeler transform of the
contexts is held as runs with the suffix positions of the run ends. A match that cannot
be extended to the left lies at a run boundary, so streaming over the boundaries
gives the matching statistics of all places, and every long match is marked.

An anchor with more than ``index_contexts`` different contexts is too much for one
task; its strings are counted by hash instead, which gives the same marks.

Blocks of documents send each distinct hash once, and learn in the same order whether it
is repeated. Inputs beyond a few hundred gigabytes want larger blocks (BLOCK_BYTES).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import mixed, prefix_hashes, span_hashes, text_slices
from .frames import arrow_map, batch, buckets_for, id_and_text, input_bytes, table, written
from .registry import query

LEAST = 200
CORE = 144
SIDE = LEAST - CORE  # bytes of context beside the core that a string may have
BLOCK_BYTES = 6 << 20
STRETCH = 1 << 19
INDEX_SYMBOLS = 1 << 19
INDEX_CONTEXTS = 20_000
JUDGED = 1 << 18

_BLOCK = "block long, doc_ids array<long>, starts binary, text binary"
_CONTEXT = "anchor long, block long, low long, left binary, right binary, single boolean, marks binary"
_MARK = "block long, begin long, end long"


def _sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum or maximum of every run of ``width`` numbers."""
    how, fill = (np.minimum, np.uint64(0xFFFFFFFFFFFFFFFF)) if least else (np.maximum, np.uint64(0))
    count = len(x) - width + 1
    rows = np.concatenate([x, np.full(-len(x) % width, fill)]).reshape(-1, width)
    ahead = how.accumulate(rows, axis=1).ravel()
    behind = how.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return how(behind[:count], ahead[width - 1 : width - 1 + count])


@dataclass
class Anchors:
    place: np.ndarray
    anchor: np.ndarray  # hash of the core
    context: np.ndarray  # hash of the context and the anchor's place in it
    low: np.ndarray
    high: np.ndarray


def anchors(data: np.ndarray, starts: np.ndarray, stretch: int = STRETCH) -> Anchors:
    """Anchors of consecutive texts, a stretch at a time."""
    found: list[tuple[np.ndarray, ...]] = []
    width = SIDE + 1
    for begin in range(0, len(data), stretch):
        # a place is judged by the cores up to SIDE around it, and its context reaches LEAST beyond
        low, high = max(0, begin - SIDE), min(len(data), begin + stretch + SIDE + LEAST)
        part = data[low:high]
        if len(part) < LEAST:
            continue
        prefix = prefix_hashes(part)
        at = np.arange(len(part) - CORE + 1)
        cores = span_hashes(prefix, at, at + CORE)
        lowest = _sliding(cores, width, least=True)
        # strings that cross the edge of a text do not count
        inner = np.searchsorted(starts, low + np.arange(len(lowest)), side="right")
        whole = np.searchsorted(starts, low + np.arange(len(lowest)) + LEAST - 1, side="right") == inner
        lowest = np.where(whole, lowest, np.uint64(0))
        best = _sliding(np.concatenate([np.zeros(SIDE, np.uint64), lowest, np.zeros(SIDE, np.uint64)]), width, least=False)
        place = np.flatnonzero(best[: len(cores)] == cores)
        place = place[(place + low >= begin) & (place + low < begin + stretch)]
        text = np.searchsorted(starts, place + low, side="right") - 1
        first = np.maximum(place - SIDE, starts[text] - low)
        last = np.minimum(place + LEAST, starts[text + 1] - low)
        context = mixed(span_hashes(prefix, first, last) + (place - first).astype(np.uint64))
        # anchors are lowest hashes, so unmixed they would crowd into the first bucket
        found.append((place + low, mixed(cores[place]), context, first + low, last + low))
    if not found:
        return Anchors(*(np.empty(0, kind) for kind in (np.int64, np.uint64, np.uint64, np.int64, np.int64)))
    return Anchors(*(np.concatenate(x) for x in zip(*found)))


def _blocks(docs: DataFrame) -> DataFrame:
    """Documents as written blocks of about BLOCK_BYTES; one longer document makes a longer block."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        parts, ids, sizes, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, parts, ids, sizes, held
            number += 1
            out = batch(
                {"block": [number], "doc_ids": pa.array([pa.concat_arrays(ids)], pa.list_(pa.int64())),
                 "starts": [np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64).tobytes()],
                 "text": [zstandard.ZstdCompressor(level=3).compress(np.concatenate(parts).tobytes())]}
            )
            parts, ids, sizes, held = [], [], [], 0
            return out

        for rows in batches:
            for piece in text_slices(rows.column(1)):
                parts.append(piece.data.copy()), sizes.append(np.diff(piece.starts))
                ids.append(rows.column(0).slice(piece.first, piece.last - piece.first))
                held += len(piece.data)
                if held >= BLOCK_BYTES:
                    yield flush()
        if ids:
            yield flush()

    return written(arrow_map(id_and_text(docs), work, _BLOCK), "text-blocks", "uncompressed")


def _opened(rows: pa.RecordBatch, i: int) -> tuple[int, np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(rows.column("text")[i].as_py())
    return rows.column("block")[i].as_py(), np.frombuffer(raw, np.uint8), np.frombuffer(rows.column("starts")[i].as_py(), np.int64)


def _cuts(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket, an equal range of hashes, begins in sorted hashes."""
    edges = np.array([(i << 64) // buckets for i in range(1, buckets)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(hashes, edges), [len(hashes)]])


def _judged(lists: list[np.ndarray], many: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each list of distinct sorted hashes: which are repeated, and which no list before has.

    ``many``: hashes that their own list stands for more than once. Judged a range of about JUDGED hashes at a time.
    """
    again, fresh = ([np.zeros(len(x), bool) for x in lists] for _ in range(2))
    filled = [x for x in lists if len(x)]
    if not filled:
        return again, fresh
    low, high = int(min(x[0] for x in filled)), int(max(x[-1] for x in filled))
    ranges = -(-sum(map(len, lists)) // JUDGED)
    edges = np.array([low + (high - low) * i // ranges for i in range(1, ranges)], np.uint64)
    cuts = [np.concatenate([[0], np.searchsorted(x, edges), [len(x)]]) for x in lists]
    for r in range(ranges):
        spans = [slice(c[r], c[r + 1]) for c in cuts]
        every = np.concatenate([x[s] for x, s in zip(lists, spans)])
        order = np.argsort(every, kind="stable")
        every = every[order]
        opens = np.ones(len(every), bool)
        opens[1:] = every[1:] != every[:-1]
        times = np.concatenate([m[s] for m, s in zip(many, spans)])[order].astype(np.int8) + np.int8(1)
        first = np.flatnonzero(opens)
        repeated, new = np.empty(len(every), bool), np.empty(len(every), bool)
        if len(first):
            repeated[order] = np.repeat(np.add.reduceat(times, first, dtype=np.int64) > 1, np.diff(np.append(first, len(every))))
        new[order] = opens
        at = np.cumsum([s.stop - s.start for s in spans])[:-1]
        for outs, values in ((again, repeated), (fresh, new)):
            for out, s, part in zip(outs, spans, np.split(values, at)):
                out[s] = part
    return again, fresh


def _repeats(blocks: DataFrame, buckets: int) -> DataFrame:
    """Per block and bucket, bits for its distinct anchors and contexts in hash order.

    Bits: anchor repeated; context repeated; this block is the one to show the context.
    """

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i in range(len(rows)):
                block, data, starts = _opened(rows, i)
                found = anchors(data, starts)
                out: dict[str, list] = {"block": [], "bucket": [], "anchors": [], "contexts": [], "many": []}
                lists = [np.unique(h, return_counts=True) for h in (found.anchor, found.context)]
                cuts = [_cuts(values, buckets) for values, _ in lists]
                for b in range(buckets):
                    spans = [slice(c[b], c[b + 1]) for c in cuts]
                    if any(s.stop > s.start for s in spans):
                        out["block"].append(block), out["bucket"].append(b)
                        out["anchors"].append(lists[0][0][spans[0]].tobytes()), out["contexts"].append(lists[1][0][spans[1]].tobytes())
                        out["many"].append(np.packbits(np.concatenate([c[s] > 1 for (_, c), s in zip(lists, spans)])).tobytes())
                yield batch(out, block=pa.int64(), bucket=pa.int32(), anchors=pa.binary(), contexts=pa.binary(), many=pa.binary())

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some: list[tuple] = []
        for rows in batches:
            columns = (rows.column(c) for c in ("block", "bucket", "anchors", "contexts", "many"))
            for block, bucket, anchor, context, many in zip(*columns):
                sides = [np.frombuffer(x.as_buffer(), np.uint64) for x in (anchor, context)]
                flags = np.unpackbits(np.frombuffer(many.as_buffer(), np.uint8), count=sum(map(len, sides))).astype(bool)
                some.append((block.as_py(), bucket.as_py(), sides, np.split(flags, [len(sides[0])])))
        if not some:
            return
        some.sort(key=lambda x: x[0])
        anchor, context = (_judged([x[2][side] for x in some], [x[3][side] for x in some]) for side in (0, 1))
        for (block, bucket, *_), a, c in zip(some, zip(*anchor), zip(*context)):
            bits = np.packbits(np.concatenate([a[0], *c])).tobytes()
            yield batch({"block": [block], "bucket": [bucket], "bits": [bits]}, block=pa.int64(), bucket=pa.int32())

    rows = arrow_map(blocks, name, "block long, bucket int, anchors binary, contexts binary, many binary")
    # one bucket a task; by hash, some tasks get several and some none
    return arrow_map(rows.repartitionById(buckets, "bucket"), answer, "block long, bucket int, bits binary")


def _contexts(blocks: DataFrame, repeats: DataFrame, buckets: int) -> DataFrame:
    """Contexts to be indexed, and per block the spans of contexts that are repeated as a whole."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i in range(len(rows)):
                block, data, starts = _opened(rows, i)
                found = anchors(data, starts)
                (_, at_anchor), (distinct, first, at_context) = (
                    np.unique(found.anchor, return_inverse=True), np.unique(found.context, return_index=True, return_inverse=True)
                )
                cuts = [_cuts(np.unique(found.anchor), buckets), _cuts(distinct, buckets)]
                again = np.zeros(cuts[0][-1], bool)
                whole, shown = np.zeros(len(distinct), bool), np.zeros(len(distinct), bool)
                for told in rows.column("answers")[i].values:
                    b, bits = told["bucket"].as_py(), np.unpackbits(np.frombuffer(told["bits"].as_py(), np.uint8)).astype(bool)
                    (a0, a1), (c0, c1) = ((c[b], c[b + 1]) for c in cuts)
                    n, m = a1 - a0, c1 - c0
                    again[a0:a1], whole[c0:c1], shown[c0:c1] = bits[:n], bits[n : n + m], bits[n + m : n + 2 * m]
                marked = whole[at_context]
                spans = _union(found.low[marked], found.high[marked])
                # of equal contexts one is shown, so that others can be matched with it
                show = np.zeros(len(found.place), bool)
                show[first[whole & shown]] = True
                single = again[at_anchor] & ~marked
                pick = np.flatnonzero(single | show)
                place, low, high = found.place[pick], found.low[pick], found.high[pick]
                yield batch(
                    {"anchor": found.anchor[pick].view(np.int64), "block": np.full(len(pick), block), "low": low,
                     "left": [data[a:b].tobytes() for a, b in zip(low, place)], "right": [data[a:b].tobytes() for a, b in zip(place + CORE, high)],
                     "single": single[pick], "marks": [None] * len(pick)},
                    left=pa.binary(), right=pa.binary(), marks=pa.binary(),
                )
                yield batch(
                    {"anchor": [None], "block": [block], "low": [None], "left": [None], "right": [None], "single": [None], "marks": [spans.tobytes()]},
                    anchor=pa.int64(), block=pa.int64(), low=pa.int64(), left=pa.binary(), right=pa.binary(), single=pa.bool_(),
                )

    answers = repeats.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias("answers"))
    return written(arrow_map(blocks.join(answers, "block"), work, _CONTEXT), "contexts")


def _union(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Disjoint ascending spans with the same cover, one a row."""
    if not len(begin):
        return np.empty((0, 2), np.int64)
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order].astype(np.int64), np.maximum.accumulate(end[order]).astype(np.int64)
    fresh = np.flatnonzero(np.r_[True, begin[1:] > end[:-1]])
    return np.stack([begin[fresh], end[np.append(fresh[1:], len(begin)) - 1]], axis=1)


@dataclass
class RunIndex:
    """Runs of a Burrows-Wheeler transform with the suffixes at their ends.

    ``heads`` are the places where a run begins, ``symbols`` what it repeats; ``first``
    and ``last`` are the suffix positions at its ends. ``ranks[k]`` orders the
    substrings of 2^k symbols, which compares any two suffixes.
    """

    heads: np.ndarray
    symbols: np.ndarray
    first: np.ndarray
    last: np.ndarray
    ranks: list[np.ndarray]

    def common(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Symbols that suffixes share."""
        size = len(self.ranks[0])
        out = np.zeros(len(one), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            a, b = one + out, two + out
            inside = (a < size) & (b < size)
            same = inside & (self.ranks[k][np.minimum(a, size - 1)] == self.ranks[k][np.minimum(b, size - 1)])
            out[same] += 1 << k
        return out

    def boundaries(self, step: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Neighbouring suffixes that differ in the symbol before them, and what they share."""
        for begin in range(1, len(self.heads), step):
            above, below = self.last[begin - 1 : begin - 1 + step][: len(self.heads) - begin], self.first[begin : begin + step]
            yield above, below, self.common(above, below)


def run_index(symbols: np.ndarray, breaks: np.ndarray, longest: int) -> RunIndex:
    """Index of symbols; ``breaks`` are places whose preceding symbol equals no other.

    Substrings longer than ``longest`` symbols must differ.
    """
    size = len(symbols)
    ranks = [np.unique(symbols, return_inverse=True)[1].astype(np.int32)]
    span = 1
    while span < longest:
        pairs = ranks[-1].astype(np.int64) * (size + 1)
        pairs[: max(size - span, 0)] += ranks[-1][span:] + 1
        ranks.append(np.unique(pairs, return_inverse=True)[1].astype(np.int32))
        span *= 2
    order = np.argsort(ranks[-1], kind="stable")
    before = symbols[order - 1].copy()
    alone = np.zeros(size, bool)
    alone[breaks] = True
    alone[0] = True
    alone = alone[order]
    change = np.ones(size, bool)
    change[1:] = (before[1:] != before[:-1]) | alone[1:] | alone[:-1]
    heads = np.flatnonzero(change)
    # ranks of the longest span only served the order
    return RunIndex(heads, before[heads], order[heads], order[np.append(heads[1:], size) - 1], ranks[:-1] if len(ranks) > 1 else ranks)


def long_matches(group: np.ndarray, left: list[bytes], right: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, begin, end) of matches of LEAST bytes or more between contexts of one group, from each context's low end."""
    n_left, n_right = (np.fromiter(map(len, side), np.int64, len(side)) for side in (left, right))
    size = n_left + n_right + 2
    start = np.concatenate([[0], np.cumsum(size)])
    symbols = np.empty(start[-1], np.int64)
    core = start[:-1] + n_left
    symbols[core] = 256 + np.unique(group, return_inverse=True)[1]
    stops = start[1:] - 1
    symbols[stops] = 256 + len(group) + np.arange(len(group))
    for sides, lengths, origin in ((left, n_left, start[:-1]), (right, n_right, core + 1)):
        flat = np.frombuffer(b"".join(sides), np.uint8)
        offset = np.cumsum(lengths) - lengths
        symbols[np.arange(len(flat)) + np.repeat(origin - offset, lengths)] = flat
    index = run_index(symbols, start[:-1], int(size.max()))
    owner = np.repeat(np.arange(len(group)), size)
    found = []
    for above, below, shared in index.boundaries():
        for at in (above, below):
            context = owner[at]
            lead = core[context] - at
            # only matches across the core are long enough
            length = np.where((lead >= 0) & (shared > lead), shared + CORE - 1, 0)
            long = length >= LEAST
            begin = (at - start[:-1][context])[long]
            found.append((context[long], begin, begin + length[long]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 3


def _indexed(contexts: DataFrame, tasks: int) -> DataFrame:
    """Marks of single contexts; all contexts of an anchor are in one partition, one after another."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        symbols = 0

        def settle() -> pa.RecordBatch:
            anchor, block, low, left, right, single = zip(*held)
            context, begin, end = long_matches(np.array(anchor), list(left), list(right))
            mine = np.array(single, bool)[context]
            context, shift = context[mine], np.array(low, np.int64)
            return batch({"block": np.array(block, np.int64)[context], "begin": shift[context] + begin[mine], "end": shift[context] + end[mine]})

        for rows in batches:
            for row in zip(*(rows.column(c).to_pylist() for c in ("anchor", "block", "low", "left", "right", "single"))):
                if symbols >= INDEX_SYMBOLS and held[-1][0] != row[0]:
                    yield settle()
                    held, symbols = [], 0
                held.append(row)
                symbols += len(row[3]) + len(row[4]) + 2
        if held:
            yield settle()

    return arrow_map(contexts.repartition(tasks, "anchor").sortWithinPartitions("anchor"), work, _MARK)


def _counted(contexts: DataFrame) -> DataFrame:
    """The same marks for anchors of very many contexts: every string of LEAST bytes counted by hash."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for anchor, block, low, left, right, single in zip(*(rows.column(c).to_pylist() for c in ("anchor", "block", "low", "left", "right", "single"))):
                text = np.frombuffer(left + right, np.uint8)
                lead = np.arange(len(left), -1, -1)
                lead = lead[(LEAST - CORE - lead >= 0) & (LEAST - CORE - lead <= len(right))]
                prefix = prefix_hashes(text)
                begin = len(left) - lead
                ones = np.full(len(lead), len(left))
                key = mixed(span_hashes(prefix, begin, begin + LEAST - CORE) + np.uint64(anchor & (1 << 64) - 1) + lead.astype(np.uint64))
                yield batch({"key": key.view(np.int64), "block": np.full(len(ones), block), "begin": low + begin, "single": np.full(len(ones), single)})

    strings = arrow_map(contexts.drop("marks"), work, "key long, block long, begin long, single boolean")
    again = strings.groupBy("key").agg(F.count("*").alias("times")).where("times > 1").select("key")
    return strings.where("single").join(again, "key", "left_semi").select("block", "begin", (F.col("begin") + LEAST).alias("end"))


def _kept(rows: pa.RecordBatch, i: int) -> pa.RecordBatch:
    """Counts and the digest of what is left, for the documents of a block."""
    _, data, starts = _opened(rows, i)
    spans = [np.frombuffer(m, np.int64).reshape(-1, 2) for m in rows.column("whole")[i].as_py() or [] if m]
    more = rows.column("found")[i].values
    if more is not None:
        spans.append(np.stack([more.field(x).to_numpy() for x in ("begin", "end")], axis=1))
    spans = np.concatenate([np.empty((0, 2), np.int64), *spans])
    begin, end = _union(spans[:, 0], spans[:, 1]).T
    before = np.searchsorted(begin, starts)  # spans that begin before each text
    total = np.concatenate([[0], np.cumsum(end - begin)])
    gone = total[before] - np.maximum(np.concatenate([[0], end])[before] - starts, 0)
    # a span may go on from one text into the next, and counts in both
    touched = np.where(np.diff(starts) > 0, before[1:] - np.searchsorted(end, starts[:-1], side="right"), 0)
    turns = np.diff(np.concatenate([[0], np.stack([begin, end], axis=1).ravel(), [len(data)]]))
    kept = data[np.repeat(np.arange(len(turns)) % 2 == 0, turns)].tobytes()
    at = starts - gone
    return batch(
        {"doc_id": rows.column("doc_ids")[i].values, "n_bytes": np.diff(starts), "n_removed": np.diff(gone), "n_spans": touched,
         "kept": [kept[a:b] for a, b in zip(at[:-1], at[1:])]},
        kept=pa.binary(),
    )


def remove_repeats(docs: DataFrame, index_contexts: int = INDEX_CONTEXTS, digest: bool = False) -> DataFrame:
    """Per document: bytes, removed bytes, removed spans and the bytes left (or their SHA-256).

    A byte goes if a string of LEAST bytes over it also starts elsewhere, in the same or
    another document. Null and empty texts have no bytes. Rows that repeat an id are
    documents of their own, and copies of each other. An empty table gives no rows.
    """
    spark = docs.sparkSession
    size = input_bytes(docs.select(F.col("text").cast("string").alias("text")))
    buckets = buckets_for(spark, size, 1 << 24, BLOCK_BYTES // 4096)
    blocks = _blocks(docs)
    contexts = _contexts(blocks, _repeats(blocks, buckets), buckets)
    around = contexts.where(F.col("anchor").isNotNull())
    groups = around.groupBy("anchor").agg(F.count("*").alias("contexts"), F.max("single").alias("any_single")).where("any_single AND contexts > 1")
    groups = groups.select("anchor", (F.col("contexts") > index_contexts).alias("large"))
    around = written(around.join(groups, "anchor"), "grouped-contexts")
    small = _indexed(around.where(~F.col("large")).drop("large", "marks"), buckets)
    large = _counted(around.where("large").drop("large"))
    found = small.unionByName(large).groupBy("block").agg(F.collect_list(F.struct("begin", "end")).alias("found"))
    whole = contexts.where(F.col("marks").isNotNull()).groupBy("block").agg(F.collect_list("marks").alias("whole"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i in range(len(rows)):
                done = _kept(rows, i)
                if digest:
                    sums = [hashlib.sha256(k).hexdigest() for k in done.column("kept").to_pylist()]
                    done = pa.RecordBatch.from_arrays([*done.columns[:4], pa.array(sums, pa.string())], [*done.schema.names[:4], "kept_sha256"])
                yield done

    last = "kept_sha256 string" if digest else "kept binary"
    marked = blocks.join(whole, "block", "left").join(found, "block", "left")
    return arrow_map(marked, finish, f"doc_id long, n_bytes long, n_removed long, n_spans long, {last}")


@query("op4_suffix_dedup")
def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(table(spark, folder, "documents"), digest=True)
