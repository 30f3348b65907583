"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into chunks of ``CHUNK`` bytes, each overlapping the next by half,
so that every byte is covered. Learned filters slide over the embedded bytes;
each filter's highest response in a chunk is kept (max pooling), and its mean,
maximum and minimum over the chunks, with the size of the text, are combined into
one probability.

Training uses at most ``per_class`` labelled texts of either label, of at most
``sample_bytes`` bytes each and lowest by hash of their id. Every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import Slice, text_slices
from .frames import arrow_map, batch, id_and_text, in_fold, table
from .registry import query

BLOCK = 256  # a chunk is two blocks
STRIDE = 4
KERNEL = 8
EMBEDDING = 8
FILTERS = 24
SLICE = 1 << 19
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


@dataclass
class Network:
    embedding: np.ndarray  # 256 x EMBEDDING
    filters: np.ndarray  # KERNEL * EMBEDDING x FILTERS
    bias: np.ndarray
    combine: np.ndarray  # 3 * FILTERS + 1
    offset: np.ndarray  # one number

    @classmethod
    def fresh(cls, seed: int) -> "Network":
        rng = np.random.default_rng(seed)
        parts = (
            rng.normal(0, 0.5, (256, EMBEDDING)),
            rng.normal(0, 1 / np.sqrt(KERNEL * EMBEDDING), (KERNEL * EMBEDDING, FILTERS)),
            np.zeros(FILTERS),
            rng.normal(0, 0.1, 3 * FILTERS + 1),
            np.zeros(1),
        )
        return cls(*(p.astype(np.float32) for p in parts))

    def parts(self) -> list[np.ndarray]:
        return [self.embedding, self.filters, self.bias, self.combine, self.offset]


@dataclass
class Pooled:
    data: np.ndarray  # padded bytes
    best: np.ndarray  # blocks x FILTERS: highest response of each block
    first: np.ndarray  # first block of each text, and the number of blocks


def _padded(piece: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after another, each filled with zeros to whole blocks (one block at least)."""
    sizes = np.diff(piece.starts)
    first = np.concatenate([[0], np.cumsum(np.maximum(1, -(-sizes // BLOCK)))])
    data = np.zeros(first[-1] * BLOCK, dtype=np.uint8)
    shift = np.repeat(first[:-1] * BLOCK - piece.starts[:-1], sizes)
    data[np.arange(len(piece.data)) + shift] = piece.data
    return data, first


def _responses(net: Network, data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Filter responses, blocks x positions x FILTERS. The last window of a text sees zeros behind it."""
    steps = net.embedding[data].reshape(-1, STRIDE * EMBEDDING)
    half = STRIDE * EMBEDDING
    out = steps @ net.filters[:half]
    ahead = steps @ net.filters[half:]
    out[:-1] += ahead[1:]
    edge = first[1:] * (BLOCK // STRIDE) - 1
    empty = np.tile(net.embedding[0], STRIDE) @ net.filters[half:]
    inner = edge[:-1]
    out[inner] += empty - ahead[inner + 1]
    out[edge[-1:]] += empty
    return (out + net.bias).reshape(len(data) // BLOCK, BLOCK // STRIDE, FILTERS)


def _chunks(best: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunk maxima (a block and its successor in the same text) after a ramp, and which block holds each."""
    follow = np.roll(best, -1, axis=0)
    last = first[1:] - 1
    follow[last] = best[last]
    later = follow > best
    return np.maximum(np.where(later, follow, best), 0), later


def _pool(chunks: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Mean, maximum and minimum over the chunks of each text, and the logarithm of its bytes."""
    mean = np.add.reduceat(chunks, first[:-1], axis=0) / np.diff(first)[:, None]
    most, least = (how.reduceat(chunks, first[:-1], axis=0) for how in (np.maximum, np.minimum))
    return np.concatenate([mean, most, least, np.log1p(sizes)[:, None] / 4], axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def scores(net: Network, piece: Slice) -> np.ndarray:
    """Probability of label 1 for each text of a slice."""
    data, first = _padded(piece)
    best = np.empty((first[-1], FILTERS), dtype=np.float32)
    step = SLICE // BLOCK
    for begin in range(0, int(first[-1]), step):
        # one block more on the right, for the windows that reach into it
        end, more = min(begin + step, int(first[-1])), min(begin + step + 1, int(first[-1]))
        cuts = np.unique(np.clip(first - begin, 0, more - begin))
        best[begin:end] = _responses(net, data[begin * BLOCK : more * BLOCK], cuts)[: end - begin].max(axis=1)
    chunks, _ = _chunks(best, first)
    return _sigmoid(_pool(chunks, first, np.diff(piece.starts)).astype(np.float64) @ net.combine.astype(np.float64) + float(net.offset[0]))


def _gradients(net: Network, piece: Slice, target: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
    data, first = _padded(piece)
    responses = _responses(net, data, first)
    where = responses.argmax(axis=1)
    blocks = np.arange(len(responses))
    best = np.take_along_axis(responses, where[:, None, :], axis=1)[:, 0]
    chunks, later = _chunks(best, first)
    pooled = _pool(chunks, first, np.diff(piece.starts))
    chance = _sigmoid(pooled @ net.combine + net.offset)
    loss = -(weight * np.log(np.where(target > 0, chance, 1 - chance) + 1e-7)).mean()
    slope = ((chance - target) * weight / len(target)).astype(np.float32)
    into = slope[:, None] * net.combine
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    # the mean reaches every chunk, the maximum and the minimum the first chunk that attains them
    flow = into[owner, :FILTERS] / np.diff(first)[owner, None]
    for at in (FILTERS, 2 * FILTERS):
        row, column = np.nonzero((chunks == pooled[owner, at : at + FILTERS]) & (chunks > 0))
        _, once = np.unique(owner[row] * FILTERS + column, return_index=True)
        flow[row[once], column[once]] += into[owner[row[once]], at + column[once]]
    flow = np.where(chunks > 0, flow, 0).astype(np.float32)
    source = np.where(later, blocks[:, None] + 1, blocks[:, None])
    position = source * (BLOCK // STRIDE) + np.take_along_axis(where, source, axis=0)
    ahead = np.concatenate([data, np.zeros(KERNEL, np.uint8)])
    d_filters, d_embedding = np.zeros_like(net.filters), np.zeros_like(net.embedding)
    text_end = first[1:][owner] * BLOCK
    for f in range(FILTERS):
        used = np.flatnonzero(flow[:, f])
        if not len(used):
            continue
        spot = position[used, f][:, None] * STRIDE + np.arange(KERNEL)
        seen = np.where(spot < text_end[used][:, None], ahead[spot], 0)
        window = net.embedding[seen].reshape(len(used), -1)
        d_filters[:, f] = window.T @ flow[used, f]
        back = flow[used, f][:, None, None] * net.filters[:, f].reshape(KERNEL, EMBEDDING)
        np.add.at(d_embedding, seen, back)
    return float(loss), [d_embedding, d_filters, flow.sum(axis=0), pooled.T @ slope, slope.sum(keepdims=True)]


def fit(
    texts: Sequence[str], labels: Sequence[int], share: float = 0.5, seed: int = 7, steps: int = 400, size: int = 48
) -> Network:
    """About ``steps`` steps of Adam on the cross-entropy; label 1 weighs ``share`` in sum, as it does among the labels it may learn from."""
    net = Network.fresh(seed)
    if not len(texts):
        return net
    rng = np.random.default_rng(seed)
    target = np.array(labels, dtype=np.float32)
    positive = float(np.clip(target.mean(), 1e-3, 1 - 1e-3))
    weight = np.where(target > 0, share / positive, (1 - share) / (1 - positive)).astype(np.float32)
    first, second, turn = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()], 0
    epochs = -(-steps // -(-len(texts) // size))
    rounds = epochs * -(-len(texts) // size)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for begin in range(0, len(order), size):
            pick = order[begin : begin + size]
            column = pa.array([texts[i] for i in pick], pa.large_string())
            piece = next(text_slices(column, 1 << 40))
            _, slopes = _gradients(net, piece, target[pick], weight[pick])
            rate = 0.01 * (1 - turn / rounds)
            turn += 1
            for part, slope, m, v in zip(net.parts(), slopes, first, second):
                m += 0.1 * (slope - m)
                v += 0.001 * (slope * slope - v)
                part -= rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8)
    return net


def sample(docs: DataFrame, labels: DataFrame, usable: Column, per_class: int, sample_bytes: int) -> tuple[list, float]:
    """Labelled texts, both labels by the lowest hashes of the ids, and the share of label 1 among the labels of usable texts."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").cast("string").alias("__text"), usable.alias("__use"))
    narrow = narrow.where(F.col("__use") & F.col("__text").isNotNull() & (F.octet_length("__text") <= sample_bytes))
    marked = (
        labels.select(F.col("doc_id").cast("long").alias("__label_id"), F.col("quality").cast("int").alias("__label"))
        .where("__label IS NOT NULL AND __label_id IS NOT NULL")
        .groupBy("__label_id").agg(F.min("__label").alias("__label"))
        .join(narrow.select("__id"), F.col("__label_id") == F.col("__id"), "left_semi")
    )
    known = marked.agg(F.avg("__label")).first()[0]
    rows = []
    for value in (0, 1):
        # the sample of ids is bounded, so it may be broadcast
        some = marked.where(F.col("__label") == value).orderBy(F.xxhash64("__label_id"), "__label_id").limit(per_class)
        rows += (
            narrow.join(F.broadcast(some), F.col("__id") == F.col("__label_id"))
            .orderBy(F.xxhash64("__id"), "__id", "__text")
            .limit(per_class)
            .select("__text", "__label")
            .collect()
        )
    return rows, 0.5 if known is None else min(max(known, 0.05), 0.95)


def train(docs: DataFrame, labels: DataFrame, usable: Column, per_class: int = 1500, sample_bytes: int = 1 << 15) -> Network:
    rows, share = sample(docs, labels, usable, per_class, sample_bytes)
    return fit([r["__text"] for r in rows], [r["__label"] for r in rows], share)


def classify(docs: DataFrame, net: Network, held_out: Column, threshold: float = 0.7) -> DataFrame:
    """Score of every text, and 1 where it reaches ``threshold``.

    Null texts count as empty; an empty text is one block of zeros and gets a score
    like any other. Repeated rows are scored each. Without labels the network keeps
    its fixed starting weights.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            parts = [scores(shared.value, piece) for piece in text_slices(rows.column(1))]
            score = np.concatenate(parts) if parts else np.empty(0)
            yield batch(
                {"doc_id": rows.column(0), "held_out": rows.column(2), "score": score,
                 "predicted": (score >= threshold).astype(np.int32)}
            )

    return arrow_map(id_and_text(docs, held_out.alias("held_out")), work, SCHEMA)


def accepted(docs: DataFrame, net: Network, threshold: float = 0.7, text_column: str = "text") -> DataFrame:
    """The rows whose text scores ``threshold`` or more, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    place = docs.columns.index(text_column)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            parts = [scores(shared.value, piece) for piece in text_slices(rows.column(place))]
            if parts:
                yield rows.filter(pa.array(np.concatenate(parts) >= threshold))

    return arrow_map(docs, work, docs.schema)


@query("op7_quality")
def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = in_fold("doc_id", 4, 2)
    return classify(docs, train(docs, table(spark, folder, "labels"), ~held_out), held_out)
