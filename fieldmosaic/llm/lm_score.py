"""Language-model scores by deleted interpolation.

Bigram, unigram and uniform estimates are mixed; the weights depend on how often the
context was seen (a bucket per doubling) and are learned by expectation-maximisation.
For that one fold of the training documents is held out: its counts are deleted, and the
tokens of its documents are predicted from the rest.

Documents are cut into blocks that are written once as token numbers and the block's
sorted word hashes. Every block sends its distinct n-grams, split by hash into buckets;
a bucket adds up the counts of all blocks and sends each block the totals in the order
in which the block named its n-grams. So each n-gram travels once per block, and
everything that is gathered grows with the corpus. Inputs beyond a few hundred gigabytes want
larger blocks (BLOCK_TOKENS), so that a block's rows for the buckets stay worth sending.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import SPACED, mixed, text_slices, words
from .frames import arrow_map, batch, buckets_for, id_and_text, in_fold, input_bytes, table, written
from .registry import query

#: Kinds of documents; a block holds one kind only.
TRAIN, DELETED, TEST = 0, 1, 2
BLOCK_TOKENS = 1 << 20
BEGIN = np.uint64(1)  # stands before the first token of a document
END = np.uint64(2)
LEVELS = 24  # context buckets
CELLS = 64  # per axis, of the held-out table
STEP = 0.15  # decades per cell
ROUNDS = 50


@dataclass
class Block:
    """Documents of one kind: distinct words by hash, and tokens as their numbers."""

    kind: int
    words: np.ndarray  # sorted uint64
    tokens: np.ndarray  # uint32, the end token included
    ends: np.ndarray  # tokens up to and with each document
    doc_ids: pa.Array

    def contexts(self) -> np.ndarray:
        """Number of each token's predecessor; BEGIN is the number after the last word."""
        before = np.empty(len(self.tokens), np.int64)
        before[1:] = self.tokens[:-1]
        before[np.concatenate([[0], self.ends[:-1]])] = len(self.words)
        return before

    def pairs(self) -> np.ndarray:
        """Hash of every (predecessor, token)."""
        names = np.append(self.words, BEGIN)
        return mixed(names[self.contexts()] * np.uint64(0xA0761D6478BD642F) + self.words[self.tokens])


_BLOCK = "block long, kind int, words binary, tokens binary, ends binary, doc_ids array<long>"


def _packed(values: np.ndarray) -> bytes:
    """Numbers with their first bytes, their second bytes and so on together, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _numbers(value: pa.Scalar, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(value.as_py()), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def _packed_sorted(hashes: np.ndarray) -> bytes:
    return _packed(np.diff(hashes, prepend=np.uint64(0)))


def _sorted_numbers(value: pa.Scalar) -> np.ndarray:
    return np.cumsum(_numbers(value, np.uint64), dtype=np.uint64)


def _blocks(docs: DataFrame, kind: Column) -> DataFrame:
    """Documents as written blocks of about BLOCK_TOKENS tokens; one longer document makes a longer block."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: dict[int, list] = {k: [] for k in (TRAIN, DELETED, TEST)}
        sizes = dict.fromkeys(held, 0)

        def flush(kind: int) -> pa.RecordBatch:
            nonlocal number
            hashes = np.concatenate([h for h, _, _ in held[kind]])
            lengths = np.concatenate([n for _, n, _ in held[kind]])
            ids = pa.concat_arrays([i for _, _, i in held[kind]])
            names, tokens = np.unique(hashes, return_inverse=True)
            held[kind], sizes[kind] = [], 0
            number += 1
            return batch(
                {"block": [number], "kind": np.array([kind], np.int32), "words": [_packed_sorted(names)],
                 "tokens": [_packed(tokens.astype(np.uint32))], "ends": [np.cumsum(lengths).astype(np.int64).tobytes()],
                 "doc_ids": pa.array([ids], pa.list_(pa.int64()))}
            )

        for rows in batches:
            kinds = rows.column(2).to_numpy()
            for piece in text_slices(rows.column(1)):
                found = words(piece, SPACED)
                count = piece.last - piece.first
                counts = np.diff(found.starts)
                # an end token behind each document
                hashes = np.insert(np.where(found.hashes <= END, found.hashes + np.uint64(8), found.hashes), found.starts[1:], END)
                owner = np.repeat(np.arange(count), counts + 1)
                for k in held:
                    mine = kinds[piece.first : piece.last] == k
                    if mine.any():
                        ids = rows.column(0).slice(piece.first, count).filter(pa.array(mine))
                        held[k].append((hashes[mine[owner]], counts[mine] + 1, ids))
                        sizes[k] += int((counts[mine] + 1).sum())
                        if sizes[k] >= BLOCK_TOKENS:
                            yield flush(k)
        for k in held:
            if held[k]:
                yield flush(k)

    return written(arrow_map(id_and_text(docs, kind.alias("kind")), work, _BLOCK), "token-blocks", "uncompressed")


def _read_blocks(batches: Iterator[pa.RecordBatch], rest: bool = False) -> Iterator[tuple]:
    for rows in batches:
        for i in range(len(rows)):
            at = {name: rows.column(name)[i] for name in rows.schema.names}
            block = Block(
                at["kind"].as_py(), _sorted_numbers(at["words"]), _numbers(at["tokens"], np.uint32),
                np.frombuffer(at["ends"].as_buffer(), np.int64), at["doc_ids"].values,
            )
            yield (at["block"].as_py(), block, at["totals"]) if rest else (at["block"].as_py(), block)


def _bucketed(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where the n-grams of each bucket begin in sorted hashes (buckets are equal ranges)."""
    edges = np.array([(i << 64) // buckets for i in range(1, buckets)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(hashes, edges), [len(hashes)]])


def _named(block: Block, buckets: int) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Distinct words and pairs of a block, their counts, where each token finds them, and bucket cuts."""
    pairs, at, counts = np.unique(block.pairs(), return_inverse=True, return_counts=True)
    grams = [block.words, pairs]
    tallies = [np.bincount(block.tokens, minlength=len(block.words)), counts]
    return grams, tallies, [block.tokens, at], [_bucketed(g, buckets) for g in grams]


def _totals(blocks: DataFrame, buckets: int) -> DataFrame:
    """Per block and bucket: corpus counts of the block's words and pairs, in its own order.

    Counts are (training without the deleted fold, deleted fold). Along with them
    comes per bucket what the corpus has there: distinct training words and tokens.
    """

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block in _read_blocks(batches):
            grams, tallies, _, cuts = _named(block, buckets)
            rows: dict[str, list] = {"block": [], "kind": [], "bucket": [], "words": [], "pairs": [], "counts": []}
            for b in range(buckets):
                spans = [slice(c[b], c[b + 1]) for c in cuts]
                if spans[1].stop > spans[1].start or spans[0].stop > spans[0].start:
                    rows["block"].append(number), rows["kind"].append(block.kind), rows["bucket"].append(b)
                    rows["words"].append(_packed_sorted(grams[0][spans[0]])), rows["pairs"].append(_packed_sorted(grams[1][spans[1]]))
                    rows["counts"].append(_packed(np.concatenate([t[s] for t, s in zip(tallies, spans)]).astype(np.uint32)))
            yield batch(rows, block=pa.int64(), kind=pa.int32(), bucket=pa.int32())

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the rows of a partition are a few buckets; each n-gram occurs once per block
        numbers, kinds, names, parts = [], [], [], []
        for rows in batches:
            numbers += rows.column("block").to_pylist()
            kinds += rows.column("kind").to_pylist()
            names += rows.column("bucket").to_pylist()
            for i in range(len(rows)):
                w, p = (_sorted_numbers(rows.column(c)[i]) for c in ("words", "pairs"))
                parts.append((w, p, _numbers(rows.column("counts")[i], np.uint32)))
        for bucket in sorted(set(names)):
            mine = [i for i, b in enumerate(names) if b == bucket]
            summed = []
            for which in (0, 1):
                grams = [parts[i][which] for i in mine]
                tallies = [parts[i][2][: len(parts[i][0])] if which == 0 else parts[i][2][len(parts[i][0]) :] for i in mine]
                distinct, at = np.unique(np.concatenate(grams), return_inverse=True)
                owner = np.repeat([kinds[i] for i in mine], [len(g) for g in grams])
                tally = np.concatenate(tallies)
                both = [np.bincount(at[owner == k], weights=tally[owner == k], minlength=len(distinct)).astype(np.int64) for k in (TRAIN, DELETED)]
                summed.append((both, at, np.cumsum([0, *[len(g) for g in grams]])))
            trained = summed[0][0][0] + summed[0][0][1]
            facts = np.array([np.count_nonzero(trained), trained.sum(), np.count_nonzero(summed[0][0][0]), summed[0][0][0].sum()])
            for turn, i in enumerate(mine):
                pieces = [both[k][at[cut[turn] : cut[turn + 1]]] for both, at, cut in summed for k in (TRAIN, DELETED)]
                yield batch(
                    {"block": [numbers[i]], "kind": [kinds[i]], "bucket": [bucket], "totals": [_packed(np.concatenate(pieces))],
                     "facts": [facts.tolist() if turn == 0 else None]},
                    block=pa.int64(), kind=pa.int32(), bucket=pa.int32(), facts=pa.list_(pa.int64()),
                )

    rows = arrow_map(blocks, name, "block long, kind int, bucket int, words binary, pairs binary, counts binary")
    summed = arrow_map(rows.repartition(buckets, "bucket"), add, "block long, kind int, bucket int, totals binary, facts array<long>")
    return written(summed, "totals", "uncompressed")


def _found(block: Block, totals: pa.Scalar, buckets: int) -> tuple[np.ndarray, ...]:
    """Per token: counts of the word, its context and the pair, each (training, deleted fold)."""
    _, _, places, cuts = _named(block, buckets)
    word = np.zeros((2, len(block.words)), np.int64)
    pair = np.zeros((2, int(cuts[1][-1])), np.int64)
    for entry in totals.values:
        b, values = entry["bucket"].as_py(), _numbers(entry["totals"], np.int64)
        (w0, w1), (p0, p1) = ((c[b], c[b + 1]) for c in cuts)
        n, m = w1 - w0, p1 - p0
        word[0, w0:w1], word[1, w0:w1] = values[:n], values[n : 2 * n]
        pair[0, p0:p1], pair[1, p0:p1] = values[2 * n : 2 * n + m], values[2 * n + m :]
    return word[:, places[0]], word, pair[:, places[1]]


def _context_counts(block: Block, word: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Counts of each token's context; a document's begin was seen once per training document."""
    return np.concatenate([word, starts[:, None]], axis=1)[:, block.contexts()]


def _level(count: np.ndarray) -> np.ndarray:
    """Context bucket: 0 for an unseen context, then one per doubling."""
    return np.minimum(np.floor(np.log2(np.maximum(count, 0.5))).astype(np.int64) + 1, LEVELS - 1)


def _cell(chance: np.ndarray) -> np.ndarray:
    """Cell of a probability on a logarithmic scale; 0 for zero."""
    return np.where(chance > 0, np.clip(CELLS - 1 + np.round(np.log10(np.maximum(chance, 1e-300)) / STEP), 1, CELLS - 1), 0).astype(np.int64)


def _in_cell(cell: np.ndarray) -> np.ndarray:
    return np.where(cell > 0, 10.0 ** ((cell - CELLS + 1) * STEP), 0.0)


def learn(table: np.ndarray, uniform: float) -> np.ndarray:
    """Weights (bigram, unigram, uniform) of each context bucket from held-out counts.

    ``table`` counts held-out tokens by context bucket and by the cells of their
    bigram and unigram estimates. Buckets without tokens take the next one's weights.
    """
    weights = np.full((LEVELS, 3), 1 / 3)
    cells = _in_cell(np.arange(CELLS))
    parts = np.stack(np.broadcast_arrays(cells[:, None], cells[None, :], uniform), axis=-1).reshape(-1, 3)
    for level in range(LEVELS):
        count = table[level].reshape(-1).astype(float)
        if not count.sum():
            weights[level] = weights[level - 1] if level else (0, 0.9, 0.1)
            continue
        mix = np.array([1 / 3] * 3) if level else np.array([0, 0.5, 0.5])
        for _ in range(ROUNDS):
            share = parts * mix
            share /= share.sum(axis=1, keepdims=True)
            mix = (share * count[:, None]).sum(axis=0) / count.sum()
        weights[level] = np.maximum(mix, 1e-9)
        if not level:
            weights[level, 0] = 0
        weights[level] /= weights[level].sum()
    return weights


def score_documents(docs: DataFrame, training: Column, deleted: Column, held_out: Column, buckets: int | None = None) -> DataFrame:
    """Log10 probability of every text under the model and under add-one unigrams.

    Tokens are runs of bytes that are no white space, A-Z lower-cased, and one end. A
    null or empty text is the end alone. Repeated rows are scored each, and count each
    in training. Without training documents every token has the uniform probability.
    """
    spark = docs.sparkSession
    if buckets is None:
        buckets = buckets_for(spark, input_bytes(docs.select(F.col("text").cast("string").alias("text"))), 1 << 24, BLOCK_TOKENS // 512)
    kind = F.when(~training, TEST).when(deleted, DELETED).otherwise(TRAIN).cast("int")
    blocks = _blocks(docs, kind)
    totals = _totals(blocks, buckets)
    facts = totals.where(F.col("facts").isNotNull()).select(*[F.sum(F.col("facts")[i]) for i in range(4)]).first()
    distinct, tokens, kept_distinct, kept_tokens = (int(x or 0) for x in facts)
    per_kind = {r["kind"]: r["docs"] for r in blocks.groupBy("kind").agg(F.sum(F.size("doc_ids")).alias("docs")).collect()}
    starts = np.array([per_kind.get(TRAIN, 0), per_kind.get(DELETED, 0)], np.int64)
    answers = totals.groupBy("block").agg(F.collect_list(F.struct("bucket", "totals")).alias("totals"))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(LEVELS * CELLS * CELLS, np.int64)
        for _, block, mine in _read_blocks(batches, rest=True):
            word, every, pair = _found(block, mine, buckets)
            context = _context_counts(block, every, starts)[TRAIN]
            place = (_level(context) * CELLS + _cell(pair[TRAIN] / np.maximum(context, 1))) * CELLS + _cell(word[TRAIN] / max(kept_tokens, 1))
            seen += np.bincount(place, minlength=len(seen))
        used = np.flatnonzero(seen)
        yield batch({"cell": used.astype(np.int32), "tokens": seen[used]})

    cells = arrow_map(blocks.where(F.col("kind") == DELETED).join(answers, "block"), held, "cell int, tokens long")
    seen = np.zeros(LEVELS * CELLS * CELLS, np.int64)
    for row in cells.groupBy("cell").agg(F.sum("tokens").alias("tokens")).collect():  # one row per cell at most
        seen[row["cell"]] = row["tokens"]
    weights = learn(seen.reshape(LEVELS, CELLS, CELLS), 1 / (kept_distinct + 1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block, mine in _read_blocks(batches, rest=True):
            word, every, pair = (x.sum(axis=0) for x in _found(block, mine, buckets))
            context = np.append(every, starts.sum())[block.contexts()]
            mix = weights[_level(context)]
            chance = mix[:, 0] * pair / np.maximum(context, 1) + mix[:, 1] * word / max(tokens, 1) + mix[:, 2] / (distinct + 1)
            if not tokens:
                chance = np.full(len(word), 1 / (distinct + 1))
            first = np.concatenate([[0], block.ends[:-1]])
            yield batch(
                {"doc_id": block.doc_ids, "held_out": np.full(len(first), block.kind == TEST), "n_tokens": np.diff(np.append(first, block.ends[-1])),
                 "n_known": np.add.reduceat((word > 0).astype(np.int64), first), "train_tokens": np.full(len(first), tokens),
                 "base_score": np.add.reduceat(np.log10((word + 1) / (tokens + distinct + 1)), first),
                 "score": np.add.reduceat(np.log10(chance), first)}
            )

    return arrow_map(
        blocks.join(answers, "block"), score,
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )


@query("op10_lm_score")
def op10_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    held_out = in_fold("doc_id", 7, 2)
    return score_documents(table(spark, folder, "documents"), ~held_out, in_fold("doc_id", 7, 5), held_out)
