"""Language identification with interpolated Kneser-Ney character models.

One model per language, all in the same sorted hash arrays: per order, the sorted
64-bit hashes of the n-grams of any language and a matrix of log probabilities,
and the sorted hashes of the contexts with their interpolation weights. A text
gets the language of lowest cross-entropy per character. Temperature (confidence)
and rejection limits come from sample texts that the counts do not include.

The sample is bounded: ``per_language`` texts of at most ``sample_bytes`` bytes for
each language, the lowest by hash of their id, so the model does not grow with the
corpus. Every text is scored whole.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrays import Slice, gram_hashes, mixed, text_slices
from .frames import arrow_map, batch, id_and_text, in_fold, table
from .registry import query

ORDER = 4
UNKNOWN = "und"
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, cross_entropy double, accepted boolean"

_SPACE = 32
_tables: list[np.ndarray] = []


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: its lower-case form (space unless a letter or mark), and whether it is a letter."""
    if not _tables:
        form = np.full(0x110000, _SPACE, dtype=np.uint32)
        letter = np.zeros(0x110000, dtype=bool)
        for code in range(0x110000):
            kind = unicodedata.category(chr(code))[0]
            if kind in "LM":
                low = chr(code).lower()
                form[code] = ord(low) if len(low) == 1 else code
                letter[code] = kind == "L"
        _tables.extend((form, letter))
    return _tables[0], _tables[1]


@dataclass
class Characters:
    """Normalised texts, each behind ORDER - 1 spaces; runs of other characters are one space."""

    codes: np.ndarray
    scored: np.ndarray  # positions that are predicted
    owner: np.ndarray  # text of each position
    letters: np.ndarray  # letters per text


def characters(piece: Slice) -> Characters:
    form, is_letter = _letters()
    count = len(piece.starts) - 1
    raw = piece.data.tobytes()
    try:
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        heads = np.concatenate([[0], np.cumsum((piece.data & 0xC0) != 0x80)])
        starts = heads[piece.starts]
    except UnicodeDecodeError:
        texts = [
            np.frombuffer(raw[a:b].decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
            for a, b in zip(piece.starts[:-1], piece.starts[1:])
        ]
        points = np.concatenate(texts) if texts else np.empty(0, np.uint32)
        starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    owner = np.repeat(np.arange(count), np.diff(starts))
    letters = np.bincount(owner[is_letter[points]], minlength=count)
    codes = form[points]
    gap = codes == _SPACE
    first = np.zeros(len(codes), dtype=bool)
    first[starts[:-1][starts[:-1] < len(codes)]] = True
    keep = ~gap
    keep[1:] |= ~gap[:-1]
    keep[first & gap] = False
    codes, owner = codes[keep], owner[keep]
    pad = ORDER - 1
    starts = np.searchsorted(owner, np.arange(count + 1))
    size = len(codes) + pad * count
    place = np.arange(len(codes)) + pad * (owner + 1)
    out = np.full(size, _SPACE, dtype=np.uint64)
    out[place] = codes
    return Characters(out, place, owner, letters)


def _keys(codes: np.ndarray, place: np.ndarray, orders: int) -> list[np.ndarray]:
    """Hashes of the n-grams that end at each place, for n = 1 .. orders."""
    return [gram_hashes(codes, n)[place - (n - 1)] for n in range(1, orders + 1)]


@dataclass
class Model:
    languages: list[str]
    grams: list[np.ndarray]  # per order, sorted hashes
    logs: list[np.ndarray]  # per order, log2 p (n-grams x languages)
    contexts: list[np.ndarray]  # per order, sorted hashes
    weights: list[np.ndarray]  # per order, log2 of the weight of the lower order
    floor: np.ndarray  # log2 p of an unseen character
    temperature: float = 1.0
    limits: np.ndarray | None = None  # per language, highest accepted cross-entropy

    def score(self, chars: Characters, texts: int) -> np.ndarray:
        """Cross-entropy in bits per character (texts x languages); texts without letters are NaN."""
        width = len(self.languages)
        total = np.zeros((texts, width))
        # a block at a time keeps the gathered rows small
        for begin in range(0, len(chars.scored), 1 << 18):
            place, owner = chars.scored[begin : begin + (1 << 18)], chars.owner[begin : begin + (1 << 18)]
            logs = self._logs(chars.codes, place)
            cuts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            total[owner[cuts]] += np.add.reduceat(logs, cuts, axis=0, dtype=np.float64)
        size = np.bincount(chars.owner, minlength=texts)[:, None]
        return np.where((chars.letters > 0)[:, None], -total / np.maximum(size, 1), np.nan)

    def _logs(self, codes: np.ndarray, place: np.ndarray) -> np.ndarray:
        out = np.zeros((len(place), len(self.languages)), dtype=np.float32)
        left = np.arange(len(place))
        for n in range(ORDER, 0, -1):
            keys = _gram_at(codes, place[left], n)
            at, hit = _look(self.grams[n - 1], keys)
            out[left[hit]] += self.logs[n - 1][at[hit]]
            left = left[~hit]
            if not len(left):
                return out
            if n > 1:
                at, hit = _look(self.contexts[n - 1], _gram_at(codes, place[left] - 1, n - 1))
                out[left[hit]] += self.weights[n - 1][at[hit]]
        out[left] += self.floor
        return out


def _gram_at(codes: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n codes that end at each place."""
    if len(place) * 4 > len(codes) and n > 1:
        low = int(place[0]) - (n - 1)
        return gram_hashes(codes[low : int(place[-1]) + 1], n)[place - (n - 1) - low]
    out = np.full(len(place), n, dtype=np.uint64)
    for step in range(n - 1, -1, -1):
        out = out * np.uint64(0xA0761D6478BD642F) + codes[place - step]
    return mixed(out)


def _look(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def fit(texts: Sequence[str], languages: Sequence[str]) -> Model:
    """Counts from four of five texts of each language; the rest sets temperature and limits."""
    names = sorted(set(languages))
    rank: dict[str, int] = {}
    use, check = [], []
    for i, name in enumerate(languages):
        rank[name] = rank.get(name, -1) + 1
        (check if rank[name] % 5 == 4 else use).append(i)
    model = _counted([texts[i] for i in use], [names.index(languages[i]) for i in use], names)
    _calibrate(model, [texts[i] for i in check or use], [names.index(languages[i]) for i in check or use])
    return model


def _slices(texts: Sequence[str]) -> Iterator[tuple[int, int, Characters]]:
    for piece in text_slices(pa.array(list(texts), pa.large_string())):
        yield piece.first, piece.last, characters(piece)


def _counted(texts: Sequence[str], labels: Sequence[int], names: list[str]) -> Model:
    width = len(names)
    label = np.array(labels, dtype=np.int64)
    per_order: list[list[tuple[np.ndarray, ...]]] = [[] for _ in range(ORDER)]
    for first, _, chars in _slices(texts):
        keys = _keys(chars.codes, chars.scored, ORDER)
        before = _keys(chars.codes, chars.scored - 1, ORDER - 1)
        for n in range(ORDER):
            gram, at, inverse = np.unique(keys[n], return_index=True, return_inverse=True)
            counts = np.zeros((len(gram), width))
            np.add.at(counts, (inverse, label[first + chars.owner]), 1)
            suffix = keys[n - 1][at] if n else np.zeros(len(gram), np.uint64)
            context = before[n - 1][at] if n else np.zeros(len(gram), np.uint64)
            per_order[n].append((gram, counts, suffix, context))
    grams, counts, suffixes, heads = [], [], [], []
    for parts in per_order:
        every = [np.concatenate(x) for x in zip(*parts)] if parts else [np.empty(0, np.uint64), np.empty((0, width)), np.empty(0, np.uint64), np.empty(0, np.uint64)]
        gram, at, inverse = np.unique(every[0], return_index=True, return_inverse=True)
        summed = np.zeros((len(gram), width))
        np.add.at(summed, inverse, every[1])
        grams.append(gram), counts.append(summed), suffixes.append(every[2][at]), heads.append(every[3][at])
    # below the highest order, a count is the number of different characters seen before the n-gram
    for n in range(ORDER - 1):
        follow = np.zeros_like(counts[n])
        np.add.at(follow, np.searchsorted(grams[n], suffixes[n + 1]), counts[n + 1] > 0)
        counts[n] = follow
    alphabet = max(len(grams[0]), 1) + 1
    contexts, weights, logs, lower = [], [], [], None
    floor = np.full(width, 1 / alphabet)
    for n in range(ORDER):
        once, twice = (counts[n] == 1).sum(axis=0), (counts[n] == 2).sum(axis=0)
        discount = np.clip(once / np.maximum(once + 2 * twice, 1), 0.1, 0.95)
        context, inverse = np.unique(heads[n], return_inverse=True)
        mass, kinds = np.zeros((len(context), width)), np.zeros((len(context), width))
        np.add.at(mass, inverse, counts[n])
        np.add.at(kinds, inverse, counts[n] > 0)
        weight = np.where(mass > 0, discount * kinds / np.maximum(mass, 1), 1.0)
        below = floor[None, :] if lower is None else lower[np.searchsorted(grams[n - 1], suffixes[n])]
        lower = np.maximum(counts[n] - discount, 0) / np.maximum(mass[inverse], 1) + weight[inverse] * below
        if n == 0 and len(weight):
            floor = weight[0] * floor
        contexts.append(context), weights.append(np.log2(weight).astype(np.float32))
        logs.append(np.log2(lower).astype(np.float32))
    return Model(names, grams, logs, contexts, weights, np.log2(floor).astype(np.float32))


def _calibrate(model: Model, texts: Sequence[str], labels: Sequence[int]) -> None:
    rows = [model.score(chars, last - first) for first, last, chars in _slices(texts)]
    entropy = np.concatenate(rows) if rows else np.empty((0, len(model.languages)))
    truth = np.array(labels, dtype=np.int64)
    fine = ~np.isnan(entropy).any(axis=1)
    entropy, truth = entropy[fine], truth[fine]
    best = np.inf
    for temperature in 2.0 ** np.arange(-2, 7):
        chance = _confidence(entropy, temperature)
        loss = -np.log(np.maximum(chance[np.arange(len(truth)), truth], 1e-12)).sum()
        if loss < best - 1e-9:
            best, model.temperature = loss, float(temperature)
    model.limits = np.full(len(model.languages), np.inf)
    for i in range(len(model.languages)):
        own = entropy[truth == i, i]
        if len(own) > 1:
            model.limits[i] = own.mean() + 4 * own.std() + 0.1


def _confidence(entropy: np.ndarray, temperature: float) -> np.ndarray:
    if not entropy.shape[1]:
        return entropy
    power = np.exp(-temperature * (entropy - entropy.min(axis=1, keepdims=True)))
    return power / power.sum(axis=1, keepdims=True)


def sample(docs: DataFrame, usable: Column, per_language: int, sample_bytes: int) -> list:
    """The lowest texts by hash of their id, for each language; bounded by both parameters.

    A hash threshold from each language's count leaves a few times the wanted ids,
    and only these are ranked; texts are read for the chosen ids alone.
    """
    place = F.conv(F.substring(F.sha2(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), 256), 1, 12), 16, 10).cast("double") / float(1 << 48)
    fit_for_use = (
        usable & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") <= sample_bytes)
    )
    narrow = docs.where(fit_for_use).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), place.alias("place")
    )
    counts = narrow.groupBy("lang").agg(F.count("*").alias("texts")).withColumnRenamed("lang", "counted")
    few = narrow.join(F.broadcast(counts), F.col("lang") == F.col("counted")).where(F.col("place") * F.col("texts") <= 4 * per_language + 16)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id"))
    chosen = (
        few.select("lang", "place", "doc_id").distinct().withColumn("rank", rank).where(F.col("rank") <= per_language)
        .select(F.col("doc_id").alias("chosen"), F.col("lang").alias("counted"))
    )
    # at most per_language ids for each language: small enough to send everywhere
    return (
        docs.where(fit_for_use)
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
        .join(F.broadcast(chosen), (F.col("doc_id") == F.col("chosen")) & (F.col("lang") == F.col("counted")))
        .select("lang", "text").distinct()
        .orderBy("lang", "text")
        .collect()
    )


def identify(docs: DataFrame, model: Model, held_out: Column, minimum: float = 0.0) -> DataFrame:
    """Language, confidence and cross-entropy of every text.

    Null or empty texts and texts without a letter are ``und`` with score 0. Ties
    go to the first language in sort order. ``accepted`` is false where the
    cross-entropy is above the language's limit or the score below ``minimum``.
    Without any learned language every text is ``und``. Repeated rows are scored each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for rows in batches:
            parts = [model.score(characters(p), p.last - p.first) for p in text_slices(rows.column(1))]
            entropy = np.concatenate(parts) if parts else np.empty((0, len(model.languages)))
            count = len(rows)
            known = np.zeros(count, bool) if not model.languages else ~np.isnan(entropy[:, 0])
            lang, score = np.full(count, UNKNOWN, dtype=object), np.zeros(count)
            lowest, accepted = np.full(count, np.nan), np.zeros(count, bool)
            if known.any():
                found = entropy[known]
                pick = found.argmin(axis=1)
                lang[known] = np.array(model.languages, dtype=object)[pick]
                score[known] = _confidence(found, model.temperature)[np.arange(len(pick)), pick]
                lowest[known] = found[np.arange(len(pick)), pick]
                accepted[known] = (lowest[known] <= model.limits[pick]) & (score[known] >= minimum)
            yield batch(
                {"doc_id": rows.column(0), "held_out": rows.column(2), "lang_pred": lang.tolist(), "score": score,
                 "cross_entropy": pa.array(lowest, from_pandas=True), "accepted": accepted},
                lang_pred=pa.string(),
            )

    return arrow_map(id_and_text(docs, held_out.alias("held_out")), work, SCHEMA)


def train(docs: DataFrame, usable: Column, per_language: int = 400, sample_bytes: int = 1 << 16) -> Model:
    rows = sample(docs, usable, per_language, sample_bytes)
    return fit([r["text"] for r in rows], [r["lang"] for r in rows])


@query("op2_language_id")
def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = in_fold("doc_id", 4, 2)
    return identify(docs, train(docs, ~held_out), held_out)
