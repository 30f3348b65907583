"""Divergence of the sources of a language, counted through a transducer of its vocabulary.

The vocabulary of a language is kept as minimal acyclic transducers: states with equal
continuations are one state, and the outputs met on the way to a term add up to its
lexicographic ordinal. They are built from the sorted kept terms, ``BLOCK_TERMS`` at a time,
so a task holds one block whatever the size of a vocabulary. Text is then streamed through
them, all words of a slice in step, to count the kept terms of every source again; from
there on a term is its ordinal, which also orders equal values.

Transducers travel to the tasks in loads of at most ``LOAD_BYTES``; a larger vocabulary
takes as many passes over the texts as it has loads.

Shares are whole numbers, ``1 + floor(10^9 (count + 2) / (total + 2 terms))``, and two shares
p and q differ by ``floor((p - q)^2 / (p + q))``. Sums over all terms of two sources are made
per block of terms and pair of tiles of sources, so no task sees all sources or all terms.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrays import Slice, mixed, prefix_hashes, span_hashes, strings, text_slices, word_spans
from .frames import arrow_map, batch, table, written
from .registry import query

LEAST_DOCUMENTS = 10
TOP_TERMS = 10
BLOCK_TERMS = 65_536  # kept terms of one transducer
LOAD_BYTES = 96 << 20  # tables of the transducers that a task holds at once
TERM_BLOCK = 8_192  # terms of one task of the pair sums
TILE = 64  # sources, about, of one side of such a task
WHOLE = 1_000_000_000
_TEXT_SLICE = 2 << 20
_HELD = 1 << 20  # counts a task holds before it sends them on

#: Terms are maximal runs of letters a-z, A-Z and bytes beyond ASCII.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[0x61:0x7B] = True
LETTERS[0x80:] = True


@dataclass
class Transducer:
    """Tables by (state, class of byte): next state (0 is dead) and what to add to the ordinal."""

    classes: np.ndarray  # of each byte; 0 occurs in no term
    width: int
    following: np.ndarray
    adding: np.ndarray
    final: np.ndarray
    longest: int

    START = 1

    def ordinals(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Ordinal of each span of bytes, -1 where it is no term."""
        size = end - begin
        out = np.full(len(begin), -1, dtype=np.int64)
        order = np.argsort(-size, kind="stable")
        order = order[np.searchsorted(-size[order], -self.longest, side="left") :]
        if not len(order):
            return out
        at, left = begin[order], size[order]
        state = np.full(len(order), self.START, dtype=np.int64)
        total = np.zeros(len(order), dtype=np.int64)
        live = np.searchsorted(-left, -np.arange(int(left[0]) + 1), side="left")  # words longer than each place
        kinds = self.classes[data]
        for place in range(int(left[0])):
            some = slice(0, live[place])
            cell = state[some] * self.width + kinds[at[some] + place]
            total[some] += self.adding[cell]
            state[some] = self.following[cell]
        known = self.final[state]
        out[order[known]] = total[known]
        return out


def transducer(terms: Sequence[bytes]) -> Transducer:
    """The minimal acyclic transducer of sorted distinct terms; the i-th has ordinal i.

    Terms are added in order. When a term leaves the path of the last one, the states of the
    part that is left can change no more, and each is replaced by an equal state seen before.
    """
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = [(False, ())]  # settled ones, after the dead state
    path: list[tuple[bool, list[tuple[int, int]]]] = [(False, [])]  # open states along the last term
    last = b""

    def settle(down_to: int) -> None:
        while len(path) > down_to + 1:
            final, arcs = path.pop()
            key = (final, tuple(arcs))
            number = register.get(key)
            if number is None:
                number = register[key] = len(states)
                states.append(key)
            path[-1][1].append((last[len(path) - 1], number))

    for term in terms:
        shared = 0
        while shared < min(len(term), len(last)) and term[shared] == last[shared]:
            shared += 1
        settle(shared)
        path.extend((False, []) for _ in range(len(term) - shared))
        path[len(term)] = (True, path[len(term)][1])
        last = term
    settle(0)
    start = len(states)
    states.append((path[0][0], tuple(path[0][1])))
    return _tables(states, start, max(map(len, terms), default=0))


def _tables(states: list[tuple[bool, tuple[tuple[int, int], ...]]], start: int, longest: int) -> Transducer:
    used = sorted({byte for _, arcs in states for byte, _ in arcs})
    classes = np.zeros(256, dtype=np.int64)
    classes[used] = np.arange(1, len(used) + 1)
    width = len(used) + 1
    # the start becomes state 1; settled states keep their order behind it, so an arc leads to a lower count first
    number = [0] + [n + 1 for n in range(1, start)] + [Transducer.START]
    following = np.zeros((len(states), width), dtype=np.int32)
    adding = np.zeros((len(states), width), dtype=np.int32)
    final = np.zeros(len(states), dtype=bool)
    words = [0] * len(states)  # terms that a state leads to; arcs lead to states settled before
    for n in range(1, len(states)):
        ends, arcs = states[n]
        passed = int(ends)
        for byte, to in arcs:
            following[number[n], classes[byte]] = number[to]
            adding[number[n], classes[byte]] = passed
            passed += words[to]
        final[number[n]] = ends
        words[n] = passed
    return Transducer(classes, width, following.reshape(-1), adding.reshape(-1), final, longest)


def _texts(docs: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])


def _coded(values: list[str]) -> tuple[list[str], np.ndarray]:
    """Distinct values in order of appearance, and the number of each value among them."""
    seen: dict[str, int] = {}
    codes = np.array([seen.setdefault(v, len(seen)) for v in values], dtype=np.int64)
    return list(seen), codes


def _terms(piece: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of a slice, begin and end of each term, and the row it lies in."""
    data, begin, end, starts = word_spans(piece, LETTERS)
    return data, begin, end, np.repeat(np.arange(len(starts) - 1), np.diff(starts))


def kept_terms(texts: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """``(lang, term)`` of terms in at least so many documents of a language.

    A task counts the documents of its own slices first, by 64-bit hash of the term; the term's bytes travel.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            langs, code = _coded(strings(rows.column(0)))
            for piece in text_slices(rows.column(1), _TEXT_SLICE):
                data, begin, end, row = _terms(piece)
                if not len(begin):
                    continue
                hashes = span_hashes(prefix_hashes(data), begin, end)
                # once a document, then how many documents of the language
                once = np.unique(mixed(hashes + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
                spoken = code[piece.first + row[once]]
                _, first, docs = np.unique(
                    mixed(hashes[once] ^ (spoken.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))), return_index=True, return_counts=True
                )
                pick = once[first]
                raw = data.tobytes()
                yield batch({
                    "lang": pa.array(langs).take(pa.array(spoken[first])),
                    "term": pa.array([raw[b:e] for b, e in zip(begin[pick].tolist(), end[pick].tolist())], pa.binary()),
                    "docs": docs.astype(np.int64),
                })

    counted = arrow_map(texts.select("lang", "text"), work, "lang string, term binary, docs long")
    return counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least).select("lang", "term")


def numbered_terms(kept: DataFrame) -> DataFrame:
    """``(lang, term, ordinal)``: ordinals are dense per language, in byte order of the terms.

    Terms are dealt into ranges of the sort order; only the number of terms of each language and
    range is added up across ranges.
    """
    place = F.monotonically_increasing_id()
    cut = kept.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    sliced = written(cut.select("lang", "term", F.spark_partition_id().alias("slice"), place.alias("place")), "terms")
    ranges = sliced.groupBy("lang", "slice").agg(F.count("*").alias("terms"), F.min("place").alias("first_place"))
    earlier = Window.partitionBy("lang").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("lang", "slice", "first_place", F.coalesce(F.sum("terms").over(earlier), F.lit(0)).alias("before"))
    return sliced.join(offsets, ["lang", "slice"]).select("lang", "term", (F.col("before") + F.col("place") - F.col("first_place")).alias("ordinal"))


def transducers(terms: DataFrame, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``(lang, block, machine, bytes)``: the transducer of each run of ordinals, compressed, and the size of its tables."""

    def build(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        ordered = rows.sort_by("ordinal").column("term").to_pylist()
        machine = pickle.dumps(transducer(ordered), protocol=5)
        packed = pa.array([zlib.compress(machine, 1)], pa.binary())
        return pa.table({"lang": [key[0].as_py()], "block": [key[1].as_py()], "machine": packed, "bytes": [len(machine)]})

    keyed = terms.withColumn("block", F.expr(f"ordinal div {block_terms}"))
    return keyed.groupBy("lang", "block").applyInArrow(build, "lang string, block long, machine binary, bytes long")


def _loads(machines: DataFrame, most: int) -> list[list[tuple[str, int]]]:
    """Blocks of the vocabularies in groups of at most so many bytes."""
    loads: list[list[tuple[str, int]]] = []
    size = most
    for row in machines.select("lang", "block", "bytes").orderBy("lang", "block").toLocalIterator():
        if size + row["bytes"] > most:
            loads.append([])
            size = 0
        loads[-1].append((row["lang"], row["block"]))
        size += row["bytes"]
    return loads


def recounted(texts: DataFrame, machines: DataFrame, block_terms: int = BLOCK_TERMS, load_bytes: int = LOAD_BYTES) -> DataFrame:
    """``(lang, source, ordinal, n)`` of kept terms that occur, by streaming every text through the transducers."""
    spark = texts.sparkSession
    counts = None
    for load in _loads(machines, load_bytes):
        wanted = [F.struct(F.lit(lang), F.lit(block).cast("long")) for lang, block in load]
        # tables of at most ``load_bytes``, or one block, and compressed
        rows = machines.where(F.struct("lang", "block").isin(wanted)).select("lang", "block", "machine").collect()
        sent = spark.sparkContext.broadcast([tuple(r) for r in rows])
        part = arrow_map(texts.select("lang", "source", "text"), _recount(sent, block_terms), "lang string, source string, ordinal long, n long")
        counts = part if counts is None else counts.unionByName(part)
    if counts is None:
        return spark.createDataFrame([], "lang string, source string, ordinal long, n long")
    return counts.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n"))


def _recount(sent, block_terms: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines: dict[str, list[tuple[int, Transducer]]] = {}
        for lang, block, machine in sent.value:
            machines.setdefault(lang, []).append((block * block_terms, pickle.loads(zlib.decompress(machine))))
        groups: dict[tuple[str, str], int] = {}
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def send() -> pa.RecordBatch:
            group, ordinal, n = _added(held)
            names = list(groups)
            out = batch({
                "lang": pa.array([a for a, _ in names]).take(pa.array(group)), "source": pa.array([b for _, b in names]).take(pa.array(group)),
                "ordinal": ordinal, "n": n,
            })
            held.clear()
            groups.clear()
            return out

        for rows in batches:
            langs, code = _coded(strings(rows.column(0)))
            sources = strings(rows.column(1))
            for piece in text_slices(rows.column(2), _TEXT_SLICE):
                data, begin, end, row = _terms(piece)
                row = row + piece.first
                owner = np.array([groups.setdefault((langs[code[r]], sources[r]), len(groups)) for r in range(piece.first, piece.last)], dtype=np.int64)
                for number, lang in enumerate(langs):
                    mine = np.flatnonzero(code[row] == number)
                    for first, machine in machines.get(lang, ()) if len(mine) else ():
                        ordinal = machine.ordinals(data, begin[mine], end[mine])
                        known = np.flatnonzero(ordinal >= 0)
                        held.append(_added([(owner[row[mine[known]] - piece.first], ordinal[known] + first, np.ones(len(known), np.int64))]))
                        size += len(held[-1][0])
                if size > _HELD:
                    held[:] = [_added(held)]
                    size = len(held[0][0])
                    if size > _HELD // 2:
                        yield send()
                        size = 0
        if held:
            yield send()

    return work


def _added(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts by (group, ordinal), each pair once."""
    group, ordinal, n = (np.concatenate([p[i] for p in parts]) for i in range(3))
    if not len(group):
        return group, ordinal, n
    order = np.lexsort((ordinal, group))
    group, ordinal, n = group[order], ordinal[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (ordinal[1:] != ordinal[:-1])]))
    return group[first], ordinal[first], np.add.reduceat(n, first)


def shares(count: np.ndarray, total: np.ndarray | int, terms: int) -> np.ndarray:
    """``1 + floor(10^9 (count + 2) / (total + 2 terms))``, digit by digit so that no product passes 64 bits."""
    whole = np.asarray(total, dtype=np.int64) + 2 * terms
    left = np.asarray(count, dtype=np.int64) + 2
    out = left // whole
    left = left % whole
    for _ in range(9):
        left = left * 10
        out = out * 10 + left // whole
        left = left % whole
    return out + 1


def _pair_sums(term_block: int):
    """Sums over a block of terms for all pairs of a tile of sources, or of two tiles."""

    def work(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        lang, block, low, high = (k.as_py() for k in key)
        source = rows.column("source").combine_chunks().dictionary_encode()
        tile, total, ordinal, n = (rows.column(c).to_numpy() for c in ("tile", "total", "ordinal", "n"))
        terms = int(rows.column("terms")[0].as_py())
        width = max(0, min(term_block, terms - block * term_block))
        names, code = source.dictionary.to_pylist(), source.indices.to_numpy()
        at_tile, totals = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        at_tile[code], totals[code] = tile, total
        counts = np.zeros((len(names), width), dtype=np.int64)
        real = ordinal >= 0
        counts[code[real], ordinal[real] - block * term_block] = n[real]
        p = shares(counts, totals[:, None], terms) if width else counts
        out: dict[str, list] = {"a": [], "b": [], "value": []}
        for i in range(len(names)):
            if at_tile[i] != low:
                continue
            others = np.array([j for j in range(len(names)) if at_tile[j] == high and (low != high or names[i] < names[j])], dtype=np.int64)
            if len(others):
                apart = p[others] - p[i]
                out["value"] += (apart * apart // (p[others] + p[i])).sum(axis=1).tolist()
                out["a"] += [names[i]] * len(others)
                out["b"] += [names[j] for j in others]
        return pa.table({
            "lang": pa.array([lang] * len(out["a"]), pa.string()), "a": pa.array(out["a"], pa.string()), "b": pa.array(out["b"], pa.string()),
            "value": pa.array(out["value"], pa.int64()),
        })

    return work


def _pairs(counts: DataFrame, groups: DataFrame, term_block: int, tile: int) -> DataFrame:
    """``(lang, source, item, value)`` for every ordered pair of sources of a language."""
    sizes = groups.groupBy("lang").agg(F.ceil(F.count("*") / tile).alias("tiles"))
    dealt = groups.join(sizes, "lang").withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles")))
    # every source meets every block of terms, as a count of nothing has a share too
    blocks = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("terms") / term_block) - 1, F.lit(0)))
    marks = dealt.select("*", F.explode(blocks).alias("block"), F.lit(-1).cast("long").alias("ordinal"), F.lit(0).cast("long").alias("n"))
    entries = counts.join(dealt, ["lang", "source"]).withColumn("block", F.expr(f"ordinal div {term_block}"))
    partners = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda t: F.struct(F.least(t, F.col("tile")).alias("low"), F.greatest(t, F.col("tile")).alias("high"))
    )
    columns = ["lang", "source", "tile", "total", "terms", "block", "ordinal", "n"]
    placed = marks.select(*columns, F.explode(partners).alias("to")).unionByName(entries.select(*columns, F.explode(partners).alias("to")))
    parts = placed.select(*columns, "to.*").groupBy("lang", "block", "low", "high").applyInArrow(
        _pair_sums(term_block), "lang string, a string, b string, value long"
    )
    both = parts.select("lang", "value", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("way"))
    return both.groupBy("lang", "way.source", "way.item").agg(F.sum("value").alias("value"))


def _share(count: str, total: str):
    """The same share in the JVM; decimals, so that no product passes 64 bits."""
    return F.expr(f"1L + cast(((cast({count} as decimal(19,0)) + 2) * {WHOLE}) div (cast({total} as decimal(19,0)) + 2 * terms) as long)")


def _leading_terms(counts: DataFrame, groups: DataFrame, terms: DataFrame, most: int) -> DataFrame:
    """``(lang, source, item, value, rank)`` of the terms that a source has more than its language."""
    spoken = counts.groupBy("lang", "ordinal").agg(F.sum("n").alias("lang_n"))
    whole = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    shared = (
        counts.join(groups, ["lang", "source"]).join(whole, "lang").join(spoken, ["lang", "ordinal"])
        .select("lang", "source", "ordinal", _share("n", "total").alias("p"), _share("lang_n", "lang_total").alias("q"))
        .where("p > q").withColumn("value", F.expr("((p - q) * (p - q)) div (p + q)"))
    )
    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "ordinal")
    first = shared.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)
    return first.join(terms, ["lang", "ordinal"]).select("lang", "source", F.col("term").cast("string").alias("item"), "value", "rank")


def source_divergence(
    docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS, block_terms: int = BLOCK_TERMS, load_bytes: int = LOAD_BYTES,
    term_block: int = TERM_BLOCK, tile: int = TILE, lang_column: str = "lang", source_column: str = "source", text_column: str = "text",
) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: how far the sources of each language are apart, and in which terms.

    Part ``pair`` ranks all other sources of the language, part ``term`` the ``top`` terms that the source has more
    than the language. Null language, source and text count as empty ones; a group without terms, or a language
    without kept terms, still has its pairs. Repeated rows are documents of their own. Equal values are ranked by the
    UTF-8 order of the item. Further columns are not read; an empty table has no rows.
    """
    texts = _texts(docs, lang_column, source_column, text_column)
    terms = written(numbered_terms(kept_terms(texts, least)), "vocabulary")
    machines = written(transducers(terms, block_terms), "transducers", "none")
    counts = written(recounted(texts, machines, block_terms, load_bytes), "counts")
    sizes = terms.groupBy("lang").agg(F.count("*").alias("terms"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = written(
        texts.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
        .select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms")), "groups",
    )
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = _pairs(counts, groups, term_block, tile).withColumn("rank", F.row_number().over(order))
    leading = _leading_terms(counts, groups, terms, top)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(leading.withColumn("part", F.lit("term")).select(*columns))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SHARE = f"1 + (({{n}})::HUGEINT + 2) * {WHOLE} // (({{total}})::HUGEINT + 2 * v)"
_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
           FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
o AS MATERIALIZED (SELECT r, lang, source, unnest(w) AS item FROM d),
k AS (SELECT lang, item FROM o GROUP BY 1, 2 HAVING count(DISTINCT r) >= {LEAST_DOCUMENTS}),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY 1),
c AS MATERIALIZED (SELECT lang, source, item, count(*) AS n FROM o JOIN k USING (lang, item) GROUP BY 1, 2, 3),
t AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY 1, 2),
gp AS MATERIALIZED (SELECT lang, source, item, coalesce(n, 0) AS n, {_SHARE.format(n='coalesce(n, 0)', total='coalesce(total, 0)')} AS p
       FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN t USING (lang, source) LEFT JOIN c USING (lang, source, item)),
lp AS (SELECT lang, item, {_SHARE.format(n='sum(n)', total='any_value(total)')} AS q
       FROM c JOIN (SELECT lang, sum(total) AS total FROM t GROUP BY 1) USING (lang) JOIN v USING (lang) GROUP BY lang, item, v),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0)::BIGINT AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN gp x ON x.lang = a.lang AND x.source = a.source
          LEFT JOIN gp y ON y.lang = b.lang AND y.source = b.source AND y.item = x.item GROUP BY 1, 2, 3),
terms AS (SELECT lang, source, item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM gp JOIN lp USING (lang, item) WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM terms
QUALIFY rank <= {TOP_TERMS}
"""


@query("op12_source_divergence", _SQL)
def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of sources and leading terms of every language of ``documents``; see ``source_divergence``."""
    return source_divergence(table(spark, folder, "documents"))
