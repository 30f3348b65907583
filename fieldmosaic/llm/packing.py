"""Order-preserving packing of documents into fixed-length token sequences.

A task's documents, in their order, form one token stream. Dynamic programming
chooses where windows of at most ``LENGTH`` tokens are cut: at document ends, at
sentence ends, or, in sentences longer than ``GRID`` tokens, every ``GRID`` tokens.
The cost is the padding of each sequence plus a penalty for every cut inside a
document. The best predecessor of a cut is the minimum over a sliding window of
token positions, which a monotone queue gives in constant time per cut.

The stream is settled in stretches of about ``STRETCH`` tokens; what follows the
last cut of a stretch is carried into the next, so memory does not grow with a task.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .arrays import strings
from .frames import arrow_map, batch, id_and_text, table
from .registry import query

LENGTH = 2048
END = 1
GRID = 24
STRETCH = 1 << 19
SENTENCE_PENALTY = 2
GRID_PENALTY = 10
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


@lru_cache(maxsize=2)
def encoder(path: str) -> tuple[tiktoken.Encoding, np.ndarray, dict[str, int], re.Pattern | None]:
    """The vocabulary file as a fast encoder of the same ids, which ids end a sentence, its added tokens, and what finds them."""
    with open(path, encoding="utf-8") as source:
        kept = json.load(source)
    added = {t["content"]: t["id"] for t in kept["added_tokens"]}
    if any(t[flag] for t in kept["added_tokens"] for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{path}: only added tokens that stand for their plain content are known")
    special = set(added.values())
    # byte-level vocabularies write every byte as one printable character
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in kept["model"]["vocab"].items() if i not in special}
    ends = np.zeros(max([*ranks.values(), *special], default=0) + 1, dtype=bool)
    for token, i in ranks.items():
        ends[i] = b"\n" in token or token.rstrip()[-1:] in (b".", b"!", b"?")
    # of added tokens that begin at one place the longest counts
    finder = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), ends, added, finder


def token_ids(text: str, path: str) -> np.ndarray:
    """Ids of a text, then END. An added token is one id wherever its content stands; the text between is encoded by itself."""
    plain, _, added, finder = encoder(path)
    ids: list[int] = []
    for i, part in enumerate(finder.split(text) if finder else [text]):
        if i % 2:
            ids.append(added[part])
        elif part:
            ids += plain.encode_ordinary(part)
    return np.array([*ids, END], dtype=np.uint32)


def candidate_cuts(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of a document where it may be cut, ascending up to its end, and their penalties."""
    size = len(ids)
    stop = np.flatnonzero(ends[np.minimum(ids, len(ends) - 1)]) + 1
    stop = np.append(stop[stop < size - 1], size)
    before = np.concatenate([[0], stop[:-1]])
    pieces = np.maximum(1, -(-(stop - before) // GRID))
    last = np.cumsum(pieces)
    cuts = np.repeat(before, pieces) + GRID * (np.arange(last[-1]) - np.repeat(last - pieces, pieces) + 1)
    cuts[last - 1] = stop
    penalty = np.full(len(cuts), GRID_PENALTY)
    penalty[last - 1] = SENTENCE_PENALTY
    penalty[-1] = 0
    return cuts, penalty


def best_cuts(places: np.ndarray, penalties: np.ndarray, length: int, final: bool) -> list[int]:
    """Ends of the sequences over cut places counted from the last settled cut at 0.

    Before the final stretch the last sequence is left open and its end not returned.
    """
    at = [0, *places.tolist()]
    extra = [0, *penalties.tolist()]
    # cost of sequences up to a cut, with the cut's place added: padding depends on their difference only
    value = [0] * len(at)
    origin = [0] * len(at)
    queue: deque[int] = deque([0])
    for i in range(1, len(at)):
        here = at[i]
        while at[queue[0]] < here - length:
            queue.popleft()
        origin[i] = queue[0]
        value[i] = value[queue[0]] + length + extra[i]
        while queue and value[queue[-1]] >= value[i]:
            queue.pop()
        queue.append(i)
    # value[i] = dp[i] + at[i]; any open remainder may follow, so the best open end has the lowest dp plus place
    i = len(at) - 1 if final else min((j for j in range(len(at)) if at[j] >= at[-1] - length), key=lambda j: value[j])
    ends = []
    while i:
        ends.append(at[i])
        i = origin[i]
    return ends[::-1]


class Packer:
    """Settles a stream of documents stretch by stretch."""

    def __init__(self, task: int, length: int):
        self.length = length
        self.next_sequence = task << 40
        self.docs: list[tuple[int | None, int, int, np.ndarray]] = []  # id, first token left, tokens, ids left
        self.cuts: list[np.ndarray] = []
        self.penalties: list[np.ndarray] = []
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray, ends: np.ndarray) -> None:
        cuts, penalty = candidate_cuts(ids, ends)
        self.docs.append((doc_id, 0, len(ids), ids))
        self.cuts.append(cuts + self.held)
        self.penalties.append(penalty)
        self.held += len(ids)

    def settle(self, final: bool) -> pa.RecordBatch | None:
        if not self.docs:
            return None
        places, penalties = np.concatenate(self.cuts), np.concatenate(self.penalties)
        ends = np.array(best_cuts(places, penalties, self.length, final), dtype=np.int64)
        if not len(ends):
            return None
        sizes = np.array([len(d[3]) for d in self.docs])
        first = np.concatenate([[0], np.cumsum(sizes)])
        done = int(ends[-1])
        edges = np.unique(np.concatenate([[0], ends, first[first < done]]))
        begin, size = edges[:-1], np.diff(edges)
        doc = np.searchsorted(first, begin, side="right") - 1
        sequence = np.searchsorted(ends, begin, side="right")
        opening = np.concatenate([[0], ends])[sequence]
        within = begin - first[doc]
        sums = [
            zlib.crc32(self.docs[d][3][w : w + n].astype("<u4").tobytes()) for d, w, n in zip(doc, within, size)
        ]
        skipped = np.array([d[1] for d in self.docs])
        out = batch(
            {"doc_id": [self.docs[d][0] for d in doc], "start": within + skipped[doc], "length": size, "ids_crc32": sums,
             "doc_tokens": np.array([d[2] for d in self.docs])[doc], "sequence_id": self.next_sequence + sequence,
             "offset": begin - opening},
            doc_id=pa.int64(), ids_crc32=pa.int64(),
        )
        self.next_sequence += len(ends)
        left = int(np.searchsorted(first, done, side="right")) - 1
        self.docs = self.docs[left:] if done < self.held else []
        if self.docs:
            doc_id, start, total, ids = self.docs[0]
            cut = done - int(first[left])
            self.docs[0] = (doc_id, start + cut, total, ids[cut:])
        self.cuts, self.penalties = [places[places > done] - done], [penalties[places > done]]
        self.held -= done
        return out


def pack(docs: DataFrame, vocabulary: str, length: int = LENGTH) -> DataFrame:
    """Pieces of documents and the sequence and offset each one has.

    Null and empty texts are the end token alone. The order of the input is kept
    within each task; a sequence never mixes tasks, so each task pads one last
    sequence. Repeated rows are packed each. An empty table has no pieces.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = encoder(vocabulary)[1]
        packer = Packer(TaskContext.get().partitionId(), length)
        for rows in batches:
            for doc_id, text in zip(rows.column(0).to_pylist(), strings(rows.column(1))):
                packer.add(doc_id, token_ids(text, vocabulary), ends)
                if packer.held >= STRETCH and (out := packer.settle(final=False)) is not None:
                    yield out
        if (out := packer.settle(final=True)) is not None:
            yield out

    return arrow_map(id_and_text(docs), work, SCHEMA)


@query("op8_packing")
def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
