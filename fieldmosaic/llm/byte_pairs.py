"""Byte-level BPE by a finite-state transducer, and decoding by an incremental UTF-8 machine.

A sequence of tokens is what merging gives for its bytes exactly if every two neighbours
are, so the last token before each byte of a piece of text is settled by the bytes before
it. That makes a transducer over bytes: its configurations are (last token, place in the
trie of tokens, tokens not sent yet), one for each byte at which a token may still have
begun. All configurations that a prefix leaves together are one state of the determinised
transducer; what their unsent tokens begin with in common is sent, so output lags behind
by the longest token at most. States are made when a text first reaches them and dropped
together when there are ``STATES`` of them.

Whether two neighbours stay apart is read from the merges that formed them, latest first.
The rank file has to list its tokens in the order of merges, as rank files do.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import strings
from .frames import arrow_map, batch, id_and_text, table
from .registry import query

STATES = 1 << 18
PIECES = 1 << 18  # outputs of whole pieces that a task remembers
REMEMBERED = 48  # characters of a piece that is remembered
BLOCK = 1 << 16  # pieces or ids of a long text that are in hand at once
_LONG = 1 << 20  # characters from which a text is split into pieces block by block
_SENT = 1 << 22  # ids of a batch, about


class State:
    __slots__ = ("arcs", "configurations", "ending")

    def __init__(self, configurations: tuple, ending: bytes):
        self.configurations = configurations
        self.ending = ending  # ids sent if the piece ends here
        self.arcs: dict[int, tuple[State, bytes]] = {}


class Transducer:
    """Ids, little-endian in 32 bits, of the pieces of a text."""

    ROOT, NONE = 0, -1

    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("every byte has to be a token")
        self.ranks = ranks
        self.tokens = {number: token for token, number in ranks.items()}
        # of each place in the trie: the places behind it, and the token that ends there
        self.children: list[dict[int, int]] = [{}]
        self.token_at = [self.NONE]
        for token, number in ranks.items():
            place = self.ROOT
            for byte in token:
                on = self.children[place].get(byte)
                if on is None:
                    on = self.children[place][byte] = len(self.children)
                    self.children.append({})
                    self.token_at.append(self.NONE)
                place = on
            self.token_at[place] = number
        self.parts: dict[int, tuple[int, int] | None] = {}
        self._forget()

    def _forget(self) -> None:
        self.apart: dict[tuple[int, int], bool] = {}
        self.states: dict[tuple, State] = {}
        self.start = self._state(((self.NONE, self.ROOT, ()),))

    def merged(self, data: bytes) -> list[bytes]:
        """The definition: the neighbours of lowest rank are merged, the leftmost first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 62), i) for i in range(len(parts) - 1))
            if rank == 1 << 62:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge forms a token; None where merging its bytes ends elsewhere."""
        if token not in self.parts:
            data = self.tokens[token]
            parts = [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 2:
                rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 62), i) for i in range(len(parts) - 1))
                if rank == 1 << 62:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            halves = tuple(self.ranks[p] for p in parts) if len(parts) == 2 else None
            if halves and any(len(p) > 1 and self.ranks[p] >= token for p in parts):
                raise ValueError("the ranks are not in the order of merges")
            self.parts[token] = halves
        return self.parts[token]

    def _stands(self, token: int) -> bool:
        return len(self.tokens[token]) == 1 or self._halves(token) is not None

    def stay_apart(self, one: int, two: int) -> bool:
        """Whether merging the bytes of two tokens gives just these two."""
        key = (one, two)
        if key not in self.apart:
            self.apart[key] = self._stands(one) and self._stands(two) and self._never_meet(one, two)
        return self.apart[key]

    def _never_meet(self, one: int, two: int) -> bool:
        # going back in time: `before` is when one of the two neighbours becomes part of a larger token
        before = 1 << 62
        while True:
            across = self.ranks.get(self.tokens[one] + self.tokens[two])
            if across is not None and across < before:
                return False
            whole_one, whole_two = len(self.tokens[one]) == 1, len(self.tokens[two]) == 1
            if whole_one and whole_two:
                return True
            if whole_two or (not whole_one and one > two):
                before, one = one, self._halves(one)[1]
            else:
                # of equal ranks the left merge comes first, so a tie goes across
                before, two = two + 1, self._halves(two)[0]

    def _state(self, configurations: tuple) -> State:
        state = self.states.get(configurations)
        if state is None:
            last, place, _ = configurations[0]
            whole = self.token_at[place] if last == self.NONE else self.NONE
            # a piece that is one token as a whole is that token
            ending = (whole,) if whole != self.NONE else configurations[-1][2]
            state = self.states[configurations] = State(configurations, _packed(ending))
        return state

    def _arc(self, state: State, byte: int) -> tuple[State, bytes]:
        """The determinised step: configurations that go on, and the one of the token that ends here."""
        moved, ended = [], None
        children, token_at, none = self.children, self.token_at, self.NONE
        for last, place, unsent in state.configurations:
            on = children[place].get(byte)
            if on is None:
                continue
            # nothing goes on behind a leaf, but the piece may end there and be one token
            if children[on] or last == none:
                moved.append((last, on, unsent))
            # one token at most can be the last before this place
            if ended is None and (token := token_at[on]) != none:
                if self._stands(token) if last == none else self.stay_apart(last, token):
                    ended = (token, self.ROOT, (*unsent, token))
        if ended is None:
            raise ValueError("the ranks are not in the order of merges")
        moved.append(ended)
        first = moved[0][2]
        if not first:
            arc = state.arcs[byte] = (self._state(tuple(moved)), b"")
            return arc
        shared = min(len(c[2]) for c in moved)
        for _, _, unsent in moved:
            while first[:shared] != unsent[:shared]:
                shared -= 1
        if shared:
            moved = [(last, place, unsent[shared:]) for last, place, unsent in moved]
        arc = state.arcs[byte] = (self._state(tuple(moved)), _packed(first[:shared]))
        return arc

    def piece(self, data: bytes) -> bytes:
        if len(self.states) > STATES:
            self._forget()
        state, out = self.start, []
        for byte in data:
            arc = state.arcs.get(byte)
            state, sent = self._arc(state, byte) if arc is None else arc
            if sent:
                out.append(sent)
        out.append(state.ending)
        return b"".join(out)


def _packed(ids: tuple[int, ...]) -> bytes:
    return b"".join([i.to_bytes(4, "little") for i in ids])


class _Pieces(dict):
    """Ids of pieces seen lately; a new one goes through the transducer."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer = transducer

    def __missing__(self, piece: str) -> bytes:
        ids = self.transducer.piece(piece.encode("utf-8", "surrogatepass"))
        if len(piece) <= REMEMBERED:
            if len(self) >= PIECES:
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer = Transducer(ranks)
        self.finder = regex.compile(pattern)
        self.pieces = _Pieces(self.transducer)

    def ids(self, text: str) -> np.ndarray:
        """Ids of a text: each match of the pattern by itself, no special tokens."""
        if len(text) < _LONG:
            sent = b"".join(map(self.pieces.__getitem__, self.finder.findall(text)))
        else:
            found = (match.group() for match in self.finder.finditer(text))
            blocks = iter(lambda: b"".join(map(self.pieces.__getitem__, islice(found, BLOCK))), b"")
            sent = b"".join(blocks)
        return np.frombuffer(sent, dtype="<u4")


def _utf8_steps() -> np.ndarray:
    """State after each byte, by state.

    0 is between characters; 1 to 3 lack so many bytes; 4 to 7 follow E0, ED, F0 and F4, whose next byte
    has a narrower range. A byte that can't follow ends the broken character and starts anew.
    """
    lead = np.zeros(256, dtype=np.uint8)
    lead[0xC2:0xE0], lead[0xE0:0xF0], lead[0xF0:0xF5] = 1, 2, 3
    lead[[0xE0, 0xED, 0xF0, 0xF4]] = 4, 5, 6, 7
    steps = np.tile(lead, (8, 1))
    for state, first, last, following in ((1, 0x80, 0xBF, 0), (2, 0x80, 0xBF, 1), (3, 0x80, 0xBF, 2), (4, 0xA0, 0xBF, 1), (5, 0x80, 0x9F, 1), (6, 0x90, 0xBF, 2), (7, 0x80, 0x8F, 2)):
        steps[state, first : last + 1] = following
    return steps


UTF8 = _utf8_steps()


class Vocabulary:
    """Bytes of the tokens, and the state of the UTF-8 machine after each token, by state."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values(), default=-1) + 1
        self.tokens = [b""] * size
        for token, number in ranks.items():
            self.tokens[number] = token
        sizes = np.array([len(t) for t in self.tokens])
        data = np.frombuffer(b"".join(self.tokens), np.uint8)
        begin = np.cumsum(sizes) - sizes
        self.moves = np.tile(np.arange(8, dtype=np.uint8)[:, None], (1, size))
        for place in range(int(sizes.max(initial=0))):
            some = np.flatnonzero(sizes > place)
            self.moves[:, some] = UTF8[self.moves[:, some], data[begin[some] + place]]


class Decoder:
    """Bytes of ids as they come, never ending within a character."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.state = 0
        self.held = b""

    def feed(self, ids: np.ndarray) -> bytes:
        """What has become complete: bytes of whole characters, and of broken ones once that is certain."""
        if len(ids) and int(ids.max()) >= len(self.vocabulary.tokens):
            raise ValueError(f"unknown id {int(ids.max())}")
        moves, state, at = self.vocabulary.moves, self.state, 0
        # between characters, most tokens end between characters too: only the others are stepped through
        for place in np.append(np.flatnonzero(moves[0][ids]), len(ids)).tolist():
            if place < at:
                continue
            while state and at < place:
                state = int(moves[state, ids[at]])
                at += 1
            if place < len(ids):
                state, at = int(moves[state, ids[place]]), place + 1
        data = self.held + b"".join(map(self.vocabulary.tokens.__getitem__, ids.tolist()))
        cut = len(data)
        if state:
            cut = max(i for i in range(max(0, len(data) - 3), len(data)) if data[i] >= 0xC0)
        self.state, self.held = state, data[cut:]
        return data[:cut]

    def finish(self) -> bytes:
        """The bytes of a character that was cut off."""
        left, self.state, self.held = self.held, 0, b""
        return left


@lru_cache(maxsize=2)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as source:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, source)}


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(read_ranks(path), pattern)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(read_ranks(path))


def streamed(ids: np.ndarray, words: Vocabulary, block: int = BLOCK) -> Iterator[bytes]:
    """The bytes of ids in parts that are whole characters."""
    decoder = Decoder(words)
    for first in range(0, len(ids), block):
        yield decoder.feed(ids[first : first + block])
    yield decoder.finish()


def encode(docs: DataFrame, ranks: str, pattern: str = public_tokenizers.PATTERN, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, ids)`` of every whole text by the rank file ``ranks``, which every worker has at this path.

    Null and empty texts have no ids; ids of documents may be null or repeated, each row is encoded. Special tokens
    are plain text. Further columns are not read; an empty table gives no rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ranks, pattern)
        for rows in batches:
            first, held, size = 0, [], 0
            for text in strings(rows.column(1)):
                held.append(own.ids(text))
                size += len(held[-1])
                if size >= _SENT:
                    yield _ids_batch(rows.column(0).slice(first, len(held)), held)
                    first, held, size = first + len(held), [], 0
            yield _ids_batch(rows.column(0).slice(first, len(held)), held)

    return arrow_map(id_and_text(docs, id_column=id_column, text_column=text_column), work, "doc_id long, ids array<int>")


def _ids_batch(doc_ids: pa.Array, found: list[np.ndarray]) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
    values = np.concatenate([*found, np.empty(0, "<u4")]).astype(np.int32)
    return batch({"doc_id": doc_ids, "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))})


def decode(encoded: DataFrame, ranks: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """``(doc_id, text)`` of rows of ids: bytes that are no UTF-8 are replaced, null ids give a null text, no ids an empty one.

    An id that is negative, null or not in the rank file is an error. Repeated rows are decoded each; an empty table gives no rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(ranks)
        for rows in batches:
            texts = []
            for ids in rows.column(1):
                if not ids.is_valid:
                    texts.append(None)
                    continue
                if ids.values.null_count:
                    raise ValueError("a null among the ids")
                numbers = ids.values.to_numpy(zero_copy_only=False).astype(np.int64)
                if len(numbers) and numbers.min() < 0:
                    raise ValueError(f"unknown id {int(numbers.min())}")
                texts.append("".join(part.decode("utf-8", "replace") for part in streamed(numbers, words)))
            yield batch({"doc_id": rows.column(0), "text": pa.array(texts, pa.string())})

    picked = encoded.select(F.col(id_column).cast("long").alias("doc_id"), F.col(ids_column).cast("array<int>").alias("ids"))
    return arrow_map(picked, work, "doc_id long, text string")


def round_trips(docs: DataFrame, ranks: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: digests of the ids of every text and of what they decode to.

    Rows as for ``encode``; a null or empty text has the digests of nothing.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, words = encoder(ranks, pattern), vocabulary(ranks)
        for rows in batches:
            sizes, of_ids, of_bytes = [], [], []
            for text in strings(rows.column(1)):
                ids = own.ids(text)
                sizes.append(len(ids))
                of_ids.append(hashlib.sha256(ids.tobytes()).hexdigest())
                digest = hashlib.sha256()
                for part in streamed(ids, words):
                    digest.update(part)
                of_bytes.append(digest.hexdigest())
            yield batch({"doc_id": rows.column(0), "n_tokens": sizes, "ids_sha256": of_ids, "decoded_sha256": of_bytes}, n_tokens=pa.int64(), ids_sha256=pa.string(), decoded_sha256=pa.string())

    return arrow_map(id_and_text(docs), work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


@query("op13_byte_pairs")
def op13_byte_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every whole text of ``documents`` and what they decode to, as digests; no rows for an empty table."""
    return round_trips(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
