"""Texts as flat numpy arrays: words and their hashes for many documents at once.

Tasks see Arrow batches. A batch is walked in slices of a few megabytes, so that
temporary arrays stay small however many rows a batch has; only a single text
larger than a slice makes a larger one. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words are maximal runs of bytes that are no white space.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: Words are maximal runs of digits, lower-case letters and bytes beyond ASCII.
ALPHANUMERIC = np.zeros(256, dtype=bool)
ALPHANUMERIC[0x30:0x3A] = True
ALPHANUMERIC[0x61:0x7B] = True
ALPHANUMERIC[0x80:] = True


@dataclass
class Slice:
    """Rows ``first`` to ``last`` of a batch: their bytes and where each text starts."""

    first: int
    last: int
    data: np.ndarray
    starts: np.ndarray  # last - first + 1 offsets into data


@dataclass
class Words:
    """Words of a slice: 64-bit hash of each, and the offsets of each text's words."""

    hashes: np.ndarray
    starts: np.ndarray


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Consecutive rows of a string column, about ``limit`` bytes at a time."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(len(column), max(first + 1, last))
        yield Slice(first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


_powers: dict[str, np.ndarray] = {}


def powers(name: str, base: int, count: int) -> np.ndarray:
    """``base ** i`` modulo 2^64 for i < count, kept and grown between calls."""
    have = _powers.get(name)
    if have is None or len(have) < count:
        size = max(count, SLICE_BYTES + 1)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[name] = have
    return have[:count]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash of bytes; entry i covers the bytes before i."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers("up", _BASE, len(data)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes from begin to end, wherever they lie."""
    down = powers("down", _INVERSE, len(prefix))
    length = (end - begin).astype(np.uint64)
    return mixed(((prefix[end] - prefix[begin]) * down[begin]) ^ (length * np.uint64(0xD6E8FEB86659FD93)))


def word_spans(piece: Slice, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, first and last-plus-one byte of each word, and word offsets of the texts."""
    data = LOWER[piece.data]
    inside = kind[data]
    joined = np.zeros(len(data), dtype=bool)
    np.logical_and(inside[1:], inside[:-1], out=joined[1:])
    edges = piece.starts[:-1]
    joined[edges[edges < len(data)]] = False
    begin = np.flatnonzero(inside & ~joined)
    follows = np.ones(len(data), dtype=bool)
    follows[:-1] = ~joined[1:]
    end = np.flatnonzero(inside & follows) + 1
    return data, begin, end, np.searchsorted(begin, piece.starts)


def words(piece: Slice, kind: np.ndarray) -> Words:
    """Hashes of the lower-cased words of a slice."""
    data, begin, end, starts = word_spans(piece, kind)
    return Words(span_hashes(prefix_hashes(data), begin, end), starts)


def gram_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive hashes (runs across texts included)."""
    count = max(0, len(hashes) - size + 1)
    out = np.full(count, size, dtype=np.uint64)
    for step in range(size):
        out = out * np.uint64(0xA0761D6478BD642F) + hashes[step : step + count]
    return mixed(out)


def owners(starts: np.ndarray) -> np.ndarray:
    """Number of the text that each word belongs to."""
    return np.repeat(np.arange(len(starts) - 1), np.diff(starts))


def strings(column: pa.Array) -> list[str]:
    """Texts of a column; null is empty, and bytes that are no UTF-8 are replaced."""
    column = column.fill_null("")
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [x.decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]
