"""Words and their 64-bit hashes for many texts at once, as NumPy arrays over the UTF-8 bytes.

A word is a maximal run of bytes other than space and \\x09-\\x0D. The work is done in pieces
of whole texts of about ``PIECE`` bytes, so memory does not follow the size of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
BATCH = 8 << 20
_RANDOM = np.random.default_rng(20240607)
_BYTE = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, count: int) -> np.ndarray:
    """base**0 .. base**(count-1) modulo 2**64."""
    known = _powers.get(base)
    if known is None or len(known) < count:
        steps = np.full(max(count, PIECE + 1), base, dtype=np.uint64)
        steps[0] = 1
        known = _powers[base] = np.multiply.accumulate(steps)
    return known[:count]


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    values = values ^ (values >> np.uint64(32))
    values = values * _MIX
    return values ^ (values >> np.uint64(29))


@dataclass
class Texts:
    """UTF-8 bytes of texts one after the other; text i is data[offsets[i]:offsets[i + 1]]."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def pieces(self, size: int = PIECE) -> Iterator[tuple[int, Texts]]:
        """(index of the first text, texts) for runs of whole texts of about ``size`` bytes."""
        first = 0
        while first < len(self):
            limit = self.offsets[first] + size
            last = max(first + 1, int(np.searchsorted(self.offsets, limit, "right")) - 1)
            begin, end = self.offsets[first], self.offsets[last]
            yield first, Texts(self.data[begin:end], self.offsets[first : last + 1] - begin)
            first = last


def texts_of(column: pa.Array | pa.ChunkedArray) -> Texts:
    """The texts of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(offsets):
        return Texts(np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64))
    data = np.frombuffer(data, dtype=np.uint8)
    return Texts(data[offsets[0] : offsets[-1]], offsets - offsets[0])


@dataclass
class Words:
    """Word w is data[starts[w]:ends[w]]; the words of text i are numbers first[i] to first[i + 1]."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Sums of byte value times power: the hash of data[a:b] is (p[b] - p[a]) / base**a."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * powers(_BASE, len(data)), out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte strings data[start:end]; equal strings have equal hashes."""
    raw = (sums[ends] - sums[starts]) * powers(_INVERSE, len(sums))[starts]
    return mix(raw + (ends - starts).astype(np.uint64))


def split_units(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes, first unit of each text): every word with the blanks before it.

    Blanks at the end of a text are a unit of their own, so the units of a text make up all of it.
    """
    words = split_words(texts, hashed=False)
    fresh = np.zeros(len(words.starts), dtype=bool)
    some = words.counts > 0
    fresh[words.first[:-1][some]] = True
    starts = np.concatenate([[0], words.ends[:-1]])[: len(words.ends)]
    starts[fresh] = texts.offsets[:-1][some]
    last = texts.offsets[:-1].copy()
    last[some] = words.ends[words.first[1:][some] - 1]
    tail = np.flatnonzero(last < texts.offsets[1:])
    at = words.first[1:][tail]
    starts = np.insert(starts, at, last[tail])
    ends = np.insert(words.ends, at, texts.offsets[1:][tail])
    first = words.first.copy()
    first[1:] += np.cumsum(last < texts.offsets[1:])
    hashes = np.zeros(len(starts), np.uint64)
    for index, piece in texts.pieces():
        begin, end = first[index], first[index + len(piece)]
        base = texts.offsets[index]
        hashes[begin:end] = span_hashes(prefix_hashes(piece.data), starts[begin:end] - base, ends[begin:end] - base)
    return starts, ends, hashes, first


def split_words(texts: Texts, hashed: bool = True) -> Words:
    """Words of all texts, found and hashed piece by piece."""
    parts, begin = [], 0
    counts = [np.zeros(1, np.int64)]
    for _, piece in texts.pieces():
        inside = ~_BLANK[piece.data]
        starts_here = inside.copy()
        starts_here[1:] &= ~inside[:-1]
        ends_here = inside.copy()
        ends_here[:-1] &= ~inside[1:]
        # A text ends its last word even where the next text begins without a blank.
        edges = piece.offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(piece.data))]
        starts_here[edges] = inside[edges]
        ends_here[edges - 1] = inside[edges - 1]
        starts = np.flatnonzero(starts_here)
        ends = np.flatnonzero(ends_here) + 1
        hashes = span_hashes(prefix_hashes(piece.data), starts, ends) if hashed else np.zeros(0, np.uint64)
        parts.append((starts + begin, ends + begin, hashes))
        counts.append(np.diff(np.searchsorted(starts, piece.offsets)))
        begin += len(piece.data)
    first = np.cumsum(np.concatenate(counts))
    if not parts:
        return Words(*(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64)), first)
    return Words(*(np.concatenate(column) for column in zip(*parts, strict=True)), first)


def runs(words: Words, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each word on, also past the end of its text."""
    total = len(words.hashes)
    out = np.zeros(total, dtype=np.uint64)
    padded = np.concatenate([words.hashes, np.zeros(size, np.uint64)])
    for place in range(size):
        out = out * np.uint64(_BASE) + padded[place : place + total]
    return mix(out)


def batches_of(rows: Iterator[pa.RecordBatch], column: str, size: int = BATCH) -> Iterator[tuple[pa.Table, Texts]]:
    """Cut record batches into tables whose texts hold about ``size`` bytes."""
    for batch in rows:
        table = pa.Table.from_batches([batch])
        texts = texts_of(table.column(column))
        for first, piece in texts.pieces(size):
            yield table.slice(first, len(piece)), piece


_held: dict = {}


def only(key, make):
    """What ``make`` gives, once a worker. Workers serve tasks of many operators: the next key takes its place."""
    if key not in _held:
        _held.clear()
        pa.default_memory_pool().release_unused()
        _held[key] = make()
    return _held[key]


class Ragged:
    """Rows of varying length: row i is values[offsets[i]:offsets[i + 1]]."""

    def __init__(self, values: np.ndarray, offsets: np.ndarray):
        self.values, self.offsets = values, offsets

    @classmethod
    def of(cls, rows: list, dtype) -> Ragged:
        offsets = np.zeros(len(rows) + 1, np.int64)
        np.cumsum([len(row) for row in rows], out=offsets[1:])
        flat = [value for row in rows for value in row]
        return cls(np.array(flat, dtype=dtype), offsets)

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.offsets)

    def take(self, index: np.ndarray) -> Ragged:
        lengths = self.lengths[index]
        offsets = np.zeros(len(index) + 1, np.int64)
        np.cumsum(lengths, out=offsets[1:])
        places = np.arange(offsets[-1]) + np.repeat(self.offsets[index] - offsets[:-1], lengths)
        return Ragged(self.values[places], offsets)

    def append(self, other: Ragged) -> Ragged:
        return Ragged(
            np.concatenate([self.values, other.values]),
            np.concatenate([self.offsets, other.offsets[1:] + self.offsets[-1]]),
        )


class Memo:
    """What was computed for byte strings, by hash; forgets everything when it holds ``limit`` of them, or ``most_bytes``.

    ``compute`` takes a list of bytes and returns one sequence of integers for each.
    """

    def __init__(self, compute, dtype, limit: int = 2_000_000, most_bytes: int | None = None):
        self.compute, self.dtype, self.limit, self.most_bytes = compute, dtype, limit, most_bytes
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.rank = np.zeros(0, np.int64)
        self.rows = Ragged(np.zeros(0, self.dtype), np.zeros(1, np.int64))

    def look_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray):
        """(Ragged of distinct strings, number of its string for every given one)."""
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        held = sum(part.nbytes for part in (self.keys, self.rank, self.rows.values, self.rows.offsets))
        if len(self.keys) + len(distinct) > self.limit or (self.most_bytes is not None and held > self.most_bytes):
            self._clear()
        place = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), dtype=bool)
        inner = place < len(self.keys)
        known[inner] = self.keys[place[inner]] == distinct[inner]
        fresh = np.flatnonzero(~known)
        if len(fresh):
            at = first[fresh]
            strings = [data[a:b].tobytes() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            rank = np.arange(len(fresh)) + len(self.rows.offsets) - 1
            self.rows = self.rows.append(Ragged.of(self.compute(strings), self.dtype))
            self.keys = np.insert(self.keys, place[fresh], distinct[fresh])
            self.rank = np.insert(self.rank, place[fresh], rank)
            place = np.searchsorted(self.keys, distinct)
        return self.rows.take(self.rank[place]), inverse
