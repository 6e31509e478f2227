"""Arrow text columns as byte blocks: words, word hashes and shingles by NumPy, without a loop over words."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
#: For work that gains from many texts side by side.
WIDE_BYTES = 4 << 20
_U64 = np.uint64


class Words(NamedTuple):
    """Words of a block of documents, in text order.

    ``hash`` is a 64-bit hash of each lower-cased word; ``first`` has the number of words before each
    document and, at the end, the number of all words; ``start`` and ``end`` are byte positions.
    """

    hash: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets of its rows; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def give_back() -> None:
    """Return free memory to the system at the end of a task: workers are used again by other stages and should not keep
    what this one took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, block_bytes: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches at about ``block_bytes`` of text. A longer text is a block of its own, never cut."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, ends = text_bytes(batch.column(column))
        at = 0
        while at < batch.num_rows:
            upto = int(np.searchsorted(ends, ends[at] + block_bytes, "right")) - 1
            upto = min(max(upto, at + 1), batch.num_rows)
            yield batch.slice(at, upto - at)
            at = upto
    give_back()


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values; wraps."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_VALUES = mix(np.arange(1, 257, dtype=_U64) * _U64(0x9E3779B97F4A7C15))
_BASE = 0xD6E8FEB86659FD93
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)

#: Bytes of words: neither blank nor a control used as white space.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of words: letters a-z, digits and all that is not ASCII, after lower-casing.
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[48:58] = ALPHANUMERIC[65:91] = ALPHANUMERIC[97:123] = ALPHANUMERIC[128:] = True


def _powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base``, modulo 2^64."""
    out = np.full(n, base, _U64)
    out[0] = 1
    return np.multiply.accumulate(out, out=out)


class _Powers:
    """Powers of the base and of its inverse; those for a block are kept, those for a longer text are not."""

    def __init__(self) -> None:
        self.kept: tuple[np.ndarray, np.ndarray] | None = None

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > BLOCK_BYTES + 1:
            return _powers(_BASE, n), _powers(_BASE_INVERSE, n)
        if self.kept is None:
            self.kept = _powers(_BASE, BLOCK_BYTES + 1), _powers(_BASE_INVERSE, BLOCK_BYTES + 1)
        return self.kept


class SpanHasher:
    """Hashes byte spans of a block by differences of prefix sums; one per task."""

    def __init__(self) -> None:
        self.powers = _Powers()

    def __call__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = len(data)
        up, down = self.powers.upto(n + 1)
        sums = np.empty(n + 1, _U64)
        sums[0] = 0
        np.multiply(_BYTE_VALUES[data], up[:n], out=sums[1:])
        np.cumsum(sums, out=sums)
        return mix((sums[end] - sums[start]) * down[start])


class Splitter:
    """Splits blocks of documents into lower-cased words; one per task."""

    def __init__(self, word_bytes: np.ndarray) -> None:
        self.word_bytes = word_bytes
        self.hasher = SpanHasher()

    def __call__(self, column: pa.Array) -> Words:
        data, offsets = text_bytes(column)
        n = len(data)
        if n == 0:
            none = np.zeros(0, np.int64)
            return Words(np.zeros(0, _U64), np.zeros(len(offsets), np.int64), none, none)
        inside = self.word_bytes[data]
        before, after = np.empty(n, bool), np.empty(n, bool)
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        edges = offsets[(offsets > 0) & (offsets < n)]
        before[edges], after[edges - 1] = False, False
        start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        return Words(self.hasher(_LOWER[data], start, end), np.searchsorted(start, offsets), start, end)


def combined(hashes: np.ndarray) -> int:
    """Order-sensitive 64-bit hash of a short sequence of word hashes."""
    out = _U64(len(hashes))
    with np.errstate(over="ignore"):
        for h in hashes:
            out = mix(np.array([out * _U64(_BASE) + h], _U64))[0]
    return int(out)


def shingles(words: Words, width: int) -> Iterator[np.ndarray]:
    """For each document its distinct hashed shingles, sorted; a shorter text is one shingle, an empty text has none."""
    h, first = words.hash, words.first
    joined = np.zeros(max(0, len(h) - width + 1), _U64)
    for k in range(width):
        joined = joined * _U64(_BASE) + mix(h[k : k + len(joined)] + _U64(k + 1))
    joined = mix(joined)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            own = np.sort(joined[a : b - width + 1])
            yield own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif b > a:
            yield np.array([combined(h[a:b])], _U64)
        else:
            yield np.zeros(0, _U64)
