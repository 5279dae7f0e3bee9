"""Numpy views of Arrow text columns: bytes, words and range fingerprints.

Everything here works on the UTF-8 bytes of a whole Arrow column at once; no
Python object is made per word.  A null text counts as the empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one numpy pass takes at most (a longer single document is taken alone).
CHUNK = 1 << 18

#: Range fingerprints are polynomials modulo this prime.
PRIME = (1 << 61) - 1
_P, _M31, _M30 = np.uint64(PRIME), np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
_U31, _U30, _U61 = np.uint64(31), np.uint64(30), np.uint64(61)
_rng = np.random.default_rng(20240229)
#: Independent random bases of the polynomials.
BASES = tuple(int(x) for x in _rng.integers(1 << 59, PRIME - 1, 2))
_POWERS: dict[int, np.ndarray] = {}

#: Bytes that end a word in the contracts with words `[^\x20\x09-\x0D]+`.
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True

#: A-Z to a-z, other bytes unchanged.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and where each text starts (one more entry at the end)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most `limit` bytes together, or of one longer document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that copies stay small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, for numbers below it."""
    ah, al, bh, bl = a >> _U31, a & _M31, b >> _U31, b & _M31
    middle = ah * bl + al * bh
    out = ((ah * bh) << np.uint64(1)) + (middle >> _U30) + ((middle & _M30) << _U31) + al * bl
    return _reduced(out)


def _reduced(a: np.ndarray) -> np.ndarray:
    a = (a & _P) + (a >> _U61)
    return np.where(a >= _P, a - _P, a)


def _powers(base: int, n: int) -> np.ndarray:
    """The first n powers of the base, kept between calls."""
    held = _POWERS.get(base)
    if held is None or len(held) < n:
        held = np.ones(1, np.uint64) if held is None else held
        while len(held) < n:
            held = np.r_[held, times(held, np.full(1, pow(base, len(held), PRIME), np.uint64))]
        _POWERS[base] = held
    return held[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Ranges:
    """Fingerprints of any range of a sequence of symbols (numbers below 2**61), in constant time each.

    A range's value is its polynomial at a random base modulo the prime
    2**61 - 1, which doesn't depend on where it lies: two different ranges of
    length n have the same with a probability of n / 2**61.  `mix` it before
    ordering by it.  Another base gives an independent value.
    """

    def __init__(self, symbols: np.ndarray, base: int = 0) -> None:
        n = len(symbols)
        self.inverse = _powers(pow(BASES[base], -1, PRIME), n + 1)
        powers = _powers(BASES[base], n + 1)[:n]
        if symbols.dtype == np.uint8:  # bytes, plus one so that none counts as 0
            symbols = symbols.astype(np.uint64) + np.uint64(1)
            high = symbols * (powers >> _U31)
            terms = symbols * (powers & _M31) + (high >> _U30) + ((high & _M30) << _U31)
        else:
            terms = times(symbols, powers)
        low, high = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
        np.cumsum(terms & np.uint64(0xFFFFFFFF), out=low[1:])
        np.cumsum(terms >> np.uint64(32), out=high[1:])
        high = _reduced(high)  # times 2**32
        self.sums = _reduced(low + (high >> np.uint64(29)) + ((high & np.uint64((1 << 29) - 1)) << np.uint64(32)))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        gap = self.sums[end] + (_P - self.sums[start])
        return times(np.where(gap >= _P, gap - _P, gap), self.inverse[start])

    def grams(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        if n <= 0:
            return np.zeros(0, np.uint64)
        gap = self.sums[length:] + (_P - self.sums[:n])
        return times(np.where(gap >= _P, gap - _P, gap), self.inverse[:n])


def words(data: np.ndarray, offsets: np.ndarray, ends_word: np.ndarray = BLANKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each document the number of its first word (one more entry at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~ends_word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = 0) -> np.ndarray:
    """A number below 2**61 for each word's bytes; another base gives an independent one."""
    return mix(Ranges(data, base).of(starts, ends) + (ends - starts).astype(np.uint64)) >> np.uint64(3)


def longs(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def arrow_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
