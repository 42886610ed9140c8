"""Words of whole Arrow batches in numpy: positions, hashes and window hashes.

Texts are read as UTF-8 bytes straight from the Arrow buffers; all that separates
words is ASCII, so bytes suffice. A batch is cut into slices of bounded size along
documents, so that memory follows the longest document and not the batch.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
#: Hashes of spans are polynomials modulo this prime, at a place drawn from a seed: texts
#: of length n collide with a probability of n / 2**61, however they are built. (Modulo
#: 2**64 there are texts that collide at every place.)
PRIME = (1 << 61) - 1
_STEP = random.Random(61).randrange(1 << 60, PRIME)
_P, _LOW30, _LOW31 = np.uint64(PRIME), np.uint64((1 << 30) - 1), np.uint64((1 << 31) - 1)
_1, _30, _31, _60, _61 = (np.uint64(k) for k in (1, 30, 31, 60, 61))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = np.arange(1, 257, dtype=np.uint64)
_BYTES_AT_ONCE = 1 << 22  # so many bytes times 31 bits add up without a remainder


def rest(x: np.ndarray) -> np.ndarray:
    """The remainder by the prime."""
    x = (x & _P) + (x >> _61)
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime, of numbers below it."""
    ah, al, bh, bl = a >> _30, a & _LOW30, b >> _30, b & _LOW30
    high, mid = ah * bh, ah * bl + al * bh
    return rest((high >> _1) + ((high & _1) << _60) + (mid >> _31) + ((mid & _LOW31) << _30) + al * bl)


class _Powers:
    """Powers of the step and of its inverse, as far as they were asked for."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(cls.up) < n:
            size = len(cls.up)
            cls.up = np.concatenate([cls.up, times(cls.up, np.uint64(pow(_STEP, size, PRIME)))])
            cls.down = np.concatenate([cls.down, times(cls.down, np.uint64(pow(_STEP, -size, PRIME)))])
        return cls.up[:n], cls.down[:n]


def span_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of ``values[start:end]`` for many spans; equal spans anywhere agree."""
    n = len(values)
    up, down = _Powers.of(n + 1)
    high, low = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
    if n <= _BYTES_AT_ONCE and (not n or values.max() <= 256):
        np.cumsum(values * (up[:n] >> _30), out=high[1:])
        np.cumsum(values * (up[:n] & _LOW30), out=low[1:])
    else:
        terms = times(rest(values), up[:n])
        np.cumsum(terms >> _30, out=high[1:])
        np.cumsum(terms & _LOW30, out=low[1:])
    total = rest(times(rest(high[end] - high[start]), _1 << _30) + rest(low[end] - low[start]))
    return mix(times(total, down[start]) ^ ((end - start).astype(np.uint64) << _61))


def window_hash(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` values in a row, by the index of the first."""
    at = np.arange(max(0, len(hashes) - n + 1))
    return span_hash(hashes, at, at + n)


def totals(x: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of ``x`` between neighbouring offsets; none for empty ones."""
    sums = np.zeros(len(x) + 1, np.int64)
    np.cumsum(x, out=sums[1:])
    return sums[off[1:]] - sums[off[:-1]]


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; NULL counts as empty."""
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


_HELD: dict[str, object] = {}


def held(key: str, make: Callable[[], object]) -> object:
    """A large object that a worker process keeps from task to task."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES, holding: str = "") -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of each slice hold ``most`` bytes or are one text.

    What an earlier task of another kind holds in this process is given up first.
    """
    if holding not in _HELD:
        _HELD.clear()
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        _, off = utf8(col)
        at = 0
        while at < len(col):
            to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


class Words:
    """Words of the texts of one slice. ``off[d]:off[d + 1]`` are those of text ``d``."""

    def __init__(self, raw: np.ndarray, bounds: np.ndarray):
        self.raw, self.bounds = raw, bounds
        edge = np.zeros(len(raw) + 1, bool)
        edge[bounds] = True
        self.solid = solid = ~_GAP[raw]
        before = np.zeros(len(raw), bool)
        before[1:] = solid[:-1]
        after = np.zeros(len(raw), bool)
        after[:-1] = solid[1:]
        self.start = np.flatnonzero(solid & (~before | edge[:-1]))
        self.end = np.flatnonzero(solid & (~after | edge[1:])) + 1
        self.off = np.searchsorted(self.start, bounds)
        self.count = np.diff(self.off)

    @classmethod
    def of(cls, col: pa.Array) -> Words:
        return cls(*utf8(col))

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self) -> np.ndarray:
        return span_hash(_BYTE[self.raw], self.start, self.end)

    def whole(self, n: int) -> np.ndarray:
        """Whether the window of ``n`` words from each word ends in its own text."""
        left = np.repeat(self.off[1:], self.count) - np.arange(len(self.start))
        return left >= n


_SIEVE_BITS = 21


def repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether it occurs again or before, and whether it occurs before.

    Keys alone in their slot of a count table occur once; only the rest is sorted.
    """
    shared, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    slot = (keys >> np.uint64(64 - _SIEVE_BITS)).view(np.int64)
    at = np.flatnonzero(np.bincount(slot, minlength=1 << _SIEVE_BITS)[slot] > 1)
    order = np.argsort(keys[at], kind="stable")
    ranked = keys[at][order]
    same = np.zeros(len(at) + 1, bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    shared[at[order]] = same[1:] | same[:-1]
    later[at[order]] = same[:-1]
    return shared, later


def covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of ``size`` words lie in a window of ``n`` words that starts at a marked word."""
    sums = np.zeros(size + n, np.int32)
    np.cumsum(starts, out=sums[n : n + len(starts)])
    sums[n + len(starts) :] = sums[n + len(starts) - 1]
    return sums[n:] > sums[:-n]


@lru_cache(4)
def byte_table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out
