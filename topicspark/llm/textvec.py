"""Words and their hashes for whole Arrow batches at once, on the UTF-8 bytes, without a Python loop over rows.

A word is a run of ASCII letters, digits, underscores and non-ASCII bytes. Case is folded for ASCII and the Latin-1
supplement. A null text counts as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
MULT = 0x9E3779B97F4A7C15
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_pow = np.ones(1, dtype=U64)
_inv = np.ones(1, dtype=U64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """MULT to the powers 0..n-1 modulo 2**64, and their inverses."""
    global _pow, _inv
    if len(_pow) < n:
        size = 1 << (n - 1).bit_length()
        back = pow(MULT, -1, 1 << 64)
        a, b = np.full(size, MULT, dtype=U64), np.full(size, back, dtype=U64)
        a[0] = b[0] = 1
        _pow, _inv = np.multiply.accumulate(a), np.multiply.accumulate(b)
    return _pow, _inv


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


@dataclass
class Words:
    """Words of some rows: byte range, row and hash each; first[i]..first[i+1] are the words of row i."""

    data: np.ndarray
    lower: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray
    sums: np.ndarray

    @property
    def n_rows(self) -> int:
        return len(self.offsets) - 1

    def hashes(self, prefix: int = 0) -> np.ndarray:
        """64-bit hash of each word, or of its first ``prefix`` bytes."""
        _, inv = _powers(len(self.data) + 1)
        end = np.minimum(self.end, self.start + prefix) if prefix else self.end
        return mix((self.sums[end] - self.sums[self.start]) * inv[self.start])


def chunks(texts: pa.Array, max_bytes: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``max_bytes``; a longer text is a run of its own."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    _, off, raw = texts.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + max_bytes, "right")) - 1)
        to = min(to, n)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to
    give_back()


def give_back() -> None:
    """Freed memory goes back to the system after each batch: workers live on from one task to the next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def fold(data: np.ndarray) -> np.ndarray:
    low = _LOWER[data]
    if len(low) > 1:
        up = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        low[up] += 0x20
    return low


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, cut at the borders of rows."""
    n = len(mask)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    border = np.zeros(n + 1, dtype=bool)
    border[offsets] = True
    before = np.concatenate(([False], mask[:-1])) & ~border[:-1]
    after = np.concatenate((mask[1:], [False])) & ~border[1:]
    return np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    power, _ = _powers(len(data) + 1)
    low = fold(data)
    start, end = runs(_WORD[data], offsets)
    first = np.searchsorted(start, offsets)
    sums = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum((low.astype(U64) + U64(1)) * power[: len(data)], out=sums[1:])
    return Words(data, low, offsets, start, end, np.repeat(np.arange(len(offsets) - 1), np.diff(first)), first, sums)


def unique_pairs(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, value) pairs, ordered; rows ascending already and values of 32 bits at most."""
    key = np.unique((row.astype(U64) << U64(32)) | value.astype(U64))
    return (key >> U64(32)).astype(np.int64), (key & U64(0xFFFFFFFF)).astype(np.int64)


def segment_sum(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Sum of the values (1-D or 2-D) of each row; rows must ascend."""
    if values.ndim == 1:
        return np.bincount(row, weights=values, minlength=n)
    out = np.zeros((n, values.shape[1]), dtype=values.dtype)
    if len(row):
        first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        out[row[first]] = np.add.reduceat(values, first, axis=0)
    return out
