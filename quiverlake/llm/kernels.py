"""Vectorised text kernels over the byte buffers of Arrow string columns.

Words are ``[^\\x20\\x09-\\x0D]+``; all separators are ASCII, so UTF-8 bytes can
be cut without decoding.  A word's hash is a polynomial over random values of
its bytes, taken from prefix sums modulo 2**64 and mixed, so every word, prefix
and shingle of a chunk costs a few vector operations.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of text that a kernel holds in 8-byte columns at a time; a single longer text is taken whole.
CHUNK_BYTES = 1 << 19

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_STEP = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: A word's key is KEY_FACTOR times the number that its bytes are in base KEY_BASE, modulo 2**32.
KEY_BASE, KEY_FACTOR = 31, 2_654_435_769
_KEY_INVERSE = pow(KEY_BASE, -1, 2**64)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int, kept: dict = {}) -> np.ndarray:  # noqa: B006  the default is the cache
    got = kept.get(base)
    if got is None or len(got) < n:
        size = max(n, CHUNK_BYTES + 1)
        got = np.full(size, np.uint64(base))
        got[0] = 1
        got = np.multiply.accumulate(got)
        kept[base] = got
    return got[:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(raw: np.ndarray, at: np.ndarray):
    """(first row, bytes, offsets) of runs of whole texts of about CHUNK_BYTES."""
    n, i = len(at) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK_BYTES, "right")) - 1)
        j = min(j, n)
        yield i, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


class Words:
    """The words of a chunk: byte ranges, the word range of each text, and hashes."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, inside: np.ndarray | None = None):
        self.raw, self.at = raw, at
        n = len(raw)
        letters = ~SPACE[raw] if inside is None else inside[raw]
        first = letters.copy()
        first[1:] &= ~letters[:-1]
        last = letters.copy()
        last[:-1] &= ~letters[1:]
        inner = at[(at > 0) & (at < n)]  # a text ends a word
        first[inner] = letters[inner]
        last[inner - 1] = letters[inner - 1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.row_at = np.searchsorted(self.start, at)
        self.counts = np.diff(self.row_at)
        self._sums = None
        self._table = None

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), self.counts)

    def _prefix(self, table: np.ndarray) -> np.ndarray:
        if self._table is not table:
            sums = np.zeros(len(self.raw) + 1, np.uint64)
            np.cumsum(table[self.raw] * _powers(_BASE, len(self.raw)), out=sums[1:])
            self._sums, self._table = sums, table
        return self._sums

    def range_hash(self, start: np.ndarray, end: np.ndarray, lower: bool = False, table: np.ndarray | None = None) -> np.ndarray:
        sums = self._prefix(table if table is not None else _LOWER if lower else _BYTE)
        back = _powers(_INVERSE, len(self.raw) + 1)
        return mix((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64) * np.uint64(_INVERSE))

    def hashes(self, lower: bool = False) -> np.ndarray:
        return self.range_hash(self.start, self.end, lower)

    def keys(self) -> np.ndarray:
        """A number below 2**32 for each word, from its bytes (A-Z as a-z) alone and plain enough for SQL."""
        small = self.raw + ((self.raw >= 65) & (self.raw <= 90)).astype(np.uint8) * np.uint8(32)
        sums = np.zeros(len(self.raw) + 1, np.uint64)
        np.cumsum(small * _powers(_KEY_INVERSE, len(self.raw)), out=sums[1:])
        sums = (sums[self.end] - sums[self.start]) * _powers(KEY_BASE, len(self.raw) + 1)[self.end - 1]
        return (sums * np.uint64(KEY_FACTOR)) & np.uint64(0xFFFFFFFF)


def range_sums(h: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each range of ``h`` that depends on its values and their order, not on where it lies."""
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _powers(_BASE, len(h)), out=sums[1:])
    return (sums[end] - sums[first]) * _powers(_INVERSE, len(h) + 1)[first]


def window_hashes(words: Words, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of every run of ``k`` words within a text."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    row = words.row
    at = np.flatnonzero(row[: n - k + 1] == row[k - 1 :])
    total = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        total += h[j : n - k + 1 + j] * _STEP[j]
    return mix(total[at] + np.uint64(k)), at


def shingles(words: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every ``k``-word shingle; a shorter text with words is one shingle."""
    h = words.hashes(lower=True)
    full, at = window_hashes(words, h, k)
    row = words.row[at] if len(at) else np.zeros(0, np.int64)
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    if len(short):
        begin, count = words.row_at[short], words.counts[short]
        total = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = count > j
            total[has] += h[begin[has] + j] * _STEP[j]
        full = np.concatenate([full, mix(total + count.astype(np.uint64))])
        row = np.concatenate([row, short])
    return full, row


def pack(values: np.ndarray) -> bytes:
    """Integers as byte planes under Zstandard; non-decreasing ones should come as differences."""
    import zstandard

    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(blob: bytes, dtype) -> np.ndarray:
    import zstandard

    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(dtype).reshape(-1)


def pack_sorted(values: np.ndarray) -> bytes:
    out = values.copy()
    out[1:] -= values[:-1]
    return pack(out)


def unpack_sorted(blob: bytes, dtype) -> np.ndarray:
    out = unpack(blob, dtype)
    return np.cumsum(out, dtype=dtype)
