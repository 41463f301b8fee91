"""Words of whole Arrow string columns as numpy arrays: one pass over the bytes, no Python string per word.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D. Words are named by 64-bit polynomial hashes
modulo 2**64 over random byte values, finished by a bijective mix.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
try:  # arrays over 1 MB are mapped, so that their memory leaves a worker as soon as they are freed
    _libc = ctypes.CDLL(None)
    _libc.mallopt(-3, 1 << 20)
except (OSError, AttributeError):
    _libc = None


def release() -> None:
    """Give freed memory back to the system, where the C library can: workers live on between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_RANDOM = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
_FOLDED = _RANDOM.copy()
_FOLDED[65:91] = _RANDOM[97:123]
_M = 0x9E3779B97F4A7C15 | 1
_MINV = pow(_M, -1, 2**64)
_tables: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    got = _tables.get(base)
    if got is None or len(got) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        got = np.full(size, base, U)
        got[0] = 1
        got = np.cumprod(got, dtype=U)
        if size <= 1 << 21:  # a longer table, for one very long text, is not kept
            _tables[base] = got
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finisher of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def rolled(values: np.ndarray, k: int, base: int = _M, inverse: int = _MINV) -> np.ndarray:
    """Hash of each k consecutive values (len - k + 1 of them; across documents too, the caller masks)."""
    n = len(values)
    if n < k:
        return np.zeros(0, U)
    with np.errstate(over="ignore"):
        c = np.zeros(n + 1, U)
        np.cumsum(values * powers(base, n), out=c[1:])
        return mix((c[k:] - c[: n - k + 1]) * powers(inverse, n - k + 1))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(offsets: np.ndarray, most_bytes: int = 1 << 20, most_rows: int = 1000) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes and rows each (one longer text stands alone)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most_bytes, "right")) - 1
        j = max(i + 1, min(j, n, i + most_rows))
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray, fold: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends) in bytes, 64-bit names, and for each text the offset of its first word (one more at the end)."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, U), np.zeros(len(offsets), np.int64)
    text = ~_SPACE[data]
    first, last = text.copy(), text.copy()
    first[1:] &= ~text[:-1]
    last[:-1] &= ~text[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    first[edge] = text[edge]
    last[edge - 1] = text[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    with np.errstate(over="ignore"):
        c = np.zeros(n + 1, U)
        np.cumsum((_FOLDED if fold else _RANDOM)[data] * powers(_M, n), out=c[1:])
        names = mix((c[ends] - c[starts]) * powers(_MINV, n)[starts] + (ends - starts).astype(U))
    return starts, ends, names, np.searchsorted(starts, offsets)


def inside(word_offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows of k words: which begin and end in one text (mask over rolled()), and how many each text has."""
    total = int(word_offsets[-1])
    counts = np.maximum(np.diff(word_offsets) - k + 1, 0)
    ok = np.zeros(max(0, total - k + 1), bool)
    d = np.zeros(total + 1, np.int32)
    has = counts > 0
    np.add.at(d, word_offsets[:-1][has], 1)
    np.add.at(d, (word_offsets[:-1] + counts)[has], -1)
    if len(ok):
        ok[:] = np.cumsum(d)[: len(ok)] > 0
    return ok, counts
