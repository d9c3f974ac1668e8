"""Words, word hashes and word windows of Arrow text columns, by numpy.

A word is a maximal run of ``[^\\x20\\x09-\\x0D]``: those separators are single
bytes in UTF-8 that never stand inside another character, so words are found on
bytes. All arrays here are bounded by ``slices``' byte limit or by one text,
whichever is larger; no function keeps more than a slice at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_M64 = (1 << 64) - 1
# An odd multiplier and its inverse modulo 2**64 turn prefix sums into substring hashes.
_R = 0x9E3779B97F4A7C15
_R_INV = pow(_R, -1, 1 << 64)


class Cache(dict):
    """Values that a process makes for itself: they are not sent with functions."""

    def __reduce__(self):
        return Cache, ()


_TABLES = Cache()


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)
    at = at[column.offset:column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]], at - at[0]


def lean() -> None:
    """Freed arrays go back to the system soon. Spark keeps Python workers for later tasks,
    and several share an executor's memory: what one has freed must not stay its own for
    good. Arrays from 4 MB on are mapped by themselves, and 32 MB at most are kept for the
    smaller ones (giving every one back at once costs half as much time again)."""
    import ctypes

    pa.set_memory_pool(pa.system_memory_pool())
    set_option = getattr(ctypes.CDLL(None), "mallopt", None)
    if set_option is not None:  # glibc's M_MMAP_THRESHOLD and M_TRIM_THRESHOLD
        set_option(-3, 4 << 20)
        set_option(-1, 32 << 20)


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES
           ) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows of at most ``limit`` bytes of text, or one row."""
    lean()
    _, at = text_bytes(batch.column(text))
    first = 0
    while first < batch.num_rows:
        end = int(np.searchsorted(at, at[first] + limit, "right")) - 1
        end = min(max(end, first + 1), batch.num_rows)
        yield batch.slice(first, end - first)
        first = end


def word_bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte ranges of all words; words of row i are
    ``first[i]:first[i + 1]``."""
    separator = np.zeros(256, bool)
    separator[[9, 10, 11, 12, 13, 32]] = True
    inside = ~separator[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    full = at[:-1] < at[1:]
    before[at[:-1][full]] = False
    after[at[1:][full] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse up to n, kept for later calls."""
    have = _TABLES.get("powers")
    if have is None or len(have[0]) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        out = []
        for r in (_R, _R_INV):
            p = np.ones(size, np.uint64)
            filled, step = 1, r
            while filled < size:  # doubling: p[k + filled] = p[k] * r**filled
                take = min(filled, size - filled)
                p[filled:filled + take] = p[:take] * np.uint64(step)
                filled, step = filled + take, (step * step) & _M64
            out.append(p)
        have = _TABLES["powers"] = tuple(out)
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, the same wherever the bytes stand."""
    up, down = _powers(len(data))
    byte = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_R))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte[data] * up[:len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every window of ``width`` successive word hashes."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h *= np.uint64(_R)
        h += words[k:k + n]
    return mix(h)


def window_starts(first: np.ndarray, width: int) -> np.ndarray:
    """Indices of the words at which a whole window of one row starts."""
    n = np.diff(first)
    counts = np.maximum(n - width + 1, 0)
    total = int(counts.sum())
    base = np.repeat(first[:-1] - (np.cumsum(counts) - counts), counts)
    return base + np.arange(total)


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i + 1]] for each row i; 0 where empty."""
    total = np.zeros(len(values) + 1, np.result_type(values.dtype, np.int64)
                     if values.dtype.kind in "bi" else values.dtype)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
