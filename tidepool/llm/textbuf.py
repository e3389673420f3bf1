"""Whole columns of text as numpy byte buffers: words, hashes, windows and per-document sums.

A batch of texts is one ``uint8`` array plus document offsets; every function here works on all
documents of a batch at once. Words are runs of bytes outside ``\\x20\\x09-\\x0D``, which cuts UTF-8
text exactly as the pattern ``[^\\x20\\x09-\\x0D]+`` cuts its characters. Null texts count as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
U64 = np.uint64

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_RNG = np.random.default_rng(20250101)
_BYTE_VALUE = _RNG.integers(0, 1 << 64, 256, dtype=U64)
_BYTE_VALUE_LOWER = _BYTE_VALUE[LOWER]
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POWERS = [np.ones(1, U64), np.ones(1, U64)]
STEP_POWERS, KEPT_POWERS = 1 << 18, 5 << 19


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse modulo 2**64; kept between calls up to KEPT_POWERS."""
    if len(_POWERS[0]) >= n:
        return _POWERS[0][:n], _POWERS[1][:n]
    size, made = (n // STEP_POWERS + 1) * STEP_POWERS, []
    for base in (_BASE, _BASE_INV):
        steps = np.full(size, base, U64)
        steps[0] = 1
        made.append(np.cumprod(steps, dtype=U64))
    if size <= KEPT_POWERS:
        _POWERS[:] = made
    return made[0][:n], made[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def prefix(values: np.ndarray) -> np.ndarray:
    """Running polynomial hash of a sequence of 64-bit values; ``span`` reads any stretch of it."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def span(pre: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each stretch [start, end) of the sequence behind ``prefix``; it includes the length."""
    inv = powers(len(pre))[1]
    return mix((pre[ends] - pre[starts]) * inv[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def rolling(pre: np.ndarray, k: int) -> np.ndarray:
    """``span`` of every window of k values."""
    n = len(pre) - k
    if n <= 0:
        return np.empty(0, U64)
    return mix((pre[k:] - pre[:-k]) * powers(len(pre))[1][:n] + U64(k * 0xD6E8FEB86659FD93 % (1 << 64)))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, document offsets) of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset :]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts hold about ``limit`` bytes, so memory doesn't follow the batch size.

    After the last one the worker gives back what it no longer uses: workers outlive their tasks.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = (np.cumsum(sizes) - sizes // 2) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(a, b - a)
        del batch
    release()


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _trim = None


def release() -> None:
    """Return freed memory to the system."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


class Words:
    """Words of a batch, between the bytes of ``between``. ``first[d]:first[d + 1]`` are the words of document d."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, between: np.ndarray = IS_SPACE):
        n = len(data)
        self.data, self.offsets = data, offsets
        space = between[data]
        before, after = np.empty(n, bool), np.empty(n, bool)
        if n:
            before[0], after[-1] = True, True
            before[1:], after[:-1] = space[:-1], space[1:]
            before[offsets[:-1][offsets[:-1] < n]] = True
            after[offsets[1:][offsets[1:] > 0] - 1] = True
        self.starts = np.flatnonzero(~space & before)
        self.ends = np.flatnonzero(~space & after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.count)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """One 64-bit hash per word; ``lower`` folds A-Z first."""
        pre = prefix((_BYTE_VALUE_LOWER if lower else _BYTE_VALUE)[self.data])
        return span(pre, self.starts, self.ends)

    def windows(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(start word, hash) of each window of k words that stays in one document."""
        h = rolling(prefix(hashes), k)
        at = np.flatnonzero(self.doc[: len(h)] == self.doc[k - 1 :]) if len(h) else np.empty(0, np.int64)
        return at, h[at]


def byte_prefix(data: np.ndarray) -> np.ndarray:
    return prefix(_BYTE_VALUE[data])


def per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of an array over each document's stretch."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def sort_within(values: np.ndarray, bounds: np.ndarray) -> None:
    """Sort each stretch bounds[i]:bounds[i + 1] in place."""
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a > 1:
            values[a:b].sort()


def ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Concatenation of arange(start, end) for each pair."""
    size = ends - starts
    at = np.repeat(starts - (np.cumsum(size) - size), size)
    return at + np.arange(int(size.sum()))


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Boolean mask of positions inside any [start, end)."""
    delta = np.zeros(n + 1, np.int32)
    np.add.at(delta, starts, 1)
    np.subtract.at(delta, ends, 1)
    return np.cumsum(delta[:n]) > 0


def duplicated(keys: np.ndarray) -> np.ndarray:
    """Mask of the values that occur at least twice."""
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys


def keyed(doc: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Hashes that only agree within one document."""
    return mix(hashes ^ mix(doc.astype(U64) + U64(1)))


def joined_words(words: Words, gone: np.ndarray) -> pa.Array:
    """For each document its words that aren't ``gone``, joined by one space."""
    stay = np.flatnonzero(~gone)
    change = np.zeros(len(words.data) + 1, np.int32)
    change[words.starts[stay]] += 1
    np.subtract.at(change, words.ends[stay], 1)
    keep = np.cumsum(change[:-1]) > 0
    gap = words.starts[stay[1:][words.doc[stay[1:]] == words.doc[stay[:-1]]]] - 1  # the byte before each word but the first
    keep[gap] = True
    out = words.data.copy()
    out[gap] = 32
    bounds = np.r_[0, np.cumsum(keep)][words.offsets].astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(words.offsets) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(out[keep])]).cast(pa.string())
