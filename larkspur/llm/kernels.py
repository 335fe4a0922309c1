"""Vectorised text kernels that the operators of this subpackage share.

Everything here works on one Arrow batch at a time: the texts are laid end to
end as UTF-8 bytes and handled with whole-array numpy operations, so that the
cost per document is small and the memory is a small multiple of the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are handled at once.
BLOCK_BYTES = (2 << 20) - 4096

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser, so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_R = 0xD1342543DE82EF95
_R_INV = pow(_R, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2 ** 64, by doubling."""
    out = np.ones(max(n, 1), dtype=np.uint64)
    have, step = 1, base
    while have < n:
        take = min(have, n - have)
        out[have : have + take] = out[:take] * np.uint64(step)
        have, step = have + take, step * step % (1 << 64)
    return out


_cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _cache:
        _cache.clear()
        _cache[size] = (_powers(_R, size), _powers(_R_INV, size))
    return _cache[size]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and n + 1 offsets. Null counts as empty."""
    texts = texts.fill_null("").cast(pa.large_utf8())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in order, in batches of about ``size`` bytes of text; a longer text stands alone. After the last one a worker keeps nothing."""
    held: list[pa.RecordBatch] = []
    weight = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
        ends, start, base = np.cumsum(lengths), 0, 0
        while start < len(lengths):
            stop = max(start + 1, int(np.searchsorted(ends, base + size - weight, side="right")))
            if stop > len(lengths):
                stop = len(lengths)
            held.append(batch.slice(start, stop - start))
            weight += int(ends[stop - 1]) - base
            base, start = int(ends[stop - 1]), stop
            if weight >= size or start < len(lengths):
                yield _join(held)
                held, weight = [], 0
    if held:
        yield _join(held)
    held, batch = [], None
    _cache.clear()
    release()


def release() -> None:
    """Give freed memory back to the system, so that workers that wait hold little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def _join(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(held) == 1:
        return held[0]
    return pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of every text: 64-bit hashes, text index (int32) and the number of words of each text.

    A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``; A-Z count as a-z if ``lower``.
    """
    n_texts = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(n_texts, np.int64)
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(data)]
    first[cuts] = solid[cuts]
    starts = np.flatnonzero(first)
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    ends_at = cuts - 1
    ends_at = ends_at[ends_at >= 0]
    last[ends_at] = solid[ends_at]
    ends = np.flatnonzero(last) + 1
    powers, inverse = _tables(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[_LOWER[data] if lower else data] * powers[: len(data)], out=total[1:])
    hashed = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    counts = np.diff(np.searchsorted(starts, offsets, side="left"))
    return hashed, np.repeat(np.arange(n_texts, dtype=np.int32), counts), counts


def grams(hashed: np.ndarray, n: int) -> np.ndarray:
    """Hash of words i..i+n-1 for every i up to the last full window of the block."""
    m = len(hashed) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = hashed[:m].copy()
    for k in range(1, n):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + hashed[k : k + m])
    return out
