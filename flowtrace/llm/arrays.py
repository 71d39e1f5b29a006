"""Vectorised text helpers for code that runs inside Arrow tasks.

A batch of texts is one byte array plus offsets; words, tokens and windows
are index arrays over it, so no per-word Python objects are made.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes between words: [\x20\x09-\x0D].
SPACE_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Bytes that are worked on at a time: a task's arrays are many times as large.
PIECE = 1 << 19


def pieces(batch: pa.RecordBatch, *columns: str) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of ``batch``, with PIECE bytes of the ``columns``
    (texts or lists of numbers) at most or one row."""
    sizes = np.zeros(batch.num_rows, np.int64)
    for column in map(batch.column, columns):
        if pa.types.is_list(column.type):
            lengths = column.value_lengths().fill_null(0).to_numpy()
            sizes += lengths * (column.type.value_type.bit_width // 8)
        else:
            sizes += np.diff(text_buffers(column)[1])
    ends, a = np.cumsum(sizes), 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PIECE, "right")))
        yield batch.slice(a, b - a)
        a = b


def returning(run: Callable) -> Callable:
    """``run`` for mapInArrow, after which the worker, that Spark keeps for
    other tasks, gives what it has freed back to the system."""

    def task(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
            trim(0)

    return task


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[column.offset:column.offset + len(column) + 1] \
        if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else \
        np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A large_binary array over consecutive slices of ``data``."""
    return pa.Array.from_buffers(
        pa.large_binary(), len(offsets) - 1,
        [None, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int64)), pa.py_buffer(data)])


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) byte positions of every word and, per text, the number of
    words before it (one more entry than texts)."""
    table = np.ones(256, dtype=bool)
    table[list(SPACE_BYTES)] = False
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = table[data]
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:n]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets, "left")


def distinct_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray
                    ) -> tuple[np.ndarray, pa.Array]:
    """(code per slice, distinct slices as large_binary). Slices ascend and
    do not overlap; the gaps between them are encoded too and skipped."""
    edges = np.empty(2 * len(starts) + 1, dtype=np.int64)
    edges[:-1:2], edges[1::2] = starts, ends
    edges[-1] = ends[-1] if len(ends) else 0
    coded = pc.dictionary_encode(binary_array(data, edges))
    return coded.indices.to_numpy(zero_copy_only=False)[::2], coded.dictionary


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (every input bit reaches every output bit)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every word's bytes (hashed once per distinct word)."""
    import xxhash

    if not len(starts):
        return np.zeros(0, np.uint64)
    codes, words = distinct_slices(data, starts, ends)
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()),
                         dtype=np.uint64, count=len(words))
    return hashed[codes]


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive entries (also across texts:
    callers keep the starts that lie inside one)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(k))
    for j in range(k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[j:j + n])
    return out


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive entries."""
    if width <= 1:
        return values
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    span, low = 1, values
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    return np.minimum(low[:n], low[width - span:width - span + n])


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of arange(start, start + length) for every pair."""
    lengths = np.asarray(lengths, dtype=np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - before, lengths)


def gather_slices(data: np.ndarray, offsets: np.ndarray, which: np.ndarray
                  ) -> tuple[np.ndarray, np.ndarray]:
    """Slices ``which`` of (data, offsets), concatenated: (data, lengths)."""
    lengths = (offsets[1:] - offsets[:-1])[which]
    return data[ranges(offsets[:-1][which], lengths)], lengths


def covered(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open intervals as maximal disjoint intervals."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(starts, kind="stable")
    s, e = np.asarray(starts, np.int64)[order], np.maximum.accumulate(np.asarray(ends, np.int64)[order])
    fresh = np.ones(len(s), dtype=bool)
    fresh[1:] = s[1:] > e[:-1]
    heads = np.flatnonzero(fresh)
    return s[heads], e[np.append(heads[1:] - 1, len(s) - 1)]
