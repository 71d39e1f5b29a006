"""Substring deduplication with suffix order and longest-previous-factor
arrays.

Candidate texts are grouped so that suffixes with a common prefix of the
wanted length meet (``repeats``). Within a group, prefix doubling ranks the
suffixes by their first ``length`` bytes; suffixes of equal rank are ordered
by position. In that order the previous smaller position of a suffix that
shares ``length`` bytes with an earlier one is its neighbour, so the
longest-previous-factor array (cut at ``length``) is a comparison of
neighbours. ``keep_first`` removes what has an earlier match; else the
earlier matches that were pointed at go too.

Defined results: a null or empty text has no bytes and loses none; rows
without doc_id take no part, of rows that repeat one the smallest text stays;
other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from flowtrace.llm.arrays import mix, ranges, text_buffers
from flowtrace.llm.repeats import Unit, cut_out, merged, prepared, repeated_spans
from flowtrace.llm.tables import table

GRAM = 16


def _byte_hashes(data, offsets):
    n = len(data) - GRAM + 1
    if n <= 0:
        return data, offsets, np.zeros(0, np.uint64), GRAM
    words = np.ndarray(len(data) - 7, "<u8", np.ascontiguousarray(data), strides=(1,))
    grams = mix(words[:n] * np.uint64(0x9E3779B97F4A7C15) ^ mix(words[8:8 + n]))
    return data, offsets, grams, GRAM


def _byte_spans(data, offsets):
    at = np.arange(len(data) + 1)
    return data, at[:-1], at[1:], offsets


BYTES = Unit(_byte_hashes, _byte_spans)


def suffix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Rank of every suffix by its first ``length`` bytes (prefix doubling);
    suffixes at the end are padded."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    span = 8 if length >= 8 else 1
    if span == 8:
        keys = np.ndarray(n, ">u8", padded, strides=(1,)).astype(np.uint64)
    else:
        keys = data.astype(np.uint64)
    _, rank = np.unique(keys, return_inverse=True)

    def joined(rank, shift):
        second = np.zeros(n, np.uint64)
        second[:n - shift] = rank[shift:] + 1
        return np.unique((rank.astype(np.uint64) << np.uint64(32)) | second, return_inverse=True)[1]

    while 2 * span <= length:
        rank = joined(rank, span) if span < n else rank
        span *= 2
    if span < length and length - span < n:
        rank = joined(rank, length - span)
    return rank


def previous_factors(rank: np.ndarray, position: np.ndarray) -> np.ndarray:
    """For every suffix, the index of the earlier one that shares its
    ``length`` bytes: its previous smaller position in suffix order, where
    that neighbour has the same rank; else -1."""
    order = np.lexsort((position, rank))
    out = np.full(len(rank), -1)
    same = rank[order[1:]] == rank[order[:-1]]
    out[order[1:][same]] = order[:-1][same]
    return out


def _window_hashes(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A rolling hash of ``data[s:s + length]`` per start, in bounded pieces."""
    out = np.zeros(len(starts), np.uint64)
    step = 1 << 19
    powers = np.full(step + length, np.uint64(0x9E3779B97F4A7C15), np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers)
    scramble = mix(np.arange(1, 257, dtype=np.uint64))
    for a in range(0, len(data), step):
        mine = np.flatnonzero((starts >= a) & (starts < a + step))
        if len(mine):
            piece = data[a:a + step + length]
            sums = np.append(np.uint64(0), np.cumsum(scramble[piece] * powers[:len(piece)]))
            at = starts[mine] - a
            out[mine] = (sums[at + length] - sums[at]) * powers[step - at]
    return out


def _compare(length: int, keep_first: bool):
    def run(rows: pa.Table, sizes: np.ndarray) -> np.ndarray:
        data, offsets = text_buffers(rows.column("units"))
        base = offsets[:-1]
        starts = ranges(base, sizes)
        hashes = _window_hashes(data, starts, length)
        order = np.argsort(hashes, kind="stable")
        equal = hashes[order[1:]] == hashes[order[:-1]]
        maybe = np.zeros(len(starts), bool)
        maybe[order[1:][equal]] = True
        maybe[order[:-1][equal]] = True
        marks = np.zeros(len(starts), bool)
        at = np.flatnonzero(maybe)
        if not len(at):
            return marks
        # Suffix order of the stretches that hold candidates.
        owner = np.repeat(np.arange(len(sizes)), sizes)
        fresh = np.ones(len(at), bool)
        fresh[1:] = (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])
        head = np.flatnonzero(fresh)
        run_len = np.diff(np.append(head, len(at)))
        spans = run_len + length - 1
        pieces = data[ranges(starts[at[head]], spans)]
        within = ranges(np.cumsum(spans) - spans, run_len)
        rank = suffix_ranks(pieces, length)[within]
        doc = rows.column("doc_id").to_numpy()[owner[at]]
        place = rows.column("at").to_numpy()[owner[at]] + (starts[at] - base[owner[at]])
        position = np.empty(len(at), np.int64)
        position[np.lexsort((place, doc))] = np.arange(len(at))
        earlier = previous_factors(rank, position)
        hit = earlier >= 0
        marks[at[hit]] = True
        if not keep_first:
            marks[at[earlier[hit]]] = True
        return marks

    return run


def _cutter(batches):
    for batch in batches:
        data, offsets = text_buffers(batch.column("text"))
        out = []
        for row, (doc, spans) in enumerate(zip(batch.column("doc_id").to_pylist(),
                                               batch.column("spans").to_pylist())):
            text = data[offsets[row]:offsets[row + 1]]
            starts, ends = merged(spans)
            keep = np.ones(len(text), bool)
            keep[ranges(starts, ends - starts)] = False
            kept = text[keep].tobytes()
            out.append((doc, len(text), len(text) - len(kept), len(starts), kept))
        cols = list(zip(*out)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.binary()])],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def deduplicate(docs: DataFrame, length: int = 400, keep_first: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): every byte that is covered
    by a ``length``-byte string which also starts elsewhere is removed."""
    docs = prepared(docs)
    spans = repeated_spans(docs, BYTES, length, _compare(length, keep_first), keep_first)
    return cut_out(docs, spans, _cutter,
                   "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove every byte of a 400-byte string that occurs more than once."""
    return deduplicate(table(spark, sf_dir, "documents")).selectExpr(
        "doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256) as kept_sha256")
