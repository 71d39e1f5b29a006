"""Substring deduplication with repeated-phrase automata.

Candidate passages are grouped so that equal windows of words meet
(``repeats``). A group's windows that recur are confirmed on the words
themselves and compiled into Aho-Corasick automata of bounded size; the
passages stream through them, which locates every occurrence. All but the
first occurrence of a window are removed.

Defined results: a null or empty text has no words; rows without doc_id take
no part, of rows that repeat one the smallest text stays; other columns are
ignored; an empty table gives an empty table. ``length`` must exceed
``GRAM`` words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from flowtrace.llm.arrays import (distinct_slices, gram_hashes, ranges, text_buffers, word_hashes,
                                  word_spans)
from flowtrace.llm.repeats import Unit, cut_out, merged, prepared, repeated_spans
from flowtrace.llm.tables import table

#: Words in a gram; windows in one automaton.
GRAM, AUTOMATON_WINDOWS = 4, 20_000


def _hashes(data, offsets):
    starts, ends, before = word_spans(data, offsets)
    hashes = word_hashes(data, starts, ends)
    return hashes, before, gram_hashes(hashes, GRAM), GRAM


def _spans(data, offsets):
    starts, ends, before = word_spans(data, offsets)
    return data, starts, ends, before


WORDS = Unit(_hashes, _spans)


def _compare(length: int):
    def run(rows: pa.Table, sizes: np.ndarray) -> np.ndarray:
        import ahocorasick

        data, offsets = text_buffers(rows.column("units"))
        starts, ends, before = word_spans(data, offsets)
        codes, _ = distinct_slices(data, starts, ends)  # exact: one code per distinct word
        codes = codes.astype(np.int64)
        windows = gram_hashes(codes.astype(np.uint64), length)
        at = ranges(before[:-1], sizes)  # word position of every start
        hashes = windows[at]
        order = np.argsort(hashes, kind="stable")
        ranked = hashes[order]
        head = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
        count = np.diff(np.append(head, len(ranked)))
        first = order[head[count > 1]]  # one start of every window that recurs
        marks = np.zeros(len(at), bool)
        if not len(first):
            return marks
        first.sort()
        owner = np.repeat(np.arange(len(sizes)), sizes)
        anchors = rows.column("anchor").to_numpy()
        docs, places = rows.column("doc_id").to_numpy(), rows.column("at").to_numpy()
        base = np.cumsum(sizes) - sizes
        # Segments whose anchor has a recurring window, by anchor.
        a = 0
        while a < len(first):
            b = min(len(first), a + AUTOMATON_WINDOWS)
            automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
            for n, s in enumerate(first[a:b].tolist()):
                automaton.add_word(tuple(codes[at[s]:at[s] + length].tolist()), n)
            automaton.make_automaton()
            segments = np.flatnonzero(np.isin(anchors, anchors[owner[first[a:b]]]))
            seen: dict[int, list] = {}
            for g in segments.tolist():
                words = tuple(codes[before[g]:before[g] + sizes[g] + length - 1].tolist())
                for end, n in automaton.iter(words):
                    s = end - length + 1
                    seen.setdefault(n, []).append((docs[g], places[g] + s, base[g] + s))
            for found in seen.values():
                if len(found) > 1:
                    keep = min(found)[2]
                    for _, _, where in found:
                        if where != keep:
                            marks[where] = True
            a = b
        return marks

    return run


def _cutter(batches):
    for batch in batches:
        data, offsets = text_buffers(batch.column("text"))
        starts, ends, before = word_spans(data, offsets)
        raw = data.tobytes()
        out = []
        for row, (doc, spans) in enumerate(zip(batch.column("doc_id").to_pylist(),
                                               batch.column("spans").to_pylist())):
            a, b = int(before[row]), int(before[row + 1])
            keep = np.ones(b - a, bool)
            s, e = merged(spans)
            keep[ranges(s, e - s)] = False
            at = np.flatnonzero(keep) + a
            kept = b" ".join([raw[x:y] for x, y in zip(starts[at].tolist(), ends[at].tolist())])
            out.append((doc, b - a, b - a - len(at), kept))
        cols = list(zip(*out)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.binary()])],
            ["doc_id", "n_words", "n_removed", "kept"])


def deduplicate(docs: DataFrame, length: int = 20) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): every word covered by a window of
    ``length`` words that also starts earlier is removed."""
    docs = prepared(docs)
    spans = repeated_spans(docs, WORDS, length, _compare(length), keep_first=True)
    return cut_out(docs, spans, _cutter, "doc_id long, n_words long, n_removed long, kept binary")


def op9_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove every 20-word window that also starts earlier."""
    return deduplicate(table(spark, sf_dir, "documents")).selectExpr(
        "doc_id", "n_words", "n_removed", "sha2(kept, 256) as kept_sha256")
