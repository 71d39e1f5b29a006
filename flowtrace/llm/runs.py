"""Periodic runs of words, found in a grammar.

Re-Pair turns a document's word ids into a grammar: in rounds, pairs of
neighbouring symbols that occur at least twice become a new symbol, frequent
pairs first (a place is replaced if its pair is more frequent than the two it
overlaps). The remaining sequence is paired up neighbour by neighbour, so one
symbol derives the document. A run lies across the middle of the lowest
symbol that derives all of it, so runs are looked for across each symbol's
middle, once per symbol, and are carried to every place where the grammar
derives it; overlapping pieces of a run are merged. A run of period q and
length 4q has 2q words on one side of the middle, which few values of q allow.

A document without a repeated pair has no grammar and no runs. The documents
of a batch are worked through together, in pieces of about ``PIECE_WORDS``
words beyond one document; nothing is shuffled.

Defined results: a null or empty text, or one without words, has no words, no
runs and an empty collapsed text; rows that repeat a doc_id, or have none,
each give their own row; other columns are ignored; an empty table gives an
empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtrace.llm.arrays import covered, distinct_slices, ranges, text_buffers, word_spans
from flowtrace.llm.tables import table

#: A run repeats at least so often and has at least so many words.
REPEATS, SHORTEST = 4, 6
#: Words in work at once, and candidates (middle, period) or compared words.
PIECE_WORDS, CANDIDATES = 200_000, 1 << 20


class Grammar:
    """Symbols over the words ``t`` of consecutive documents (``ends``: words
    before and with each). Symbol s < base is a word, others are
    (left[s - base], right[s - base])."""

    def __init__(self, t: np.ndarray, ends: np.ndarray):
        self.base = int(t.max()) + 1 if len(t) else 0
        self.left, self.right, self.first, self.length, self.rounds = [], [], [], [], []
        self.count = 0
        doc = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        sym, at = t.astype(np.int64), np.arange(len(t))
        size = np.ones(len(t), np.int64)
        sym, at, size, doc = self._repair(sym, at, size, doc)
        self._pair_up(sym, at, size, doc)
        self.left, self.right, self.first, self.length = (
            np.concatenate([*x, np.zeros(0, np.int64)]) for x in (self.left, self.right, self.first, self.length))

    def _add(self, left, right, first, length) -> np.ndarray:
        """New symbols; returns their ids."""
        for to, new in zip((self.left, self.right, self.first, self.length), (left, right, first, length)):
            to.append(new)
        ids = self.base + self.count + np.arange(len(left))
        self.rounds.append((self.count, self.count + len(left)))
        self.count += len(left)
        return ids

    def _repair(self, sym, at, size, doc):
        live = np.ones(len(sym), bool)
        self.grown = np.zeros(int(doc[-1]) + 1 if len(doc) else 0, bool)
        while True:
            live[-1:] = False
            live[:-1] &= doc[1:] == doc[:-1]
            i = np.flatnonzero(live)
            if not len(i):
                break
            span = int(sym.max()) + 1
            keys = (doc[i] * span + sym[i]) * span + sym[i + 1] if (int(doc[-1]) + 1) * span * span < 1 << 62 else \
                np.unique(np.stack([doc[i], sym[i], sym[i + 1]]), axis=1, return_inverse=True)[1]
            distinct, code, counts = np.unique(keys, return_inverse=True, return_counts=True)
            often = counts[code] > 1
            live[i[~often]] = False
            i, code = i[often], code[often]
            if not len(i):
                break
            # Rank of a pair: frequent first; it must beat both overlaps.
            rank = np.empty(len(distinct), np.int64)
            rank[np.argsort(counts, kind="stable")] = np.arange(1, len(distinct) + 1)
            here = np.zeros(len(sym) + 1, np.int64)
            here[i] = rank[code]
            best = (here[i] >= here[i - 1]) & (here[i] >= here[i + 1])  # here[-1] is 0
            i, code = i[best], code[best]
            # Every other place of a word that repeats itself.
            head = np.ones(len(i), bool)
            head[1:] = (i[1:] != i[:-1] + 1) | (code[1:] != code[:-1])
            block = np.maximum.accumulate(np.where(head, np.arange(len(i)), 0))
            even = (np.arange(len(i)) - block) % 2 == 0
            i, code = i[even], code[even]
            used = np.bincount(code, minlength=len(distinct)) > 1
            live[i[~used[code]]] = False
            i, code = i[used[code]], code[used[code]]
            if not len(i):
                continue
            _, lead, which = np.unique(code, return_index=True, return_inverse=True)
            lead = i[lead]
            ids = self._add(sym[lead], sym[lead + 1], at[lead], size[lead] + size[lead + 1])
            self.grown[doc[i]] = True
            sym[i] = ids[which]
            size[i] += size[i + 1]
            live[i] = True
            before = i[i > 0] - 1
            live[before] = True
            live[before[before > 0] - 1] = True  # the one before may start there by now
            stay = np.ones(len(sym), bool)
            stay[i + 1] = False
            sym, at, size, doc, live = sym[stay], at[stay], size[stay], doc[stay], live[stay]
        return sym, at, size, doc

    def _pair_up(self, sym, at, size, doc):
        mine = self.grown[doc] if len(doc) else np.zeros(0, bool)
        sym, at, size, doc = sym[mine], at[mine], size[mine], doc[mine]
        while len(sym):
            head = np.ones(len(sym), bool)
            head[1:] = doc[1:] != doc[:-1]
            place = np.arange(len(sym)) - np.maximum.accumulate(np.where(head, np.arange(len(sym)), 0))
            last = np.append(head[1:], True)
            i = np.flatnonzero((place % 2 == 0) & ~last)
            if not len(i):
                break
            sym[i] = self._add(sym[i], sym[i + 1], at[i], size[i] + size[i + 1])
            size[i] += size[i + 1]
            stay = np.ones(len(sym), bool)
            stay[i + 1] = False
            sym, at, size, doc = sym[stay], at[stay], size[stay], doc[stay]
        self.roots, self.root_at, self.root_doc = sym, at, doc


def _agree(t, a, b, most, step):
    """For every pair of places, how many words agree from there on, at most
    ``most`` (``step`` -1: towards the start)."""
    n, out, open_, width = len(a), np.zeros(len(a), np.int64), np.arange(len(a)), 16
    open_ = open_[most > 0]
    while len(open_):
        rows = max(1, CANDIDATES // width)
        rest = []
        for k in range(0, len(open_), rows):
            o = open_[k:k + rows]
            d = out[o][:, None] + np.arange(width)
            inside = d < most[o][:, None]
            d = np.where(inside, d, 0) * step
            same = (t[a[o][:, None] + d] == t[b[o][:, None] + d]) & inside
            good = np.where(same.all(axis=1), width, same.argmin(axis=1))
            out[o] += good
            rest.append(o[(good == width) & (out[o] < most[o])])
        open_, width = np.concatenate(rest), min(2 * width, CANDIDATES)
    return out


def _crossing(t, low, mid, high):
    """Runs across ``mid`` inside [low, high) of every symbol's first place:
    (symbol, start, end, period)."""
    most_q = np.where(high - low >= SHORTEST, (high - low) // REPEATS, 0)
    sums, out, a = np.append(0, np.cumsum(most_q)), [], 0
    while a < len(low):
        b = max(a + 1, int(np.searchsorted(sums, sums[a] + CANDIDATES, "right")) - 1)
        node = np.repeat(np.arange(a, b), most_q[a:b])
        q = ranges(np.ones(b - a, np.int64), most_q[a:b])
        for right in (True, False):
            # 2q words on that side repeat after q: samples first.
            c = mid[node] if right else mid[node] - 2 * q
            good = (c + 2 * q <= high[node]) & (c >= low[node])
            n, p, c = node[good], q[good], c[good]
            for k in (0, 1, 2, 3, 4):
                good = t[c + (p - 1) * k // 4] == t[c + (p - 1) * k // 4 + p]
                n, p, c = n[good], p[good], c[good]
            out.append((n, p, c))
        a = b
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    node, q, c = (np.concatenate(x) for x in zip(*out))
    found = []
    size = np.floor(np.log2(np.maximum(q, 1))).astype(np.int64)
    # Periods by powers of two: multiples of a run's period fall to it.
    for k in range(int(size.max()) + 1 if len(size) else 0):
        now = size == k
        n, p, x = node[now], q[now], c[now]
        more = _agree(t, x, x + p, high[n] - p - x, 1)
        less = _agree(t, x - 1, x - 1 + p, x - low[n], -1)
        s, e = x - less, x + more + p
        good = (s < mid[n]) & (e > mid[n]) & (e - s >= np.maximum(SHORTEST, REPEATS * p))
        runs = np.unique(np.stack([n, s, e, p])[:, good], axis=1)
        found.append(runs)
        node, q, c, size = (v[~now] for v in (node, q, c, size))
        # Drops windows that lie inside a run found across the same middle.
        for r in range(int(np.bincount(runs[0]).max()) if runs.shape[1] else 0):
            rn, head = np.unique(runs[0], return_index=True)
            pick = head + r
            pick = pick[pick < runs.shape[1]]
            pick = pick[runs[0][pick] == runs[0][pick - r]]
            s_of, e_of = np.full(len(low), np.iinfo(np.int64).max), np.full(len(low), -1)
            s_of[runs[0][pick]], e_of[runs[0][pick]] = runs[1][pick], runs[2][pick]
            keep = ~((c >= s_of[node]) & (c + 2 * q <= e_of[node]))
            node, q, c, size = (v[keep] for v in (node, q, c, size))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    # What also repeats after a multiple of its period keeps the period.
    n, s, e, p = np.concatenate(found, axis=1)
    order = np.lexsort((p, e, s, n))
    n, s, e, p = n[order], s[order], e[order], p[order]
    fresh = np.ones(len(n), bool)
    fresh[1:] = (n[1:] != n[:-1]) | (s[1:] != s[:-1]) | (e[1:] != e[:-1])
    return n[fresh], s[fresh], e[fresh], p[fresh]


def runs(t: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, start, length, period) of every run, by document, start and
    period; starts count from the document's first word."""
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    if len(t) < SHORTEST:
        return none
    g = Grammar(t, ends)
    if not g.count:
        return none

    def length(symbols):
        inner = symbols >= g.base
        return np.where(inner, g.length[np.where(inner, symbols - g.base, 0)], 1)

    node, s, e, q = _crossing(t, g.first, g.first + length(g.left), g.first + g.length)
    if not len(node):
        return none
    order = np.argsort(node, kind="stable")
    node, s, e, q = node[order], s[order] - g.first[node[order]], e[order] - g.first[node[order]], q[order]
    head, many = np.searchsorted(node, np.arange(g.count)), np.bincount(node, minlength=g.count)
    # Symbols that have runs or derive one that has.
    carries = many > 0
    for a, b in g.rounds:
        for child in (g.left[a:b], g.right[a:b]):
            inner = child >= g.base
            carries[a:b][inner] |= carries[child[inner] - g.base]
    # All places of those, from the roots down.
    inner = g.roots >= g.base
    symbol, at, doc, out = g.roots[inner] - g.base, g.root_at[inner], g.root_doc[inner], []
    while len(symbol):
        keep = carries[symbol]
        symbol, at, doc = symbol[keep], at[keep], doc[keep]
        which = ranges(head[symbol], many[symbol])
        base = np.repeat(at, many[symbol])
        out.append((np.repeat(doc, many[symbol]), base + s[which], base + e[which], q[which]))
        left, right = g.left[symbol], g.right[symbol]
        child = np.concatenate([left, right])
        at, doc = np.concatenate([at, at + length(left)]), np.concatenate([doc, doc])
        inner = child >= g.base
        symbol, at, doc = child[inner] - g.base, at[inner], doc[inner]
    doc, s, e, q = (np.concatenate(x) for x in zip(*out))
    # Pieces of one run share its period and at least that many words.
    order = np.lexsort((s, q, doc))
    doc, s, e, q = doc[order], s[order], e[order], q[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (q[1:] != q[:-1])
    group, width = np.cumsum(fresh) - 1, len(t) + 1
    low, high = covered(s + group * width, e - q + group * width)
    lead = np.flatnonzero(fresh)[low // width]
    doc, q = doc[lead], q[lead]
    s, length_ = low % width - ends[:-1][doc], high - low + q
    order = np.lexsort((q, s, doc))
    return doc[order], s[order], length_[order], q[order]


def repeated_tail(words: np.ndarray, ends: np.ndarray, hashes) -> np.ndarray:
    """Places to take the words from, after the rule of the query: where the
    hash ends in 0, the text from word a on repeats its next p words."""
    place = np.arange(len(words))
    for d, h in enumerate(hashes):
        start, n = int(ends[d]), int(ends[d + 1] - ends[d])
        if h is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            place[start + a:start + n] = start + a + np.arange(n - a) % p
    return place


def _finder(tail: bool):
    def pieces(ends):
        a = 0
        while a < len(ends) - 1:
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + PIECE_WORDS, "right")) - 1)
            yield a, b
            a = b

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            ids, hashes = batch.column("doc_id"), batch.column("hash").to_pylist()
            starts, stops, ends = word_spans(data, offsets)
            for a, b in pieces(ends):
                one, two = starts[ends[a]:ends[b]], stops[ends[a]:ends[b]]
                cuts = ends[a:b + 1] - ends[a]
                if len(one):
                    t = distinct_slices(data[one[0]:two[-1]], one - one[0], two - one[0])[0].astype(np.int64)
                else:
                    t = np.zeros(0, np.int64)
                if tail:
                    place = repeated_tail(t, cuts, hashes[a:b])
                    t, one, two = t[place], one[place], two[place]
                doc, s, n, q = runs(t, cuts)
                # Words behind a run's first period go.
                gone_from, gone_to = covered(cuts[:-1][doc] + s + q, cuts[:-1][doc] + s + n)
                keep = np.ones(len(t), bool)
                keep[ranges(gone_from, gone_to - gone_from)] = False
                # Kept words, each with a blank behind it.
                sizes = np.where(keep, two - one + 1, 0)
                text_ends = np.append(0, np.cumsum(sizes))
                text = np.full(int(text_ends[-1]), 0x20, np.uint8)
                text[ranges(text_ends[:-1][keep], sizes[keep] - 1)] = data[ranges(one[keep], sizes[keep] - 1)]
                text, edge = text.tobytes(), text_ends[cuts]
                split = np.searchsorted(doc, np.arange(b - a + 1))
                found, collapsed = [], []
                for d in range(b - a):
                    mine = slice(split[d], split[d + 1])
                    found.append([{"start": x, "length": y, "period": z} for x, y, z in
                                  zip(s[mine].tolist(), n[mine].tolist(), q[mine].tolist())])
                    collapsed.append(text[edge[d]:max(edge[d], edge[d + 1] - 1)])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array(np.diff(cuts)), pa.array(found, _RUN_LIST),
                     pa.array(collapsed, pa.binary())], ["doc_id", "n_words", "runs", "collapsed"])

    return run


_RUN_LIST = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))


def find(docs: DataFrame, tail: bool = False) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row: runs as an array of
    (start, length, period) by start and period; collapsed, in UTF-8, has each
    run's first period only. ``tail`` applies :func:`repeated_tail` first, by
    crc32 of the decimal doc_id (rows without one stay as they are)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.withColumn("hash", F.crc32(F.col("doc_id").cast("string").cast("binary"))).mapInArrow(
        _finder(tail), "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, "
                       "collapsed binary")


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document."""
    found = find(table(spark, sf_dir, "documents"), tail=True)
    # Greatest length; the list is in the order of ties.
    best = F.when(F.size("runs") > 0, F.aggregate(
        F.slice("runs", 2, F.greatest(F.size("runs") - 1, F.lit(0))), F.get("runs", F.lit(0)),
        lambda b, r: F.when(r["length"] > b["length"], r).otherwise(b)))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "").cast("binary"), 256)
        .alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))
