"""Alignment of two tokenizers over the same bytes.

Both tokenizers cut blank + text into byte ranges. Where a range of each ends
at the same byte, the shared end closes a group: the tokens since the last
shared end. Shared ends come from a galloping intersection of the two end
lists: each element of the shorter list is looked up in the longer one by
steps of doubling size and a binary search between the last two.

All token pairs of a group are linked. Documents come in blocks: a block
holds the distinct (document, pair) entries of its documents as codes of its
distinct pairs. Only a block's distinct pairs are shuffled, with the number of
its documents that hold them, to be counted over the corpus; the counts go
back to the blocks. A pair that every document holds is one row per block.
A block has at most about ``BLOCK_PAIRS`` entries: a document with more is
spread over blocks by its A ids.

Defined results: null and empty texts, and those that one of the tokenizers
does not reproduce byte by byte, have no tokens: zeros, and '' as digest; rows
that repeat a doc_id, or have none, are documents each on its own; other
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtrace.llm.arrays import ranges, text_buffers
from flowtrace.llm.byte_bpe import _packed, _unpacked
from flowtrace.llm.subwords import ByteLevelBpe, PieceModel, parts
from flowtrace.llm.tables import stored, table

#: (document, pair) entries and documents of a block; tokens linked at a time.
BLOCK_PAIRS, BLOCK_DOCS, LINK_TOKENS = 1_000_000, 50_000, 1_000_000


def _lookup(x: np.ndarray, long: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each x, the first place in ``long`` from ``low`` on that is not
    below it: steps of doubling size, then a binary search."""
    low, high, width, open_ = low.copy(), low.copy(), 1, np.arange(len(x))
    while len(open_):
        open_ = open_[high[open_] < len(long)]
        open_ = open_[long[high[open_]] < x[open_]]
        low[open_] = high[open_] + 1
        high[open_] += width
        width *= 2
    high = np.minimum(high, len(long))
    open_ = np.flatnonzero(low < high)
    while len(open_):
        mid = (low[open_] + high[open_]) >> 1
        below = long[mid] < x[open_]
        low[open_[below]] = mid[below] + 1
        high[open_[~below]] = mid[~below]
        open_ = open_[low[open_] < high[open_]]
    return low


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each element of ``short``, the first place in ``long`` that is not
    below it. Both ascend. Of the elements every 2^k-th is looked up first;
    an element starts where the nearest earlier one was found."""
    n = len(short)
    found = np.zeros(n, np.int64)
    found[:1] = _lookup(short[:1], long, np.zeros(min(n, 1), np.int64))
    for k in reversed(range(max(n - 1, 0).bit_length())):
        i = np.arange(1 << k, n, 2 << k)
        found[i] = _lookup(short[i], long, found[i - (1 << k)])
    return found


def shared_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ends that both lists hold; the shorter list drives."""
    if len(b) < len(a):
        y, x = shared_ends(b, a)
        return x, y
    at = gallop(a, b)
    same = np.flatnonzero(at < len(b))
    same = same[b[at[same]] == a[same]]
    return same, at[same]


def _decimals(n: int, separator: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the numbers below n, each with the separator."""
    written = [f"{i}{separator}".encode() for i in range(n)]
    return np.frombuffer(b"".join(written), np.uint8), np.append(0, np.cumsum([len(w) for w in written]))


class Writer:
    """The digest text of groups: ``a1,a2|b1;a3|b2,b3;``"""

    def __init__(self, n_a: int, n_b: int):
        # Tables in order: A id inside and at the end of its half, B likewise.
        tables = [_decimals(n_a, ","), _decimals(n_a, "|"), _decimals(n_b, ","), _decimals(n_b, ";")]
        self.data = np.concatenate([d for d, _ in tables])
        base = np.append(0, np.cumsum([len(d) for d, _ in tables]))
        self.starts = [o[:-1] + s for (_, o), s in zip(tables, base)]
        self.sizes = [np.diff(o) for _, o in tables]

    def text(self, a, b, a_ends, b_ends) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all groups, bytes before and with each group)."""
        a_from, b_from = np.append(0, a_ends[:-1]), np.append(0, b_ends[:-1])
        group_a = np.repeat(np.arange(len(a_ends)), a_ends - a_from)
        group_b = np.repeat(np.arange(len(b_ends)), b_ends - b_from)
        place_a = np.arange(len(a)) + b_from[group_a]
        place_b = np.arange(len(b)) + a_ends[group_b]
        start, size = (np.empty(len(a) + len(b), np.int64) for _ in range(2))
        for ids, place, ends, k in ((a, place_a, a_ends, 0), (b, place_b, b_ends, 2)):
            start[place], size[place] = self.starts[k][ids], self.sizes[k][ids]
            last = place[ends - 1]
            start[last], size[last] = self.starts[k + 1][ids[ends - 1]], self.sizes[k + 1][ids[ends - 1]]
        sums = np.append(0, np.cumsum(size))
        return self.data[ranges(start, size)], sums[np.append(0, a_ends + b_ends)]


def _tally(group: np.ndarray, ids: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, id, occurrences), distinct, by group."""
    keys, counts = np.unique(group * span + ids, return_counts=True)
    return keys // span, keys % span, counts


def linked(a, b, a_ends, b_ends, doc, span: int, share: tuple[int, int] = (0, 1)):
    """Slices of [document, a, b, links] over the pairs of all groups, at most
    about BLOCK_PAIRS entries each; ``doc``: document of every group. What a
    document has in two slices differs in the A id. ``share`` (k, n): only A
    ids that leave k when divided by n."""
    n_a, n_b = np.diff(a_ends, prepend=0), np.diff(b_ends, prepend=0)
    single = (n_a == 1) & (n_b == 1)
    g, many = np.flatnonzero(single), np.flatnonzero(~single)
    g = g[a[a_ends[g] - 1] % share[1] == share[0]]
    one = [doc[g], a[a_ends[g] - 1].astype(np.int64), b[b_ends[g] - 1].astype(np.int64), np.ones(len(g), np.int64)]
    ia, ib = ranges(a_ends[many] - n_a[many], n_a[many]), ranges(b_ends[many] - n_b[many], n_b[many])
    ga = np.repeat(np.arange(len(many)), n_a[many])
    mine = a[ia] % share[1] == share[0]
    ga, xa, ca = _tally(ga[mine], a[ia[mine]].astype(np.int64), span)
    gb, xb, cb = _tally(np.repeat(np.arange(len(many)), n_b[many]), b[ib].astype(np.int64), span)
    first, fan = np.searchsorted(gb, np.arange(len(many))), np.bincount(gb, minlength=len(many))[ga]
    # Both kinds by document and A id; slices end between A ids.
    key_one, key_many = one[0] * span + one[1], doc[many][ga] * span + xa
    order = np.argsort(key_one, kind="stable")
    one, key_one = [v[order] for v in one], key_one[order]
    order = np.argsort(key_many, kind="stable")
    ga, xa, ca, fan, key_many = ga[order], xa[order], ca[order], fan[order], key_many[order]
    keys = np.unique(np.concatenate([key_one, key_many]))
    upto = np.searchsorted(key_one, keys, "right") \
        + np.append(0, np.cumsum(fan))[np.searchsorted(key_many, keys, "right")]
    at = 0
    while at < len(keys):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BLOCK_PAIRS, "right")))
        s = slice(*np.searchsorted(key_one, [keys[at], keys[to - 1] + 1]))
        m = slice(*np.searchsorted(key_many, [keys[at], keys[to - 1] + 1]))
        other = ranges(first[ga[m]], fan[m])
        yield [np.concatenate([x[s], y]) for x, y in zip(one, (
            np.repeat(doc[many][ga[m]], fan[m]), np.repeat(xa[m], fan[m]), xb[other],
            np.repeat(ca[m], fan[m]) * cb[other]))]
        at = to


_DOC = "row:long,doc_id:long,n_a:long,n_b:long,n_groups:long,n_links:long,groups_sha256:string"
_BLOCK = f"block long, docs array<struct<{_DOC}>>, rows array<long>, counts array<int>, codes binary, " \
         "links_low binary, links_high binary, a array<int>, b array<int>, n array<int>"
_FIELDS = pa.schema([
    ("block", pa.int64()),
    ("docs", pa.list_(pa.struct([(f.split(":")[0], pa.string() if f.endswith("string") else pa.int64())
                                 for f in _DOC.split(",")]))),
    ("rows", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("codes", pa.binary()),
    ("links_low", pa.binary()), ("links_high", pa.binary()), *((k, pa.list_(pa.int32())) for k in "abn")])


class Blocks:
    """Documents and their pairs, collected into blocks."""

    def __init__(self, part: int, span: int):
        self.part, self.span, self.seq = part, span, 0
        self.docs, self.entries, self.size = [], [], 0

    def add(self, row, a, b, links):
        """Entries of a slice; yields a block when there are enough."""
        self.entries.append((row, a * self.span + b, links))
        self.size += len(row)
        if self.size >= BLOCK_PAIRS:
            yield self.flush()

    def flush(self) -> pa.RecordBatch:
        none = np.zeros(0, np.int64)
        row, pair, links = (np.concatenate([none, *x]) for x in zip(*self.entries)) if self.entries else (none,) * 3
        order = np.lexsort((pair, row))
        row, pair, links = row[order], pair[order], links[order]
        fresh = np.ones(len(row), bool)
        fresh[1:] = (row[1:] != row[:-1]) | (pair[1:] != pair[:-1])
        head = np.flatnonzero(fresh)
        links = np.add.reduceat(links, head) if len(head) else links
        rows, counts = np.unique(row[head], return_counts=True)
        distinct, code, n = np.unique(pair[head], return_inverse=True, return_counts=True)
        out = pa.RecordBatch.from_pylist([{
            "block": (self.part << 32) + self.seq, "docs": self.docs, "rows": rows, "counts": counts,
            "codes": _packed(code), "links_low": _packed(links & 0xFFFFFFFF), "links_high": _packed(links >> 32),
            "a": distinct // self.span, "b": distinct % self.span, "n": n}], schema=_FIELDS)
        self.docs, self.entries, self.size, self.seq = [], [], 0, self.seq + 1
        return out


class Batch:
    """Texts of a batch (blank first) under both tokenizers, part by part."""

    def __init__(self, data, offsets, one, two):
        self.offsets = offsets
        self.parts = [(first, text, cuts, one.ids(text, cuts), two.ids(text, cuts))
                      for first, text, cuts in parts(data, offsets)]

    def reproduced(self, spellings) -> np.ndarray:
        """Texts, not empty, that both tokenizers' ids spell byte by byte."""
        good = np.diff(self.offsets) > 0
        for first, text, cuts, *encoded in self.parts:
            for (ids, counts), (spelt, starts, sizes) in zip(encoded, spellings):
                if int(sizes[ids].sum()) == len(text) and np.array_equal(spelt[ranges(starts[ids], sizes[ids])], text):
                    continue
                ends = np.append(0, np.cumsum(counts))
                for t in range(len(counts)):
                    mine = ids[ends[t]:ends[t + 1]]
                    good[first + t] &= np.array_equal(spelt[ranges(starts[mine], sizes[mine])],
                                                      text[cuts[t]:cuts[t + 1]])
        return good


def _joined(held, span: int):
    """Slices of links over parts that share a text; parts with many tokens
    are linked by shares of the A ids."""
    if not held:
        return
    a, b = (np.concatenate([part[k] for part in held]) for k in (0, 1))
    before = [np.cumsum([0] + [len(part[k]) for part in held]) for k in (0, 1)]
    a_ends, b_ends = (np.concatenate([part[k + 2] + n for part, n in zip(held, before[k])]) for k in (0, 1))
    doc, n = np.concatenate([part[4] for part in held]), 1 + len(a) // LINK_TOKENS
    for k in range(n):
        yield from linked(a, b, a_ends, b_ends, doc, span, (k, n))


def _aligner(a_file: str, b_file: str):
    """Scan task: documents to blocks."""

    def run(batches):
        from pyspark import TaskContext

        one, two = ByteLevelBpe(a_file, specials=False), PieceModel(b_file)
        spellings = []
        for model in (one, two):
            sizes = np.array([len(e) for e in model.entries])
            spellings.append((np.frombuffer(b"".join(model.entries), np.uint8), np.cumsum(sizes) - sizes, sizes))
        span = 1 << max(len(one.entries), len(two.entries)).bit_length()
        writer, part = Writer(len(one.entries), len(two.entries)), TaskContext.get().partitionId()
        blocks, seen = Blocks(part, span), 0
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            full = np.diff(offsets) > 0
            data = np.insert(data, offsets[:-1][full], 0x20)
            offsets = np.append(0, np.cumsum(np.diff(offsets) + full))
            texts = Batch(data, offsets, one, two)
            good = texts.reproduced(spellings)
            totals = np.zeros((4, len(good)), np.int64)
            digests = [hashlib.sha256() if g else None for g in good.tolist()]
            base, held, done = (part << 32) + seen, [], 0
            for first, text, cuts, (a, a_counts), (b, b_counts) in texts.parts:
                mine = good[first:first + len(a_counts)]
                a, b = a[np.repeat(mine, a_counts)], b[np.repeat(mine, b_counts)]
                a_counts, b_counts = a_counts * mine, b_counts * mine
                ia, ib = shared_ends(np.cumsum(spellings[0][2][a]), np.cumsum(spellings[1][2][b]))
                a_ends, b_ends = ia + 1, ib + 1
                doc = np.searchsorted(np.cumsum(a_counts), ia, "right")
                pairs = np.append(0, np.cumsum(np.diff(a_ends, prepend=0) * np.diff(b_ends, prepend=0)))
                edge = np.searchsorted(doc, np.arange(len(mine) + 1))
                written, at = writer.text(a, b, a_ends, b_ends)
                written = written.tobytes()
                for t in np.flatnonzero(np.diff(edge)).tolist():
                    # A text that goes on in the next part: groups are joined by ';'.
                    digests[first + t].update(b";" * bool(totals[2, first + t])
                                              + written[at[edge[t]]:at[edge[t + 1]] - 1])
                totals[:, first:first + len(mine)] += np.stack(
                    [a_counts, b_counts, np.diff(edge), pairs[edge[1:]] - pairs[edge[:-1]]])
                held.append((a, b, a_ends, b_ends, doc + base + first))
                done += len(text)
                if done == offsets[first + len(mine)]:  # no text goes on
                    for rows in _joined(held, span):
                        yield from blocks.add(*rows)
                    held = []
            seen += len(good)
            blocks.docs += [dict(zip(
                ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"),
                (base + t, doc_id, *totals[:, t].tolist(), digests[t].hexdigest() if digests[t] else "")))
                for t, doc_id in enumerate(batch.column("doc_id").to_pylist())]
            if len(blocks.docs) >= BLOCK_DOCS:
                yield blocks.flush()
        yield blocks.flush()

    return run


def _sums(key, blocks, counted):
    """(row, n_best, count_sum) of the documents in one block."""
    block = blocks.to_pylist()[0]
    n = len(block["a"])
    count, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
    code = counted.column("code").to_numpy()
    count[code], best[code] = counted.column("count").to_numpy(), counted.column("best").to_numpy()
    entries = np.asarray(block["counts"], np.int64)
    total = int(entries.sum())
    code = _unpacked(block["codes"], total)
    links = _unpacked(block["links_low"], total) + (_unpacked(block["links_high"], total).astype(np.int64) << 32)
    ends = np.append(0, np.cumsum(entries))
    sums = [np.append(0, np.cumsum(links * x[code])) for x in (best, count)]
    return pa.table({"row": pa.array(block["rows"], pa.int64()),
                     **{name: np.diff(s[ends]) for name, s in zip(("n_best", "count_sum"), sums)}})


def align(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)
    of every row of (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = stored(docs.mapInArrow(_aligner(a_file, b_file), _BLOCK), "aligned")
    pairs = blocks.select("block", F.posexplode(F.arrays_zip("a", "b", "n")).alias("code", "p")) \
        .select("block", "code", "p.a", "p.b", "p.n")
    counts = pairs.groupBy("a", "b").agg(F.sum("n").alias("count"))
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))
    counts = counts.join(highest, "a").select(
        "a", "b", "count", (F.col("count") == F.col("highest")).cast("int").alias("best"))
    counted = pairs.join(counts, ["a", "b"]).select(
        F.col("block").alias("of"), "code", "count", "best")
    held = blocks.where(F.size("rows") > 0).select("block", "rows", "counts", "codes", "links_low", "links_high", "a")
    sums = held.groupBy("block").cogroup(counted.groupBy("of")).applyInArrow(
        _sums, "row long, n_best long, count_sum long") \
        .groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    rows = blocks.select(F.explode("docs").alias("d")).select("d.*")
    return rows.join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE (A) against pieces (B) over every document."""
    import public_tokenizers

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                 public_tokenizers.path("piece_bpe_32k.model"))
