"""Where do windows of a fixed length occur more than once in a corpus?

Shared by the two substring deduplicators. Texts are sequences of units
(bytes or words). Every window start is filed under its window's smallest
gram hash (its anchor); consecutive starts with one anchor form a segment.
Equal windows have equal anchors, so

* a segment whose anchor gram occurs nowhere else, also not in the segment,
  can't hold a repeated window,
* segments that are equal as a whole are counted, not compared,
* only different segments under one anchor are compared, window by window
  (``compare``, the operator's own method),
* an anchor with more than ``BATCH_UNITS`` units in different segments (a
  passage in very many documents, each with other text around it) never
  meets as a whole: its segments are cut into single windows, which are
  counted by their 128-bit digest as equal segments are.

Segments move as keys, never as text; text is fetched for the few that are
compared, one copy of each. A passage that a third of all documents hold
collapses into its distinct segments before anything is grouped.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtrace.llm.arrays import covered, ranges, sliding_min, text_buffers
from flowtrace.llm.tables import one_row_per_id, release, stored

#: Starts in a segment at most (a low-entropy text could have one anchor all
#: through), units compared in one piece and of one anchor at most.
SEGMENT_STARTS, BATCH_UNITS = 1024, 4_000_000


class Unit(NamedTuple):
    """How texts become sequences.

    ``hashes(data, offsets)``: (one hash per unit, units before each text,
    gram hash per unit position, gram length).
    ``payload(data, offsets)``: (bytes, byte start of every unit, byte end).
    """

    hashes: Callable
    spans: Callable


def _segments(unit: Unit, length: int):
    def run(batches):
        import xxhash

        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            hashes, before, grams, k = unit.hashes(data, offsets)
            width = length - k + 1
            low = sliding_min(grams, width)
            per = np.diff(before)
            rows = np.flatnonzero(per >= length)
            starts = ranges(before[rows], per[rows] - length + 1)
            if not len(starts):
                continue
            anchor = low[starts]
            fresh = np.ones(len(starts), bool)
            fresh[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
            head = np.flatnonzero(fresh)
            size = np.diff(np.append(head, len(starts)))
            if size.max() > SEGMENT_STARTS:
                pieces = -(-size // SEGMENT_STARTS)
                head = np.repeat(head, pieces) + SEGMENT_STARTS * ranges(np.zeros(len(head)), pieces)
                size = np.diff(np.append(head, len(starts)))
            at = starts[head]
            # Does the segment hold its anchor gram more than once? Only grams
            # that are the smallest of some window can be anchors.
            edge = np.zeros(width - 1, np.uint64)
            most = ~sliding_min(~np.concatenate([edge, low, edge]), width)
            smallest = np.flatnonzero(grams == most)
            lo = np.searchsorted(smallest, at)
            many = np.searchsorted(smallest, at + size + width - 1) - lo
            same = grams[smallest[ranges(lo, many)]] == np.repeat(anchor[head], many)
            sums = np.append(0, np.cumsum(same))[np.append(0, np.cumsum(many))]
            own = np.diff(sums) > 1
            view = memoryview(np.ascontiguousarray(hashes)).cast("B")
            width = hashes.itemsize
            digest = np.fromiter(
                (xxhash.xxh3_64_intdigest(view[a:b]) for a, b in
                 zip((at * width).tolist(), ((at + size + length - 1) * width).tolist())),
                np.uint64, len(at))
            doc = np.searchsorted(before, at, "right") - 1
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor[head].view(np.int64)), pa.array(digest.view(np.int64)),
                 pa.array(ids[doc], pa.int64()), pa.array((at - before[doc]).astype(np.int32)),
                 pa.array(size.astype(np.int32)), pa.array(own)],
                ["anchor", "digest", "doc_id", "at", "run", "own"])

    return run


def _fetch(unit: Unit, length: int):
    """The text of listed segments: one row per segment."""

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            raw, starts, ends, before = unit.spans(data, offsets)
            raw = raw.tobytes()
            out = []
            for row, (doc, wanted) in enumerate(zip(batch.column("doc_id").to_pylist(),
                                                    batch.column("wanted").to_pylist())):
                for w in wanted:
                    a = before[row] + w["at"]
                    b = a + w["run"] + length - 2
                    out.append((w["anchor"], w["digest"], w["copies"], doc, w["at"], w["run"], w["large"],
                                raw[starts[a]:ends[b]]))
            cols = list(zip(*out)) if out else [[]] * 8
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.int64(), pa.int64(),
                                                       pa.int32(), pa.int32(), pa.bool_(), pa.binary()])],
                ["anchor", "digest", "copies", "doc_id", "at", "run", "large", "units"])

    return run


def _windows(unit: Unit, length: int):
    """The windows of fetched segments: one row per start."""

    def run(batches):
        import xxhash

        for batch in batches:
            data, offsets = text_buffers(batch.column("units"))
            hashes, before, _, _ = unit.hashes(data, offsets)
            view = memoryview(np.ascontiguousarray(hashes)).cast("B")
            width = hashes.itemsize
            runs = batch.column("run").to_numpy()
            for row, n in enumerate(runs.tolist()):
                a = int(before[row])
                digests = b"".join([xxhash.xxh3_128_digest(view[s * width:(s + length) * width])
                                    for s in range(a, a + n)])
                high, low = np.frombuffer(digests, np.int64).reshape(n, 2).T
                same = pa.array(np.full(n, row))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(same) for c in ("anchor", "digest", "doc_id", "at")),
                     pa.array(np.arange(n, dtype=np.int32)),
                     pa.array(np.ascontiguousarray(high)), pa.array(np.ascontiguousarray(low))],
                    ["anchor", "digest", "doc_id", "at", "offset", "high", "low"])

    return run


def _counted(fetched: DataFrame, unit: Unit, length: int, keep_first: bool
             ) -> tuple[DataFrame, list[DataFrame]]:
    """What ``_compare_batches`` returns, for segments of any number: windows
    are counted by digest, no group is held. Also the tables it reads."""
    windows = stored(fetched.mapInArrow(
        _windows(unit, length), "anchor long, digest long, doc_id long, at int, offset int, "
                                "high long, low long"), "windows")
    start = F.col("at") + F.col("offset")
    # Only who keeps the first needs to know it.
    first = [F.min(F.struct("doc_id", start.alias("start"))).alias("first")] if keep_first else []
    # Stored, so that a window with very many starts is a skewed join only.
    again = stored(windows.groupBy("high", "low").agg(F.count("*").alias("n"), *first)
                   .where("n > 1").drop("n"), "again")
    marked = windows.join(again, ["high", "low"])
    if keep_first:
        marked = marked.where((F.col("doc_id") != F.col("first.doc_id")) | (start != F.col("first.start")))
    # At most SEGMENT_STARTS starts in a segment; consecutive ones become runs.
    marked = marked.groupBy("anchor", "digest").agg(F.sort_array(F.collect_list("offset")).alias("here"))
    after = F.transform("here", lambda x: x + 1)
    marked = marked.select(
        "anchor", "digest", F.array_except("here", after).alias("froms"),
        F.array_except(after, "here").alias("tos"))
    return marked, [windows, again]


def _compare_batches(compare: Callable, length: int):
    """Whole anchor groups (sorted by anchor) go to ``compare`` together,
    small groups many at a time. It returns one boolean per start."""

    def run(batches):
        def flagged(rows: pa.Table):
            rows = rows.combine_chunks()
            sizes = rows.column("run").to_numpy().astype(np.int64)
            marks = compare(rows, sizes)
            # Runs of marked starts inside each segment.
            owner = np.repeat(np.arange(len(sizes)), sizes)
            at = np.flatnonzero(marks)
            if not len(at):
                return None
            fresh = np.ones(len(at), bool)
            fresh[1:] = (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])
            head = np.flatnonzero(fresh)
            last = at[np.append(head[1:] - 1, len(at) - 1)]
            who = owner[at[head]]
            base = np.cumsum(sizes) - sizes
            froms, tos = at[head] - base[who], last + 1 - base[who]
            which, first = np.unique(who, return_index=True)
            cuts = np.append(first, len(who)).astype(np.int32)
            return pa.RecordBatch.from_arrays(
                [rows.column("anchor").take(pa.array(which)).combine_chunks(),
                 rows.column("digest").take(pa.array(which)).combine_chunks(),
                 pa.ListArray.from_arrays(pa.array(cuts), pa.array(froms, pa.int32())),
                 pa.ListArray.from_arrays(pa.array(cuts), pa.array(tos, pa.int32()))],
                ["anchor", "digest", "froms", "tos"])

        held, units = None, 0
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            units += int(batch.column("run").to_numpy().sum()) + length * batch.num_rows
            if units < BATCH_UNITS:
                continue
            anchors = held.column("anchor").to_numpy()
            cut = int(np.searchsorted(anchors, anchors[-1], "left"))
            if cut:
                if (out := flagged(held.slice(0, cut))) is not None:
                    yield out
                held = held.slice(cut)
                units = int(held.column("run").to_numpy().sum()) + length * held.num_rows
        if held is not None and held.num_rows and (out := flagged(held)) is not None:
            yield out

    return run


def repeated_spans(docs: DataFrame, unit: Unit, length: int, compare: Callable,
                   keep_first: bool) -> DataFrame:
    """(doc_id, spans): for documents that lose something, the unit intervals
    [start, stop) to remove.

    ``compare(rows, runs)`` gets whole anchor groups of different segments
    and returns, per start of every segment, whether it is to be removed from
    the segment's first copy.
    """
    docs = docs.select("doc_id", "text")
    segments = docs.mapInArrow(_segments(unit, length),
                               "anchor long, digest long, doc_id long, at int, run int, own boolean")
    again = segments.groupBy("anchor").agg(F.count("*").alias("n"), F.max("own").alias("own")) \
        .where("n > 1 or own").select("anchor")
    # What is counted by a key that may be hot is stored before it is joined
    # back: only a join of two plain shuffles can be split inside a key.
    again = stored(again, "anchors")
    shared = stored(segments.join(again, "anchor"), "segments")
    kinds = shared.groupBy("anchor", "digest").agg(
        F.count("*").alias("copies"), F.max("own").alias("own"),
        F.min(F.struct("doc_id", "at", "run")).alias("first"))
    kinds = stored(kinds, "kinds")
    contested = kinds.groupBy("anchor").agg(
        F.count("*").alias("k"), F.max("own").alias("own"),
        F.sum(F.col("first.run") + (length - 1)).alias("units")) \
        .where("k > 1 or own").select("anchor", (F.col("units") > BATCH_UNITS).alias("large"))
    contested = stored(contested, "contested")
    listed = stored(kinds.join(contested, "anchor").select(
        F.col("first.doc_id").alias("doc_id"),
        F.struct("anchor", "digest", "copies", F.col("first.at").alias("at"),
                 F.col("first.run").alias("run"), "large").alias("w")), "listed")
    wanted = listed.groupBy("doc_id").agg(F.collect_list("w").alias("wanted"))
    fetched = docs.join(wanted, "doc_id").mapInArrow(
        _fetch(unit, length), "anchor long, digest long, copies long, doc_id long, at int, run int, "
                              "large boolean, units binary")
    used, large = [again, shared, kinds, contested, listed], listed.where("w.large").limit(1).count() > 0
    if large:  # the texts move once, for both ways
        fetched = stored(fetched, "fetched")
        counted, tables = _counted(fetched.where("large"), unit, length, keep_first)
        used += [fetched, *tables]
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    compared = fetched.where("not large").drop("large") \
        .repartition(n, "anchor").sortWithinPartitions("anchor") \
        .mapInArrow(_compare_batches(compare, length),
                    "anchor long, digest long, froms array<int>, tos array<int>")
    if large:
        compared = compared.unionByName(counted)
    found = kinds.join(compared, ["anchor", "digest"], "left").select(
        "anchor", "digest", "copies", F.col("first.doc_id").alias("first_doc"),
        F.col("first.at").alias("first_at"), "froms", "tos").where("copies > 1 or froms is not null")
    found = stored(found, "found")
    members = shared.join(found, ["anchor", "digest"])
    whole = F.array(F.struct(F.col("at").alias("s"), (F.col("at") + F.col("run") + (length - 1)).alias("e")))
    marked = F.zip_with("froms", "tos", lambda a, b: F.struct(
        (F.col("at") + a).alias("s"), (F.col("at") + b + (length - 1)).alias("e")))
    is_first = (F.col("doc_id") == F.col("first_doc")) & (F.col("at") == F.col("first_at"))
    if keep_first:
        spans = F.when(is_first, marked).otherwise(whole)
    else:
        spans = F.when(F.col("copies") > 1, whole).otherwise(marked)
    result = stored(members.select("doc_id", spans.alias("spans")).where("spans is not null")
                    .groupBy("doc_id").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")
    release(*used, found)
    return result


def cut_out(docs: DataFrame, spans: DataFrame, cutter: Callable, schema: str) -> DataFrame:
    """Every document with its spans (null: none) through ``cutter(batches)``."""
    return docs.select("doc_id", "text").join(spans, "doc_id", "left").mapInArrow(cutter, schema)


def merged(spans: list[dict] | None) -> tuple[np.ndarray, np.ndarray]:
    if not spans:
        return covered(np.zeros(0), np.zeros(0))
    return covered(np.array([x["s"] for x in spans]), np.array([x["e"] for x in spans]))


def prepared(docs: DataFrame) -> DataFrame:
    docs = one_row_per_id(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))
