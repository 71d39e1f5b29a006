"""Packing by powers of two.

A document's ids, with the end id, are cut into pieces whose lengths are
powers of two: as many of ``SEQUENCE`` ids as fit, then the binary digits of
the rest, longest first. Every piece is a sequence of its own, so none crosses
documents and none is padded. Sequences are numbered bucket by bucket, the
longest first; a bucket holds sequences of one length, which batch without
padding.

Each task cuts its own documents and counts its pieces per bucket; the only
shuffle is over these counts (at most twelve rows a task).

Defined results: a null or empty text has the end id alone, one piece; rows
that repeat a doc_id, or have none, are packed each on its own; other columns
are ignored; an empty table gives no sequences.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowtrace.llm.arrays import ranges, text_buffers
from flowtrace.llm.subwords import ByteLevelBpe, parts
from flowtrace.llm.tables import stored, table

#: Ids in a full sequence (a power of two).
SEQUENCE = 2048

_PIECES = "part int, nth long, length int, doc_id long, start long, doc_tokens long, ids_crc32 long, ids array<int>"


def piece_lengths(totals: np.ndarray, longest: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """(number of pieces of every document, lengths of all pieces)."""
    sizes = longest >> np.arange(longest.bit_length())
    many = np.concatenate([totals[:, None] // longest,
                           (totals[:, None] % longest // sizes[1:]) & 1], axis=1)
    return many.sum(axis=1), np.repeat(np.tile(sizes, len(totals)), many.ravel())


def _with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    return np.insert(ids, np.cumsum(counts), end_id), counts + 1


def _cutter(tokenizer_file: str, end_id: int, longest: int):
    """Scan task: pieces of its documents, numbered per bucket."""

    def run(batches):
        from pyspark import TaskContext

        part, tokenizer = TaskContext.get().partitionId(), ByteLevelBpe(tokenizer_file, specials=True)
        seen = np.zeros(longest.bit_length(), np.int64)

        def pieces(doc_ids, ids, counts):
            ids, totals = _with_end(ids, counts, end_id)
            many, lengths = piece_lengths(totals, longest)
            ends = np.cumsum(lengths)
            doc = np.repeat(np.arange(len(totals)), many)
            # The place in its bucket: earlier pieces of that length.
            bucket = np.log2(lengths).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            sizes = np.bincount(bucket, minlength=len(seen))
            nth = np.empty(len(lengths), np.int64)
            nth[order] = np.repeat(seen, sizes) + ranges(np.zeros(len(sizes), np.int64), sizes)
            seen[:] += sizes
            ids = np.ascontiguousarray(ids, "<u4")
            raw = memoryview(ids).cast("B")
            crc = [zlib.crc32(raw[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
            return pa.RecordBatch.from_arrays([
                pa.array(np.full(len(doc), part), pa.int32()), pa.array(nth), pa.array(lengths, pa.int32()),
                pa.array(doc_ids, pa.int64()).take(pa.array(doc)),
                pa.array(ends - lengths - (np.cumsum(totals) - totals)[doc]), pa.array(totals[doc]),
                pa.array(crc, pa.int64()),
                pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids.view(np.int32)))],
                ["part", "nth", "length", "doc_id", "start", "doc_tokens", "ids_crc32", "ids"])

        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            doc_ids = batch.column("doc_id").to_pylist()
            held, counts = [np.zeros(0, np.uint32)], np.zeros(len(doc_ids), np.int64)
            for first, text, cuts in parts(data, offsets):
                ids, n = tokenizer.ids(text, cuts)
                held.append(ids)
                counts[first:first + len(n)] += n
            if doc_ids:
                yield pieces(doc_ids, np.concatenate(held), counts)

    return run


def sequences(docs: DataFrame, tokenizer_file: str, end_id: int, longest: int = SEQUENCE) -> DataFrame:
    """One row per sequence: sequence_id, length, its document (doc_id, start,
    doc_tokens), ids_crc32 and ids; ``longest`` is a power of two."""
    cut = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
                 .mapInArrow(_cutter(tokenizer_file, end_id, longest), _PIECES), "pieces")
    counts = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # Buckets are as few as the powers of two.
    longer = Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    buckets = counts.groupBy("length").agg(F.sum("n").alias("n")).select(
        "length", F.coalesce(F.sum("n").over(longer), F.lit(0)).alias("bucket"))
    bases = counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")) \
        .join(buckets, "length").select("length", "part", (F.col("bucket") + F.col("base")).alias("base"))
    return cut.join(bases, ["length", "part"]).select(
        (F.col("base") + F.col("nth")).alias("sequence_id"), "length", "doc_id", "start", "doc_tokens",
        "ids_crc32", "ids")


def write(packed: DataFrame, path: str) -> None:
    """One folder per length, ids in sequence order inside a file."""
    packed.sortWithinPartitions("length", "sequence_id") \
        .write.partitionBy("length").option("compression", "zstd").parquet(path)


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of power-of-two lengths."""
    import public_tokenizers

    packed = sequences(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1)
    return packed.select(
        "doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens",
        "sequence_id", F.lit(0).cast("long").alias("offset"))
