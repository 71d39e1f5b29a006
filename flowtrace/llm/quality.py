"""Document quality by nearest-neighbour voting in a latent-semantic space.

A text becomes counts of hashed byte trigrams plus one term for words that
repeat their predecessor; square roots, inverse document frequencies (over
all documents) and a truncated singular value decomposition of the labelled
sample turn it into a short unit vector. The labelled vectors are broadcast:
at most ``SAMPLE`` rows, the documented bound of the fit. Every document gets
exact cosine products with all of them, in blocks, and its nearest neighbours
vote with their similarity; of neighbours tied for the last place all vote.

Labels are learnt only from rows whose crc32(doc_id as text) mod 3 is not 1.
Ids, languages, sources and labels of a document never enter its score.

Defined results: a null or empty text scores the share of label 1 in the
sample, as does every text where nothing is labelled (then 0.5); rows that
repeat a doc_id, or have none, each give their own row (a missing id is not
held out); labels that are null or have no id are ignored, of several labels
the largest counts; other columns are ignored; empty tables are fine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtrace.llm.arrays import returning, text_buffers, word_hashes, word_spans
from flowtrace.llm.tables import table

#: Labelled rows used at most, hashed terms, dimensions, neighbours.
SAMPLE, TERMS, DIMENSIONS, NEIGHBOURS = 4096, 2048, 64, 25
#: A similarity counts by this power; the prior weighs as one of this size.
SHARPNESS, PRIOR = 8, 1e-3
#: Bytes of text whose terms are counted at a time, texts compared at a time.
PIECE, ROWS = 1 << 17, 200


def counts(column) -> np.ndarray:
    """Term counts of every text (rows) as float32."""
    data, offsets = text_buffers(column)
    n = len(offsets) - 1
    out = np.zeros((n, TERMS + 1), np.float32)
    a = 0
    while a < n:  # texts in pieces of about PIECE bytes
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + PIECE, "right")) - 1)
        text, cuts = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        for low in range(0, len(text) - 2, PIECE):
            _count_trigrams(out[a:b], text[low:low + PIECE + 2], cuts - low)
        # As heavy as the trigrams of a word.
        out[a:b, TERMS] = 5 * _repeated_words(text, cuts)
        a = b
    return out


def _count_trigrams(out: np.ndarray, text: np.ndarray, cuts: np.ndarray) -> None:
    """Adds the trigrams of a stretch of bytes; ``cuts`` are where texts start
    and end, counted from the stretch's first byte."""
    a, b, c = text[:-2].astype(np.int64), text[1:-1].astype(np.int64), text[2:].astype(np.int64)
    term = (a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D >> 7) % TERMS
    inside = np.diff(np.clip(cuts, 0, len(text)))
    doc = np.repeat(np.arange(len(out), dtype=np.int32), inside)
    same = doc[:-2] == doc[2:]
    first = int(doc[0])
    flat = (doc[:-2][same] - first) * np.int64(TERMS + 1) + term[same]
    rows = int(doc[-1]) - first + 1
    out[first:first + rows] += np.bincount(flat, minlength=rows * (TERMS + 1)).reshape(rows, TERMS + 1)


def _repeated_words(text: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Words of every text that repeat the one before."""
    starts, ends, before = word_spans(text, cuts)
    if len(starts) < 2:
        return np.zeros(len(cuts) - 1, np.int64)
    hashes = word_hashes(text, starts, ends)
    again = np.flatnonzero(hashes[1:] == hashes[:-1]) + 1
    doc = np.searchsorted(before, again, "right") - 1
    return np.bincount(doc[again > before[doc]], minlength=len(cuts) - 1)


def weighted(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    out = np.empty(c.shape, np.float32)
    for a in range(0, len(c), ROWS):
        part = c[a:a + ROWS]
        total = np.maximum(part.sum(axis=1, keepdims=True), 1)
        x = np.sqrt(part / total) * idf
        out[a:a + ROWS] = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    return out


def _frequencies(batches):
    total, rows = np.zeros(TERMS + 1, np.int64), 0
    for batch in batches:
        c = counts(batch.column("text"))
        total += (c > 0).sum(axis=0)
        rows += len(c)
    at = np.arange(-1, TERMS + 1)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.append(rows, total))], ["term", "n"])


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """idf of every term over all documents (TERMS + 2 rows are collected)."""
    rows = docs.select("text").mapInArrow(returning(_frequencies), "term long, n long") \
        .groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {r.term: r.n for r in rows}
    n = np.array([found.get(t, 0) for t in range(TERMS + 1)])
    return (np.log((1 + found.get(-1, 0)) / (1 + n)) + 1).astype(np.float32)


def _featurise(batches):
    """Term counts, compressed, as most are 0: what the driver collects."""
    for batch in batches:
        packed = [pa.compress(r.tobytes(), codec="zstd", asbytes=True) for r in counts(batch.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("quality"), pa.array(packed, pa.binary())], ["quality", "counts"])


def unpacked(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(counts, labels) of collected rows, by the bytes of the counts and the
    label: an order of their own, whatever order they arrived in."""
    c = np.empty((rows.num_rows, TERMS + 1), np.float32)
    for k, packed in enumerate(rows.column("counts")):
        c[k] = np.frombuffer(pa.decompress(packed.as_buffer(), c[k].nbytes, codec="zstd"), np.float32)
    labels = rows.column("quality").to_numpy()
    order = np.lexsort((labels, c.view(f"S{c.itemsize * c.shape[1]}").ravel()))
    return c[order], labels[order].astype(np.float32)


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def right_vectors(x: np.ndarray, k: int) -> np.ndarray:
    """The k leading right singular vectors, by subspace iteration."""
    basis = np.random.default_rng(0).standard_normal((x.shape[1], k + 16)).astype(np.float32)
    for _ in range(8):
        basis, _ = np.linalg.qr(x.T @ (x @ basis))
    inner = x @ basis
    _, turn = np.linalg.eigh(inner.T @ inner)
    return (basis @ turn[:, ::-1][:, :k]).astype(np.float32)


class Model:
    """Term weights, projection, and the labelled vectors."""

    def __init__(self, idf, labels, prior, projection, vectors):
        self.idf, self.labels, self.prior = idf, labels, prior
        self.projection, self.vectors = projection, vectors

    @staticmethod
    def learn(idf, c, labels) -> Model:
        labels = labels.astype(np.float32)
        x = weighted(c, idf)
        projection = right_vectors(x, DIMENSIONS)
        return Model(idf, labels, float(labels.mean()) if len(labels) else 0.5, projection, unit(x, projection))

    def arrays(self) -> tuple:
        """The constructor's arguments: what workers get, as plain arrays."""
        return self.idf, self.labels, self.prior, self.projection, self.vectors

    def score(self, c: np.ndarray) -> np.ndarray:
        """Scores of the texts with term counts ``c``, ROWS at a time."""
        if not len(self.labels) or not len(c):
            return np.full(len(c), self.prior)
        return np.concatenate([self._score(c[a:a + ROWS]) for a in range(0, len(c), ROWS)])

    def _score(self, c: np.ndarray) -> np.ndarray:
        # Rounded, as equal vectors may differ in the last bits of a product.
        cosine = np.round(unit(weighted(c, self.idf), self.projection) @ self.vectors.T, 5)
        k = min(NEIGHBOURS, cosine.shape[1])
        least = np.partition(cosine, cosine.shape[1] - k, axis=1)[:, cosine.shape[1] - k]
        # As near as the last neighbour: all of those vote.
        row, best = np.nonzero(cosine >= least[:, None])
        near = np.maximum(cosine[row, best], 0).astype(np.float64) ** SHARPNESS
        votes = np.bincount(row, near * self.labels[best], len(c)) + PRIOR * self.prior
        score = votes / (np.bincount(row, near, len(c)) + PRIOR)
        return np.where(c.sum(axis=1) > 0, score, self.prior)


def unit(x: np.ndarray, projection: np.ndarray) -> np.ndarray:
    y = x @ projection
    return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of the labelled rows with the smallest id hashes."""
    chosen = labels.select("doc_id", "quality").where(
        F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out()) \
        .groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality")) \
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("quality", "text") \
        .mapInArrow(_featurise, "quality int, counts binary").limit(sample).toArrow()
    return Model.learn(inverse_frequencies(docs), *unpacked(rows))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted, text) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model.arrays())

    def run(batches):
        model = Model(*shared.value)
        for batch in batches:
            values = model.score(counts(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.clip(values, 0, 1))], [*batch.schema.names, "score"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(returning(run), "doc_id long, text string, score double").select(
        "doc_id", held_out().alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "text")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of ``docs``, all columns, that the model doesn't reject."""
    shared = docs.sparkSession.sparkContext.broadcast(model.arrays())

    def run(batches):
        model = Model(*shared.value)
        for batch in batches:
            yield batch.filter(pa.array(model.score(counts(batch.column("text"))) >= 0.5))

    return docs.mapInArrow(returning(run), docs.schema)


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return classified(spark, table(spark, sf_dir, "documents"), sf_dir).drop("text")
