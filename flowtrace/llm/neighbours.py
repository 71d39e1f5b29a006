"""Approximate nearest neighbours by multiprobe p-stable hashing.

Largest inner product becomes smallest Euclidean distance: vectors get one
more component that lifts them to the largest norm, queries get zero there
(their own norm doesn't change their order). Each table hashes a lifted
vector with ``FUNCTIONS`` Gaussian projections cut into cells of ``WIDTH``
times the norm. A query visits, per table, its own bucket and perturbed ones
in the order of estimated success: the sets of moved coordinates with the
smallest sums of squared distances to the crossed cell borders. In a bucket
its inner products with all members are computed exactly, in double
precision; the best of every table and bucket are merged.

Equal vectors are indexed and searched once. A distinct vector carries its
smallest ``k + 1`` ids, more can't be among anyone's best. Buckets are cut
into salted blocks of about ``BLOCK`` members, the queries that visit one into
parts of about ``QUERIES``; every part meets every block of its bucket in a task
of its own, so no bucket and no crowd of queries is gathered whole and none is
cut short. A query whose buckets hold fewer than k others is answered exactly: it meets every
vector, in blocks of about ``BLOCK`` members and as many queries.

Defined results: vectors that are null, empty, zero, of another length than
most queries need, or hold null or non-finite components take no part; rows
without an id take no part, of rows that repeat one the smallest vector
stays; with fewer than k other vectors a query gets all of them; other columns
are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowtrace.llm.arrays import mix
from flowtrace.llm.tables import stored, table

#: Projections per table, cell width, tables, buckets visited per table.
FUNCTIONS, WIDTH, TABLES, PROBES = 6, 2.0, 4, 60
#: Members in a block, queries in a part, seed of the projections.
BLOCK, QUERIES, SEED = 4096, 4096, 20240229


def probes(place: np.ndarray, count: int) -> np.ndarray:
    """Cells to visit for one query at real-valued ``place``, own cell first,
    then perturbed ones by estimated success."""
    import heapq

    own = np.floor(place).astype(np.int64)
    inside = place - own
    k = len(own)
    moves = sorted([(inside[i] ** 2, i, -1) for i in range(k)] + [((1 - inside[i]) ** 2, i, 1) for i in range(k)])
    cells, heap = [own], [(moves[0][0], (0,))]
    while heap and len(cells) < count:
        cost, chosen = heapq.heappop(heap)
        axes = [moves[c][1] for c in chosen]
        if len(set(axes)) == len(axes):
            cell = own.copy()
            for c in chosen:
                cell[moves[c][1]] += moves[c][2]
            cells.append(cell)
        last = chosen[-1]
        if last + 1 < 2 * k:  # shift the last move, or add the next one
            heapq.heappush(heap, (cost - moves[last][0] + moves[last + 1][0], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (cost + moves[last + 1][0], (*chosen, last + 1)))
    return np.array(cells)


class Hashing:
    """Projections of all tables for vectors of one length."""

    def __init__(self, length: int, norm: float):
        random = np.random.default_rng(SEED)
        self.norm = norm
        self.directions = random.standard_normal((TABLES, length + 1, FUNCTIONS))
        self.shifts = random.random((TABLES, FUNCTIONS))

    def places(self, vectors: np.ndarray, lift: bool) -> np.ndarray:
        """Real-valued cells, table by table. Queries are scaled to the norm."""
        squares = (vectors ** 2).sum(axis=1)
        if lift:
            last = np.sqrt(np.maximum(self.norm ** 2 - squares, 0))
        else:
            vectors, last = vectors * (self.norm / np.sqrt(squares))[:, None], np.zeros(len(vectors))
        lifted = np.column_stack([vectors, last]) / self.norm
        return np.einsum("nd,tdk->tnk", lifted, self.directions) / WIDTH + self.shifts[:, None, :]


def _vectors(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _keys(table_no: int, cells: np.ndarray) -> np.ndarray:
    """One 64-bit key per cell."""
    key = np.full(len(cells), np.uint64(table_no + 1))
    for column in cells.T:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + column.astype(np.int64).view(np.uint64))
    return key.view(np.int64)


def _indexer(hashing: Hashing):
    def run(batches):
        for batch in batches:
            cells = np.floor(hashing.places(_vectors(batch.column("vector")), lift=True)).astype(np.int64)
            for t in range(TABLES):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_keys(t, cells[t])), batch.column("rep"), batch.column("vector")],
                    ["bucket", "rep", "vector"])

    return run


def _prober(hashing: Hashing):
    def run(batches):
        for batch in batches:
            places = hashing.places(_vectors(batch.column("vector")), lift=False)
            for t in range(TABLES):
                cells = [probes(p, PROBES) for p in places[t]]
                sizes = [len(c) for c in cells]
                if not cells:
                    continue
                at = pa.array(np.repeat(np.arange(len(cells)), sizes))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_keys(t, np.concatenate(cells))), batch.column("rep").take(at)], ["bucket", "query"])

    return run


def _ranked(k: int, ties: bool = True):
    def run(index, queries):
        """A block's exact products with the queries that visit it."""
        empty = pa.table({"query": pa.array([], pa.int64()), "rep": pa.array([], pa.int64()),
                          "score": pa.array([], pa.float64())})
        if not index.num_rows or not queries.num_rows:
            return empty
        members, reps = _vectors(index.column("vector")), index.column("rep").to_numpy()
        out = []
        for a in range(0, queries.num_rows, 512):
            part = queries.slice(a, 512)
            score = products(_vectors(part.column("vector")), members)
            best = np.argpartition(-score, min(k, score.shape[1]) - 1, axis=1)[:, :k] if score.shape[1] > k \
                else np.broadcast_to(np.arange(score.shape[1]), score.shape)
            # Equal scores at the border all stay: ties are for the ids.
            border = np.take_along_axis(score, best, axis=1).min(axis=1)
            row, col = np.nonzero(score >= border[:, None])
            if not ties:  # of equal scores, those with the smallest rep
                order = np.lexsort((reps[col], -score[row, col], row))
                place = np.arange(len(row)) - np.searchsorted(row[order], row[order])
                row, col = row[order[place < k]], col[order[place < k]]
            out.append(pa.table({"query": part.column("query").to_numpy()[row], "rep": reps[col],
                                 "score": score[row, col]}))
        return pa.concat_tables(out)

    return run


def _exact(queries: DataFrame, reps: DataFrame, k: int) -> DataFrame:
    """(query, rep, score): the k best of all members for every query, by
    score and representative. Members with a higher one of an equal score
    can't be among the k smallest ids."""
    parts = [max(1, -(-df.count() // BLOCK)) for df in (reps, queries)]

    def blocks(df: DataFrame, mine: int) -> DataFrame:
        """Rows in their own block, once for every block of the others."""
        names, other = [("block", "part"), ("part", "block")][mine], parts[1 - mine]
        return df.withColumn(names[0], F.pmod(F.xxhash64(df.columns[0]), F.lit(parts[mine])).cast("int")) \
            .withColumn(names[1], F.explode(F.sequence(F.lit(0), F.lit(other - 1))))

    found = blocks(reps.select("rep", "vector"), 0).groupBy("block", "part").cogroup(
        blocks(queries.select("query", "vector"), 1).groupBy("block", "part")).applyInArrow(
        _ranked(k, ties=False), "query long, rep long, score double")
    return found.withColumn("place", F.row_number().over(
        Window.partitionBy("query").orderBy(F.desc("score"), "rep"))).where(F.col("place") <= k).drop("place")


def products(queries: np.ndarray, members: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in component order, so that
    a pair's value does not depend on what else stands in the block."""
    out = np.zeros((len(queries), len(members)))
    for d in range(queries.shape[1]):
        out += queries[:, d, None].astype(np.float64) * members[None, :, d].astype(np.float64)
    return out


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, vector): rows that take part, every id once."""
    vector = F.col("embedding").cast("array<double>")
    rows = rows.select("vec_id", vector.alias("vector")).where(
        F.col("vec_id").isNotNull() & (F.size("vector") > 0)
        & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("vector", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def search(rows: DataFrame, is_query, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row that ``is_query``
    selects, its k nearest other rows, as far as they are found."""
    spark = rows.sparkSession
    rows = usable(rows)
    length = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if length is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = stored(rows.where(F.size("vector") == length.n).withColumn("key", F.xxhash64("vector")), "vectors")
    # Equal vectors: the smallest k + 1 ids, cut before the shuffle.
    same = Window.partitionBy("key", "vector").orderBy("vec_id")
    ids = stored(rows.withColumn("place", F.row_number().over(same)).where(F.col("place") <= k + 1), "ids")
    reps = ids.where("place = 1").select(F.col("vec_id").alias("rep"), "key", "vector")
    norm = reps.agg(F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))).first()[0] ** 0.5
    hashing = Hashing(length.n, norm)

    members = stored(reps.select("rep", "vector").mapInArrow(
        _indexer(hashing), "bucket long, rep long, vector array<double>"), "index")
    blocks = members.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    # Distinct query vectors, by the representative of their equals.
    asked = rows.where(is_query).select("vec_id", "key", "vector") \
        .join(reps.withColumnRenamed("vector", "same"), "key").where("vector = same").select("vec_id", "rep")
    asked = stored(asked, "queries")
    distinct = asked.select("rep").distinct().join(reps, "rep").select("rep", "vector")
    visits = stored(distinct.mapInArrow(_prober(hashing), "bucket long, query long").join(blocks, "bucket"), "visits")
    # A bucket is cut on both sides: blocks of members meet parts of queries.
    # Members of buckets that no query visits stay where they are.
    parts = visits.groupBy("bucket").agg(F.max("blocks").alias("blocks"),
                                         F.ceil(F.count("*") / QUERIES).cast("int").alias("parts"))
    members = members.join(parts, "bucket").select(
        "bucket", F.pmod(F.xxhash64("rep", "bucket"), F.col("blocks")).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "rep", "vector")
    visits = visits.join(parts.select("bucket", "parts"), "bucket").select(
        "bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.pmod(F.xxhash64("query", "bucket"), F.col("parts")).cast("int").alias("part"), "query")
    visits = visits.join(distinct.select(F.col("rep").alias("query"), "vector"), "query")
    meeting = ["bucket", "block", "part"]
    found = members.groupBy(*meeting).cogroup(visits.groupBy(*meeting)).applyInArrow(
        _ranked(k + 1), "query long, rep long, score double")
    # A pair has one score, whichever table found it.
    found = found.groupBy("query", "rep").agg(F.max("score").alias("score"))
    found = stored(found.withColumn("place", F.rank().over(
        Window.partitionBy("query").orderBy(F.desc("score")))).where(F.col("place") <= k + 1).drop("place"), "found")
    # Queries with too few candidates, itself among them or not, see all.
    sizes = ids.groupBy("key", "vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).select("rep", "n")
    enough = found.join(sizes, "rep").groupBy("query").agg(F.sum("n").alias("n")) \
        .where(F.col("n") >= min(k + 1, rows.count())).select("query")
    short = stored(distinct.withColumnRenamed("rep", "query").join(enough, "query", "left_anti"), "short")
    if short.limit(1).count():
        found = found.join(enough, "query", "left_semi").unionByName(_exact(short, reps, k + 1))
    # Back to ids: of the members, then of the queries, without itself.
    groups = ids.join(reps.withColumnRenamed("vector", "same"), "key").where("vector = same").select("rep", "vec_id")
    found = found.join(groups, "rep").withColumn("place", F.row_number().over(
        Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("place") <= k + 1)
    found = asked.select(F.col("vec_id").alias("query_id"), F.col("rep").alias("query")) \
        .join(found.select("query", "vec_id", "score"), "query").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest inner products of every 20th vector."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
