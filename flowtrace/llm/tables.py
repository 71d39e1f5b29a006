"""Reading tables, unique ids, reliable intermediate results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtrace.session import ensure_checkpoint_dir

#: Rows and bytes that go to a Python worker at once: bounds its arrays.
BATCH_ROWS, BATCH_BYTES = 1000, 4 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of bounded size for this session's Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: the lineage ends
    there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_path = path
    return back


def release(*frames: DataFrame) -> None:
    """Empties the folders of stored frames that nothing reads any more, so
    that a long chain of stages does not pile up its intermediate tables."""
    for df in frames:
        df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(df.stored_path)


def one_row_per_id(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) with every id once.

    An id identifies a document. Rows without an id take no part; of rows
    that repeat an id, the smallest text stays (null only if all are null).
    """
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    odd = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1)
    if not odd.count():
        return docs
    return docs.where("doc_id is not null").groupBy("doc_id").agg(F.min("text").alias("text"))


def with_row_keys(docs: DataFrame) -> tuple[DataFrame, str]:
    """(``docs`` with one more column, its name): a long per row, unique.

    It is doc_id where that is present and belongs to one row only. Other rows
    get keys above all ids (below, if ids reach 2^62), those of one partition
    in (doc_id, text) order, and are written once, so that every reader sees
    the same keys. Ids are expected to leave 2^62 keys free at one end.
    """
    key = "row"
    while key in docs.columns:
        key += "_"
    ids = docs.groupBy("doc_id").count()
    odd = ids.where("count > 1 or doc_id is null").select(F.col("doc_id").alias("shared"), F.lit(True).alias("odd"))
    if not odd.limit(1).count():
        return docs.withColumn(key, F.col("doc_id").cast("long")), key
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    low, high = low or 0, high or 0
    first = high + 1 if high < 2 ** 62 else low - 2 ** 62
    rows = docs.select(F.struct(*docs.columns).alias("doc")).join(
        odd, F.col("doc.doc_id").eqNullSafe(F.col("shared")), "left")
    rows = rows.sortWithinPartitions("doc.doc_id", "doc.text").withColumn("key", F.when(
        F.col("odd"), F.lit(first) + F.monotonically_increasing_id()).otherwise(F.col("doc.doc_id")))
    return stored(rows.select("doc.*", F.col("key").cast("long").alias(key)), "keyed"), key
