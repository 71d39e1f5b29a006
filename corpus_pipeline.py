"""The document pipeline: five stages over the documents table.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and
returns a DataFrame; all but the last keep the columns of documents. Every row
counts on its own: rows without doc_id, and rows that share one, are compared
and kept or dropped by their own texts. The stages' operators define the other
cases.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtrace.llm import byte_bpe, decontamination, jaccard_join, pii, quality
from flowtrace.llm.tables import bounded_batches, stored, table, with_row_keys


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    bounded_batches(spark)
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked by similarity, the one with the smallest
    id; rows without an id of their own come after those that have one."""
    bounded_batches(spark)
    keyed, key = with_row_keys(docs)
    linked = jaccard_join.similar(keyed.select(F.col(key).alias("doc_id"), "text"))
    copies = stored(linked.where("doc_id <> component_id").select(F.col("doc_id").alias(key)), "copies")
    return jaccard_join.without(keyed, copies, key).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with a benchmark item."""
    keyed, key = with_row_keys(docs)
    found = decontamination.hits(keyed.select(F.col(key).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return keyed.join(found.select(F.col("doc_id").alias(key)).distinct(), key, "left_anti").select(docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars follows."""
    clean = pii.redacted(pii.find(docs))
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    return clean.select("doc_id", "text", *(
        F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"rest.`{c}`")
        for c in others)).select(docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the decoded bytes."""
    bounded_batches(spark)
    return byte_bpe.round_trip(docs)


#: In this order; each stage's result is written and read as the next one's docs.
STAGES = [
    ("quality", classify),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("pii", redact),
    ("byte_bpe", tokenise),
]

#: Classifier votes and BPE merges can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
