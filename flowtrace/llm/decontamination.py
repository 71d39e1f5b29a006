"""Benchmark decontamination by winnowing, with DataFrame functions only.

Of every ``WINDOW - K + 1`` consecutive k-gram hashes of a text, the smallest
is kept as a fingerprint. Two texts that share ``WINDOW`` words share a whole
run of k-grams and so a fingerprint. Fingerprints of documents and benchmark
items are joined; each hit is extended to the windows that contain it, and
these are compared as text. Items shorter than a window have no such
guarantee: for each of their lengths (fewer than ``WINDOW``), all word runs of
that length are looked up instead.

The benchmark side is broadcast only when its fingerprint count, taken first,
is at most ``BROADCAST_ROWS``; beyond that the join shuffles.

Defined results: a null or empty text, or one without words, has no words and
no hits; benchmark rows without an id take no part, repeated ids count once;
documents without doc_id take no part, of rows that repeat one the smallest
text stays; other columns are ignored; empty tables give no hits.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtrace.llm.tables import one_row_per_id, stored, table

#: Words in a window and in a k-gram; fingerprints broadcast at most.
WINDOW, K, BROADCAST_ROWS = 10, 5, 200_000

CAPITAL_SIGMA, SMALL_SIGMA = "\u03a3", "\u03c3"

#: Signs between words, A-Z included as texts are lower-cased first.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column, exact: bool = True) -> Column:
    """Words of a text. ``exact`` lower-cases A-Z only; otherwise all letters
    are lower-cased, which is faster and keeps the words' places. The capital
    sigma, whose lower case alone depends on its neighbours, is replaced
    first, so letters are mapped one by one and equal words stay equal (more
    may become equal: good enough to propose)."""
    text = F.coalesce(text, F.lit(""))
    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase) if exact else \
        F.lower(F.replace(text, F.lit(CAPITAL_SIGMA), F.lit(SMALL_SIGMA)))
    return F.array_remove(F.split(lower, _BETWEEN, -1), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row: the optimizer
    would otherwise copy its expression into every place that uses it, also
    into functions that run per word."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _grams(w: Column, n: int) -> Column:
    """Hash of every run of n words (none if the text is shorter)."""
    at = F.sequence(F.lit(1), F.size(w) - (n - 1))
    return F.when(F.size(w) >= n, F.transform(at, lambda i: F.xxhash64(F.slice(w, i, n))))


def _winnowed(grams: Column) -> Column:
    """Distinct smallest hashes of all windows of k-gram hashes."""
    width = WINDOW - K + 1
    at = F.sequence(F.lit(1), F.size(grams) - (width - 1))
    return F.when(F.size(grams) >= width, F.array_distinct(
        F.transform(at, lambda i: F.array_min(F.slice(grams, i, width)))))


def fingerprints(text: Column) -> Column:
    return let(words(text, exact=False), lambda v: let(_grams(v, K), _winnowed))


def _lookup(left: DataFrame, right: DataFrame, on, right_rows: int) -> DataFrame:
    return left.join(F.broadcast(right) if right_rows <= BROADCAST_ROWS else right, on)


def hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, at, n, item_id): n words from word ``at`` on are a window of
    the item. ``docs`` (doc_id, text) has unique ids."""
    items = stored(items.where("item_id is not null").select(
        F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w"),
        words(F.col("text"), exact=False).alias("v")).where("size(w) > 0"), "items")
    # A few lengths at most, and the number of rows to be broadcast.
    lengths = [r.n for r in items.where(F.size("w") < WINDOW).select(F.size("w").alias("n")).distinct().collect()]
    size = items.agg(F.coalesce(F.sum(F.size("w")), F.lit(0))).first()[0]

    # Proposals: word runs of a document that may be an item's.
    long, short = items.where(F.size("w") >= WINDOW), items.where(F.size("w") < WINDOW)
    selected = docs.select("doc_id", F.explode(fingerprints(F.col("text"))).alias("f"))
    known = long.select(F.explode(let(_grams(F.col("v"), K), _winnowed)).alias("f")).distinct()
    found = _lookup(selected, known, "f", size).select("doc_id", "f", F.lit(WINDOW).alias("n"))
    for n in lengths:
        runs = docs.select("doc_id", F.explode(let(
            words(F.col("text"), exact=False), lambda v: _grams(v, n))).alias("f"))
        given = short.where(F.size("w") == n).select(F.explode(_grams(F.col("v"), n)).alias("f")).distinct()
        found = found.unionByName(_lookup(runs, given, "f", size).select(
            "doc_id", "f", F.lit(n).alias("n")))
    found = found.groupBy("doc_id").agg(F.collect_set(F.struct("n", "f")).alias("found"))

    # Extension: windows that hold a proposed gram, compared as text. A gram
    # can stand at several places of its document, all are taken.
    def starts(n, w, v):
        """Windows of n words over all places of proposed grams."""
        k = K if n == WINDOW else n

        def windows_at(mine):
            gram = F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.struct(
                i.alias("i"), F.xxhash64(F.slice(v, i, k)).alias("f")))
            places = F.filter(gram, lambda x: F.array_contains(mine, x["f"]))
            first = F.flatten(F.transform(places, lambda x: F.sequence(
                F.greatest(x["i"] - (n - k), F.lit(1)), F.least(x["i"], F.size(w) - (n - 1)))))
            return F.when((F.size(mine) > 0) & (F.size(w) >= n), F.transform(
                F.array_distinct(first), lambda i: F.struct(
                    (i - 1).alias("at"), F.lit(n).alias("n"),
                    F.array_join(F.slice(w, i, n), " ").alias("window"))))

        mine = F.transform(F.filter("found", lambda x: x["n"] == n), lambda x: x["f"])
        none = F.array().cast("array<struct<at:int,n:int,window:string>>")
        return F.coalesce(let(mine, windows_at), none)

    candidates = docs.join(found, "doc_id").select("doc_id", F.explode(let(
        words(F.col("text")), lambda w: let(words(F.col("text"), exact=False), lambda v: F.concat(
            *(starts(n, w, v) for n in [WINDOW, *lengths]))))).alias("c")).select("doc_id", "c.*")
    runs = F.transform(F.sequence(F.lit(1), F.size("w") - (WINDOW - 1)),
                       lambda i: F.array_join(F.slice("w", i, WINDOW), " "))
    windows = long.select("item_id", F.explode(F.array_distinct(runs)).alias("window")) \
        .unionByName(short.select("item_id", F.array_join("w", " ").alias("window")))
    # A window is looked up once, with the list of its items.
    windows = windows.groupBy("window").agg(F.collect_set("item_id").alias("item_ids"))
    return _lookup(candidates, windows, "window", size).select("doc_id", "at", "n", "item_ids")


def check(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, item_ids) of every document."""
    docs = one_row_per_id(docs)
    found = hits(docs, items).groupBy("doc_id").agg(
        F.collect_set(F.struct("at", "n")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"))
    places = F.array_distinct(F.flatten(F.transform(
        "spans", lambda s: F.sequence(s["at"], s["at"] + s["n"] - 1))))
    found = found.select("doc_id", F.size(places).cast("long").alias("n_hit"), "item_ids")
    counted = docs.select("doc_id", F.size(words(F.col("text"), exact=False)).cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    return counted.join(found, "doc_id", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("item_ids", none).alias("item_ids"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    return check(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))
