"""Archives, neighbours, classifier, components, pipeline and registration."""

import base64
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from flowtrace.llm import neighbours, quality, warc
from flowtrace.llm.components import components
from flowtrace.llm.queries import QUERIES
from flowtrace.llm.tables import bounded_batches

from ..conftest import SF_SMALL


def archived(rows):
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    first = {}
    for p, h in sorted(rows):
        first.setdefault(digest(h), p)
    return {p: (len((h or "").encode()), digest(h), "response" if first[digest(h)] == p else "revisit",
                None if first[digest(h)] == p else first[digest(h)]) for p, h in rows}


def back(spark, path):
    return {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
            for r in warc.read(spark, path).collect()}


@pytest.mark.parametrize("split", ["128m", "300"])
def test_warc_rejects_magic_inside_payloads(spark, scratch, split):
    inner = (f"{warc.MAGIC}WARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 65\r\n\r\n"
             f"{warc.HTTP}hello\r\n\r\n")
    rows = [(1, "u\r\nWARC/1.0\r\n", None), (2, "u", ""), (3, None, "x"), (4, "u", "x"),
            (5, "u", "aWARC/1.0\r\nb\r\n\r\n"), (6, "u", inner + inner + "tail"), (7, "u", "\r\n\r\n"),
            (8, "u", warc.MAGIC * 50), (9, "u", warc.MAGIC * 50), (10, "é", "é\n")]
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        path = f"{scratch}/warc{split}"
        pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
        warc.write(pages.repartition(2), path)
        assert back(spark, path) == archived([(a, c) for a, _, c in rows])
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_warc_odd_tables(spark, scratch):
    schema = "page_id long, url string, html string"
    warc.write(spark.createDataFrame([(None, "a", "x"), (1, "b", "y"), (1, "a", "y"), (2, None, "y")], schema),
               f"{scratch}/warc_odd")
    assert back(spark, f"{scratch}/warc_odd") == archived([(1, "y"), (2, "y")])
    warc.write(spark.createDataFrame([], schema), f"{scratch}/warc_none")
    assert back(spark, f"{scratch}/warc_none") == {}


def exact(rows, k):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    out = {}
    for q in np.flatnonzero(ids % 20 == 0):
        score = neighbours.products(x[q:q + 1], x)[0]
        best = [j for j in np.lexsort((ids, -score)) if j != q][:k]
        out[int(ids[q])] = [(int(ids[j]), float(score[j])) for j in best]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_neighbours_with_ties_copies_and_bad_vectors(spark, monkeypatch):
    bounded_batches(spark)
    monkeypatch.setattr(neighbours, "BLOCK", 7)
    rng = np.random.default_rng(1)
    rows = [(i, [1.0, 2.0, 1.0] if i % 3 == 0 else (rng.integers(0, 3, 3) + 1.0).tolist()) for i in range(150)]
    odd = [(1000, None), (1020, [0.0, 0.0, 0.0]), (1040, [float("nan"), 1.0, 1.0]), (1060, [None, 1.0, 1.0]),
           (None, [1.0, 1.0, 1.0]), (1080, [1.0]), (1100, [])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))
    got, want = found(neighbours.search(df, F.col("vec_id") % 20 == 0)), exact(rows, 20)
    assert set(got) == set(want) and all(got[q] == want[q] for q in want)
    assert neighbours.search(df.where("vec_id >= 1000"), F.lit(True)).count() == 0


@pytest.mark.parametrize("members, queries", [(7, 3), (1000, 3), (7, 1000)])
def test_neighbours_do_not_depend_on_how_buckets_are_cut(spark, monkeypatch, members, queries):
    bounded_batches(spark)
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(12).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = found(neighbours.search(df, F.lit(True), 5))
    monkeypatch.setattr(neighbours, "BLOCK", members)
    monkeypatch.setattr(neighbours, "QUERIES", queries)
    assert found(neighbours.search(df, F.lit(True), 5)) == whole and len(whole) == 300


@pytest.mark.parametrize("n", [15, 400])
def test_neighbours_no_query_misses_what_there_is(spark, monkeypatch, n):
    """One vector of huge norm sends all others to other cells than the
    queries'; with few vectors every other one is a neighbour."""
    bounded_batches(spark)
    monkeypatch.setattr(neighbours, "BLOCK", 7 if n < 20 else 150)
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(64).tolist()) for i in range(n)] + [(n, [1e4] * 64)]
    rows += [(1000 + i, rows[3][1]) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = found(neighbours.search(df, F.col("vec_id") % 20 == 0)), exact(rows, 20)
    assert set(got) == set(want) and all(len(got[q]) == len(want[q]) for q in want)
    # Queries whose buckets held too little are exact: here, most.
    assert sum(got[q] == want[q] for q in want) >= len(want) * 0.5


def test_neighbours_recall(spark):
    df = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    rows = [tuple(r) for r in df.select("vec_id", "embedding").collect()]
    got, want = found(QUERIES["op2_neighbours"](spark, SF_SMALL)), exact(rows, 20)
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_probes_go_by_estimated_success():
    place = np.array([0.1, 2.45, -1.2])
    cells = neighbours.probes(place, 27)
    assert len({tuple(c) for c in cells.tolist()}) == len(cells) and cells[0].tolist() == [0, 2, -2]

    def cost(cell):
        moved = cell - np.floor(place)
        inside = place - np.floor(place)
        return sum((1 - f) ** 2 if m > 0 else f ** 2 if m < 0 else 0 for m, f in zip(moved, inside))

    costs = [cost(c) for c in cells]
    assert costs == sorted(costs)


def test_quality_on_held_out_rows(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = QUERIES["op8_quality"](spark, "/root/testdata/sf0.01").join(labels, "doc_id")
    r = scored.where("held_out").agg(F.count("*").alias("n"), F.avg((F.col("predicted") == F.col("quality"))
                                                                   .cast("int")).alias("right")).first()
    assert r.n > 50 and r.right > 0.95


def test_quality_odd_rows(spark):
    bounded_batches(spark)
    rows = [(i, "good prose of words " * 5 + str(i)) for i in range(30)] + [
        (100 + i, "BAD!! BAD!! " * 20 + str(i)) for i in range(30)] + [(None, None), (1, ""), (1, "x" * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("quality", F.lit(9))
    marks = [(i, 1) for i in range(30)] + [(100 + i, 0) for i in range(30)] + [(None, 1), (5, None), (7, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    out = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert all(r.predicted == (r.doc_id < 100) for r in out if r.text and "o" in r.text.lower() + "o"
               and r.doc_id is not None and len(r.text) < 1000)
    assert quality.accepted(docs, quality.fit(docs, labels)).columns == docs.columns
    empty = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, empty).collect()} == {0.5}
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0), labels)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 140)] + [(200, 200)] + [
        (rng.randrange(300, 340), rng.randrange(300, 340)) for _ in range(30)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_pipeline(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "pii", "byte_bpe"]
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    out = {r.doc_id: r for r in entry.queries()["pipeline"](spark, SF_SMALL).collect()}
    assert 0.6 * docs.count() < len(out) < docs.count()
    scored = {r.doc_id: r.predicted for r in QUERIES["op8_quality"](spark, SF_SMALL).collect()}
    assert all(scored[d] == 1 for d in out)
    # Later stages act on what is left: clean, unique documents stay as they are.
    texts = {r.doc_id: r.text for r in docs.collect()}
    same = [d for d, r in out.items() if r.decoded_sha256 == hashlib.sha256(texts[d].encode()).hexdigest()]
    assert len(same) > 0.8 * len(out)


def test_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14)) and set(QUERIES) < set(entry.queries())
