"""How much of a batch a task works on at once, and joins with the rows that
go instead of those that stay."""

import os
import random
import subprocess
import sys
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from flowtrace.llm import arrays, byte_bpe, jaccard_join, quality
from flowtrace.llm.tables import stored, table

from . import brute
from .conftest import sentence


def test_pieces_hold_every_row_once(monkeypatch):
    monkeypatch.setattr(arrays, "PIECE", 20)
    texts = [None, "", "x" * 50, "ab", None, "y" * 19, "é" * 10, "", "z" * 21, "z", ""]
    lists = [[], None, [1] * 30, [2], [3, 4], [], [5] * 5, [6], None, [7], [8]]
    whole = pa.record_batch([pa.array(texts), pa.array(lists, pa.list_(pa.int32()))], ["text", "ids"])
    for batch in (whole, whole.slice(2, 7), whole.slice(0, 0)):
        for columns, size in ((["text"], lambda r: len((r["text"] or "").encode())),
                              (["ids"], lambda r: 4 * len(r["ids"] or [])),
                              (["text", "text"], lambda r: 2 * len((r["text"] or "").encode()))):
            parts = [p.to_pylist() for p in arrays.pieces(batch, *columns)]
            assert [r for p in parts for r in p] == batch.to_pylist()
            assert all(len(p) == 1 or sum(map(size, p)) <= 20 for p in parts)


@pytest.mark.parametrize("name", ["describe", "counts", "decoder"])
def test_tasks_work_on_pieces_of_a_batch(name):
    rng = random.Random(1)
    some = [sentence(rng, 1000) for _ in range(50)]
    texts = pa.record_batch([pa.array(range(1000)), pa.array(some * 20)], ["doc_id", "text"])
    ids = pa.record_batch([pa.array(range(1000)), pa.array([[k % 50_000 for k in range(i, i + 1000)] for i in range(1000)],
                                                           pa.list_(pa.int32()))], ["doc_id", "ids"])
    run, batch = {"describe": (jaccard_join._describe(5, 80, np.zeros(1 << 20, np.uint8)), texts),
                  "counts": (jaccard_join._counts(5, 1 << 20), texts),
                  "decoder": (byte_bpe._decoder(public_tokenizers.path("byte_bpe_50k.tiktoken")), ids)}[name]
    assert batch.nbytes > 4_000_000
    for _ in run([batch.slice(0, 1)]):  # imports
        pass
    tracemalloc.start()
    for _ in run([batch]):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30_000_000


def test_few_copies_leave_the_other_rows_out_of_shuffles(spark, frame, scratch, monkeypatch):
    rng = random.Random(2)
    docs = [(i, sentence(rng, 6)) for i in range(3000)]
    docs += [(3000 + i, docs[100 * i][1]) for i in range(5)]
    plans = {}

    def planned(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return stored(df, name)

    monkeypatch.setattr(jaccard_join, "stored", planned)
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "3k")  # less than the 3,000 that stay, more than the five that go
    try:
        kept = corpus_pipeline.near_duplicates(spark, frame(docs, scratch), scratch)
        assert "SortMergeJoin" not in plans["postings"]
        assert "SortMergeJoin" not in kept._jdf.queryExecution().executedPlan().toString()
        got = sorted((r.doc_id, r.text) for r in kept.collect())
    finally:
        spark.conf.set(threshold, before)
    group = brute.jaccard_components(docs)
    assert got == [(d, t) for d, t in docs if group[d][1] == d]


def test_a_finished_task_gives_its_memory_back():
    code = """
import re, sys
import numpy as np
from flowtrace.llm.arrays import returning

def held():
    return sum(map(int, re.findall("\\nPss_Anon: +([0-9]+)", open("/proc/self/smaps_rollup").read()))) / 1024

def run(batches):
    rows = [bytes(1000) for _ in range(100_000)]
    pins = [bytes(1000) for _ in range(10)]  # above the others, so that they don't just shrink the heap
    yield len(rows)
    del rows
    kept.extend(pins)

kept, before = [], held()
assert list(returning(run)([])) == [100_000]
assert held() - before < 30, held() - before
"""
    if not os.path.exists("/proc/self/smaps_rollup"):
        pytest.skip("memory can't be read here")
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_quality_collects_its_sample_compressed(spark, monkeypatch):
    """The sample's counts are mostly 0: a quarter of their size at most comes
    to the driver, and the model learns from the same counts and order."""
    docs, labels = (table(spark, "/root/testdata/sf0.01", name) for name in ("documents", "labels"))
    collected, learnt, collect = [], [], type(docs).toArrow
    monkeypatch.setattr(type(docs), "toArrow", lambda df: collected.append(collect(df)) or collected[-1])
    monkeypatch.setattr(quality.Model, "learn", staticmethod(lambda idf, c, labels: learnt.append((c, labels))))
    quality.fit(docs, labels)
    (c, y), = learnt
    assert len(c) == collected[0].num_rows > 20 and 4 * collected[0].nbytes < c.nbytes
    marks = dict(labels.where("quality is not null").where(~quality.held_out())
                 .groupBy("doc_id").agg(F.max("quality")).collect())
    texts = [(r.text, marks[r.doc_id]) for r in docs.collect() if r.doc_id in marks]
    want = sorted(zip((r.tobytes() for r in quality.counts(pa.array([t for t, _ in texts]))), (m for _, m in texts)))
    assert [r.tobytes() for r in c] == [r for r, _ in want] and y.tolist() == [m for _, m in want]
