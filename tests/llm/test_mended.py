"""Cases that earlier versions got wrong."""

import os
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest

from flowtrace.llm import decontamination, quality
from tests.llm import brute


def test_decontamination_maps_letters_one_by_one(frame, scratch):
    docs = [(1, "a b c d ΟΔΟΣ.Α e f g h"), (2, "zz ΑΣ'Β yy"), (3, "a b c d οδος.α e f g h"),
            (4, "x İI ıi ǅ K Å ſ ß ẞ Ω y"), (5, "Σ ΑΣ ΑΣΑ Σ. ΣΣ")]
    items = [("i1", "a b c d ΟΔΟΣ Α e f g h"), ("i2", "zz ΑΣ Β yy"), ("i3", "x İI ıi ǅ K Å ſ ß ẞ Ω y"),
             ("i4", "ΑΣΑ Σ ΣΣ")]
    rows = decontamination.check(frame(docs, scratch), frame(items, scratch, "item_id string, text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in rows} == brute.contaminated(docs, items)


def test_quality_counts_do_not_depend_on_pieces(monkeypatch, corpus):
    column = pa.array([t for _, t in corpus])
    whole = quality.counts(column)
    monkeypatch.setattr(quality, "PIECE", 37)
    assert np.array_equal(quality.counts(column), whole)
    for row, (_, text) in zip(whole, corpus):
        data = (text or "").encode()
        want = np.zeros(quality.TERMS)
        for a, b, c in zip(data, data[1:], data[2:]):
            want[(a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D >> 7) % quality.TERMS] += 1
        assert np.array_equal(row[:-1], want)
        words = brute.space_words(text)
        assert row[-1] == 5 * sum(x == y for x, y in zip(words, words[1:]))


def test_quality_counts_a_large_batch_in_little_memory():
    code = """
import resource, pyarrow as pa
from flowtrace.llm import quality
texts = pa.array(["some words that stand here " * 40] * 16000)
quality.counts(texts.slice(0, 100))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
quality.counts(texts.slice(0, 1000)); quality.counts(pa.array(["some words " * 1_500_000]))
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    assert int(out.stdout) < 300


@pytest.mark.parametrize("name", ["op2_neighbours", "op8_quality", "op11_packing", "op12_runs", "op13_alignment"])
def test_workers_do_not_need_the_package(name, tmp_path):
    """The driver finds the package by sys.path alone; workers, started in
    another folder without PYTHONPATH, don't find it at all."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false") \\
    .config("spark.sql.shuffle.partitions", "2").getOrCreate()
print(entry.queries()[{name!r}](spark, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr[-2000:]


def test_quality_votes_equal_brute_force():
    """Scores from plain loops over the same labelled vectors; ties at the
    last neighbour all vote, in any order of the sample."""
    rng = np.random.default_rng(1)
    words = ["alpha", "beta", "gamma", "delta", "click here", "buy", "now now", "the", "of"]
    texts = [" ".join(rng.choice(words, rng.integers(0, 30))) for _ in range(120)]
    texts += texts[:40] * 2 + [""]
    c = quality.counts(pa.array(texts))
    labels = rng.integers(0, 2, len(texts))
    idf = np.linspace(1, 2, c.shape[1]).astype(np.float32)
    model = quality.Model.learn(idf, c, labels)
    got = model.score(c)
    x = quality.unit(quality.weighted(c, idf), model.projection)
    for row in range(len(texts)):
        cosine = [round(float(v), 5) for v in x[row].astype(np.float64) @ model.vectors.T.astype(np.float64)]
        least = sorted(cosine)[-quality.NEIGHBOURS]
        near = [(max(v, 0) ** quality.SHARPNESS, y) for v, y in zip(cosine, labels) if v >= least]
        score = (sum(w * y for w, y in near) + quality.PRIOR * labels.mean()) \
            / (sum(w for w, _ in near) + quality.PRIOR)
        want = score if texts[row] else labels.mean()
        assert abs(got[row] - want) < 1e-4
    order = rng.permutation(len(texts))
    again = quality.Model(idf, model.labels[order], model.prior, model.projection, model.vectors[order])
    assert np.allclose(again.score(c), got, atol=1e-5)
