"""The pipeline's rows against plain Python, and sets of very different sizes."""

import random
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tiktoken.load import load_tiktoken_bpe

import corpus_pipeline
from flowtrace.llm import jaccard_join, pii
from flowtrace.llm.tables import with_row_keys

from ..conftest import SF_SMALL
from . import brute
from .conftest import sentence


@pytest.fixture(scope="module")
def folder(spark, scratch):
    """documents of the smallest scale, with rows that have no id or share one."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    some = docs.where(F.length("text") > 400).orderBy("doc_id").limit(6).collect()
    items = [r.text for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").limit(3).collect()]
    fresh = [" ".join(reversed(r.text.split())) for r in some]  # unlike every other text
    odd = [(None, some[0].text), (None, fresh[1]), (None, fresh[1]),    # a copy; two copies of one text
           (some[2].doc_id, fresh[2]), (some[3].doc_id, some[3].text),  # another text; the same row again
           (None, fresh[4] + " " + items[0]), (10 ** 9, fresh[5]), (10 ** 9, fresh[0]), (None, None), (None, "")]
    more = spark.createDataFrame(odd, "doc_id long, text string").select(
        F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "text",
        F.lit("en").alias("lang"), F.lit("odd").alias("source"),
        F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars"))
    path = f"{scratch}/pipeline_rows"
    docs.unionByName(more).write.parquet(f"{path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF_SMALL}/{name}.parquet").write.parquet(f"{path}/{name}.parquet")
    return path


def expected(rows, items, spans):
    """Rows that stages two to five keep of ``rows`` [(doc_id, text)]."""
    times = Counter(d for d, _ in rows)
    key = {i: (d if d is not None and times[d] == 1 else 10 ** 12 + i) for i, (d, _) in enumerate(rows)}
    group = brute.jaccard_components([(key[i], t) for i, (_, t) in enumerate(rows)])
    rows = [r for i, r in enumerate(rows) if group[key[i]][1] == key[i]]
    hit = brute.contaminated([(i, t) for i, (_, t) in enumerate(rows)], items)
    rows = [r for i, r in enumerate(rows) if not hit[i][1]]
    ranks = load_tiktoken_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coder = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = []
    for d, t in rows:
        t = t or ""
        at, parts = 0, []
        for kind, start, stop in sorted(((k, int(a), int(b)) for k, a, b in spans[t]),
                                        key=lambda s: (s[1], s[2], pii.KINDS.index(s[0]))):
            if start >= at:
                parts += [t[at:start], f"[{kind}]"]
            at = max(at, stop)
        clean = "".join(parts) + t[at:]
        ids = coder.encode_ordinary(clean)
        out.append((d, len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(clean)))
    return Counter(out)


def test_pipeline_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.classify(spark, docs, folder).collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    texts = spark.createDataFrame([(i, t) for i, t in enumerate({t or "" for _, t in kept})], "doc_id long, text string")
    found = texts.join(pii.report(pii.find(texts)).select("doc_id", "spans"), "doc_id")
    spans = {r.text: [s.split(":") for s in r.spans.split(",") if s] for r in found.collect()}
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256)
                  for r in corpus_pipeline.run(spark, folder).collect())
    assert got == expected(kept, items, spans)


def test_row_keys(spark, frame, scratch):
    rows = [(1, "a"), (2, "b"), (2, "c"), (None, "d"), (None, None), (-7, "e"), (2 ** 62, "f")]
    for given in (rows, rows[:-1], rows[:2], rows[3:5], []):
        docs = frame(given, scratch).withColumn("row", F.lit("taken"))
        keyed, key = with_row_keys(docs)
        got = [(r.doc_id, r.text, r[key]) for r in keyed.collect()]
        assert Counter((d, t) for d, t, _ in got) == Counter(given) and keyed.drop(key).columns == docs.columns
        assert len({k for _, _, k in got}) == len(given) and all(k is not None for _, _, k in got)
        times = Counter(d for d, _ in given)
        assert all(k == d for d, _, k in got if d is not None and times[d] == 1)


def test_sizes_apart_in_one_group(frame, scratch, monkeypatch):
    """Short and long texts that share a passage, with links inside sizes and
    across the border of two size classes; blocks of a few sets."""
    rng = random.Random(12)
    passage = sentence(rng, 12)
    docs = []
    for size in (0, 4, 20, 24, 28, 60, 115, 120, 500, 2000):
        for _ in range(3):
            own = sentence(rng, size).split()
            docs.append((len(docs), passage + " " + " ".join(own)))
            own[len(own) // 2:len(own) // 2 + 1] = ["x"]
            docs.append((len(docs), passage + " " + " ".join(own)))
            docs.append((len(docs), passage + " " + " ".join(own[:max(1, int(0.88 * len(own)))])))
    monkeypatch.setattr(jaccard_join, "BLOCK", 5)
    monkeypatch.setattr(jaccard_join, "BLOCK_BYTES", 4000)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar(frame(docs, scratch)).collect()}
    assert got == brute.jaccard_components(docs)
