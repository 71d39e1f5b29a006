"""Document operators against plain Python on a small awkward corpus."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowtrace.llm import (byte_bpe, decontamination, jaccard_join, phrase_dedup, pii, repeats,
                           suffix_dedup, token_store)
from flowtrace.llm.tables import bounded_batches, stored

from . import brute
from .conftest import sentence


@pytest.fixture(scope="module")
def docs(frame, corpus, scratch, spark):
    bounded_batches(spark)
    return frame(corpus, scratch)


@pytest.fixture(scope="module")
def none(frame, scratch):
    return frame([], scratch, n=1)


def rows(df):
    return {r["doc_id"]: tuple(r)[1:] for r in df.collect()}


def test_suffix_dedup(docs, none, corpus):
    want = brute.repeated_bytes(corpus, 50)
    got = rows(suffix_dedup.deduplicate(docs, 50))
    assert {d: (*g[:3], bytes(g[3])) for d, g in got.items()} == want
    assert sum(w[1] for w in want.values()) > 1000
    assert suffix_dedup.deduplicate(none, 50).count() == 0


def test_suffix_dedup_keeps_the_first(docs, corpus):
    got = rows(suffix_dedup.deduplicate(docs, 50, keep_first=True))
    seen, want = set(), {}
    for d, t in sorted(corpus):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if b[i:i + 50] in seen:
                gone[i:i + 50] = b"\1" * 50
            seen.add(b[i:i + 50])
        want[d] = bytes(c for c, g in zip(b, gone) if not g)
    assert {d: bytes(g[3]) for d, g in got.items()} == want


def test_suffix_ranks_order_suffixes():
    data = np.frombuffer(b"abracadabra abracadabra abra", np.uint8)
    rank = suffix_dedup.suffix_ranks(data, 11)
    cut = [data.tobytes()[i:i + 11].ljust(11, b"\0") for i in range(len(data) - 11)]
    assert all((cut[i] < cut[j]) == (rank[i] < rank[j]) and (cut[i] == cut[j]) == (rank[i] == rank[j])
               for i in range(len(cut)) for j in range(len(cut)))


def test_phrase_dedup(docs, none, corpus):
    want = brute.repeated_words(corpus, 20)
    got = rows(phrase_dedup.deduplicate(docs))
    assert {d: (*g[:2], bytes(g[2]).decode()) for d, g in got.items()} == want
    assert sum(w[1] for w in want.values()) > 500
    assert phrase_dedup.deduplicate(none).count() == 0


def test_phrase_dedup_with_small_automata(docs, corpus, monkeypatch):
    monkeypatch.setattr(phrase_dedup, "AUTOMATON_WINDOWS", 3)
    got = rows(phrase_dedup.deduplicate(docs))
    assert {d: g[1] for d, g in got.items()} == {d: w[1] for d, w in brute.repeated_words(corpus, 20).items()}


def bounded(compare, length, most):
    """``compare``, which must not see an anchor with more units."""
    def run(rows, sizes):
        _, group = np.unique(rows.column("anchor").to_numpy(), return_inverse=True)
        assert np.bincount(group, sizes + length - 1).max() <= most
        return compare(rows, sizes)

    return run


@pytest.mark.parametrize("most", [1000, 0])
def test_no_anchor_is_compared_whole(docs, corpus, monkeypatch, most):
    """One passage with other text around it in every document."""
    monkeypatch.setattr(repeats, "BATCH_UNITS", most)
    for module, length in ((suffix_dedup, 50), (phrase_dedup, 20)):
        compare = module._compare
        monkeypatch.setattr(module, "_compare", lambda *a, c=compare: bounded(c(*a), a[0], most))
    want = brute.repeated_bytes(corpus, 50)
    assert {d: (*g[:3], bytes(g[3])) for d, g in rows(suffix_dedup.deduplicate(docs, 50)).items()} == want
    want = brute.repeated_words(corpus, 20)
    got = rows(phrase_dedup.deduplicate(docs))
    assert {d: (*g[:2], bytes(g[2]).decode()) for d, g in got.items()} == want
    whole = rows(suffix_dedup.deduplicate(docs, 50, keep_first=True))
    monkeypatch.undo()
    assert whole == rows(suffix_dedup.deduplicate(docs, 50, keep_first=True))


def test_joins_split_hot_anchors(spark, frame, scratch, monkeypatch):
    """One passage with other text around it, and many copies of one text."""
    rng = random.Random(5)
    passage, copy = sentence(rng, 60), sentence(rng, 60)
    docs = [(i, f"{sentence(rng, 20)} {passage} {sentence(rng, 20)}") for i in range(300)]
    docs += [(300 + i, copy) for i in range(300)]
    plans, join = {}, "spark.sql.adaptive.skewJoin."
    confs = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "32",
             "spark.sql.adaptive.coalescePartitions.enabled": "false",
             f"{join}skewedPartitionThresholdInBytes": "1k", f"{join}skewedPartitionFactor": "1.5",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k"}
    before = {k: spark.conf.get(k, None) for k in confs}

    def planned(df, name):
        df.collect()
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return stored(df, name)

    monkeypatch.setattr(repeats, "stored", planned)
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        got = rows(suffix_dedup.deduplicate(frame(docs, scratch), 50))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert {d: (*g[:3], bytes(g[3])) for d, g in got.items()} == brute.repeated_bytes(docs, 50)
    for name in ("segments", "listed", "spans"):
        assert "SortMergeJoin(skew=true)" in plans[name], name


@pytest.mark.parametrize("block", [1024, 2])
def test_jaccard_join(docs, corpus, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    assert rows(jaccard_join.similar(docs)) == brute.jaccard_components(corpus)


def test_jaccard_join_links_chains_that_miss_the_hub(frame, scratch):
    """Each text is similar to its neighbours only; all share words."""
    words = [f"w{i}" for i in range(130)]
    chain = [(i, " ".join(words[3 * i:3 * i + 60])) for i in range(20)]
    got = rows(jaccard_join.similar(frame(chain, scratch)))
    assert got == brute.jaccard_components(chain) and {c for _, c in got.values()} == {0}


def test_jaccard_join_of_nothing(none):
    assert jaccard_join.similar(none).count() == 0


def test_traversal_loses_no_pair():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 400, dtype=np.uint64)
    sets = [np.unique(rng.choice(base, n)) for n in rng.integers(1, 300, 90)]
    sets += [s[rng.random(len(s)) > 0.05] for s in sets]
    sets = [s for s in sets if len(s)]
    offsets = np.append(0, np.cumsum([len(s) for s in sets]))
    bits, count = jaccard_join._rows_of(jaccard_join.bitmaps(np.concatenate(sets), offsets))
    sizes = np.diff(offsets)
    order = np.argsort(sizes, kind="stable")
    tree = jaccard_join.Tree(bits[order], (sizes - count)[order], sizes[order], np.arange(len(sets)))
    found = set(zip(*(x.tolist() for x in jaccard_join.traverse(tree, tree, 80))))
    linked = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets))
              if 100 * (c := len(np.intersect1d(sets[order[i]], sets[order[j]])))
              >= 80 * (sizes[order[i]] + sizes[order[j]] - c)}
    assert linked and linked <= found and len(found) < len(sets) ** 2 / 4
    half = len(sets) // 2
    parts = [jaccard_join.Tree(bits[order][s], (sizes - count)[order][s], sizes[order][s],
                               np.arange(len(sets))[s]) for s in (slice(0, half), slice(half, None))]
    across = {(i, half + j) for i, j in zip(*(x.tolist() for x in jaccard_join.traverse(*parts, 80)))}
    assert {p for p in linked if p[0] < half <= p[1]} <= across


def test_byte_bpe(docs, none, corpus):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                 mergeable_ranks=byte_bpe.vocabulary(path))
    encoded = byte_bpe.encode(docs, path, public_tokenizers.PATTERN, chunk_tokens=500)
    assert {d: list(g[0]) for d, g in rows(encoded).items()} == {
        d: encoding.encode_ordinary(t or "") for d, t in corpus}
    got = rows(byte_bpe.round_trip(docs))
    assert {d: g[2] for d, g in got.items()} == {d: brute.sha(t or "") for d, t in corpus}
    assert byte_bpe.round_trip(none).count() == 0


@pytest.mark.parametrize("text", [
    "don't you'll we've I'm he'd 'tis 's's ''s '' x'sx 're're", " 's  's\t's 'S", "  a   b \n\n c  ", " \n", "\n x",
    "1a2'll3 ''ll !!'t", "a b 　 c ", "é'sé ٣٤ ½ x²", "'", "'l", "'ve", "<|endoftext|> x"])
def test_pre_tokens(text):
    import public_tokenizers
    import regex

    raw = text.encode()
    data = np.frombuffer(raw + raw, np.uint8)
    offsets = np.array([0, len(raw), 2 * len(raw)])
    starts, before = byte_bpe.pre_tokens(data, offsets, byte_bpe.Classes())
    ends = np.append(starts[1:], len(data))
    got = [data[a:b].tobytes().decode() for a, b in zip(starts, ends)]
    want = regex.findall(public_tokenizers.PATTERN, text)
    assert got == want + want and before.tolist() == [0, len(want), 2 * len(want)]


def test_token_store(docs, none, corpus, spark, scratch):
    import public_tokenizers
    from tokenizers import Tokenizer

    file = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(file)
    extra = [(100, "Don't STOP, 'LL <|endoftext|> a<|startoftext|>b Ünïcødé×y ≠ é, 12,5 ÷"), (100, "again")]
    frame = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    token_store.write(frame, f"{scratch}/tokens", file, 2)
    got = sorted((tuple(r) for r in token_store.read(spark, f"{scratch}/tokens").collect()), key=lambda r: r[1])
    ids = {}
    for d, t in corpus + extra:
        ids.setdefault(d, []).append(tokenizer.encode(t or "", add_special_tokens=False).ids + [2])
    start, flat = 0, []
    for d, at, n, crc in got:
        own = next(x for x in ids[d] if zlib.crc32(np.array(x, "<u4").tobytes()) == crc)
        ids[d].remove(own)
        assert (at, n) == (start, len(own))
        start, flat = start + n, flat + own
    assert not any(ids.values()) and [g[0] for g in got] == sorted(g[0] for g in got)
    for p in (0, 1, 777, len(flat) - 1):
        assert token_store.token(spark, f"{scratch}/tokens", p) == flat[p]
    token_store.write(none, f"{scratch}/no_tokens", file, 2)
    assert token_store.read(spark, f"{scratch}/no_tokens").count() == 0


def test_codes_random_access():
    rng = np.random.default_rng(1)
    for ids in ([], [0], [255, 256, 65535, 65536, 2 ** 32 - 1], rng.integers(0, 50000, 5000),
                rng.integers(0, 200, 1024)):
        codes = token_store.Codes(token_store.pack(np.array(ids, np.uint32)))
        assert codes.all().tolist() == list(ids) == [codes[i] for i in range(len(codes))]


def test_decontamination(docs, frame, scratch, corpus, none):
    texts = dict(corpus)
    items = [(1, " ".join(texts[-5].split()[5:40])), (2, "ONE two"), (3, ""), (4, None), (None, texts[7]),
             (5, "a b a b a b a b a b a"), (6, "é ü"), (6, " ".join(texts[8].split()[100:120]))]
    bench = frame(items, scratch, "item_id long, text string")
    got = rows(decontamination.check(docs, bench))
    want = brute.contaminated(corpus, items)
    assert {d: (g[0], g[1], list(g[2])) for d, g in got.items()} == want
    assert sum(w[1] > 0 for w in want.values()) > 12
    assert decontamination.check(none, bench).count() == 0
    assert all(g[1] == 0 for g in rows(decontamination.check(
        docs, bench.where("item_id = 3"))).values())


PII = [(1, None), (2, ""), (3, "a@b.c_d@e.f x@y..z@q.w.e é@x.y"), (4, "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0004"),
       (5, "5555 5555 5555 4444 4111-1111-1111-1111 12-"), (6, "+1 (568) 555-6437 4918187128635271 +49 30 1234567-"),
       (7, "ü1.1.1.1 account DE89 3704 0044 0532 0130 00 DE88370400440532013000 ssn 123-45-6789 or 123-45-6780"),
       (8, " 4111 1111 1111 1111 " * 500), (9, "1" * 5000), (10, "1 " * 9000), (11, "a.b" * 9000 + "@c.d"),
       (12, "+" * 500 + "1" * 300), (13, "𝒳 a@b.cd 10.0.0.1"), (13, "13 twice a@b.cd")]


def test_pii(frame, scratch, none):
    docs = frame(PII, scratch)
    found = pii.find(docs)
    got = sorted(tuple(r)[:6] for r in pii.report(found).collect())
    want = []
    for d, t in PII:
        spans = brute.base_spans(t)
        kinds = [s.split(":")[0] for s in spans]
        want.append((d, *(kinds.count(k) for k in ("email", "ip", "card", "phone")), brute.sha(",".join(spans))))
    assert got == sorted(want)
    spans = {r.doc_id: r.spans for r in pii.report(found).collect()}
    assert spans[6] == "card:18:34,phone:0:17,phone:35:49"  # next to each other, found by the method
    assert spans[7] == "ip:1:8,iban:17:44,ssn:72:83"  # a wrong checksum, and no context, add nothing
    clean = {r.doc_id: r.text for r in pii.redacted(found).collect()}
    assert clean[6] == "[phone] [card] [phone]-" and clean[1] == "" and clean[13] is not None
    assert pii.report(pii.find(none)).count() == 0
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()


def test_repeated_and_missing_ids(frame, scratch, spark):
    rows_ = [(1, "b " * 60), (1, "a"), (None, "b " * 60), (2, "b " * 60), (2, "b " * 60), (3, None), (3, "z")]
    docs = frame(rows_, scratch)
    kept = [(1, "a"), (2, "b " * 60), (3, "z")]
    assert rows(jaccard_join.similar(docs)) == brute.jaccard_components(kept)
    assert {d: g[1] for d, g in rows(phrase_dedup.deduplicate(docs)).items()} == {
        d: w[1] for d, w in brute.repeated_words(kept, 20).items()}
    assert {d: g[1] for d, g in rows(suffix_dedup.deduplicate(docs, 50)).items()} == {
        d: w[1] for d, w in brute.repeated_bytes(kept, 50).items()}
    items = spark.createDataFrame([(1, "z")], "item_id long, text string")
    assert {d: g[1] for d, g in rows(decontamination.check(docs, items)).items()} == {1: 0, 2: 0, 3: 1}
    digests = sorted(r.decoded_sha256 for r in byte_bpe.round_trip(docs).collect())
    assert digests == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in rows_)
