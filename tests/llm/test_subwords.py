"""Packing, periodic runs and alignment against plain Python."""

import random
import zlib

import numpy as np
import pytest

from flowtrace.llm import alignment, packing, runs, subwords
from tests.llm import brute

ODD = [
    (70, "a <|endoftext|> b<|endoftext|>"), (71, "under▁score here"), (72, "͸ \U0001f642 ’tis “x”"),
    (73, " lead  and trail  "), (74, "\x00\x1c\x85  \t \r\n"), (75, "<s> </s> <unk> <0x41>"),
    (76, "İI ıi ǅ ʼn ſ K Å"), (77, "日本語のテキスト、漢字。 한국어 العربية"), (78, "don't we'll I'VE 'tis 's"),
    (79, "x" * 2000), (None, "no id"), (79, "same id twice"), (None, None),
]


@pytest.fixture(scope="module")
def docs(frame, scratch, corpus):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz+/0123456789") for _ in range(4000))
    return [*corpus, *ODD, (80, long), (81, "word " * 3000 + long[:500] + " end")]


@pytest.fixture(scope="module")
def df(docs, frame, scratch):
    return frame(docs, scratch)


@pytest.fixture(scope="module")
def nothing(frame, scratch):
    return frame([], scratch)


def paths():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def key(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("part", [1 << 20, 64])
def test_packing(df, docs, nothing, monkeypatch, part):
    monkeypatch.setattr(subwords, "PART_BYTES", part)
    packed = packing.sequences(df, paths()[0], end_id=1)
    rows = packed.collect()
    want = []
    for d, text in docs:
        ids = brute.packed_ids(text)
        want += [(d, a, n, len(ids), zlib.crc32(np.array(ids[a:a + n], "<u4").tobytes()), ids[a:a + n])
                 for a, n in brute.binary_pieces(len(ids))]
    assert key((r.doc_id, r.start, r.length, r.doc_tokens, r.ids_crc32, r.ids) for r in rows) == key(want)
    # Numbered without gaps, the longest bucket first.
    by_id = sorted(rows, key=lambda r: r.sequence_id)
    assert [r.sequence_id for r in by_id] == list(range(len(rows)))
    assert [r.length for r in by_id] == sorted((r.length for r in rows), reverse=True)
    assert packing.sequences(nothing, paths()[0], end_id=1).count() == 0


def test_packed_files_hold_one_length_a_folder(df, spark, scratch):
    packing.write(packing.sequences(df, paths()[0], end_id=1, longest=64), f"{scratch}/packed")
    back = spark.read.parquet(f"{scratch}/packed")
    assert back.where("size(ids) != length").count() == 0
    assert {r.length for r in back.select("length").distinct().collect()} <= {1 << k for k in range(7)}


def run_row(doc_id, text, tail):
    words = brute.space_words(text)
    words = brute.with_repeated_tail(doc_id, words) if tail else words
    found = brute.maximal_runs(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return doc_id, len(words), found, " ".join(w for i, w in enumerate(words) if i not in gone).encode()


@pytest.mark.parametrize("tail", [False, True])
def test_runs(frame, scratch, docs, nothing, tail):
    rng = random.Random(4)
    more = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))) for i in range(100, 260)]
    more += [(300, "a b c " * 50 + "x " + "a b c " * 9), (301, "one two " * 3), (302, "z " * 6), (303, "z " * 5)]
    rows = runs.find(frame(docs + more, scratch), tail).collect()
    assert key((r.doc_id, r.n_words, [tuple(x) for x in r.runs], bytes(r.collapsed)) for r in rows) == \
        key(run_row(d, t, tail) for d, t in docs + more)
    assert runs.find(nothing).count() == 0


def test_runs_across_pieces_and_documents():
    rng = random.Random(1)
    for _ in range(200):
        texts = []
        for _ in range(rng.randint(1, 5)):
            unit = [rng.randrange(3) for _ in range(rng.randint(1, 9))]
            texts.append((unit * rng.randint(0, 12) + [rng.randrange(3) for _ in range(rng.randint(0, 20))])
                         * rng.randint(1, 3))
        ends = np.append(0, np.cumsum([len(t) for t in texts]))
        doc, s, n, q = runs.runs(np.array([w for t in texts for w in t], np.int64), ends)
        for d, text in enumerate(texts):
            mine = doc == d
            assert list(zip(s[mine], n[mine], q[mine])) == brute.maximal_runs(text)


def test_grammar_derives_its_words():
    rng = np.random.default_rng(3)
    words = np.concatenate([np.tile(rng.integers(0, 4, 13), 9), rng.integers(0, 4, 300)])
    g = runs.Grammar(words, np.array([0, 200, len(words)]))

    def spell(symbol):
        if symbol < g.base:
            return [symbol]
        return spell(g.left[symbol - g.base]) + spell(g.right[symbol - g.base])

    assert [w for root in g.roots for w in spell(root)] == words.tolist()
    for k in range(g.count):
        assert spell(g.base + k) == words[g.first[k]:g.first[k] + g.length[k]].tolist()


@pytest.mark.parametrize("part, block, tokens", [(1 << 20, 1_000_000, 1_000_000), (64, 40, 50)])
def test_alignment(df, docs, nothing, monkeypatch, part, block, tokens):
    monkeypatch.setattr(subwords, "PART_BYTES", part)
    monkeypatch.setattr(alignment, "BLOCK_PAIRS", block)
    monkeypatch.setattr(alignment, "LINK_TOKENS", tokens)
    rows = alignment.align(df, *paths()).collect()
    assert key(tuple(r) for r in rows) == key(brute.aligned(docs).values())
    assert alignment.align(nothing, *paths()).count() == 0


def test_galloping_finds_every_place():
    rng = np.random.default_rng(2)
    for n, m in [(0, 5), (1, 0), (1, 9), (7, 300), (40, 41), (300, 5), (1, 1)]:
        short, long = np.sort(rng.choice(1000, n, False)), np.sort(rng.choice(1000, m, False))
        assert alignment.gallop(short, long).tolist() == np.searchsorted(long, short).tolist()
        x, y = alignment.shared_ends(short, long)
        assert short[x].tolist() == long[y].tolist() == sorted(set(short) & set(long))


def test_parts_keep_all_bytes_and_texts():
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab  é") for _ in range(rng.randint(0, 60))).encode() for _ in range(40)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.append(0, np.cumsum([len(t) for t in texts]))
    for limit in (1, 7, 30, 10_000):
        back = [b""] * len(texts)
        for first, part, cuts in subwords.parts(data, offsets, limit):
            for t in range(len(cuts) - 1):
                back[first + t] += part[cuts[t]:cuts[t + 1]].tobytes()
        assert back == texts
