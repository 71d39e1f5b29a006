"""Token ids in files of directly addressable codes.

An id is split into byte-wide levels, lowest first. A level holds one byte
for every id that reaches it and a bitmap that tells which ids continue in
the next level. A rank directory (set bits before every 512-bit block) turns
a position of one level into that of the next, so any token is read without
decoding its neighbours. A file row is one block: consecutive documents in
ascending doc_id order, their offsets and the levels.

Tokenising encodes every distinct word of a task's documents once; the
tokenizer drops white space, so words are independent.

Defined results: a null or empty text holds the end id alone; rows that
repeat a doc_id stand in the order of their texts, rows without one come first; other
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowtrace.llm.arrays import distinct_slices, lower_ascii, text_buffers, word_spans
from flowtrace.llm.lexicon import Lexicon
from flowtrace.llm.tables import shared_folder, table

#: Ids in a block (beyond one document), bits between rank directory entries.
BLOCK_IDS, RANK_BITS = 1_000_000, 512


def pack(ids: np.ndarray) -> bytes:
    """Levels, bitmaps and rank directories of ``ids`` as bytes."""
    rest, parts, levels = np.asarray(ids, np.uint32), [], 0
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        bits = np.append(bits, np.zeros(-len(bits) % (RANK_BITS // 8), np.uint8))
        counts = np.bitwise_count(bits).reshape(-1, RANK_BITS // 8).sum(axis=1)
        ranks = (np.cumsum(counts) - counts).astype("<u4")
        parts += [np.uint32(len(rest)).tobytes(), (rest & 0xFF).astype(np.uint8).tobytes(),
                  bits.tobytes(), ranks.tobytes()]
        levels += 1
        rest = rest[more] >> 8
        if not len(rest):
            return bytes([levels]) + b"".join(parts)


class Codes:
    """Reader of :func:`pack`'s bytes."""

    def __init__(self, packed: bytes):
        self.levels, at = [], 1
        for _ in range(packed[0]):
            n = int(np.frombuffer(packed, "<u4", 1, at)[0])
            words = -(-n // RANK_BITS)
            low = np.frombuffer(packed, np.uint8, n, at + 4)
            bits = np.frombuffer(packed, np.uint8, words * RANK_BITS // 8, at + 4 + n)
            ranks = np.frombuffer(packed, "<u4", words, at + 4 + n + len(bits))
            self.levels.append((low, bits, ranks))
            at += 4 + n + len(bits) + 4 * words

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        value = 0
        for shift, (low, bits, ranks) in enumerate(self.levels):
            value |= int(low[i]) << (8 * shift)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_BITS
            inside = np.unpackbits(bits[block * RANK_BITS // 8:(i >> 3) + 1], bitorder="little")
            i = int(ranks[block]) + int(inside[:i - block * RANK_BITS].sum())
        return value

    def all(self) -> np.ndarray:
        out = np.zeros(len(self), np.uint32)
        at = np.arange(len(self))
        for shift, (low, bits, _) in enumerate(self.levels):
            out[at] |= low.astype(np.uint32) << np.uint32(8 * shift)
            at = at[np.unpackbits(bits, count=len(low), bitorder="little").astype(bool)]
        return out


#: Words of these letters alone are one pre-token and stay as they are under
#: normalisation, but for case; the merges can be applied to them directly.
PLAIN_LETTERS = "[a-zß-öø-ÿÀ-ÖØ-Þ]+"


def byte_letters() -> dict[int, str]:
    """The sign by which byte-level vocabularies write each byte: itself
    where it prints in Latin-1, else the next unused code point from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(hidden)}}


def _pieces(data: np.ndarray, offsets: np.ndarray):
    """(data, start, end, pieces before each text): words, cut where ASCII
    punctuation follows a letter, as no pre-token spans that. Case and cuts
    stay as they are where a special token may stand in the text."""
    starts, ends, before = word_spans(data, offsets)
    if b"<|" in data.tobytes():
        return data, starts, ends, before
    data = lower_ascii(data)
    punctuation, letter = np.zeros(256, bool), np.zeros(256, bool)
    punctuation[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
    letter[97:123] = True
    after = np.zeros(len(data), bool)
    after[1:] = letter[data[:-1]]
    # Latin-1 letters: lead byte C3, all but the signs for times and divided by.
    after[2:] |= (data[:-2] == 0xC3) & (data[1:-1] >= 0x80) & (data[1:-1] != 0x97) & (data[1:-1] != 0xB7)
    cuts = np.flatnonzero(punctuation[data] & after)
    cuts = cuts[~np.isin(cuts, starts)]
    starts, ends = np.sort(np.append(starts, cuts)), np.sort(np.append(ends, cuts))
    return data, starts, ends, np.searchsorted(starts, offsets, "left")


def _tokenise(tokenizer_file: str, end_id: int):
    """Batches of (doc_id, text) to (doc_ids, ids, offsets) arrays."""

    def run(batches):
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_file)
        tokenize, plain = tokenizer.model.tokenize, re.compile(PLAIN_LETTERS).fullmatch
        letters = byte_letters()
        shown = "".join(letters[b] for b in range(256))

        def learn(words: list[bytes]):
            out, rest = [], []
            for word in words:
                text = word.decode()
                if word.isalpha() and word.islower():  # ASCII letters
                    out.append([t.id for t in tokenize(text)])
                elif plain(text):
                    text = text.lower()
                    if not text.isascii():
                        text = text.encode().decode("latin-1").translate(shown)
                    out.append([t.id for t in tokenize(text)])
                else:
                    rest.append((len(out), text))
                    out.append(())
            for a in range(0, len(rest), 10_000):
                part = rest[a:a + 10_000]
                coded = tokenizer.encode_batch_fast([t for _, t in part], add_special_tokens=False)
                for (k, _), e in zip(part, coded):
                    out[k] = e.ids
            return out

        lexicon = Lexicon(learn)
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            data, starts, ends, before = _pieces(data, offsets)
            ids, lengths = lexicon.ids(*distinct_slices(data, starts, ends))
            sums = np.append(0, np.cumsum(lengths))
            # The end id goes behind every document.
            cuts = sums[before]
            ids = np.insert(ids, cuts[1:], end_id).astype(np.uint32)
            yield batch.column("doc_id").to_pylist(), ids, cuts + np.arange(len(cuts))

    return run


_BLOCK = "part int, seq int, doc_ids array<long>, offsets array<long>, codes binary"


def _writer(tokenise):
    def run(batches):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        held, size = [], 0

        def block():
            doc_ids = [i for d, _, _ in held for i in d]
            ids = np.concatenate([i for _, i, _ in held])
            counts = np.concatenate([np.diff(o) for _, _, o in held])
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()),
                 pa.array([doc_ids], pa.list_(pa.int64())),
                 pa.array([np.append(0, np.cumsum(counts))], pa.list_(pa.int64())),
                 pa.array([pack(ids)], pa.binary())],
                ["part", "seq", "doc_ids", "offsets", "codes"])

        for docs in tokenise(batches):
            held.append(docs)
            size += len(docs[1])
            if size >= BLOCK_IDS:
                yield block()
                held, size, seq = [], 0, seq + 1
        if held:
            yield block()

    return run


def write(docs: DataFrame, path: str, tokenizer_file: str, end_id: int) -> None:
    """Encode (doc_id, text) and write blocks in ascending doc_id order."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                          F.col("text").cast("string").alias("text")) \
        .repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_writer(_tokenise(tokenizer_file, end_id)), _BLOCK) \
        .write.option("compression", "none").parquet(path)


def _read_documents(batches):
    import zlib

    for batch in batches:
        for row in batch.to_pylist():
            ids = Codes(row["codes"]).all().astype("<u4")
            cuts = row["offsets"]
            spans = list(zip(cuts[:-1], cuts[1:]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["part"]] * len(spans), pa.int32()),
                 pa.array([row["seq"]] * len(spans), pa.int32()),
                 pa.array(row["doc_ids"], pa.int64()), pa.array(cuts[:-1], pa.int64()),
                 pa.array([b - a for a, b in spans], pa.int64()),
                 pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in spans], pa.int64())],
                ["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files."""
    blocks = spark.read.schema(_BLOCK).parquet(path)
    docs = blocks.mapInArrow(
        _read_documents, "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")
    # Ids before a block: those of earlier parts (one row per part) and of
    # earlier blocks of its part.
    sizes = blocks.select("part", "seq", F.element_at("offsets", -1).alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", "seq", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("inner")) \
        .join(parts, "part").select("part", "seq", (F.col("base") + F.col("inner")).alias("base"))
    return docs.join(bases, ["part", "seq"]).select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token(spark: SparkSession, path: str, position: int) -> int:
    """The id at one position over all documents: one block is opened, and
    within it only the bytes of that id's levels are looked at."""
    blocks = spark.read.schema(_BLOCK).parquet(path)
    sizes = sorted(blocks.select("part", "seq", F.element_at("offsets", -1).alias("n")).collect())
    for part, seq, n in sizes:
        if position < n:
            row = blocks.where((F.col("part") == part) & (F.col("seq") == seq)).select("codes").first()
            return Codes(row["codes"])[position]
        position -= n
    raise IndexError("position is behind the last token")


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents' ids, then read the files back."""
    import public_tokenizers

    path = shared_folder(spark, "tokens")
    write(table(spark, sf_dir, "documents"), path,
          public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read(spark, path)
