"""Byte-level BPE encoding and decoding over a global distinct-word shuffle.

Every text is cut into pre-tokens (words). A scan task turns its documents
into chunks: the distinct words of the chunk with the positions at which they
stand (one code per position). Only the distinct words are shuffled, by word,
so each word of the corpus is encoded in one place and once; the ids go back
to the chunks, where documents are reassembled by position. Decoding joins
ids with the token-byte table, whose size the vocabulary fixes.

A word that fills a third of the corpus is one entry per chunk, so no key is
hot. Chunks hold at most ``CHUNK_TOKENS`` positions beyond one document.

Defined results: a null or empty text gives no ids and decodes to an empty
text; rows that repeat a doc_id, or have none, each give their own row; other
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtrace.llm.arrays import binary_array, gather_slices, pieces, ranges, returning, text_buffers
from flowtrace.llm.tables import table

#: Positions in a chunk, and of a chunk in work at a time.
CHUNK_TOKENS, SLICE = 1_500_000, 1 << 18

#: White_Space code points (fixed values of the Unicode property).
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
               0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Suffixes that stay with a leading apostrophe (fixed values of the pattern).
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4


def vocabulary(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Classes:
    """Letter, number, space or other for every code point, looked up on
    first sight."""

    def __init__(self):
        self.known = np.zeros(0x110000, np.uint8)

    def of(self, points: np.ndarray) -> np.ndarray:
        import unicodedata

        found = self.known[points]
        if not found.all():
            for p in np.unique(points[found == 0]).tolist():
                kind = unicodedata.category(chr(p))[0]
                self.known[p] = SPACE if p in WHITE_SPACE else \
                    {"L": LETTER, "N": NUMBER}.get(kind, OTHER)
            found = self.known[points]
        return found


def pre_tokens(data: np.ndarray, offsets: np.ndarray, classes: Classes
               ) -> tuple[np.ndarray, np.ndarray]:
    """(byte position where every pre-token starts, pre-tokens before each
    text). Pre-tokens fill the texts without gaps.

    A run of letters, numbers or other signs takes one blank before it. Of
    white space before such a run, all but the last character is one
    pre-token; white space at the end of a text is one. An apostrophe that
    starts a pre-token takes a contraction suffix.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    texts = np.searchsorted(lead, offsets, "left")  # the texts' code point offsets
    n = len(points)
    kind = classes.of(points)
    head = np.zeros(n + 1, bool)
    head[texts] = True
    start = np.ones(n, bool)
    start[1:] = kind[1:] != kind[:-1]
    start |= head[:n]
    # The last space character before a run of another class, in one text.
    space = kind == SPACE
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~head[1:n])
    start[last] = True
    start[last[points[last] == 0x20] + 1] = False
    # Contractions.
    apostrophe = np.flatnonzero((points == 0x27) & start)
    apostrophe = apostrophe[(apostrophe + 1 < n)]
    apostrophe = apostrophe[(kind[apostrophe + 1] == LETTER) & ~head[apostrophe + 1]]
    if len(apostrophe):
        p1 = points[apostrophe + 1]
        two = np.minimum(apostrophe + 2, n - 1)
        p2 = np.where((apostrophe + 2 < n) & ~head[two], points[two], 0)
        size = np.zeros(len(apostrophe), np.int64)
        for suffix in CONTRACTIONS:
            hit = p1 == ord(suffix[0])
            if len(suffix) == 2:
                hit &= p2 == ord(suffix[1])
            size[hit & (size == 0)] = len(suffix)
        apostrophe, size = apostrophe[size > 0], size[size > 0]
        start[apostrophe + 1] = False
        after = apostrophe + 1 + size
        after = after[after < n]
        start[after[(kind[after] == LETTER) & ~head[after]]] = True
    at = np.flatnonzero(start)
    return lead[at], np.searchsorted(at, texts, "left")


def _packed(codes: np.ndarray) -> bytes:
    """Codes by byte planes, compressed."""
    planes = np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint32)
    planes = np.frombuffer(pa.decompress(packed, 4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel()


_POSITIONS = "chunk long, doc_ids array<long>, counts array<int>, n_words int, buckets binary, " \
             "codes binary"
_WORDS = "chunk long, bucket int, n int, sizes binary, words binary"
_IDS = "chunk long, bucket int, n int, sizes binary, n_ids int, ids binary"


def _rows(schema: list, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, (_, t) in zip(columns, schema)], [n for n, _ in schema])


def _chunker(buckets: int, want_words: bool, chunk_tokens: int):
    """Scan task: one row of positions per chunk, or its distinct words, one
    row per bucket. Words are numbered by frequency; each knows its bucket."""

    def run(batches):
        import xxhash
        from pyspark import TaskContext

        task, seq = TaskContext.get().partitionId(), 0
        classes, held, size = Classes(), [], 0

        def flush():
            coded = pa.chunked_array([c for _, _, c in held]).unify_dictionaries()
            index = np.concatenate([c.indices.to_numpy(zero_copy_only=False) for c in coded.chunks])
            words = coded.chunk(0).dictionary
            order = np.argsort(-np.bincount(index, minlength=len(words)), kind="stable")
            words = words.take(pa.array(order)).to_pylist()
            doc_ids = [i for ids, _, _ in held for i in ids]
            # The content names the chunk, so that words and positions that
            # were read by different attempts can't be mixed up.
            digest = xxhash.xxh3_64(repr((task, seq, doc_ids)).encode())
            digest.update(b"\0".join(words))
            chunk = digest.intdigest() - (1 << 63)
            of = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in words),
                             np.int64, len(words))
            if not want_words:
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                return _rows(
                    [("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                     ("counts", pa.list_(pa.int32())), ("n_words", pa.int32()),
                     ("buckets", pa.binary()), ("codes", pa.binary())],
                    [(chunk, doc_ids, np.concatenate([c for _, c, _ in held]), len(words),
                      _packed(of), _packed(rank[index]))])
            by = np.argsort(of, kind="stable")
            cuts = np.searchsorted(of[by], np.arange(buckets + 1)).tolist()
            rows = []
            for k in range(buckets):
                mine = [words[i] for i in by[cuts[k]:cuts[k + 1]].tolist()]
                rows.append((chunk, k, len(mine), _packed(np.fromiter(map(len, mine), np.int64, len(mine))),
                             pa.compress(b"".join(mine), codec="zstd", asbytes=True)))
            return _rows([("chunk", pa.int64()), ("bucket", pa.int32()), ("n", pa.int32()),
                          ("sizes", pa.binary()), ("words", pa.binary())], rows)

        for batch in (piece for batch in batches for piece in pieces(batch, "text")):
            data, offsets = text_buffers(batch.column("text"))
            starts, before = pre_tokens(data, offsets, classes)
            coded = binary_array(data, np.append(starts, len(data))).dictionary_encode() if len(starts) \
                else pa.DictionaryArray.from_arrays(pa.array([], pa.int32()),
                                                    pa.array([], pa.large_binary()))
            held.append((batch.column("doc_id").to_pylist(), np.diff(before).astype(np.int32), coded))
            size += len(starts)
            if size >= chunk_tokens:
                yield flush()
                held, size, seq = [], 0, seq + 1
        if held:
            yield flush()

    return run


def _encoder(rank_file: str, pattern: str):
    """Words of a bucket to ids: every distinct word of the corpus meets here
    and is encoded once."""

    def run(batches):
        import tiktoken

        encoding = tiktoken.Encoding("ranks", pat_str=pattern, special_tokens={},
                                     mergeable_ranks=vocabulary(rank_file))
        known: dict[bytes, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                sizes = _unpacked(row["sizes"], row["n"]).astype(np.int64)
                ends = np.cumsum(sizes)
                text = pa.decompress(row["words"], int(sizes.sum()), codec="zstd", asbytes=True)
                found = []
                for a, b in zip((ends - sizes).tolist(), ends.tolist()):
                    word = text[a:b]
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = np.array(encoding.encode_ordinary(word.decode()), np.uint32)
                    found.append(ids)
                ids = np.concatenate([*found, np.zeros(0, np.uint32)])
                yield _rows(
                    [("chunk", pa.int64()), ("bucket", pa.int32()), ("n", pa.int32()),
                     ("sizes", pa.binary()), ("n_ids", pa.int32()), ("ids", pa.binary())],
                    [(row["chunk"], row["bucket"], row["n"],
                      _packed(np.fromiter(map(len, found), np.int64, len(found))), len(ids), _packed(ids))])

    return run


def _reassemble(key, positions, words):
    """Documents of one chunk from its positions and its words' ids."""
    if positions.num_rows != 1:
        raise RuntimeError("the documents were read in another order meanwhile")
    chunk = positions.to_pylist()[0]
    replies = sorted(words.to_pylist(), key=lambda r: r["bucket"])
    order = np.argsort(_unpacked(chunk["buckets"], chunk["n_words"]), kind="stable")
    sizes = np.concatenate([np.zeros(0, np.int64),
                            *(_unpacked(r["sizes"], r["n"]).astype(np.int64) for r in replies)])
    ids = np.concatenate([np.zeros(0, np.uint32), *(_unpacked(r["ids"], r["n_ids"]) for r in replies)])
    first, length = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    length[order] = sizes
    first[order] = np.cumsum(sizes) - sizes
    counts = np.asarray(chunk["counts"], np.int64)
    ends = np.append(0, np.cumsum(counts))
    codes = _unpacked(chunk["codes"], int(ends[-1]))
    out, a = [], 0
    while a < len(counts):  # documents in slices of about SLICE positions
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + SLICE, "right")) - 1)
        part = codes[ends[a]:ends[b]]
        lengths = length[part]
        flat = ids[ranges(first[part], lengths)]
        offsets = np.append(0, np.cumsum(lengths))[ends[a:b + 1] - ends[a]]
        out.append(pa.Table.from_arrays(
            [pa.array(chunk["doc_ids"][a:b], pa.int64()),
             pa.ListArray.from_arrays(pa.array(offsets, pa.int32()),
                                      pa.array(flat.astype(np.int32)))], ["doc_id", "ids"]))
        a = b
    return pa.concat_tables(out)


def encode(docs: DataFrame, rank_file: str, pattern: str,
           chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """(doc_id, ids) of every row of ``docs`` (doc_id, text).

    ``docs`` must come from files or a checkpoint: it is read twice, and both
    reads must see the rows in the same order (a difference raises).
    """
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    words = docs.mapInArrow(returning(_chunker(buckets, True, chunk_tokens)), _WORDS) \
        .repartition(buckets, "bucket").mapInArrow(returning(_encoder(rank_file, pattern)), _IDS)
    positions = docs.mapInArrow(returning(_chunker(buckets, False, chunk_tokens)), _POSITIONS)
    return positions.groupBy("chunk").cogroup(words.groupBy("chunk")).applyInArrow(
        _reassemble, "doc_id long, ids array<int>")


def _decoder(rank_file: str):
    def run(batches):
        ranks = vocabulary(rank_file)
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        offsets = np.append(0, np.cumsum([len(t) for t in tokens]))
        data = np.frombuffer(b"".join(tokens), np.uint8)
        for batch in (piece for batch in batches for piece in pieces(batch, "ids")):
            column = batch.column("ids")
            ids = column.flatten().to_numpy()
            counts = column.value_lengths().fill_null(0).to_numpy()
            joined, lengths = gather_slices(data, offsets, ids)
            ends = np.append(0, np.cumsum(lengths))[np.append(0, np.cumsum(counts))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), column, binary_array(joined, ends).cast(pa.binary())],
                ["doc_id", "ids", "decoded"])

    return run


def decode(encoded: DataFrame, rank_file: str) -> DataFrame:
    """(doc_id, ids, decoded) of every row of (doc_id, ids): the bytes of the
    token-byte table, joined in order."""
    return encoded.select("doc_id", "ids").mapInArrow(
        returning(_decoder(rank_file)), "doc_id long, ids array<int>, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document with the 50k byte-level ranks."""
    return round_trip(table(spark, sf_dir, "documents"))


def round_trip(docs: DataFrame, vocabulary_name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    import public_tokenizers

    rank_file = public_tokenizers.path(vocabulary_name)
    return digests(decode(encode(docs, rank_file, public_tokenizers.PATTERN), rank_file))
