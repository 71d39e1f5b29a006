"""N-gram Jaccard join with signature trees.

Texts become sets of word shingles, equal sets one class. Two sets with
Jaccard similarity t share one of the first ``n - ceil(t n) + 1`` tokens of
each (any order that all sets use; here heavy tokens come last, by a counting
sketch of bounded size). Each shared token has a hub, the class that shares most
tokens with most others; classes that share tokens of one hub meet in the
hub's signature tree: leaves are sets with a token bitmap, inner nodes hold
the OR of their bitmaps, the range of set sizes, and the largest number of tokens
that one of the bitmaps hides. The dual traversal compares a tree with itself and
drops node pairs whose largest possible overlap is too small for their sizes.
What remains is verified on the texts.

Similarity links within a class, and between classes that are connected
already, need not be found again: a first round links every class to its
hubs, a second round traverses the trees that still hold several components
and skips node pairs that lie in one component. Large trees are cut into
blocks; pairs of blocks are traversed in separate tasks, except those that lie
in the hub's component altogether. So a group of near copies that holds a
third of all rows costs one link each, not one per pair, and no link between
unconnected texts is lost. A group is cut by size first: sets of sizes that
can't be similar never meet, and a block's bitmaps have about one width and
bounded bytes together, so that a very long text widens no short ones. (Shingles
are 64-bit hashes of their words, in the sets, their sizes and the decision.)

Defined results: a null or empty text, or one without words, has no shingles
and no links; a text of fewer than ``words`` words is one shingle; documents
without doc_id take no part, of rows that repeat one the smallest text stays;
other columns are ignored; an empty table gives an empty table.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtrace.llm.arrays import (gram_hashes, lower_ascii, mix, pieces, ranges, returning, text_buffers,
                                  word_hashes, word_spans)
from flowtrace.llm.components import components
from flowtrace.llm.repeats import prepared
from flowtrace.llm.tables import release, stored, table

#: Counters of the sketch at least and at most, bytes of text per counter,
#: slices they travel in.
SKETCH_MIN, SKETCH_MAX, SKETCH_BYTES, SLICES = 1 << 20, 1 << 23, 192, 64
#: Bits of a bitmap per token, sets in a leaf, children of an inner node, sets
#: in a block, bytes of a block's bitmaps.
BITS, LEAF, FANOUT, BLOCK, BLOCK_BYTES = 4, 16, 8, 1024, 32 << 20
#: Tokens that go to the sketch at once.
HELD = 1 << 17


def shingle_sets(column, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the distinct shingles of every text, ascending."""
    data, offsets = text_buffers(column)
    data = lower_ascii(data)
    starts, ends, before = word_spans(data, offsets)
    hashes = word_hashes(data, starts, ends)
    per = np.diff(before)
    rows = np.flatnonzero(per >= words)
    at = ranges(before[rows], per[rows] - words + 1)
    owner = np.repeat(rows, per[rows] - words + 1)
    grams = [gram_hashes(hashes, words)[at]] if len(at) else []
    owners = [owner]
    for n in range(1, words):
        few = np.flatnonzero(per == n)
        if len(few):
            grams.append(gram_hashes(hashes, n)[before[few]])
            owners.append(few)
    grams = np.concatenate([*grams, np.zeros(0, np.uint64)])
    owners = np.concatenate(owners)
    order = np.lexsort((grams, owners))
    grams, owners = grams[order], owners[order]
    fresh = np.ones(len(grams), bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (owners[1:] != owners[:-1])
    grams, owners = grams[fresh], owners[fresh]
    return grams, np.searchsorted(owners, np.arange(len(per) + 1))


def _counts(words: int, slots: int):
    """A task's share of the counting sketch, in slices."""

    def run(batches):
        total = np.zeros(slots, np.uint32)
        for batch in batches:
            for piece in pieces(batch, "text"):
                grams, _ = shingle_sets(piece.column("text"), words)
                for a in range(0, len(grams), HELD):
                    at, many = np.unique(grams[a:a + HELD] % np.uint64(slots), return_counts=True)
                    total[at.astype(np.int64)] += many.astype(np.uint32)
        packed = [pa.compress(part.astype("<u4").tobytes(), codec="zstd", asbytes=True)
                  for part in total.reshape(SLICES, -1)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(SLICES, dtype=np.int32)), pa.array(packed, pa.binary())], ["slice", "counts"])

    return run


def _levels(counts: np.ndarray, mean: float) -> np.ndarray:
    return np.clip(32 + 8 * (counts - mean) / np.sqrt(mean), 0, 255).astype(np.uint8)


def token_levels(docs: DataFrame, words: int) -> np.ndarray:
    """How heavy each slot of the sketch is, as one byte per slot: how many
    eighths of a (Poisson) deviation its count stands above the mean. So even
    a token that is only a few times as frequent as that deviation moves
    behind most others. The sketch grows with the texts up to SKETCH_MAX
    counters, which are collected; beyond, the order only gets coarser."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    slots = SKETCH_MIN
    while slots < min(size / SKETCH_BYTES, SKETCH_MAX):
        slots *= 2

    def summed(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots // SLICES, np.int64)
        for batch in batches:
            for packed in batch.column("counts").to_pylist():
                total += np.frombuffer(pa.decompress(packed, 4 * len(total), codec="zstd", asbytes=True), "<u4")
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0].as_py()], pa.int32()),
             pa.array([np.minimum(total, 2 ** 32 - 1).astype("<u4").tobytes()], pa.binary())], ["slice", "counts"])

    rows = docs.mapInArrow(returning(_counts(words, slots)), "slice int, counts binary").groupBy("slice") \
        .applyInArrow(summed, "slice int, counts binary").collect()
    parts = {r["slice"]: np.frombuffer(r["counts"], "<u4") for r in rows}
    counts = np.concatenate([parts.get(k, np.zeros(slots // SLICES, np.uint32)) for k in range(SLICES)])
    return _levels(counts, max(float(counts.mean()), 1.0))


def bitmaps(grams: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """A bitmap per set, of a power of two of bits, at least BITS per token
    and 64: bit ``hash mod width``, so a wider one folds into a narrower."""
    sizes = np.diff(offsets)
    width = 64 << np.ceil(np.log2(np.maximum(sizes * BITS / 64, 1))).astype(np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    first = np.cumsum(width) - width
    bits = np.zeros(int(width.sum()), bool)
    place = (mix(grams) >> np.uint64(20)) & (width[owner] - 1).astype(np.uint64)
    bits[first[owner] + place.astype(np.int64)] = True
    packed = np.packbits(bits, bitorder="little").tobytes()
    return [packed[a:b] for a, b in zip((first // 8).tolist(), ((first + width) // 8).tolist())]


def _rows_of(maps: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bitmaps as rows of 64-bit words, bits set in each as it is): narrow
    ones are repeated up to the widest, which keeps every bit that folds."""
    rows = np.empty((len(maps), max(map(len, maps)) // 8), np.uint64)
    count = np.empty(len(maps), np.int64)
    for k, bitmap in enumerate(maps):
        own = np.frombuffer(bitmap, "<u8")
        rows[k].reshape(-1, len(own))[:] = own
        count[k] = np.bitwise_count(own).sum()
    return rows, count


def _describe(words: int, percent: int, level: np.ndarray):
    """Size, digest, bitmap and prefix tokens of every text's set."""

    def run(batches):
        import xxhash

        for batch in (piece for batch in batches for piece in pieces(batch, "text")):
            grams, offsets = shingle_sets(batch.column("text"), words)
            sizes = np.diff(offsets)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            view = memoryview(np.ascontiguousarray(grams)).cast("B")
            digest = [xxhash.xxh3_128_digest(view[8 * a:8 * b]) for a, b in
                      zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            heavy = level[(grams % np.uint64(len(level))).astype(np.int64)].astype(np.uint64)
            token = (heavy << np.uint64(56)) | (mix(grams) >> np.uint64(8))
            token = token[np.lexsort((token, owner))]
            prefix = np.where(sizes > 0, sizes - -(-percent * sizes // 100) + 1, 0)
            chosen = token[ranges(offsets[:-1], prefix)].view(np.int64)
            cuts = np.append(0, np.cumsum(prefix)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes.astype(np.int64)), pa.array(digest, pa.binary()),
                 pa.array(bitmaps(grams, offsets), pa.binary()),
                 pa.ListArray.from_arrays(pa.array(cuts), pa.array(chosen))],
                ["doc_id", "n", "digest", "bitmap", "tokens"])

    return run


def _shared(batches):
    """Of rows sorted by token, those whose token occurs more than once. The
    last row waits for its successor."""
    last, paired = None, False
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if not rows.num_rows:
            continue
        rows = rows if last is None else pa.concat_tables([last, rows])
        token = rows.column("token").to_numpy()
        same = token[1:] == token[:-1]
        before, after = np.append(paired, same), np.append(same, False)
        tail = rows.num_rows - 1
        yield from rows.slice(0, tail).filter(pa.array((before | after)[:tail])).combine_chunks().to_batches()
        last, paired = rows.slice(tail), bool(before[tail])
    if paired:
        yield from last.combine_chunks().to_batches()


class Tree:
    """A signature tree over sets, level by level from the leaves up."""

    def __init__(self, rows: np.ndarray, hidden: np.ndarray, sizes: np.ndarray, label: np.ndarray):
        self.levels = [(rows, sizes, sizes, hidden, label, label)]
        width = LEAF
        while len(self.levels[-1][0]) > 1:
            bits, low, high, hid, first, last = self.levels[-1]
            cut = np.arange(0, len(bits), width)
            self.levels.append((
                np.bitwise_or.reduceat(bits, cut), np.minimum.reduceat(low, cut),
                np.maximum.reduceat(high, cut), np.maximum.reduceat(hid, cut),
                np.minimum.reduceat(first, cut), np.maximum.reduceat(last, cut)))
            width = FANOUT


def _may_link(a, b, i, j, percent) -> np.ndarray:
    """Can sets below nodes i of a and j of b reach the similarity?"""
    bits_a, low_a, high_a, hid_a, first_a, last_a = a
    bits_b, low_b, high_b, hid_b, first_b, last_b = b
    ok = (100 * high_a[i] >= percent * low_b[j]) & (100 * high_b[j] >= percent * low_a[i])
    ok &= ~((first_a[i] == last_a[i]) & (first_b[j] == last_b[j]) & (first_a[i] == first_b[j]))
    at, step = np.flatnonzero(ok), max(1, (1 << 21) // bits_a.shape[1])
    for s in range(0, len(at), step):
        x, y = i[at[s:s + step]], j[at[s:s + step]]
        most = np.bitwise_count(bits_a[x] & bits_b[y]).sum(axis=1) + np.minimum(hid_a[x], hid_b[y])
        most = np.minimum(most, np.minimum(high_a[x], high_b[y]))
        # 100 * overlap >= percent * union, with the smallest union.
        ok[at[s:s + step]] = (100 + percent) * most >= percent * (low_a[x] + low_b[y])
    return ok


def traverse(a: Tree, b: Tree, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of sets of a and b that may be linked. For a tree with
    itself, every pair once and none of a set with itself."""
    own, depth = a is b, max(len(a.levels), len(b.levels)) - 1
    at = lambda tree, d: tree.levels[min(d, len(tree.levels) - 1)]
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for d in range(depth, -1, -1):
        keep = _may_link(at(a, d), at(b, d), i, j, percent)
        i, j = i[keep], j[keep]
        if d == 0:
            break
        width = LEAF if d == 1 else FANOUT

        def children(tree, node):
            if d > len(tree.levels) - 1:  # the lower tree stays at its root
                return node, np.ones(len(node), np.int64)
            n = len(tree.levels[d - 1][0])
            return node * width, np.minimum(n, node * width + width) - node * width

        first_i, many_i = children(a, i)
        first_j, many_j = children(b, j)
        down = ranges(first_i, many_i)
        first_j, many_j = np.repeat(first_j, many_i), np.repeat(many_j, many_i)
        i, j = np.repeat(down, many_j), ranges(first_j, many_j)
        if own:
            i, j = i[i <= j], j[i <= j]
    if own:
        i, j = i[i < j], j[i < j]
    return i, j


def _traversed(percent: int):
    """Candidate pairs of one block with itself, or of two blocks."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        ids, sizes = rows.column("cid").to_numpy(), rows.column("n").to_numpy()
        side, label = rows.column("side").to_numpy(), rows.column("label").to_numpy()
        bits, count = _rows_of(rows.column("bitmap").to_pylist())
        trees, members = [], []
        for k in (0, 1):
            mine = np.flatnonzero(side == k)
            mine = mine[np.lexsort((ids[mine], label[mine], sizes[mine]))]
            if len(mine):
                trees.append(Tree(bits[mine], sizes[mine] - count[mine], sizes[mine], label[mine]))
                members.append(ids[mine])
        i, j = traverse(trees[0], trees[-1], percent)
        x, y = members[0][i], members[-1][j]
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    return run


def _meetings():
    """The block pairs that a row takes part in. Blocks of the hub's
    component meet the other blocks only; these meet each other as well, and
    a block itself, once each."""
    def of(blocks):
        return F.pmod(F.xxhash64("cid", "hub"), F.greatest(blocks, F.lit(1))).cast("int")

    def upto(n):
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def meeting(main, low, high, side):
        return F.struct(F.lit(main).alias("main"), low.alias("low"), high.alias("high"),
                        side.cast("int").alias("side"))

    main, other = of(F.col("mains")), of(F.col("others"))
    return F.when(F.col("is_main"), F.transform(upto(F.col("others")), lambda o: meeting(
        True, main, o, F.lit(0)))).otherwise(F.concat(
            F.transform(upto(F.col("mains")), lambda m: meeting(True, m, other, F.lit(1))),
            F.transform(upto(F.col("others")), lambda o: meeting(
                False, F.least(other, o), F.greatest(other, o), other > o))))


def _size_class(percent: int):
    """Classes of sizes, of which similar sets have the same or neighbouring
    ones: powers of two, or of more where the similarity is below a half."""
    step = max(1, math.ceil(math.log2(100 / percent)))
    return F.floor(F.length(F.bin("n")) / step).cast("int")


def _cells(present, own):
    """The cells that a set of class ``own`` takes part in. Cell c holds the
    classes c and c + 1 of a group; cells that another holds whole are left
    out, so that a group of one size, or of two neighbouring ones, is one cell."""
    def has(c):
        return F.array_contains(present, c)

    return F.filter(F.array(own - 1, own), lambda c: has(c) & (has(c + 1) | ~has(c - 1)))


def _plausible(percent: int):
    """Of pairs with both bitmaps, those whose largest possible overlap is
    enough."""

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            good = []
            for r in rows:
                (x, y), (p, q) = _rows_of([r["bitmap_a"], r["bitmap_b"]])
                most = int(np.bitwise_count(x & y).sum()) + min(r["n_a"] - p, r["n_b"] - q)
                most = min(most, r["n_a"], r["n_b"])
                good.append((100 + percent) * most >= percent * (r["n_a"] + r["n_b"]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _verified(words: int, percent: int):
    """Of pairs with both texts, those that are similar."""

    def run(batches):
        for batch in (piece for batch in batches for piece in pieces(batch, "text_a", "text_b")):
            x, at_x = shingle_sets(batch.column("text_a"), words)
            y, at_y = shingle_sets(batch.column("text_b"), words)
            good = []
            for k in range(batch.num_rows):
                s, t = x[at_x[k]:at_x[k + 1]], y[at_y[k]:at_y[k + 1]]
                common = len(s) + len(t) - len(np.union1d(s, t))
                good.append(100 * common >= percent * (len(s) + len(t) - common) and common > 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def without(rows: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """``rows`` whose ``key`` is not ``listed`` (stored, so that its size is
    known and a short list is broadcast). Naming the rows that go, which are
    mostly few, keeps the ones that stay out of a shuffle."""
    return rows.join(listed.select(key), key, "left_anti")


def similar(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document: documents link
    when 100 * intersection >= percent * union of their shingle sets."""
    docs = prepared(docs)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sets = stored(docs.mapInArrow(
        returning(_describe(words, percent, token_levels(docs, words))),
        "doc_id long, n long, digest binary, bitmap binary, tokens array<long>"), "sets")
    classes = sets.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("cid"))
    members = stored(sets.select("doc_id", "n", "digest").join(classes, "digest", "left")
                     .select("doc_id", "n", F.coalesce("cid", "doc_id").alias("cid")), "members")

    # Tokens that several classes have; one token of those with equal lists.
    copies = stored(members.where("doc_id <> cid").select("doc_id"), "copies")
    postings = without(sets, copies, "doc_id").select(F.col("doc_id").alias("cid"), F.explode("tokens").alias("token"))
    shared = stored(postings.repartition(parts, "token").sortWithinPartitions("token")
                    .mapInArrow(returning(_shared), "cid long, token long"), "postings")
    lists = stored(shared.groupBy("token").agg(
        F.count("*").alias("many"), F.sum(F.xxhash64("cid").cast("decimal(38,0)")).alias("list")), "lists")
    tokens = lists.groupBy("many", "list").agg(F.min("token").alias("token")).select("token", "many")
    # The class that shares most tokens with most others is the best hub: in
    # a group of edited copies that is the text they were made from.
    degree = shared.join(lists.select("token", "many"), "token").groupBy("cid").agg(
        F.sum("many").alias("degree"))
    sizes = sets.select(F.col("doc_id").alias("cid"), "n")
    found, shared = shared, stored(
        shared.join(tokens, "token").join(degree, "cid").join(sizes, "cid"), "shared")
    release(copies, found, lists)
    hub_of = shared.groupBy("token").agg(F.max(F.struct("degree", (-F.col("cid")).alias("c"))).alias("h")) \
        .select("token", (-F.col("h.c")).alias("hub"))
    # Tokens with one hub are one group: who shares a token shares its hub.
    groups = stored(shared.join(hub_of, "token").select("hub", "cid", "n").distinct(), "groups")
    release(shared)

    def verified(pairs: DataFrame, checked: bool) -> DataFrame:
        """Similar pairs: by the bitmaps what may be, by the texts what is."""
        if not checked:
            for side in ("a", "b"):
                pairs = pairs.join(sets.select(
                    F.col("doc_id").alias(side), F.col("n").alias(f"n_{side}"),
                    F.col("bitmap").alias(f"bitmap_{side}")), side)
            pairs = pairs.mapInArrow(_plausible(percent), "a long, b long")
        pairs = stored(pairs, "pairs")
        ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        texts = stored(docs.join(ids, "doc_id", "left_semi"), "texts")
        left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
        right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
        links = stored(pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
                       .mapInArrow(returning(_verified(words, percent)), "a long, b long"), "edges")
        release(pairs, texts)
        return links

    # First round: every class against its hubs.
    edges = verified(groups.where("hub <> cid").select(
        F.least("hub", "cid").alias("a"), F.greatest("hub", "cid").alias("b")).distinct(), checked=False)
    joined = components(edges)

    # Second round: trees of groups whose classes are not all connected yet.
    rows = stored(groups.join(joined, groups.cid == joined.node, "left").select(
        "hub", "cid", "n", F.coalesce("component", "cid").alias("label")), "labelled")
    release(groups)
    mixed = rows.groupBy("hub").agg(
        F.min("label").alias("x"), F.max("label").alias("y"),
        F.max(F.when(F.col("cid") == F.col("hub"), F.col("label"))).alias("main"),
        F.collect_set(_size_class(percent)).alias("present")) \
        .where("x <> y").select("hub", "main", "present")
    labelled, rows = rows, stored(rows.join(mixed, "hub").select(
        "hub", "cid", "n", "label", (F.col("label") == F.col("main")).alias("is_main"),
        F.explode(_cells(F.col("present"), _size_class(percent))).alias("cell")), "mixed")
    release(labelled)
    several = rows
    # A bitmap has at most as many bytes as its set has shingles, or eight.
    share = F.greatest(F.lit(1 / BLOCK), F.max("n") / BLOCK_BYTES)
    counts = rows.groupBy("hub", "cell").agg(
        F.min("label").alias("x"), F.max("label").alias("y"),
        F.ceil(F.count_if("is_main") * share).cast("int").alias("mains"),
        F.ceil(F.count_if(~F.col("is_main")) * share).cast("int").alias("others")) \
        .where("x <> y").drop("x", "y")
    rows = rows.join(counts, ["hub", "cell"]).join(sets.select(F.col("doc_id").alias("cid"), "bitmap"), "cid")
    pairs = rows.select("hub", "cell", "cid", "n", "label", "bitmap", F.explode(_meetings()).alias("at")) \
        .select("hub", "cell", "cid", "n", "label", "bitmap", "at.*") \
        .groupBy("hub", "cell", "main", "low", "high").applyInArrow(_traversed(percent), "a long, b long").distinct()
    edges = edges.unionByName(verified(pairs, checked=True))
    joined = components(edges)
    result = stored(members.join(joined, members.cid == joined.node, "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "cid").alias("component_id")), "linked")
    release(sets, members, several)
    return result


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingles overlap by 80 %."""
    return similar(table(spark, sf_dir, "documents"))
