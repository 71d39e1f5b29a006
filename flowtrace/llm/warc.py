"""WARC archives: written as text files, read by boundary chains.

Writing: one record per page. Of pages with equal payloads (SHA-1), the one
with the smallest id is a response, the others are revisits that refer to it.
Spark's text sink writes the records; their separator is its line separator.

Reading: the text source splits archives at the record magic, so any task
can start in the middle of a file. Every magic is a candidate, also one that
stands inside a payload. A candidate's header names its successor's offset;
pointer jumping from the start of the file (as many rounds as the logarithm
of the longest chain) keeps the candidates that the chain reaches. A payload
that holds the magic is put together from the pieces between its record and
the successor.

Defined results: a null html is an empty payload; pages without page_id take
no part, of rows that repeat one the smallest (html, url) stays; line ends in
a url are escaped; other columns are ignored; an empty table gives an empty
table. A record without a length, or a revisit whose response is missing,
keeps null in what is unknown.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowtrace.llm.tables import shared_folder, stored, table

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: The signs of base32 in order, and those that conv() writes for them.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGITS32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
PAGE_URN = "<urn:page:"
#: Revisits that are broadcast at most; beyond, pages and revisits shuffle.
BROADCAST_ROWS = 200_000


def base32_sha1(payload: Column) -> Column:
    """SHA-1 as upper-case base32: four times 40 bits, each eight signs."""
    hexed = F.sha1(payload)
    digits = F.concat(*(F.lpad(F.conv(F.substring(hexed, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)))
    return F.translate(digits, DIGITS32, BASE32)


def one_row_per_page(pages: DataFrame) -> DataFrame:
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    odd = pages.groupBy("page_id").count().where("count > 1 or page_id is null").limit(1)
    if not odd.count():
        return pages
    return pages.where("page_id is not null").groupBy("page_id").agg(
        F.min(F.struct("html", "url")).alias("x")).select("page_id", "x.url", "x.html")


def records(pages: DataFrame, date: str, min_bytes: int = 0) -> DataFrame:
    """(record): text of every page's record, without its end."""
    digests = pages.select("page_id", base32_sha1(F.col("html").cast("binary")).alias("digest"),
                           F.octet_length("html").alias("n"))
    keys = digests.where(F.col("n") >= min_bytes)
    first = keys.groupBy("digest").agg(F.min("page_id").alias("refers_to"))
    revisits = stored(keys.join(first, "digest").where("page_id <> refers_to")
                      .select("page_id", "refers_to"), "revisits")
    # Two numbers a revisit: while they are few, the pages stay where they are.
    small = revisits.count() <= BROADCAST_ROWS
    rows = pages.join(F.broadcast(revisits) if small else revisits, "page_id", "left")
    revisit = F.col("refers_to").isNotNull()
    block = F.concat(F.lit(HTTP), F.when(revisit, F.lit("")).otherwise(F.col("html")))
    url = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    header = F.concat_ws(
        "\r\n", F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit(f"WARC-Record-ID: {PAGE_URN}"), F.col("page_id"), F.lit(">")),
        F.when(revisit, F.concat(F.lit(f"WARC-Refers-To: {PAGE_URN}"), F.col("refers_to"), F.lit(">"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")),
        F.concat(F.lit("WARC-Target-URI: "), url), F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32_sha1(F.col("html").cast("binary"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block)))
    return rows.select(F.concat(F.lit(MAGIC), header, F.lit(END), block).alias("record"))


def write(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z") -> None:
    records(one_row_per_page(pages), date).write.option("lineSep", END).text(path)


def _candidates(batches):
    """Rows between magics, in file order, to candidates with offsets in
    their split. A record that ends before the next magic is digested here."""
    import base64
    import hashlib

    magic, end, urn = MAGIC.encode(), END.encode(), PAGE_URN.encode()
    place: dict[tuple, int] = {}

    def number(text):
        text = text.removeprefix(urn).removesuffix(b">")
        return int(text) if text.lstrip(b"-").isdigit() else None

    for batch in batches:
        out = []
        for path, split, value in zip(*(batch.column(n).to_pylist() for n in ("path", "split", "value"))):
            at = place.get((path, split), 0)
            place[path, split] = at + len(value) + len(magic)
            head, found, rest = value.partition(end)
            fields = {}
            for line in head.split(b"\r\n"):
                name, _, text = line.partition(b":")
                fields.setdefault(name.strip().lower(), text.strip())
            length = fields.get(b"content-length", b"")
            size = len(head) + 4 + int(length) if found and length.isdigit() else None
            whole = size is not None and len(value) == size + 4
            payload = rest[:int(length)].partition(end)[2] if whole else None
            out.append((
                path, split, at, len(value), size, whole, fields.get(b"warc-type", b"").decode("utf-8", "replace"),
                number(fields.get(b"warc-record-id", b"")), number(fields.get(b"warc-refers-to", b"")),
                fields.get(b"warc-target-uri", b"").decode("utf-8", "replace"),
                fields.get(b"warc-payload-digest", b"").decode("utf-8", "replace"),
                None if payload is None else len(payload),
                None if payload is None else base64.b32encode(hashlib.sha1(payload).digest()).decode()))
        columns = list(zip(*out)) if out else [[]] * len(_FIELDS)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS)],
                                         [n for n, _ in _FIELDS])


_FIELDS = [("path", pa.string()), ("split", pa.int64()), ("at", pa.int64()), ("n", pa.int64()),
           ("size", pa.int64()), ("whole", pa.bool_()), ("record_type", pa.string()),
           ("page_id", pa.int64()), ("refers_to", pa.int64()), ("url", pa.string()),
           ("named_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
_SCHEMA = "path string, split long, at long, n long, size long, whole boolean, record_type string, " \
          "page_id long, refers_to long, url string, named_digest string, payload_bytes long, " \
          "payload_digest string"


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"),
        F.col("value").cast("binary").alias("value"))


def _with_offsets(rows: DataFrame, n: str = "n") -> DataFrame:
    """Adds ``row``, each row's offset in its file: rows and magics fill the
    file without gaps, so the splits before one end where it starts."""
    splits = rows.groupBy("path", "split").agg(F.sum(F.col(n) + len(MAGIC)).alias("bytes"))
    earlier = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    bases = splits.select("path", "split", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("base"))
    return rows.join(bases, ["path", "split"]).withColumn("row", F.col("base") + F.col("at")).drop("base")


def reached(chain: DataFrame) -> DataFrame:
    """Of (path, start, next), the starts that the chain from start 0 of each
    path reaches, by pointer jumping."""
    state = stored(chain.select("path", "start", "next", (F.col("start") == 0).alias("hit")), "chain")
    while state.where("hit and next is not null").limit(1).count():
        marks = state.where("hit and next is not null").select("path", F.col("next").alias("start")) \
            .distinct().withColumn("marked", F.lit(True))
        far = state.select("path", F.col("start").alias("next"), F.col("next").alias("after"))
        # Pointers double; what a reached record points at is reached. A
        # pointer that leads to no candidate ends its chain.
        state = stored(state.join(far, ["path", "next"], "left").join(marks, ["path", "start"], "left").select(
            "path", "start", F.col("after").alias("next"),
            (F.col("hit") | F.coalesce("marked", F.lit(False))).alias("hit")), "chain")
    return state.where("hit").select("path", "start")


def _payload(key, pieces):
    """A payload that holds the magic, from its record's row and the next."""
    import base64
    import hashlib

    rows = sorted(pieces.to_pylist(), key=lambda r: r["row"])
    value = MAGIC.encode().join(r["value"] for r in rows)
    block = value.partition(END.encode())[2]
    head = len(value) - len(block)
    payload = block[:rows[0]["size"] - head].partition(END.encode())[2]
    return pa.table({"path": [key[0].as_py()], "start": [key[1].as_py()], "long_bytes": [len(payload)],
                     "long_digest": [base64.b32encode(hashlib.sha1(payload).digest()).decode()]})


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url)
    of every record of the archives under ``path``."""
    found = stored(_rows(spark, path).mapInArrow(_candidates, _SCHEMA), "candidates")
    # The row before the first magic of a file is no candidate.
    found = _with_offsets(found).where("row > 0").withColumn("start", F.col("row") - len(MAGIC)) \
        .withColumn("next", F.col("start") + len(MAGIC) + F.col("size") + len(END))
    found = stored(found, "offsets")
    real = stored(found.join(reached(found.select("path", "start", "next")), ["path", "start"], "left_semi"), "records")
    split = real.where("not whole and size is not null")
    if split.limit(1).count():
        spans = split.select("path", F.col("start").alias("first"), "next", "size")
        rows = _rows(spark, path).mapInArrow(_placed, "path string, split long, at long, n long, value binary")
        rows = _with_offsets(rows)
        pieces = rows.join(spans, "path").where("row - 10 >= first and row - 10 < next").select(
            "path", F.col("first").alias("start"), "row", "value", "size")
        payloads = pieces.groupBy("path", "start").applyInArrow(
            _payload, "path string, start long, long_bytes long, long_digest string")
        real = real.join(payloads, ["path", "start"], "left") \
            .withColumn("payload_bytes", F.coalesce("long_bytes", "payload_bytes")) \
            .withColumn("payload_digest", F.coalesce("long_digest", "payload_digest"))
    responses = real.where("record_type = 'response'").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"), "url")
    originals = responses.select(F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest")
    revisits = real.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to", "url") \
        .join(originals, "refers_to", "left")
    return responses.unionByName(revisits)


def _placed(batches):
    place: dict[tuple, int] = {}
    for batch in batches:
        at, n = [], []
        for path, split, value in zip(*(batch.column(c).to_pylist() for c in ("path", "split", "value"))):
            at.append(place.get((path, split), 0))
            n.append(len(value))
            place[path, split] = at[-1] + len(value) + len(MAGIC)
        yield pa.RecordBatch.from_arrays(
            [batch.column("path"), batch.column("split"), pa.array(at, pa.int64()), pa.array(n, pa.int64()),
             batch.column("value")], ["path", "split", "at", "n", "value"])


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive every page, then read the archives back."""
    path = shared_folder(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
