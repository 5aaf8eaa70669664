"""WARC archives: writing pages as records and reading records back.

Writing uses Spark's text writer with CRLF CRLF as its line separator: each
value is a record's header and block, so every part file is a WARC/1.0 file,
compressed whole with gzip and rolled at about `FILE_BYTES` by the pages' mean
size, so that a task can hold it.  Offsets are those of the uncompressed archive.

Reading verifies record boundaries by their chain.  Tasks scan files for every
`WARC/1.0` at a file's start or after CRLF CRLF and emit the offset with the
offset that its Content-Length leads to.  Payloads may hold whole records, so
these are only candidates: pointer jumping from offset 0 of each file (the
reached set and the jumps double each round) keeps the reachable ones.

Nulls and odd rows: a null html is an empty payload; a null url is written
empty; CR and LF in urls are percent-encoded; a null page_id is written as
`null` and read back as null.  Pages of one id are records of
their own, and a revisit refers to the response of its id that has its payload.  Empty tables give empty archives, which have no records.  A page is
one record of any length, and one value of a task.
"""

from __future__ import annotations

import gzip
import hashlib
from base64 import b32encode
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import remove, shared_dir, table, written
from .textkit import tidy

CRLF = "\r\n"
GAP = CRLF * 2
MAGIC = "WARC/1.0" + CRLF
FILE_BYTES = 64 << 20
HEADER_BYTES = 512
GZIP = b"\x1f\x8b"
FOUND = "file string, offset long, successor long, type string, record_id string, refers_to string, digest string, stated_digest string, payload_bytes long, payload binary"


def sha1_base32(text: Column) -> Column:
    """Upper-case base32 of a string's SHA-1: 20 bits are five hex and four base32 digits."""
    hexed = F.sha1(text.cast("binary"))
    five = [F.lpad(F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*five), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html with digest and refers_to (null: a response)."""
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", sha1_base32(F.col("html")))
    # One row a payload after map-side maxima; the hot side of the join is the large one, which skew joins split.
    last = pages.where(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("kept_id")).withColumnRenamed("digest", "__digest")
    joined = pages.join(last, F.col("digest") == F.col("__digest"), "left").drop("__digest")
    return joined.withColumn("refers_to", F.when(F.col("page_id") < F.col("kept_id"), F.col("kept_id"))).drop("kept_id")


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write (page_id, url, html) as WARC files below path; equal payloads are written once."""
    rows = with_revisits(pages, min_bytes)
    again = F.col("refers_to").isNotNull()
    block = F.when(again, "").otherwise(F.col("html"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    uri = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    value = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(again, "revisit").otherwise("response"),
        F.lit(CRLF + "WARC-Record-ID: "), name(F.col("page_id")),
        F.lit(CRLF + "WARC-Date: 2024-01-01T00:00:00Z" + CRLF + "WARC-Target-URI: "), uri,
        F.when(again, F.concat(F.lit(CRLF + "WARC-Refers-To: "), name(F.col("refers_to")), F.lit(CRLF + "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))).otherwise(""),
        F.lit(CRLF + "WARC-Payload-Digest: sha1:"), F.col("digest"),
        F.lit(CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: "), F.octet_length(block).cast("string"), F.lit(GAP), block,
    )
    mean = pages.agg(F.avg(F.coalesce(F.octet_length("html"), F.lit(0)))).first()[0] or 0
    most = max(1, int(FILE_BYTES / (mean + HEADER_BYTES)))
    rows.select(value.alias("value")).write.option("lineSep", GAP).option("maxRecordsPerFile", most).option("compression", "gzip").text(path)


def _candidates(with_payload: bool):
    magic, gap = MAGIC.encode(), GAP.encode()

    def scan(name: str, data: bytes) -> Iterator[tuple]:
        at = data.find(magic)
        while at >= 0:
            body = data.find(gap, at)
            if (at == 0 or data[at - 4 : at] == gap) and body >= 0:
                fields = {}
                for line in data[at + len(magic) : body].decode("utf-8", "replace").split(CRLF):
                    key, _, value = line.partition(":")
                    fields[key.strip().lower()] = value.strip()
                if (size := fields.get("content-length", "")).isdigit():
                    start = body + len(gap)
                    end = start + int(size)
                    if data[end : end + 4] == gap:
                        payload = data[start:end]
                        digest = b32encode(hashlib.sha1(payload).digest()).decode()
                        yield name, at, end + 4, fields.get("warc-type"), fields.get("warc-record-id"), fields.get("warc-refers-to"), digest, fields.get("warc-payload-digest", "").rpartition(":")[2], len(payload), payload if with_payload else None
            at = data.find(magic, at + 1)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.binary()]
        names = [f.split()[0] for f in FOUND.split(", ")]
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                data = data.as_py()
                rows = list(scan(name.as_py(), gzip.decompress(data) if data[:2] == GZIP else data))
                for k in range(0, len(rows), 5000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 5000], strict=True), kinds, strict=True)], names=names)

    return run


def reachable(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(file, offset) on the chain of (file, offset, successor) that starts at each file's offset 0."""
    # The joins are merged: what they hold grows with the records, so nothing of it is sent to all.
    most = links.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    jump = links.select("file", "offset", F.col("successor").alias("to"))
    reached = jump.where("offset = 0").select("file", "offset")
    for k in range(max(0, most - 1).bit_length()):
        there = jump.select(F.col("file").alias("f"), F.col("offset").alias("o"), F.col("to").alias("further"))
        walk = jump.select("file", "offset", "to", F.lit(False).alias("got")).unionByName(reached.select("file", "offset", F.col("offset").alias("to"), F.lit(True).alias("got")))
        step = walk.join(there.hint("merge"), (F.col("file") == F.col("f")) & (F.col("to") == F.col("o")))
        step = written(step.select("file", "offset", "further", "got"), spark) if k % 2 else step.select("file", "offset", "further", "got")
        reached = reached.unionByName(step.where("got").select("file", F.col("further").alias("offset"))).distinct()
        jump = step.where("not got").select("file", "offset", F.col("further").alias("to"))
        if k % 2:
            reached = written(reached, spark)
    return reached


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records below path: file, offset, type, record_id, refers_to, digest, stated_digest, payload_bytes, payload.

    A file is read by one task, so archives should be rolled at a size that a task can hold.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    found = files.mapInArrow(_candidates(payload), FOUND)
    links = written(found.select("file", "offset", "successor") if payload else found.drop("payload"), spark)
    chain = reachable(spark, links.select("file", "offset", "successor"))
    return (found if payload else links.withColumn("payload", F.lit(None).cast("binary"))).join(chain, ["file", "offset"], "left_semi").drop("successor")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    write_warc(table(spark, sf_dir, "pages"), path)
    records = digest(spark, read_warc(spark, path, payload=False))
    remove(spark, path)  # without payloads, the records read are in a table of their own
    return records


def digest(spark: SparkSession, records: DataFrame) -> DataFrame:
    """Per record: page_id, and the full payload's size and digest, of revisits from the response they name."""
    number = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).try_cast("long")
    rows = records.select(number("record_id").alias("page_id"), "type", number("refers_to").alias("refers_to"), "digest", "stated_digest", "payload_bytes")
    # A response is named by its id and its payload's digest, which its revisits state: pages of one id may differ.
    responses = rows.where("type = 'response' and page_id is not null").groupBy("page_id", "digest").agg(F.first("payload_bytes").alias("n"))
    responses = responses.select(F.col("page_id").alias("id"), F.col("digest").alias("d"), "n")
    # Written first, so that the join deals both sides itself and AQE can split a response with very many revisits.
    joined = rows.join(written(responses, spark), (F.col("refers_to") == F.col("id")) & (F.col("stated_digest") == F.col("d")), "left")
    return joined.select("page_id", F.coalesce("n", "payload_bytes").alias("payload_bytes"), F.coalesce("d", "digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")
