"""WARC archives with revisit resolution.

Headers (no payloads) are shuffled by payload digest; of the records of one digest that with the largest id stays the
response and the others become revisits that refer to it. The archive is then written with fresh headers: a response
carries its payload, a revisit only headers. Spark's own writer makes the files, so any file system works.

A third of all records may share one payload: the shuffle by digest aggregates before it moves, and only digests that
occur twice are joined back, from a written table, so that adaptive execution can split a hot digest.

Null payloads count as empty ones (and equal each other); a null url is written as ``urn:page:<id>``. An empty table
gives an empty archive. A null id is written as an empty one and its record is always a response; rows of equal ids and payloads are
all responses. Extra columns are ignored. Payloads are never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import materialize

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: every 5 hexadecimal digits are 4 base32 digits."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def headers(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest) of every page."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    url = F.coalesce(F.col("url").cast("string"), F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), payload.alias("payload")).select(
        "page_id", "url", "payload", F.length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest")
    )


def resolve(records: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``records`` with record_type and refers_to; payloads under ``least_bytes`` are always responses."""
    slim = materialize(records.select("page_id", "payload_bytes", "payload_digest"), "headers")
    copies = slim.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    copies = materialize(copies.select("payload_digest", "first_id"), "copies")
    revisit = (F.col("first_id") != F.col("page_id")) & (F.col("payload_bytes") >= least_bytes)
    return (
        records.join(copies, "payload_digest", "left")
        .withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
        .withColumn("refers_to", F.when(revisit, F.col("first_id")))
        .drop("first_id")
    )


def _record_id(page_id: Column) -> Column:
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit(""))).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def write_archive(resolved: DataFrame, path: str, records_per_file: int = 2000, date: str = DATE) -> None:
    """Uncompressed WARC/1.1 files below ``path``, a record per row. A record ends in CRLF CRLF; the writer's line end is its last byte."""
    response = F.col("record_type") == "response"
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\r\n"))
    url = F.regexp_replace("url", "[\\x00-\\x1F\\x7F]", "")
    http = F.lit(_HTTP.decode())
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", _record_id(F.col("page_id"))),
        line("WARC-Target-URI", url),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("X-Page-ID", F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(response, F.lit("")).otherwise(F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _record_id(F.col("refers_to"))), line("WARC-Refers-To-Date", F.lit(date)), line("X-Refers-To-Page", F.col("refers_to").cast("string")))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.lit(len(_HTTP)) + F.when(response, F.col("payload_bytes")).otherwise(0)).cast("string")),
        F.lit("\r\n"),
        http,
    )
    body = F.concat(F.encode(head, "UTF-8"), F.when(response, F.col("payload")).otherwise(F.lit(b"")), F.lit(b"\r\n\r"))
    resolved.select(body.cast("string").alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", records_per_file).text(path)


def parse(data: bytes | memoryview) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, content block) of every record of an archive."""
    view, at = memoryview(data), 0
    raw = bytes(data) if not isinstance(data, bytes) else data
    while at < len(view):
        end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        named = dict(x.split(": ", 1) for x in lines[1:])
        start = end + 4
        stop = start + int(named["Content-Length"])
        yield named, raw[start:stop]
        if raw[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} does not end")
        at = stop + 4


def _read_batches(with_payload: bool):
    import base64
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for h, block in parse(content.as_buffer().to_pybytes()):
                    payload = block[block.index(b"\r\n\r\n") + 4 :]
                    digest, size, to = h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["X-Payload-Length"]), h.get("X-Refers-To-Page")
                    if h["WARC-Type"] == "response":
                        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        if found != digest or len(payload) != size:
                            raise ValueError(f"payload of page {h['X-Page-ID']} is damaged")
                    rows.append((int(h["X-Page-ID"]) if h["X-Page-ID"] else None, h["WARC-Target-URI"], h["WARC-Type"], int(to) if to else None, size, digest, payload if with_payload and h["WARC-Type"] == "response" else None))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return run


def read_archive(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records of the archives below ``path``; the digest of every stored payload is checked. Revisits have no payload of their own."""
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("content")
    return files.mapInArrow(_read_batches(with_payload), schema)


def deduplicate_archive(spark: SparkSession, source: str, target: str, least_bytes: int = 0) -> DataFrame:
    """Rewrite an archive of responses as a deduplicated one with fresh headers; returns its headers as read back."""
    records = read_archive(spark, source)
    original = records.where("record_type = 'response'").select("page_id", "url", "payload", "payload_bytes", "payload_digest")
    revisits = records.where("record_type = 'revisit'").select("page_id", "url", F.lit(None).cast("binary").alias("payload"), "payload_bytes", "payload_digest")
    # an earlier revisit may become the response only if no payload is at hand elsewhere; it borrows the stored one
    stored = materialize(original.select("payload_digest", F.col("payload").alias("stored")).dropDuplicates(["payload_digest"]), "stored")
    every = original.union(revisits).join(stored, "payload_digest", "left").withColumn("payload", F.coalesce("payload", "stored")).drop("stored")
    write_archive(resolve(every, least_bytes), target)
    return read_archive(spark, target, with_payload=False).drop("payload")
