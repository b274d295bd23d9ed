"""WARC archives with revisit resolution.

Headers (page id, payload digest, payload length) are shuffled by digest and pre-aggregated; of equal payloads the
record with the largest page id stays a response, the others become revisit records that carry headers only. The
archives are written by Spark's own text writer (a WARC record ends in CRLF CRLF, which is the line separator used), so
any file system that Spark can write to will do. An archive is one partition, and there are as many partitions as keep it at about
FILE_BYTES; RECORDS_PER_FILE bounds it too. Archives are decompressed and parsed as streams, a record at a time.

Defined cases: a null html is an empty payload; a null url becomes urn:page:<id>; spaces and control characters in a url are
percent-encoded, each as itself; a null page_id is always a response; repeated rows share their outcome and have record ids of their
own (revisits refer to the first); a payload must fit in one row, however long; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, staged, tune

MIN_BYTES = 1000
RECORDS_PER_FILE = 2000
FILE_BYTES = 32 << 20
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_BACK = "record_id string, record_type string, page_id long, payload_bytes long, payload_digest string, refers_to_id string"


def base32_of_hex(sha1: Column) -> Column:
    """RFC 4648 base32 of a 40-digit hex string, five bytes (eight letters) at a time."""
    groups = [F.lpad(F.conv(F.substring(sha1, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(page_id: Column, digest: Column, copy: Column | None = None) -> Column:
    """Of the copy-th row with this page and payload; of the first where there is no number."""
    which = [] if copy is None else [F.when(copy > 1, copy.cast("string"))]
    h = F.md5(F.concat_ws(":", F.coalesce(page_id.cast("string"), F.lit("null")), digest, *which))
    return F.concat(F.lit("urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


def encoded(url: Column) -> Column:
    """The url with spaces and control characters as percent signs and two hexadecimal digits."""
    unsafe = "[\\x00-\\x20\\x7F]"
    one = lambda c: F.when(c.rlike(unsafe), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c)
    return F.when(url.rlike(unsafe), F.array_join(F.transform(F.split(url, ""), one), "")).otherwise(url)


def _headers(pages: DataFrame) -> DataFrame:
    html = F.coalesce(F.col("html"), F.lit(""))
    return pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).cast("long").alias("n_bytes"))


def resolve_revisits(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(page_id, digest, refers_to) of every record that is to be a revisit."""
    heads = staged(_headers(pages).filter((F.col("n_bytes") >= min_bytes) & F.col("page_id").isNotNull()).select("page_id", "digest"), "warc-heads")
    originals = heads.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("low")).filter("low < refers_to").drop("low")
    originals = staged(originals, "warc-originals")  # the join below then has an exchange on either side, and AQE can split a hot digest
    return heads.join(originals, "digest").filter("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, warc_date: str = "2024-01-01T00:00:00Z", records_per_file: int = RECORDS_PER_FILE, file_bytes: int = FILE_BYTES) -> str:
    """Write one WARC record per row below path; the payload is shuffled once, by page."""
    revisits = resolve_revisits(pages, min_bytes)
    total = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    files = max(int(total // file_bytes) + 1, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # fewer, and the join deals again
    by_page = _headers(pages).repartition(files, "page_id", "digest")
    copies = Window.partitionBy("page_id", "digest").orderBy(F.lit(0))  # follows the join's partitioning
    rows = by_page.join(revisits, ["page_id", "digest"], "left").withColumn("copy", F.row_number().over(copies))
    lines = record_text(rows, warc_date)
    lines.write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", records_per_file).option("compression", "gzip").text(path)
    return path


def record_text(rows: DataFrame, warc_date: str) -> DataFrame:
    revisit = F.col("refers_to").isNotNull()
    uri = F.coalesce(encoded(F.col("url")), F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n_bytes").cast("string"), F.lit(CRLF * 2))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    ref = F.concat(F.lit("WARC-Refers-To: <"), record_id(F.col("refers_to"), F.col("digest")), F.lit(f">{CRLF}WARC-Profile: {PROFILE}"))
    head = F.concat_ws(
        CRLF,
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: <"), record_id(F.col("page_id"), F.col("digest"), F.col("copy")), F.lit(">")),
        F.lit(f"WARC-Date: {warc_date}"),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32_of_hex(F.col("digest"))),
        F.when(revisit, ref),
        F.concat(F.lit("X-Page-Id: "), F.col("page_id").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    return rows.select(F.concat(head, F.lit(CRLF * 2), block).alias("value"))


def parse_records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of one archive."""
    while first := stream.readline():
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {first[:40]!r}")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8").partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) < size or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {fields.get('warc-record-id')} is not closed")
        yield fields, block


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("record_id", "record_type", "page_id", "payload_bytes", "payload_digest", "refers_to_id")}
        for x in batch.column(0):
            for fields, block in parse_records(gzip.GzipFile(fileobj=pa.BufferReader(x.as_buffer()))):
                payload = block.partition(b"\r\n\r\n")[2]
                kept = fields["warc-type"] == "response"
                out["record_id"].append(fields["warc-record-id"])
                out["record_type"].append(fields["warc-type"])
                out["page_id"].append(int(fields["x-page-id"]) if "x-page-id" in fields else None)
                out["payload_bytes"].append(len(payload) if kept else None)
                out["payload_digest"].append(hashlib.sha1(payload).hexdigest() if kept else None)
                out["refers_to_id"].append(fields.get("warc-refers-to"))
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))


def read_archives(spark, path: str) -> DataFrame:
    """One row per record; revisits are joined to their original responses by record id."""
    tune(spark, 1)  # a row is a whole archive
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    rows = staged(files.mapInArrow(_read, READ_BACK), "warc-read")
    tune(spark)
    own = rows.filter("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    wanted = rows.filter("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to_id")).agg(F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("payload_bytes"), F.max("payload_digest").alias("payload_digest"))
    again = rows.filter("record_type = 'revisit'").select("page_id", "refers_to_id", "record_type").join(staged(wanted, "warc-wanted"), "refers_to_id")
    return own.unionByName(again.select(*own.columns))


def roundtrip(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    spark = pages.sparkSession
    return read_archives(spark, write_archives(pages.select("page_id", "url", "html"), fresh_path(spark, "warc"), min_bytes))
