"""WARC archives without repeated payloads, written and read by Spark on any file system."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from settlespark.session import shared_path

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"


def base32(digits: Column) -> Column:
    """Forty hex digits in upper-case base32: five digits make four letters."""
    def letter(i: Column) -> Column:
        five = F.conv(F.substring(digits, F.floor(i / 4).cast("int") * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return F.substring(F.lit(ALPHABET), F.floor(five / F.pow(F.lit(2), 15 - i % 4 * 5)).cast("int") % 32 + 1, F.lit(1))

    letters = F.transform(F.sequence(F.lit(0), F.lit(31)), letter)
    return F.array_join(letters, "")


def resolved(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_bytes: int = 0) -> DataFrame:
    """``(page_id, url, payload, size, digest, first_id)``, the digest in hex; ``first_id`` is the response that a revisit repeats, else null.

    Headers alone are folded by digest, before and after the shuffle, to the least id of each
    payload; each record then meets the original of its digest. Rows that share the least id
    are all responses. A null id is a response where no row of the payload has an id.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"),
                        F.octet_length(payload).cast("long").alias("size"), F.sha1(payload.cast("binary")).alias("digest"))
    originals = rows.groupBy("digest").agg(F.min("page_id").alias("original"))
    repeats = (F.col("size") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("original"))
    return rows.join(originals, "digest").select("page_id", "url", "payload", "size", "digest", F.when(repeats, F.col("original")).alias("first_id"))


def _record_id(page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("|", page_id.cast("string"), digest).cast("binary"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def records(rows: DataFrame, date: str) -> DataFrame:
    """One text per row of ``resolved``: a WARC record without the two line ends that close it."""
    revisit, digest = F.col("first_id").isNotNull(), F.col("digest")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    head = F.concat_ws(
        "", F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _record_id(F.col("page_id"), digest)), line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace("url", "[\\x00-\\x20\\x7F]", "%20")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(digest))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _record_id(F.col("first_id"), digest)))),
        line("X-Page-ID", F.col("page_id").cast("string")), line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"))
    return rows.select(F.concat(head, block).alias("value"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   date: str = "2024-01-01T00:00:00Z", min_bytes: int = 0) -> None:
    """A gzipped WARC file for each partition of the join by digest.

    The text writer ends each record with the two line ends that WARC asks for, and its commit
    leaves one file for each task even where executors are lost. Partition sizes, so archive
    sizes, follow the session's advisory partition size.
    """
    records(resolved(pages, id_col, url_col, payload_col, min_bytes), date).write.option("lineSep", END).option("compression", "gzip").text(path)


def _read(stream) -> dict | None:
    """The next record of an archive: header fields by lower-case name, and its block."""
    first = stream.readline()
    if not first:
        return None
    if not first.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    fields = {}
    while (line := stream.readline()).strip():
        name, _, value = line.decode("utf-8").partition(":")
        fields[name.strip().lower()] = value.strip()
    fields["block"] = stream.read(int(fields["content-length"]))
    if stream.read(4) != END.encode():
        raise ValueError("a WARC record doesn't end where its length says")
    return fields


def read_archives(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """``(page_id, record, refers, url, payload_bytes, payload_digest, record_type, html)`` of every record.

    ``html`` is null for revisits; ``refers`` is the record that they name.
    Payloads are hashed again; a digest that differs, like a record cut short, is an error.
    """
    def parse(batches):
        kinds = [("page_id", pa.string()), ("record", pa.string()), ("refers", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()),
                 ("payload_digest", pa.string()), ("record_type", pa.string()), ("html", pa.string())]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(kinds)], names=[n for n, _ in kinds])

        for files in batches:
            for content in files.column(0):
                stream, rows, held = gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer())), [], 0
                while (r := _read(stream)) is not None:
                    head, _, body = r["block"].partition(END.encode())
                    size = int(re.search(rb"(?i)content-length: *(\d+)", head)[1])
                    digest, response = r["warc-payload-digest"].partition(":")[2], r["warc-type"] == "response"
                    if response and (base64.b32encode(hashlib.sha1(body).digest()).decode() != digest or len(body) != size):
                        raise ValueError(f"payload of {r['warc-record-id']} is damaged")
                    rows.append((r.get("x-page-id"), r["warc-record-id"], r.get("warc-refers-to"), r.get("warc-target-uri"), size, digest, r["warc-type"], body.decode("utf-8") if response else None))
                    held += len(body)
                    if held > 4_000_000 or len(rows) >= 5_000:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content").mapInArrow(
        parse, "page_id string, record string, refers string, url string, payload_bytes bigint, payload_digest string, record_type string, html string")
    return found.withColumn("page_id", F.col("page_id").cast(id_type))


def resolve(found: DataFrame) -> DataFrame:
    """Revisits of ``read_archives`` joined to the responses they name: adds ``refers_to``, drops record ids."""
    originals = found.where("record_type = 'response'").select(F.col("record").alias("refers"), F.col("page_id").alias("refers_to")).distinct()
    return found.join(originals, "refers", "left").drop("refers", "record")


def archived(pages: DataFrame, **options) -> DataFrame:
    """Writes archives of ``pages`` to a new shared folder and returns what they hold."""
    path = shared_path(pages.sparkSession, "warc")
    write_archives(pages, path, **options)
    id_type = pages.schema[options.get("id_col", "page_id")].dataType.simpleString()
    return resolve(read_archives(pages.sparkSession, path, id_type))
