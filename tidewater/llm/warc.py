"""WARC archives: writing, reading, and revisit resolution.

Records are WARC/1.1 responses whose block is a small HTTP header and the payload. Headers (id and
payload digest) are shuffled by digest: of the records with one digest, that with the largest id keeps
its payload; the others become revisit records, with fresh headers that name it. A page then meets
its fate by id and digest, so no task holds a digest's payloads: the planner broadcasts the fates of repeated
payloads where they are small, else it deals payloads evenly over the ids. A revisit's block keeps
the HTTP header, so the payload's length is not lost.

Archives are written by Spark's text writer, a record a row with CRLF CRLF after it, gzipped, so
any file system Spark knows can hold them. A file holds at most 64 MB before compression, or one record. Files
are read whole and parsed by Content-Length, a record at a time, so payloads may hold anything, record
headers included. The writer compresses a file as one stream, so one record cannot be read alone.

Defined results: a null payload is empty; rows that repeat the id and payload of a response are
responses too; a record of a null id is a response only if no record of its payload has an id;
line breaks in a URL are dropped; a payload of any length Spark can hold is one record, in a file of its
own from 4 MB on; an empty table gives an empty archive folder; extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BREAK = "\r\n"
#: (payloads below so many bytes, so many records a file): a file stays small enough to be read whole in a task.
FILES = ((1 << 14, 4096), (1 << 18, 256), (1 << 22, 16))
BATCH_BYTES = 4 << 20
READ = "record_id string, target_uri string, record_type string, refers_to string, payload_digest string, payload_bytes long, payload binary, intact boolean"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 SHA-1: each 40 bits are 10 hex digits and 8 base32 digits."""
    hexes = F.sha1(payload)
    digits = F.concat(*[F.lpad(F.conv(F.substring(hexes, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)])
    return F.translate(F.upper(digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def resolve_revisits(headers: DataFrame) -> DataFrame:
    """(id, digest, response_id) of the headers (id, digest) whose payload more than one record has."""
    kept = headers.groupBy("digest").agg(F.max("id").alias("response_id"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    return headers.join(kept, "digest").distinct()


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> None:
    """Write one record a row: a response, or a revisit of the response with the same payload."""
    payload = F.coalesce(pages[payload_col].cast("string"), F.lit(""))
    headers = pages.select(pages[id_col].alias("id"), base32_sha1(payload).alias("digest"))
    fates = resolve_revisits(headers).select(F.col("id").alias("_of"), F.col("digest").alias("_digest"), "response_id")
    rows = pages.select(pages[id_col].alias("id"), pages[url_col].cast("string").alias("url"), payload.alias("payload"), base32_sha1(payload).alias("digest"))
    rows = rows.join(fates, F.col("id").eqNullSafe(F.col("_of")) & (F.col("digest") == F.col("_digest")), "left")
    revisit = F.col("response_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("response_id"))
    name = lambda c: F.concat(F.lit("<urn:record:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}Content-Length: "), F.octet_length("payload").cast("string"), F.lit(BREAK * 2))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    head = F.concat(
        F.lit(f"WARC/1.1{BREAK}WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(f"{BREAK}WARC-Record-ID: "), name(F.col("id")),
        F.lit(f"{BREAK}WARC-Date: {date}"),
        F.coalesce(F.concat(F.lit(f"{BREAK}WARC-Target-URI: "), F.translate("url", BREAK, "")), F.lit("")),
        F.lit(f"{BREAK}WARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"{BREAK}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{BREAK}WARC-Refers-To: "), name(F.col("response_id")))).otherwise(F.lit("")),
        F.lit(f"{BREAK}Content-Type: application/http; msgtype=response{BREAK}Content-Length: "), F.octet_length(block).cast("string"), F.lit(BREAK * 2),
    )
    # Rows of a task are counted off into files of payloads of like size.
    turn = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    file = F.concat(F.lit(len(FILES)), F.lit("-"), F.col("turn"))
    for k, (below, records_) in reversed(list(enumerate(FILES))):
        file = F.when(F.octet_length("payload") < below, F.concat(F.lit(k), F.lit("-"), F.floor(F.col("turn") / records_))).otherwise(file)
    rows.withColumn("turn", turn).select(file.alias("file"), F.concat(head, block).alias("value")).write.option("lineSep", BREAK * 2).option("compression", "gzip").partitionBy("file").text(path)


def records(archive: bytes | BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive, by Content-Length: one record is held at a time."""
    archive = io.BytesIO(archive) if isinstance(archive, bytes) else archive
    while True:
        line = archive.readline()
        while line == b"\r\n":
            line = archive.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record where {line[:40]!r} stands")
        fields = {}
        while (line := archive.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        yield fields, archive.read(int(fields["content-length"]))


def parse(data: bytes, with_payload: bool) -> Iterator[dict]:
    """The columns of READ for each record of an archive, gzipped or plain."""
    stream = io.BytesIO(data)
    for fields, block in records(io.BufferedReader(gzip.GzipFile(fileobj=stream), 1 << 16) if data[:2] == b"\x1f\x8b" else stream):
        head, _, payload = block.partition(b"\r\n\r\n")
        length = next((int(x.partition(":")[2]) for x in head.decode("latin-1").lower().split(BREAK) if x.startswith("content-length:")), 0)
        digest, kind = fields.get("warc-payload-digest", "").removeprefix("sha1:"), fields["warc-type"]
        yield {
            "record_id": fields["warc-record-id"], "target_uri": fields.get("warc-target-uri"), "record_type": kind, "refers_to": fields.get("warc-refers-to"),
            "payload_digest": digest, "payload_bytes": length, "payload": payload if with_payload and kind == "response" else None,
            "intact": kind != "response" or len(payload) == length and base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest,
        }


def read(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """The records of the archives below ``path``, with each response's digest checked against its payload."""
    schema = pa.schema([pa.field(x.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}[x.split()[1]]) for x in READ.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                held, size = [], 0
                for row in parse(data.as_py(), with_payload):
                    held.append(row)
                    size += 500 + len(row["payload"] or b"")
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, schema)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(run, READ)


def restored(archive: DataFrame) -> DataFrame:
    """Revisits joined to the payload of the response they name."""
    full = archive.filter("record_type = 'response'").select(F.col("record_id").alias("_of"), F.col("payload").alias("_payload"))
    return archive.join(full, F.coalesce("refers_to", "record_id") == F.col("_of"), "left").withColumn("payload", F.col("_payload")).drop("_of", "_payload")


#: DuckDB SQL for the query over ``pages``.
ORACLE = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h
  FROM pages),
d AS (
  SELECT page_id, payload_bytes, h, list_aggregate(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INTEGER, 1)), 'string_agg', '') AS payload_digest
  FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = max(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id < max(page_id) OVER w THEN max(page_id) OVER w END AS refers_to
FROM d WINDOW w AS (PARTITION BY h)
"""
