"""WARC archives with revisit records.

Deduplication works on headers: (payload digest, record id) rows are shuffled by digest, the smallest id of each digest keeps its
response and all others become revisits that refer to it. Decisions go back to the records by id, in the one shuffle
that also deals the records evenly into archive files. Reading takes the headers of the archives, and joins revisits to their responses for
what only the response holds.

Spark's text writer writes the files: a record is its head and block, and the writer's separator is the empty line pair that ends a
record. Files are gzip streams, sized by ``BYTES_PER_FILE`` of records, so that one file is a small part of a task's memory.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from panelfolio.llm.common import parts

END = "\r\n\r\n"
VERSION = "WARC/1.1"
BYTES_PER_FILE = 32_000_000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADERS = "page_id long, record_id string, record_type string, refers_to_record string, url string, payload_digest string, payload_bytes long, digest_matches boolean"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # fixed value: the alphabet of RFC 4648
HEX32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"  # digits that conv() writes


def digest(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: 160 bits are eight times 20 bits, four digits each."""
    h = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(h, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), HEX32, BASE32)


def header_value(value: Column) -> Column:
    """A value that stays on its line: control characters, blanks and '%' before them are percent-encoded as a URL would."""
    clean = F.regexp_replace(value, "\\r", "%0D")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(clean, "\\n", "%0A"), " ", "%20"), "[\\x00-\\x1f\\x7f]", "%00")


def record_uuid(key: Column, copy: Column) -> Column:
    h = F.md5(F.concat_ws("|", key, copy.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def record_key(page_id: Column, payload_digest: Column) -> Column:
    return F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("null")), payload_digest))


def records(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest and key of every row of ``pages`` (page_id, url, html as text or bytes)."""
    html = F.col("html")
    payload = html if isinstance(pages.schema["html"].dataType, BinaryType) else html.cast("string").cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(payload, F.lit(b"")).alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", digest(F.col("payload")))
    return rows.withColumn("key", record_key(F.col("page_id"), F.col("payload_digest")))


def resolved(rows: DataFrame, least_bytes: int, files: int) -> DataFrame:
    """``rows`` with copy (1, 2, ... among rows of equal id and payload), first_id (the response of a repeated payload) and is_response.

    A hot payload is a key only for headers, first in a partial aggregate and then in a join that Spark may split. Records
    are dealt by id and payload, so that copies of one payload spread over all files.
    """
    heads = rows.select("page_id", "payload_digest", "key").where(F.col("payload_bytes") >= least_bytes)
    firsts = heads.groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    decisions = heads.join(firsts, "payload_digest").groupBy("key").agg(F.first("first_id").alias("first_id"), F.lit(True).alias("repeated"))
    both = rows.repartition(files, "key").join(decisions.repartition(files, "key").hint("shuffle_hash"), "key", "left")
    numbered = both.withColumn("copy", F.row_number().over(Window.partitionBy("key").orderBy("url")))
    first = F.col("repeated").isNull() | (F.col("page_id").eqNullSafe(F.col("first_id")) & (F.col("copy") == 1))
    return numbered.withColumn("is_response", first)


def record_text(date: str) -> Column:
    """Head and block of a row of ``resolved``. A revisit has the HTTP head alone, and names its response."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.col("payload_bytes").cast("string")), F.lit("\r\n"))
    size = F.octet_length(http) + F.when(F.col("is_response"), F.col("payload_bytes")).otherwise(0)
    refers = record_uuid(record_key(F.col("first_id"), F.col("payload_digest")), F.lit(1))
    revisit = F.concat(line("WARC-Profile", F.lit(REVISIT_PROFILE)), line("WARC-Refers-To", refers))
    uri = F.coalesce(F.nullif(header_value(F.col("url")), F.lit("")), F.lit("urn:unknown"))
    head = F.concat(
        F.lit(VERSION + "\r\n"), line("WARC-Type", F.when(F.col("is_response"), "response").otherwise("revisit")), line("WARC-Record-ID", record_uuid(F.col("key"), F.col("copy"))),
        line("WARC-Date", F.lit(date)), line("WARC-Target-URI", uri), F.when(F.col("page_id").isNotNull(), line("WARC-Page-ID", F.col("page_id").cast("string"))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))), F.when(F.col("is_response"), "").otherwise(revisit),
        line("Content-Type", F.lit("application/http;msgtype=response")), line("Content-Length", size.cast("string")), F.lit("\r\n"), http)
    return F.concat(head.cast("binary"), F.when(F.col("is_response"), F.col("payload")).otherwise(F.lit(b""))).cast("string")


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", bytes_per_file: int = BYTES_PER_FILE) -> None:
    """Write ``pages`` (page_id, url, html; other columns are ignored) as deduplicated archives with fresh heads.

    Of the records whose payloads are equal and of ``least_bytes`` at least, that with the smallest page_id is a response and
    the others are revisits; smaller payloads are all responses. Null html: an empty payload. Null page_id: after all
    ids. Null or empty url: urn:unknown. Repeated rows: one record each, all but one of them revisits. Empty table: an archive without records.
    """
    html = F.octet_length(F.col("html")) if isinstance(pages.schema["html"].dataType, BinaryType) else F.octet_length(F.col("html").cast("string"))
    total = pages.agg(F.sum(F.coalesce(html.cast("long"), F.lit(0)) + 700)).first()[0] or 0
    # below the session's shuffle partitions Spark would deal the payloads a second time for the join
    files = max(parts(total, bytes_per_file), int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    done = resolved(records(pages), least_bytes, files)
    done.select(record_text(date).alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive."""
    at, end = 0, END.encode()
    while at < len(data):
        stop = data.index(end, at)
        lines = data[at:stop].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in lines[1:])}
        begin = stop + len(end)
        at = begin + int(headers["content-length"])
        yield headers, data[begin:at]
        at += len(end)


def _header_rows(content: bytes) -> Iterator[tuple]:
    for h, block in parsed(gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content):
        stated = h.get("warc-payload-digest", "").removeprefix("sha1:")
        size, same = None, None
        if h["warc-type"] == "response":
            payload = block[block.index(END.encode()) + 4 :]
            size = len(payload)
            found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            same, stated = found == stated, found
        page = int(h["warc-page-id"]) if "warc-page-id" in h else None
        yield page, h["warc-record-id"], h["warc-type"], h.get("warc-refers-to"), h.get("warc-target-uri"), stated, size, same


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """One row per record under ``path``: its headers, and for a response the digest and size of the payload as read."""
    names = [c.split()[0] for c in HEADERS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                frame = pd.DataFrame(list(_header_rows(content)), columns=names)
                yield frame.astype({"page_id": "Int64", "payload_bytes": "Int64", "digest_matches": "boolean"})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, HEADERS)


def resolve(headers: DataFrame) -> DataFrame:
    """Revisits joined to the responses they name: page_id, url, payload_bytes, payload_digest, record_type, refers_to and
    verified (the digest of a response is that of its payload as read, that of a revisit its response's)."""
    responses = headers.where("record_type = 'response'")
    targets = responses.select(F.col("record_id").alias("target"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("size"), F.col("payload_digest").alias("theirs"))
    revisits = headers.where("record_type = 'revisit'").join(targets, F.col("refers_to_record") == F.col("target"), "left")
    own = responses.select("page_id", "url", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"), F.col("digest_matches").alias("verified"))
    return own.unionByName(revisits.select("page_id", "url", F.col("size").alias("payload_bytes"), "payload_digest", "record_type", "refers_to",
                                           F.coalesce(F.col("payload_digest") == F.col("theirs"), F.lit(False)).alias("verified")))
