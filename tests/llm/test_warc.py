import base64
import glob
import gzip
import hashlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from panelfolio.llm import warc
from panelfolio.llm.common import new_folder

SCHEMA = "page_id long, url string, html string"
TRAP = "<p>WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n</p>"
ROWS = ([(i, f"http://x/{i}", "hot page") for i in range(50, 20, -1)] + [(1, None, None), (2, "", ""), (3, "http://a b\r\nX: y", TRAP), (4, "http://t", TRAP), (5, "u", "é" * 30000),
        (6, "u", "once"), (None, "n", "hot page"), (None, "n", "null twins"), (None, "m", "null twins"), (7, "r", "same row"), (7, "r", "same row"), (8, "r", "same row")])


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def run(spark, rows, **options):
    path = new_folder(spark, "warc-test")
    df = spark.createDataFrame(rows, SCHEMA).withColumn("payload", F.lit("x")).withColumn("key", F.lit(1)).withColumn("copy", F.lit(2))
    warc.write_archives(df, path, **options)
    return path, warc.resolve(warc.read_headers(spark, path)).collect()


def expected(rows, least):
    groups = defaultdict(list)
    for i, _, html in rows:
        groups[html or ""].append(i)
    out = Counter()
    for html, ids in groups.items():
        known = [i for i in ids if i is not None]
        first, size = min(known) if known else None, len(html.encode())
        for n, i in enumerate(sorted(ids, key=lambda i: (i is None, i))):
            response = size < least or n == 0
            out[(i, size, sha(html), "response" if response else "revisit", None if response else first)] += 1
    return out


def test_revisits_refer_to_the_smallest_page(spark):
    for least in (0, 9):
        _, got = run(spark, ROWS, least_bytes=least)
        assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == expected(ROWS, least)
        assert all(r["verified"] for r in got)


def test_archives_are_well_formed(spark):
    path, _ = run(spark, ROWS, bytes_per_file=20_000)
    files = glob.glob(path + "/part-*")
    assert len(files) > 1
    payloads = Counter()
    ids = set()
    for f in files:
        data = gzip.decompress(open(f, "rb").read())
        for headers, block in warc.parsed(data):
            assert headers["warc-record-id"] not in ids and "\r" not in headers["warc-target-uri"]
            ids.add(headers["warc-record-id"])
            body = block.split(b"\r\n\r\n", 1)[1]
            if headers["warc-type"] == "response":
                payloads[body.decode()] += 1
            else:
                assert body == b"" and headers["warc-profile"] == warc.REVISIT_PROFILE
    assert payloads == Counter({html or "" for _, _, html in ROWS}) and len(ids) == len(ROWS)


def test_archives_of_others_are_read(spark):
    record = lambda p: b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nContent-Length: %d\r\n\r\nHTTP/1.1 200 OK\r\n\r\n%b\r\n\r\n" % (19 + len(p), p)
    members = gzip.compress(record(b"one")) + gzip.compress(record(b"\xff\x00"))
    got = list(warc._header_rows(members))
    assert [(r[5], r[6]) for r in got] == [(base64.b32encode(hashlib.sha1(p).digest()).decode(), len(p)) for p in (b"one", b"\xff\x00")]


def test_binary_payloads_and_empty_table(spark):
    path = new_folder(spark, "warc-test")
    df = spark.createDataFrame([(1, "u", bytes(range(256)))], "page_id long, url string, html binary")
    warc.write_archives(df, path)
    (row,) = warc.resolve(warc.read_headers(spark, path)).collect()
    assert row["payload_bytes"] == 256 and row["verified"]
    assert run(spark, [])[1] == []
