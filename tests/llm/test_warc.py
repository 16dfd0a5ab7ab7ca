import base64
import hashlib

import pytest

from panelmill.llm import warc


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected(pages):
    out = {}
    for page, _, html in pages:
        same = [p for p, _, h in pages if (h or "") == (html or "")]
        first = max(same)
        out[page] = (len((html or "").encode()), digest(html), "response" if page == first else "revisit", None if page == first else first)
    return out


def record(body):
    return f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n"


@pytest.mark.parametrize("split", ["134217728", "700", "97"])
def test_records_come_back_whole(spark, split):
    pages = [
        (1, "http://a", "<p>plain</p>"), (2, None, None), (3, "http://b\r\nX: y", ""), (4, "u", "é" * 200),
        (5, "u", "WARC/1.0\r\n"), (6, "u", record("inner") * 3), (7, "u", "x" * 900 + "WARC/1.0\r\nContent-Length: 5\r\n\r\n" + "y" * 900),
        (8, "u", "<p>plain</p>"), (9, "u", "WARC/1.0\r\n" * 40), (10, "u", "\r\n\r\n"), (11, "u", record("z" * 600) + "tail"),
        *[(100 + k, "u", f"page {k % 7}") for k in range(40)],
    ]
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(2)
        got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_and_read(rows).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == expected(pages)


def test_empty_table_and_null_ids(spark):
    kind = "page_id long, url string, html string, size long"
    assert warc.archive_and_read(spark.createDataFrame([], kind)).count() == 0
    rows = spark.createDataFrame([(None, "u", "a", 1), (3, "u", "a", 2), (3, "u", "a", 2)], kind)
    assert [(r.page_id, r.record_type) for r in warc.archive_and_read(rows).collect()] == [(3, "response")] * 2
