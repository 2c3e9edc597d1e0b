import gzip
import hashlib
import io

import pytest

from furlong.llm import warc
from furlong.llm.common import shared_path
from tests.llm.helpers import by_spark, by_sql

SCHEMA = "page_id long, url string, html string, payload string, id string, digest string"


def pages(spark):
    long = "<p>" + "é" * 60 + "</p>"
    rows = [(1, "http://a/1", long), (2, "http://a/ü b", long), (5, None, long), (2, "http://a/ü b", long), (3, "u", "short"), (4, "u", "short"),
            (6, "", None), (7, "u", ""), (8, "u", "x" * 100), (0, "u", "x" * 99), (9, "u", "x" * 99), (10, "u", "y" * 3_000_000),
            (11, "u", "y" * 3_000_000), (None, "u", "x" * 100), (None, None, None), (12, "u", "a\r\n\r\nb" * 30), (1, "again", long)]
    return spark.createDataFrame([(*r, "p", "i", None) for r in rows], SCHEMA)


def answer(spark, table, **options):
    path = shared_path(spark, "warc-test")
    warc.write_archives(warc.decide(table), path, **options)
    found = warc.read_archives(spark, path)
    return found, found.selectExpr("cast(record_id as long) page_id", "payload_bytes", "payload_digest", "record_type",
                                   "cast(refers_to as long) refers_to")


@pytest.mark.parametrize("size", [1, 8 << 20])
def test_matches_sql_and_returns_the_payloads(spark, size):
    table = pages(spark)
    found, got = answer(spark, table, archive_bytes=size)
    assert by_spark(got) == by_sql(warc.SQL, pages=table)
    stored = sorted(bytes(r["payload"]) for r in found.filter("record_type = 'response'").collect())
    first, expected = {}, []
    for r in sorted(table.collect(), key=lambda r: (r["page_id"] is None, r["page_id"] or 0)):
        payload = (r["html"] or "").encode()
        if len(payload) < 100 or first.setdefault(payload, r["page_id"]) == r["page_id"]:
            expected.append(payload)
    assert stored == sorted(expected)


def test_empty_table(spark):
    table = pages(spark).limit(0)
    assert answer(spark, table)[1].collect() == []


def test_archives_are_plain_gzip_files():
    payload = b"<html>" * 50
    digest = hashlib.sha256(payload).hexdigest()
    raw = warc.record("1", "http://x", payload, digest) + warc.record("2", "http://x", payload, digest, "1") + b"\0"
    text = gzip.decompress(raw)
    assert text.count(b"WARC/1.1\r\n") == 2 and payload in text
    (one, block), (two, head) = warc.records(io.BytesIO(raw))
    assert one["warc-type"] == "response" and block.endswith(payload) and two["warc-refers-to"] == "<urn:page:1>"
    assert int(two["content-length"]) == len(head)


def test_reading_in_small_steps_and_through_padding():
    raw = b"\0\0".join(warc.record(str(i), "u", b"x" * i * 1000, hashlib.sha256(b"x" * i * 1000).hexdigest()) for i in range(9))
    source = warc.Source(io.BytesIO(raw), step=7)
    assert not source.at_end()
    assert [f["warc-record-id"] for f, _ in warc.records(io.BytesIO(raw))] == [f"<urn:page:{i}>" for i in range(9)]


@pytest.mark.parametrize("damage", ["cut", "digest", "length", "version", "trailing"])
def test_broken_records_are_refused(damage):
    payload = b"<html>" * 50
    good = gzip.decompress(warc.record("1", "u", payload, hashlib.sha256(payload).hexdigest()))
    bad = {"cut": good, "digest": good.replace(b"<html>", b"<HTML>", 1), "length": good.replace(b"Content-Length: 3", b"Content-Length: 9", 1),
           "version": b"X" + good, "trailing": good + b"more"}[damage]
    raw = gzip.compress(bad)
    with pytest.raises(warc.BrokenRecord):
        list(warc.records(io.BytesIO(raw[:-20] if damage == "cut" else raw)))


def test_a_payload_that_differs_from_its_digest_is_refused():
    fields = {"warc-type": "response", "warc-payload-digest": "sha256:" + "0" * 64}
    with pytest.raises(warc.BrokenRecord):
        warc.parsed(fields, b"HTTP/1.1 200 OK\r\n\r\nbody", True)
