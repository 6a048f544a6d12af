from __future__ import annotations

import tempfile

import pytest
from pyspark.sql import functions as F

from rollcall.llm import warc


def _pages(spark, rows):
    return spark.createDataFrame([(i, u, h, 7) for i, u, h in rows], "page_id long, url string, html string, segment int")


ROWS = [(1, "http://a/é b", "é" * 5_000), (2, None, None), (3, "u", ""), (4, "u", "x" * 99), (5, "u", "x" * 99), (6, "u", "y" * 100), (9, "u", "y" * 100), (7, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" * 40),
        (6, "u", "y" * 100), (8, "u", "0\r\n\r\n" * 30), (None, "u", "null id")]


def test_round_trip_with_small_segments(spark):
    path = tempfile.mkdtemp(prefix="warc-test-") + "/w"
    warc.write_warc(_pages(spark, ROWS), path, segment=777, chunk=100)
    back = warc.reassembled(warc.read_warc(spark, path)).collect()
    payloads = sorted(r["payload"].decode() for r in back if r["record_type"] == "response")
    assert payloads == sorted([(h or "") for i, _, h in ROWS if i != 9])
    assert [r["payload"] for r in back if r["record_type"] == "revisit"] == [None]
    assert warc.read_warc(spark, path).filter("record_type = 'continuation'").count() > 10


def test_query(spark):
    got = sorted(tuple(r) for r in warc.op5_warc(_pages(spark, ROWS)).select(F.coalesce("page_id", F.lit(-1)), "payload_bytes", "record_type", "refers_to").collect())
    assert got[:4] == [(-1, 7, "response", None), (1, 10_000, "response", None), (2, 0, "response", None), (3, 0, "response", None)]
    assert got[6:] == [(6, 100, "response", None), (6, 100, "response", None), (7, len(ROWS[7][2]), "response", None), (8, 150, "response", None), (9, 100, "revisit", 6)]
    assert warc.op5_warc(_pages(spark, [])).collect() == []


def test_broken_records_are_found():
    assert warc.dechunked(warc.chunked(b"abc" * 1000, 7)) == b"abc" * 1000
    assert warc.dechunked(b"3;ext=1\r\nabc\r\n0\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc\r\n0\r\n\r\n")


def test_missing_segment_and_wrong_total_raise(spark):
    rows = [("a", "response", None, "a", 1, None, None, None, b"h\r\n\r\n12"), ("a3", "continuation", None, "a", 3, 9, None, None, b"34")]
    with pytest.raises(Exception, match="segments are missing"):
        warc.reassembled(spark.createDataFrame(rows, warc.RECORDS)).collect()
    rows[1] = ("a2", "continuation", None, "a", 2, 99, None, None, b"34")
    with pytest.raises(Exception, match="instead of 99"):
        warc.reassembled(spark.createDataFrame(rows, warc.RECORDS)).collect()
