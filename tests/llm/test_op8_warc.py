import base64
import gzip
import hashlib
import json
import os

import pytest

from palaver.llm import warc

SCHEMA = "page_id long, url string, html string"
ROWS = [(1, "http://a/é", "<p>x</p>"), (2, None, None), (3, "u\r\nv", ""), (4, "u", "<p>x</p>"), (None, "n", "<p>x</p>"),
        (4, "w", "<p>x</p>"), (5, "long", "日本\r\n\r\n" * 40000), (6, "", "WARC/1.1\r\n\r\n")]


def test_round_trip_revisits_and_odd_rows(spark):
    pages = spark.createDataFrame([(*row, "extra") for row in ROWS], SCHEMA + ", payload string").repartition(3)
    rows = warc.archive(spark, pages).collect()
    assert len(rows) == len(ROWS)
    found = {(row.page_id, row.url): row for row in rows}
    for page_id, url, html in ROWS:
        payload = (html or "").encode()
        row = found[page_id, url]
        latest = max(p for p, _, h in ROWS if (h or "") == (html or "") and p is not None)
        assert row.payload_bytes == len(payload)
        assert row.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert (row.record_type, row.refers_to) == (("response", None) if page_id == latest else ("revisit", latest))
        assert bytes(row.payload) == (payload if row.record_type == "response" else b"")


def test_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame(ROWS, SCHEMA)
    assert {r.record_type for r in warc.classify(pages, 9).filter("payload_bytes < 9").collect()} == {"response"}


def test_members_and_index(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, SCHEMA).coalesce(1)
    archives = warc.write_archives(warc.classify(pages), f"file://{tmp_path}/whole").collect()
    paths = spark.createDataFrame(archives, "path string, records long")
    entries = warc.normalise(paths, f"{tmp_path}/split").collect()
    assert sum(row.records for row in archives) == len(entries) == len(ROWS)
    for path in {row.path for row in entries}:
        own = sorted((e.offset, e.length) for e in entries if e.path == path)
        data = open(path, "rb").read()
        assert own[0][0] == 0 and sum(own[-1]) == len(data)
        whole = [gzip.decompress(data[offset:offset + length]) for offset, length in own]
        assert all(part.startswith(b"WARC/1.1\r\n") and part.endswith(b"\r\n\r\n") for part in whole)
        source = os.path.join(tmp_path, "whole", os.path.basename(path))
        assert b"".join(whole) == gzip.decompress(open(source, "rb").read())
        sidecar = [json.loads(line) for line in open(path + ".index")]
        assert [(e["offset"], e["length"]) for e in sidecar] == own


def test_empty_table_and_damage(spark, tmp_path):
    assert warc.archive(spark, spark.createDataFrame([], SCHEMA)).collect() == []
    with pytest.raises(ValueError):
        list(warc.split_records([b"WARC/1.1\r\nContent-Length: 10\r\n\r\nshort"]))
    with pytest.raises(ValueError):
        list(warc.split_records([b"HTTP/1.1\r\nContent-Length: 1\r\n\r\nx\r\n\r\n"]))
