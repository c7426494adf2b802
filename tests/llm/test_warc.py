import base64
import hashlib

import pytest

from wayfold.llm import warc
from wayfold.session import scratch

SCHEMA = "page_id long, url string, html string, address string, payload string, first string"


def archive(spark, rows, **how):
    folder = scratch(spark)
    frame = spark.createDataFrame([(*r, "x", None, "y") for r in rows], SCHEMA)
    warc.write_archive(frame, folder, **how)
    return folder


def expected(rows, least=0):
    groups = {}
    for page, _, html in rows:
        groups.setdefault(html or "", []).append(page)
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        ids = [p for p in groups[html or ""] if p is not None]
        first = max(ids) if ids else None
        revisit = len(data) >= least and first is not None and (page is None or page < first)
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


ROWS = [
    (1, "http://a/1", "<p>ä</p>"), (5, "http://a/2", "<p>ä</p>"), (3, None, "<p>ä</p>"), (5, "http://a/2", "<p>ä</p>"),
    (2, "http://b/\r\nWARC-Type: x y", None), (9, "http://c", ""), (None, "http://d", ""), (7, "http://e", "x" * 3_000_000),
    (None, "u", "only nulls"), (None, "u", "only nulls"), (8, "http://f", "\r\n\r\nWARC/1.1\r\n"),
]


@pytest.mark.parametrize("least", [0, 5])
def test_facts(spark, least):
    folder = archive(spark, ROWS, min_bytes=least)
    assert sorted((tuple(r) for r in warc.read_facts(spark, folder).collect()), key=str) == expected(ROWS, least)


def test_records_are_whole_and_payloads_are_stored_once(spark):
    folder = archive(spark, ROWS)
    assert warc.read_payloads(spark, folder).count() == len({r[2] or "" for r in ROWS})
    records = warc.read_records(spark, folder).collect()
    assert sorted(bytes(r.payload) for r in records) == sorted((r[2] or "").encode() for r in ROWS)
    for r in records:
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        length = int(dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])[b"Content-Length"])
        assert len(rest) == length + 4 and rest.endswith(b"\r\n\r\n")
        if r.record_type == "response":
            assert rest.partition(b"\r\n\r\n")[2][:-4] == bytes(r.payload)
    assert {r.target for r in records if r.page_id == 2} == {"http://b/%0D%0AWARC-Type:%20x%20y"}


def test_damage_is_found(spark):
    folder = archive(spark, ROWS[:2])
    spark.createDataFrame([("0" * 64, bytearray(b"other"))], warc.PAYLOADS).write.mode("append").parquet(f"{folder}/payloads")
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_payloads(spark, folder).collect()


def test_empty_table(spark):
    folder = archive(spark, [])
    assert warc.read_facts(spark, folder).collect() == [] and warc.read_records(spark, folder).collect() == []
