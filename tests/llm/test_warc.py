import base64
import hashlib

import pytest

from lumenfold.llm import warc

SCHEMA = "page_id long, url string, html string, extra string"


def expected(rows, least=0):
    first = {}
    for i, _, h, _ in rows:
        h = h or ""
        if len(h.encode()) >= least:
            first[h] = min(first.get(h, i), i)
    out = []
    for i, _, h, _ in rows:
        h = (h or "").encode()
        lead = first.get(h.decode(), i)
        digest = base64.b32encode(hashlib.sha1(h).digest()).decode()
        out.append((i, len(h), digest, "response" if lead == i else "revisit", None if lead == i else lead))
    return sorted(out, key=str)


def round_trip(spark, path, rows, least=0, parts=1):
    warc.write(spark.createDataFrame(rows, SCHEMA).repartition(parts), path, least)
    return sorted((tuple(r) for r in warc.read(spark, path).collect()), key=str)


FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip_with_hostile_payloads(spark, tmp_path, least):
    rows = [
        (1, "http://a/ b", "plain", None), (2, None, None, "x"), (3, "u", "plain", None), (4, "u", "", None),
        (5, "u", "x" + FAKE + "y", None), (6, "u", FAKE, None), (7, "u", FAKE + FAKE + "WARC/1.1\r\n", None),
        (8, "u", "\r\n\r\n", None), (9, "u", "é世😀\r\n" * 5, None), (10, "u", "WARC/1.1\r\nContent-Length: 999999\r\n\r\n", None), (11, "u", "tail", None),
    ]
    assert round_trip(spark, f"{tmp_path}/w", rows, least) == expected(rows, least)


def test_many_small_splits_and_a_record_inside_every_payload(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"page {i % 37} " + "é" * (i % 11) + (FAKE * (i % 3)), None) for i in range(120)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert round_trip(spark, f"{tmp_path}/w", rows, parts=2) == expected(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_no_pages(spark, tmp_path):
    assert round_trip(spark, f"{tmp_path}/w", []) == []


def test_repeated_rows_are_all_responses(spark, tmp_path):
    rows = [(1, "u", "same", None), (1, "u", "same", None), (2, "u", "same", None)]
    got = round_trip(spark, f"{tmp_path}/w", rows)
    assert [r[3] for r in got] == ["response", "response", "revisit"]


def test_a_cut_archive_keeps_its_whole_records(spark, tmp_path):
    rows = [(i, "u", f"payload {i}", None) for i in range(5)]
    warc.write(spark.createDataFrame(rows, SCHEMA).coalesce(1).orderBy("page_id"), f"{tmp_path}/w")
    part = next(p for p in (tmp_path / "w").glob("part-*") if p.stat().st_size)
    part.write_bytes(part.read_bytes()[:-30])
    for crc in (tmp_path / "w").glob(".*.crc"):
        crc.unlink()
    got = warc.read(spark, f"{tmp_path}/w").collect()
    assert sorted((r["page_id"], r["payload_bytes"]) for r in got) == [(i, 9) for i in range(4)]


def test_a_torn_record_cut_off_is_not_returned(spark, tmp_path):
    rows = [(i, "u", f"payload {i}" + FAKE * 2, None) for i in range(3)]
    warc.write(spark.createDataFrame(rows, SCHEMA).coalesce(1).orderBy("page_id"), f"{tmp_path}/w")
    part = next(p for p in (tmp_path / "w").glob("part-*") if p.stat().st_size)
    part.write_bytes(part.read_bytes()[:-120])
    for crc in (tmp_path / "w").glob(".*.crc"):
        crc.unlink()
    got = warc.read(spark, f"{tmp_path}/w").collect()
    assert sorted(tuple(r)[:2] for r in got) == [(i, len(rows[i][2])) for i in range(2)]


def test_reading_leaves_the_session_as_it_was(spark, tmp_path):
    before = spark.conf.get("spark.sql.files.minPartitionNum", None)
    round_trip(spark, f"{tmp_path}/w", [(1, "u", FAKE, None)])
    assert spark.conf.get("spark.sql.files.minPartitionNum", None) == before
