"""Operator 6: round trips, damaged archives and framing."""

from __future__ import annotations

import gzip
import hashlib

import pytest
from helpers import ODD

from graphloom.llm import warc

PAGES = "page_id long, url string, html string, payload string, digest string"


def pages(spark):
    rows = [(i, f"http://h/{i}\r\nX: 1", t, "clash", "clash") for i, t in enumerate(ODD)]
    rows += [(100, None, "z" * 1000, None, None), (101, "u", "z" * 1000, None, None), (102, "u", "z" * 1000, None, None), (None, "u", "z" * 1000, None, None)]
    rows += [(200, "u", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n" * 50, None, None), rows[3], (102, "u", "z" * 1000, None, None)]
    return spark.createDataFrame(rows, PAGES), rows


@pytest.mark.parametrize(("segment", "records"), [(warc.SEGMENT_BYTES, 4096), (300, 7)])
def test_round_trip(spark, tmp_path, segment, records):
    frame, rows = pages(spark)
    path = f"file://{tmp_path}/a"
    warc.write_archives(frame, path, segment_bytes=segment, records=records)
    got = warc.read_archives(spark, path).collect()
    assert len(got) == len(rows)
    texts: dict = {}
    for page_id, _, html, *_ in rows:
        texts.setdefault(page_id, (html or "").encode())
    for r in got:
        payload = texts[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha1(payload).hexdigest())
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == payload
    kinds = sorted(((r.page_id or 0), r.record_type, r.refers_to) for r in got if r.payload_bytes == 1000)
    assert kinds == [(0, "revisit", 102), (100, "revisit", 102), (101, "revisit", 102), (102, "response", None), (102, "revisit", 102)]
    assert {r.record_type for r in got if r.payload_bytes < 1000} == {"response"}


def test_empty_table(spark, tmp_path):
    frame, _ = pages(spark)
    warc.write_archives(frame.limit(0), f"file://{tmp_path}/e")
    assert warc.read_archives(spark, f"file://{tmp_path}/e").count() == 0


def test_archives_of_one_member_of_many_and_of_none(spark, tmp_path):
    frame, rows = pages(spark)
    warc.write_archives(frame, f"file://{tmp_path}/a", segment_bytes=300)
    files = sorted((tmp_path / "a").glob("part*"))
    many = b"".join(p.read_bytes() for p in files)
    assert many.count(b"\x1f\x8b\x08\x00\x00\x00\x00\x00") > len(rows)
    plain = gzip.decompress(many)
    records = list(warc.parse_archive(many))
    assert records == list(warc.parse_archive(gzip.compress(plain))) == list(warc.parse_archive(plain)) and len(records) > len(rows)
    with pytest.raises(ValueError, match="cut short"):
        list(warc.parse_archive(many[:-9]))
    big = bytes(range(256)) * 70_000
    assert gzip.decompress(warc.member(big) + b"\0") == big
    info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.warc.gz").write_bytes(gzip.compress(info) + many)
    assert warc.read_archives(spark, f"file://{tmp_path}/b").count() == len(rows)


def test_missing_segment_is_told(spark, tmp_path):
    frame = spark.createDataFrame([(1, "u", "q" * 5000, None, None)], PAGES)
    warc.write_archives(frame, f"file://{tmp_path}/a", segment_bytes=1000)
    records = [(f, b) for p in (tmp_path / "a").glob("part*") for f, b in warc.parse_archive(gzip.decompress(p.read_bytes()))]
    assert [f["warc-type"] for f, _ in records] == ["response"] + ["continuation"] * (len(records) - 1)
    assert int(records[-1][0]["warc-segment-total-length"]) == sum(len(b) for _, b in records)
    (tmp_path / "b").mkdir()
    kept = [r for r in records if r[0].get("warc-segment-number") != "3"]
    body = b"".join(b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in f.items()).encode() + b"\r\n" + b + b"\r\n\r\n" for f, b in kept)
    (tmp_path / "b" / "part-0.txt.gz").write_bytes(gzip.compress(body))
    (row,) = warc.read_archives(spark, f"file://{tmp_path}/b", strict=False).collect()
    assert row.page_id == 1 and "segment" in row.problem
    with pytest.raises(Exception, match="segment"):
        warc.read_archives(spark, f"file://{tmp_path}/b").collect()


def test_chunked_framing():
    for n in (0, 1, 4096, 4097, 10_000):
        assert warc.unchunked(warc.chunked(b"x" * n)) == b"x" * n
    assert warc.unchunked(b"3;ext=1\r\nabc\r\n0\r\n\r\n") == b"abc"
    for bad in (b"3\r\nab", b"3\r\nabcd\r\n0\r\n\r\n", b""):
        with pytest.raises(ValueError):
            warc.unchunked(bad)
