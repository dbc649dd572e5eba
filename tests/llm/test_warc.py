from __future__ import annotations

import base64
import gzip
import hashlib

import pytest

from seatwise.llm import warc as W

SCHEMA = "page_id long, url string, html string, sha string, size long, first long"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1, 2) for i, u, h in rows], SCHEMA)


ROWS = [(3, "http://a/", "same"), (1, "http://b/", "same"), (2, None, None), (4, "u\r\nX: y", ""), (5, "u", "é" * 30_000),
        (6, "u", "WARC/1.1\r\n\r\n0\r\n\r\n"), (7, "u", "é" * 30_000), (None, "u", "same"), (1, "http://b/", "same")]


def test_round_trip(spark):
    got = W.round_trip(pages(spark, ROWS), segment_bytes=1000).collect()
    assert len(got) == len(ROWS) and all(r.intact for r in got)
    payload = {i: (h or "").encode() for i, _, h in ROWS}
    for r in got:
        p = payload[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode())
        if r.record_type == "response":
            assert bytes(r.payload) == p and r.refers_to is None
    kinds = sorted(((r.page_id or 0, r.record_type, r.refers_to) for r in got), key=str)
    assert kinds == sorted([(0, "revisit", 1), (1, "response", None), (1, "revisit", 1), (2, "response", None), (3, "revisit", 1),
                            (4, "revisit", 2), (5, "response", None), (6, "response", None), (7, "revisit", 5)], key=str)


def test_small_payloads_are_never_revisits(spark):
    got = W.round_trip(pages(spark, ROWS), least_bytes=5).collect()
    assert sorted(r.page_id for r in got if r.record_type == "revisit") == [7]


def test_empty_table(spark):
    assert W.round_trip(pages(spark, [])).collect() == []


def test_missing_and_foreign_segments_are_found(spark):
    schema = W._RECORD
    def row(origin, n, total, block):
        return (f"{origin}-{n}", origin, n, total, "response" if n == 1 else "continuation", 1, "u", "d", 0, None, block)
    rows = [row("ok", 2, 5, b"de"), row("ok", 1, None, b"abc"), row("gap", 1, None, b"a"), row("gap", 3, 2, b"b"),
            row("size", 1, None, b"a"), row("size", 2, 9, b"b"), row("open", 1, None, b"a"), row("twice", 1, None, b"a"),
            row("twice", 2, 2, b"b"), row("twice", 2, 2, b"b")]
    got = {r.origin_id: (r.complete, r.block and bytes(r.block)) for r in W.reassemble(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"ok": (True, b"abcde"), "gap": (False, None), "size": (False, None), "open": (False, None), "twice": (False, None)}


@pytest.mark.parametrize("n", [0, 1, 4095, 4096, 4097, 20_000])
def test_chunked_framing(n):
    assert W.dechunked(W.chunked(b"\r\n0" * n)) == b"\r\n0" * n


def test_broken_framing_raises():
    with pytest.raises(ValueError):
        W.dechunked(b"3\r\nabcd\r\n0\r\n\r\n")


def test_members_and_plain_files(tmp_path, spark):
    record = W.record([("WARC-Type", "response"), ("WARC-Record-ID", "<a>")], b"block") + b"\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(record) + gzip.compress(record))
    (tmp_path / "b.warc").write_bytes(record * 3)
    assert [bytes(r.block) for r in W.read_records(spark, str(tmp_path)).collect()] == [b"block"] * 5
