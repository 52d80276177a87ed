"""WARC: exact round trips, broken archives."""

import base64
import gzip
import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import warc as W


@given(st.binary(max_size=300), st.integers(1, 40))
def test_chunked_framing(body, size):
    assert W.dechunked(W.chunked(body, size)) == body
    assert W.http_body(W.HTTP_HEAD + W.chunked(body, size)) == body


def test_framing_by_others():
    assert W.dechunked(b"4;name=value\r\nWiki\r\n6\r\npedia \r\nE\r\nin \r\n\r\nchunks.\r\n0\r\nTrailer: x\r\n\r\n") == b"Wikipedia in \r\n\r\nchunks."
    for bad in (b"", b"5\r\nabc\r\n0\r\n\r\n", b"zz\r\nabc\r\n", b"3\r\nabc"):
        with pytest.raises(ValueError):
            W.dechunked(bad)
    assert W.http_body(b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nplain") == b"plain"


def want(rows, least=0):
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        same = [j for j, _, h in rows if (h or "").encode() == body and j is not None and len(body) >= least]
        top = max(same, default=None)
        revisit = top is not None and top != i
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r)[:1] + (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


ROWS = [(1, "http://a/", "<p>one</p>"), (2, "http://b/", "<p>one</p>"), (3, None, None), (4, "http://c/", ""), (None, "http://d/", "<p>one</p>"), (None, "x y", "only"),
        (6, "http://e/", "long é漢𝄞 " * 20000), (7, "http://e/", "long é漢𝄞 " * 20000), (8, "u", "\r\n\r\nWARC/1.1\r\n\r\n"), (8, "u", "\r\n\r\nWARC/1.1\r\n\r\n"), (9, "u", "other"), (9, "u", "others")]


@pytest.mark.parametrize("segment,least", [(100, 0), (32768, 9), (10**9, 0)])
def test_round_trip(spark, segment, least):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumn("sha1", F.lit("x")).withColumn("id", F.lit(1))
    back = W.round_trip(pages, segment_bytes=segment, min_revisit_bytes=least, with_payload=True)
    assert got(back) == want(ROWS, least)
    assert all(r.status == "ok" for r in back.collect())
    bodies = sorted((r.payload.decode() for r in back.collect()))
    assert bodies == sorted(h or "" for _, _, h in ROWS)


def test_empty_table(spark):
    assert W.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def archive(tmp_path, recs, name="a.warc.gz", members=False):
    data = [r + b"\r\n\r\n" for r in recs]
    raw = b"".join(map(gzip.compress, data)) if members else gzip.compress(b"".join(data))
    (tmp_path / name).write_bytes(raw)


def pieces(body="x" * 1000, page=5):
    return W.records(page, "http://u/", body.encode(), hashlib.sha1(body.encode()).hexdigest(), 1, None, 300)


def status(spark, tmp_path):
    return [(r.page_id, r.payload_bytes, r.status) for r in W.read(spark, str(tmp_path)).collect()]


def test_segments_in_any_order_and_file(spark, tmp_path):
    a = pieces()
    assert len(a) == 4
    archive(tmp_path, [a[2], a[0]], members=True)
    archive(tmp_path, [a[3], a[1]], "b.warc.gz")
    (tmp_path / "c.warc").write_bytes(pieces("plain file", 6)[0] + b"\r\n\r\n")
    assert sorted(status(spark, tmp_path)) == [(5, 1000, "ok"), (6, 10, "ok")]


@pytest.mark.parametrize("pick,expected", [([0, 1, 3], "incomplete"), ([0, 1, 2], "incomplete"), ([1, 2, 3], "incomplete"), ([0, 1, 1, 2, 3], "incomplete")])
def test_missing_or_repeated_segments(spark, tmp_path, pick, expected):
    a = pieces()
    archive(tmp_path, [a[i] for i in pick])
    (row,) = status(spark, tmp_path)
    assert row[1:] == (None, expected)


def test_damage_is_reported(spark, tmp_path):
    a, b = pieces(), pieces("y" * 10, 6)[0]
    short = a[3].replace(b"WARC-Segment-Total-Length: ", b"WARC-Segment-Total-Length: 9")
    archive(tmp_path, [*a[:3], short], "a.warc.gz")
    archive(tmp_path, [b.replace(b"yyyyyyyyyy", b"yyyyyyyyyz")], "b.warc.gz")
    revisit = W.records(7, "u", b"", hashlib.sha1(b"y" * 10).hexdigest(), 1, 6, 300)
    archive(tmp_path, [*revisit, b"no record at all"], "c.warc.gz")
    archive(tmp_path, [pieces("fine", 8)[0], pieces("cut", 9)[0][:-40]], "d.warc.gz")
    assert sorted(status(spark, tmp_path), key=str) == [(5, None, "bad length"), (6, None, "bad block digest"), (7, None, "unresolved"), (8, 4, "ok"),
                                                        (None, None, "malformed"), (None, None, "malformed")]


def kinds(data):
    return [f["warc-type"] for f, _ in W.parse(data)]


def test_reading_goes_on_behind_damage():
    one, two, three = (pieces(c * 20, i)[0] + b"\r\n\r\n" for i, c in enumerate("xyz"))
    good, bad = ["response"], ["malformed"]
    assert kinds(one + two + three) == good * 3 and kinds(b"") == [] and kinds(b"\r\n\r\n") == []
    assert kinds(one + b"junk\r\nmore junk\r\n" + three) == good + bad + good
    assert kinds(one + two.replace(b"Content-Length: ", b"Content-Length: 9") + three) == good + bad + good
    assert kinds(one + two.replace(b"Content-Length: ", b"Content-Length: x") + three) == good + bad + good
    assert kinds(one + two[:30] + b"\r\n" + three) == good + bad + good and kinds(one + two[:-30]) == good + bad
    assert kinds(two[40:]) == bad and kinds(b"\x00" * 100) == bad
    # gzip: a damaged member, a damaged end, a single damaged member
    members = [gzip.compress(x) for x in (one, two, three)]
    assert kinds(b"".join(members)) == good * 3
    hurt = bytearray(members[1])
    hurt[20:60] = bytes(40)
    assert kinds(members[0] + bytes(hurt) + members[2]) == good + bad + good
    assert kinds(members[0] + members[1][:-12]) in (good + bad, good * 2 + bad) and kinds(bytes(hurt)) == bad and kinds(gzip.compress(b"")) == []
    whole = bytearray(gzip.compress(one * 400 + two * 400 + three * 400))
    whole[len(whole) // 2:len(whole) // 2 + 30] = bytes(30)
    found = kinds(bytes(whole))
    assert found.count("malformed") >= 1 and found.count("response") > 100


@given(st.binary(max_size=400))
def test_any_bytes_are_read_to_the_end(data):
    list(W.parse(data))
    list(W.parse(b"\x1f\x8b\x08" + data))
    list(W.parse(gzip.compress(b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n") + data))


def test_a_third_of_all_rows_without_id(spark):
    rows = [(None, "u", "<p>same</p>")] * 200 + [(i, "u", "<p>same</p>" if i % 2 else f"<p>{i}</p>") for i in range(100)]
    back = W.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert got(back) == want(rows)


def test_files_are_cut_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "FILE_BYTES", 5000)
    rows = [(i, "u", "x" * 1000 + str(i)) for i in range(50)]
    W.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"))
    assert len(list((tmp_path / "w").glob("*.gz"))) >= 10
