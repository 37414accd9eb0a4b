"""Legacy archives converted to WARC and read back, against brute force and by the bytes."""

import gzip
import hashlib
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from dieflow.llm import warc

PAGES = "page_id bigint, url string, html string"


def archived_by_hand(rows, least=1000):
    out, best = [], {}
    for page, _, html in rows:
        data = (html or "").encode()
        k = -1 if page is None else page
        best[data] = max(k, best.get(data, k))
    stored = set()
    for page, _, html in rows:
        data, k = (html or "").encode(), -1 if page is None else page
        digest = hashlib.sha1(data).hexdigest()
        first = k == best[data] and data not in stored
        if len(data) < least or first:
            stored |= {data} if first else set()
            out.append((page, len(data), digest, "response", None))
        else:
            out.append((page, len(data), digest, "revisit", None if best[data] < 0 else best[data]))
    return Counter(out)


def odd_pages():
    big, other = "<p>a\n\nb\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" + "ä" * 600, "x" * 1000
    rows = [(i, f"http://h.example/{i % 3}", big if i % 3 == 0 else other if i % 3 == 1 else f"page {i}") for i in range(30)]
    rows += [(29, "http://h.example/a b\nc", other)] * 2 + [(None, None, big), (None, "", None), (40, "http://é.example/", ""), (41, None, "short"), (42, "u", "short")]
    rows += [(None, "u", "y" * 2000)] * 3 + [(50, "u", "long " * 400_000), (51, "v", "long " * 400_000), (52, "w", "\n" * 1500), (53, "http://h/ 0.0.0.0 19970401000000 text/html 7", "\n1 0 x\nhttp://u 1.2.3.4 19970101000000 text/html 9\n")]
    return rows


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(odd_pages(), PAGES).withColumns({c: F.lit("x") for c in ("id", "value", "sha1", "original", "file")})


def test_archived_equals_brute_force(pages):
    assert Counter(map(tuple, warc.archived(pages.repartition(3)).collect())) == archived_by_hand(odd_pages())


def test_hot_payload_is_dealt_out(spark, pages, tmp_path):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        arcs = warc.write_arc(pages.repartition(3), f"{tmp_path}/arc")
        back = warc.read_warc(spark, warc.convert(spark, arcs, f"{tmp_path}/warc", slots=4, hot=2), payload=True)
        got = back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
        assert Counter(map(tuple, got.collect())) == archived_by_hand(odd_pages())
        assert back.where(~F.col("intact")).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_no_pages(pages):
    assert warc.archived(pages.limit(0)).count() == 0


def files(path):
    return {n: gzip.open(f"{path}/{n}").read() for n in sorted(os.listdir(path)) if n.endswith(".gz")}


def test_round_trip_of_the_bytes(spark, pages, tmp_path):
    arcs = warc.write_arc(pages.repartition(4), f"{tmp_path}/arc")
    versions = {data.split(b"\n")[1][:1] for data in files(arcs).values() if data}
    assert versions == {b"1", b"2"}
    for data in filter(None, files(arcs).values()):  # declared places are those of the records
        for r in warc.ArcRecords("f").feed(data):
            assert data[r[0] :].startswith(r[2].encode())
    read = warc.read_arc(spark, arcs)
    payloads = Counter((p, (h or "").encode()) for p, _, h in odd_pages())
    assert Counter((r.page_id, warc.http_split(bytes(r.block))[1]) for r in read.collect()) == payloads
    out = warc.convert(spark, arcs, f"{tmp_path}/warc")
    back = warc.read_warc(spark, out, payload=True).collect()
    assert all(r.intact for r in back) and len({r.record_id for r in back}) == len(back)
    stored = {r.record_id: r for r in back if r.record_type == "response"}
    for r in back:
        if r.record_type == "revisit":
            assert stored[r.refers_to_record].payload_digest == r.payload_digest and r.payload is None
    assert Counter((r.page_id, bytes(r.payload)) for r in stored.values()) <= payloads
    assert {r.uri for r in back if r.page_id == 29} == {"http://h.example/2", "http://h.example/a%20b%0Ac"}
    for data in filter(None, files(out).values()):  # every file is a WARC of its own
        kinds = [named["warc-type"] for named, _ in warc.WarcRecords("f").feed(data)]
        assert kinds[0] == "warcinfo" and set(kinds[1:]) <= {"response", "revisit"} and data.endswith(b"\r\n\r\n")


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("step", [1, 7, 10_000])
def test_records_come_whole_in_any_pieces(version, step):
    bodies = [b"HTTP/1.0 404 Not Found\n\nbody\n\n", b"", b"v=1 DNS\n", b"HTTP/1.1 200 OK\r\n\r\n"]
    urls = [b"http://a b/", b"ftp://x", b"dns:a.example", b"http://c/"]
    data, offsets = warc.arc_head(version, "old.arc", "19960923142103") + b"\n", []
    for u, body in zip(urls, bodies):
        offsets.append(len(data))
        data += warc.arc_line(version, u, "127.0.0.1", "199609231421", "text/html; charset=x", 200, 0, "old.arc", len(body)) + b"\n" + body + b"\n"
    reader = warc.ArcRecords("old")
    got = [r for at in range(0, len(data), step) for r in reader.feed(data[at : at + step])]
    reader.end()
    assert [(r[0], r[2].encode(), r[5], r[7]) for r in got] == [(o, u, "text/html; charset=x", b) for o, u, b in zip(offsets, urls, bodies)]
    assert {r[1] for r in got} == {version} and got[0][6] == (404 if version == 1 else 200)


def test_broken_files_are_refused():
    whole = warc.arc_head(1, "f", "19960923142103") + b"\nhttp://a 1.2.3.4 19970101000000 text/html 10\n12345"
    reader = warc.ArcRecords("f")
    assert list(reader.feed(whole)) == []
    with pytest.raises(ValueError, match="ends inside"):
        reader.end()
    with pytest.raises(ValueError, match="no header"):
        list(warc.ArcRecords("f").feed(whole[:-5] + b"1234567890\nnot a header\n"))
    with pytest.raises(ValueError, match="doesn't start"):
        list(warc.ArcRecords("f").feed(b"http://a 1.2.3.4 19970101000000 text/html 3\nabc\n"))


def test_made_up_fields():
    assert warc.warc_date("19960923142103") == "1996-09-23T14:21:03Z" and warc.warc_date("199609231421") == "1996-09-23T14:21:00Z"
    assert warc.record_id("f", 5) == warc.record_id("f", 5) != warc.record_id("f", 6)
    assert warc.hex_digest(warc.labelled_digest("da39a3ee5e6b4b0d3255bfef95601890afd80709")) == "da39a3ee5e6b4b0d3255bfef95601890afd80709"
    row = {"id": "urn:uuid:1", "url": "ftp://x", "ip": "1.2.3.4", "date": "199609231421", "type": "text/plain", "page_id": None, "payload_bytes": 3, "sha1": hashlib.sha1(b"abc").hexdigest(), "original": None, "block": b"abc"}
    named, block = next(warc.WarcRecords("f").feed(warc._converted(row) + b"\r\n\r\n"))
    assert named["warc-type"] == "resource" and named["content-type"] == "text/plain" and block == b"abc"
    assert b"WARC-Type: response" in warc._converted(row | {"url": "dns:x"})
