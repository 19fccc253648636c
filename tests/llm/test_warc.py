import base64
import hashlib

import pytest

from tallyforge.llm import queries, warc

PAGES = [(5, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (9, None, None), (7, "http://a/\r\nb", ""), (1, "u", "é" * 100_000), (3, "v", "<p>y</p>\r\n\r\nWARC/1.1"), (3, "v", "<p>y</p>\r\n\r\nWARC/1.1"), (8, "w", "<p>x</p>")]


def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_round_trip(spark):
    got = warc.read_archives(warc.write_archives(warc.plan_records(pages(spark)))).collect()
    first = {}
    for i, _, html in PAGES:
        first[html or ""] = min(first.get(html or "", 10**9), i)
    assert len(got) == len(PAGES)
    by_id = {i: html for i, _, html in PAGES}
    for r in got:
        i = int(r.record_id.rsplit(":", 1)[1])
        html = by_id[i] or ""
        assert r.problem is None and r.payload_digest == digest(html) and r.payload_bytes == len(html.encode())
        if first[html] == i:
            assert r.record_type == "response" and bytes(r.payload) == html.encode() and r.refers_to is None
        else:
            assert r.record_type == "revisit" and r.payload is None and r.refers_to == f"urn:page:{first[html]}"


def test_query(spark, tmp_path):
    pages(spark).write.parquet(str(tmp_path / "pages.parquet"))
    got = {(r.page_id, r.record_type, r.refers_to) for r in queries.op9_warc_reader(spark, str(tmp_path)).collect()}
    assert got == {(5, "revisit", 2), (2, "response", None), (8, "revisit", 2), (7, "response", None), (9, "revisit", 7), (1, "response", None), (3, "response", None)}


def test_archives_are_cut(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 300)
    got = warc.write_archives(warc.plan_records(pages(spark)).coalesce(1))
    assert got.count() > 1


def test_members_and_framing():
    raws = [warc.record_bytes(f"urn:page:{i}", "u", b"x" * i, "response", None) for i in (0, 1, 70_000)]
    import gzip

    content = b"".join(map(gzip.compress, raws))
    assert list(warc.members(content)) == raws
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.members(content[:-5]))
    good = warc.parse_record(raws[1])
    assert good["problem"] is None and good["payload"] == b"x"
    assert warc.parse_record(raws[1].replace(b"\r\n\r\nx\r\n", b"\r\n\r\ny\r\n"))["problem"] == "block digest"
    assert warc.parse_record(raws[1][:-1])["problem"] == "framing"


def test_files_on_disk(spark, tmp_path):
    for r in warc.write_archives(warc.plan_records(pages(spark))).collect():
        (tmp_path / r["name"]).write_bytes(r["content"])
    read = warc.read_archives(spark.read.format("binaryFile").load(str(tmp_path)))
    assert read.count() == len(PAGES) and read.where("problem is not null").count() == 0


def test_empty_and_extra_columns(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(warc.plan_records(none))).count() == 0
    more = spark.createDataFrame([(1, "u", "h", "x", "y")], "page_id long, url string, html string, kind string, uri string")
    assert warc.plan_records(more).first().kind == "response"


def chunked(text):
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in (text[:7], text[7:])) + b"0\r\n\r\n"


def real_archive():
    """What crawlers write: warcinfo, request, a chunked response, metadata, a resource, and records with faults."""
    import gzip

    def record(kind, block, *fields, content="application/http;msgtype=response", end=b"\r\n\r\n", version="WARC/1.0", name="a"):
        lines = [version, f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", "WARC-Date: 2024-01-01T00:00:00Z", f"Content-Type: {content}", *fields, f"Content-Length: {len(block)}"]
        return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + end)

    page = b"<html>chunked body</html>"
    head = b"HTTP/1.1 200 OK\r\ntransfer-encoding: chunked\r\n\r\n"
    return [
        record("warcinfo", b"software: x\r\n", content="application/warc-fields", name="info"),
        record("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", content="application/http;msgtype=request", name="request"),
        record("response", head + chunked(page), f"WARC-Payload-Digest: sha1:{digest(page.decode())}", "WARC-Target-URI: <http://a/>", name="chunked"),
        record("response", b"HTTP/1.1 200 OK\r\n\r\nbody", "warc-target-uri: http://b/", f"WARC-Block-Digest: md5:{hashlib.md5(b'HTTP/1.1 200 OK' + bytes([13, 10, 13, 10]) + b'body').hexdigest()}", name="plain"),
        record("metadata", b"fetchTimeMs: 5", content="application/warc-fields", name="metadata"),
        record("resource", b"\0\1\2", content="image/png", name="resource"),
        record("revisit", b"HTTP/1.1 200 OK\r\nContent-Length: 9\r\n\r\n", "WARC-Refers-To: <urn:uuid:plain>", "WARC-Profile: x", name="revisit"),
        record("response", b"HTTP/1.1 200 OK\r\n\r\nbody", "WARC-Payload-Digest: sha1:AAAA", name="digest"),
        record("response", b"no head", name="nohead"),
        record("response", head + b"zz\r\n", name="chunks"),
        record("metadata", b"x", end=b"\r\n", name="framing"),
        record("metadata", b"x", version="ARC/1", name="version"),
        gzip.compress(b"WARC/1.0\r\nWARC-Type: metadata\r\nWARC-Record-ID: <urn:uuid:none>\r\n\r\nx\r\n\r\n"),
        gzip.compress(b"not a record"),
    ]


def test_records_of_a_real_archive(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(b"".join(real_archive()) + b"junk")
    (tmp_path / "b.warc.gz").write_bytes(b"".join(real_archive()[:3])[:-4])
    files = spark.createDataFrame([(str(tmp_path / "a.warc.gz"),)], "path string")
    got = warc.read_files(files).collect()
    by = {(r.record_id or "").rsplit(":", 1)[-1]: r for r in got}
    assert len(got) == 15
    assert {k for k, r in by.items() if r.problem is None} == {"info", "request", "chunked", "plain", "metadata", "resource", "revisit"}
    assert {k: r.problem for k, r in by.items() if k and r.problem} == {"digest": "payload digest", "nohead": "http head", "chunks": "chunks", "framing": "framing", "version": "version", "none": "content length"}
    assert sorted(r.problem for r in got if r.record_id is None)[1] == "head"
    assert bytes(by["chunked"].payload) == b"<html>chunked body</html>" and by["chunked"].target_uri == "http://a/" and by["chunked"].payload_digest == digest("<html>chunked body</html>")
    assert bytes(by["plain"].payload) == b"body" and by["plain"].payload_digest == digest("body") and by["plain"].target_uri == "http://b/"
    assert bytes(by["resource"].payload) == b"\0\1\2" and by["info"].target_uri is None
    assert by["revisit"].payload is None and by["revisit"].payload_bytes == 9 and by["revisit"].refers_to == "urn:uuid:plain"
    cut = warc.read_archives(spark.read.format("binaryFile").load(str(tmp_path / "b.warc.gz"))).collect()
    assert [r.problem for r in cut] == [None, None, "the archive ends inside a gzip member"]


def test_reading_by_small_pieces():
    content = b"".join(real_archive()[:9])
    whole = [r.told() for r in warc.records([content])]
    assert [r.told() for r in warc.records(content[i : i + 3] for i in range(0, len(content), 3))] == whole and len(whole) == 9


def test_files_are_written_and_read(spark, tmp_path, monkeypatch):
    rows = warc.plan_records(pages(spark))
    files = warc.write_files(rows, str(tmp_path / "out")).cache()
    listed = files.collect()
    assert sum(r.n_records for r in listed) == len(PAGES) and all(r.path.endswith(".warc.gz") for r in listed)
    want = {(r.record_id, r.record_type, r.refers_to, r.payload_digest) for r in warc.read_archives(warc.write_archives(rows)).collect()}
    got = warc.read_files(files).collect()
    assert len(got) == len(PAGES) and {(r.record_id, r.record_type, r.refers_to, r.payload_digest) for r in got} == want
