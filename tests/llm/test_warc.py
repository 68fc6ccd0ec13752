import base64
import hashlib
import time

from rollbook.llm import warc

PAGES = [
    (1, "http://h.example/a/b?x=1", "<!DOCTYPE html><html lang=\"en\"><head><title>A &amp; B</title><style>p{}</style></head><body><h1>Head</h1><p>One  two<br>three &lt;4&gt;</p><script>no()</script>"
        "<a href='../c?a=1&amp;b=2'>go</a><a href=\"http://[bad\">x</a><!-- <p>hidden</p> --></body></html>"),
    (2, None, None), (3, "", ""), (3, "", ""), (4, "http://h/", "plain < text"), (None, "http://h/n", "<script>never closed <p>x"), (5, "http://h/l", "<p>" + "long " * 60000),
]


def sha1(text):
    return "sha1:" + base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def test_records(spark):
    pages = spark.createDataFrame([(i, u, h, "x") for i, u, h in PAGES], "page_id long, url string, html string, header string").repartition(3)
    found = warc.responses(pages, date="2024-01-01T00:00:00Z")
    got = warc.derivatives(found).collect()
    assert len(got) == 2 * len(PAGES)
    for r in got:
        assert r.block_digest == sha1(r.block) and r.content_length == len(r.block.encode())
        assert f"WARC-Refers-To: {r.refers_to}\r\n" in r.header and f"WARC-Record-ID: {r.record_id}\r\n" in r.header and f"Content-Length: {r.content_length}\r\n" in r.header
        assert r.header.startswith("WARC/1.1\r\nWARC-Type: ") and r.header.endswith("\r\n\r\n")
    # both records of a response refer to it, and the ids are the response's own
    ids = {r.response_id for r in found.collect()}
    assert {r.refers_to for r in got} == ids and len({r.record_id for r in got}) == 2 * len(ids)
    one = {r.warc_type: r for r in got if r.id == 1}
    assert one["conversion"].block == "A & B\nHead\nOne two\nthree <4>\ngox"
    meta = one["metadata"].block
    assert "title: A & B\r\n" in meta and "language: en\r\n" in meta and "outlink: http://h.example/c?a=1&b=2\r\n" in meta and "outlink: http://[bad\r\n" in meta
    assert "source-content-type: text/html; charset=utf-8\r\n" in meta and f"source-payload-digest: {sha1(PAGES[0][2])}\r\n" in meta
    assert [r.block for r in got if r.id == 2 and r.warc_type == "conversion"] == [""]
    assert [r.block for r in got if r.id == 4 and r.warc_type == "conversion"] == ["plain < text"]
    assert [r.content_length for r in got if r.id == 5 and r.warc_type == "conversion"] == [299_999]
    assert sorted(map(str, got)) == sorted(map(str, warc.derivatives(found).collect()))
    assert warc.derivatives(found.limit(0)).count() == 0


def test_hostile_pages_take_one_pass():
    for page in ("<a" * 1_000_000, "<title>" * 300_000, "<html lang" * 200_000, "<p <a href=" * 200_000, "<script" * 300_000, "<!--" * 500_000, "< " * 1_000_000):
        began = time.process_time()
        warc.derive("<urn:uuid:0>", "http://h/", "", "", page)
        assert time.process_time() - began < 60
    assert warc.plain_text("a <b>bold</b> < c <a <p>next") == "a bold < c next"
