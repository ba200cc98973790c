"""The page reader against Python's own HTML parser, and what gives no text."""

from __future__ import annotations

import html.parser

import pytest

from notelake.llm import warc


class Reader(html.parser.HTMLParser):
    """Text outside of elements without text, blocks on lines of their own."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts, self.unseen = [], 0

    def handle_starttag(self, tag, attrs):
        self.unseen += tag in warc._UNSEEN
        if tag in warc._BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        self.unseen -= tag in warc._UNSEEN
        if tag in warc._BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.unseen:
            self.parts.append(data)


def test_pages_as_another_parser_reads_them(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    assert len(pages) == 250
    for page in pages:
        reader = Reader()
        reader.feed(page)
        reader.close()
        want = [" ".join(x.split()) for x in "".join(reader.parts).split("\n")]
        assert warc.plain_text(page) == "\n".join(x for x in want if x)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<html><head><title>T</title><body><p>keep me</p><header>H</header><p>x</p>", "keep me\nH\nx"),
        ("<head><title>T</title></head><body><header>H</header>x", "H\nx"),
        ('<p><img alt="x > y">z</p>', "z"),
        ("<p data-a='1>2' b=\"3>\">z<i title=it's>k</i> don't</p>", "zk don't"),
        ('<a href="open>text</a> more', "text more"),
        ("<script>a</scripts>b</script>c", "c"),
        ('<p x="' * 3000 + ">y", "y"),
    ],
)
def test_tags(page, text):
    got = warc.plain_text(page)
    assert got == text or (page.startswith("<html><head>") and got.endswith(text))


def _kinds(fields: bytes, body: bytes) -> dict:
    record = warc.build_record("response", [("WARC-Record-ID", "<urn:r>")], b"HTTP/1.1 200 OK\r\n" + fields + b"\r\n\r\n" + body)
    return {k: next(warc.parse_records(warc.build_record(k, h, b)))[1] for k, h, b in warc.derivatives(*next(warc.parse_records(record)))}


def test_media_types():
    assert set(_kinds(b"Content-Type: image/png", b"\x89PNG\0\xff")) == {"metadata"}
    assert _kinds(b"Content-Type: text/plain; charset=latin-1", b"a <b>\r\n\r\n  c \xe9")["conversion"] == "a <b>\nc é".encode()
    assert _kinds(b"Content-Type: application/xhtml+xml", b"<p>a</p>")["conversion"] == b"a"
    assert _kinds(b"X: y", b"<p>a</p>")["conversion"] == b"a"


@pytest.mark.parametrize("coding", [b"br", b"zstd", b"gzip, br", b"gzip, gzip"])
def test_unknown_codings_are_errors(spark, coding):
    record = warc.build_record("response", [("WARC-Record-ID", "<urn:r>")], b"HTTP/1.1 200 OK\r\nContent-Encoding: " + coding + b"\r\n\r\nxx")
    got = warc.build_derivatives(spark.createDataFrame([(7, bytearray(record))], "page_id long, record binary")).collect()
    assert [r.record_type for r in got] == ["error"]
