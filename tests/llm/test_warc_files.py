"""Rows that hold a whole WARC file: a record that gives no derivative does not touch the others."""

import gzip
import random
import time

import pytest

from notelake.llm import warc

INFO = warc.build_record("warcinfo", [("WARC-Record-ID", "<urn:info>")], b"software: x\r\n")
REQUEST = warc.build_record("request", [("WARC-Record-ID", "<urn:request>"), ("WARC-Target-URI", "http://h.example/1")], b"GET / HTTP/1.1\r\n\r\n")
NOISE = "".join(random.Random(1).choices("abcdefghij klmnop", k=300_000))
ONE, TWO = (warc.response_record(i, f"http://h.example/{i}", f"<title>{i}</title><p>page {i}</p>{NOISE}") for i in (1, 2))
KINDS = ["metadata", "conversion"]


def _kinds(spark, data: bytes) -> list[str]:
    got = warc.build_derivatives(spark.createDataFrame([(7, bytearray(data))], "page_id long, record binary")).collect()
    assert all(r.page_id == 7 for r in got)
    return [r.record_type for r in got]


def test_records_beside_responses(spark):
    got = warc.build_derivatives(spark.createDataFrame([(7, bytearray(INFO + REQUEST + ONE + TWO)), (7, bytearray(b""))], "page_id long, record binary")).collect()
    assert [r.record_type for r in got] == KINDS * 2
    ids = [next(warc.parse_records(x))[0]["warc-record-id"] for x in (ONE, TWO)]
    assert [r.refers_to for r in got] == [ids[0], ids[0], ids[1], ids[1]]
    assert [next(warc.parse_records(bytes(r.record)))[1][:6] for r in got if r.record_type == "conversion"] == [b"1\npage", b"2\npage"]


def test_warcinfo_response_and_a_cut_record(spark):
    assert _kinds(spark, INFO + ONE + TWO[:-100]) == [*KINDS, "error"]


def test_encoded_bodies(spark):
    import zlib

    def response(fields: bytes, body: bytes) -> bytes:
        return warc.build_record("response", [("WARC-Record-ID", "<urn:r>")], b"HTTP/1.1 200 OK\r\n" + fields + b"\r\n\r\n" + body)

    page = b"<title>T</title><p>one<p>two"
    chunked = b"5;x=y\r\n" + page[:5] + b"\r\n%x\r\n" % (len(page) - 5) + page[5:] + b"\r\n0\r\n\r\n"
    raw = zlib.compressobj(wbits=-15)
    bodies = [
        (b"Transfer-Encoding: chunked", chunked), (b"Content-Encoding: gzip", gzip.compress(page)), (b"Content-Encoding: deflate", zlib.compress(page)),
        (b"Content-Encoding: deflate", raw.compress(page) + raw.flush()),
    ]
    for fields, body in bodies:
        kinds = dict((k, b) for k, _, b in warc.derivatives(*next(warc.parse_records(response(fields, body)))))
        assert kinds["conversion"] == b"T\none\ntwo" and b"title: T\r\n" in kinds["metadata"]
    assert _kinds(spark, response(b"Content-Encoding: gzip", b"junk") + response(b"Transfer-Encoding: chunked", b"9\r\nab") + ONE) == ["error", "error", *KINDS]


@pytest.mark.parametrize("piece", ["<script ", "<script>", "<!--", "<a ", "<a href=", "<head>", "<title>", "<p", "<", "</script"])
def test_long_pages_of_open_tags(piece):
    began = time.process_time()
    warc.read_page(piece * (1_000_000 // len(piece)))
    assert time.process_time() - began < 2


def test_text_of_a_page():
    page = "a<b>b</b>c <!-- x > y --> 1 < 2 &lt;p&gt;<style>p</style>d<script>'<p>'</script >e<br/>f</DIV>g<x"
    assert warc.read_page(page) == ("abc 1 < 2 <p> d e\nf\ng<x", None, [])
    assert warc.read_page("<HEAD><TITLE>A\n&amp; B</TITLE><title>C</title></HEAD><a class=x HREF='u?a&amp;b'>l</a><a name=n>m</a>") == ("lm", "A & B", ["u?a&b"])


def test_a_bad_response_among_good_ones(spark):
    bad = warc.build_record("response", [("WARC-Record-ID", "<urn:bad>")], b"no http")
    assert _kinds(spark, ONE + bad + TWO) == [*KINDS, "error", *KINDS]


def test_broken_tails(spark):
    assert _kinds(spark, ONE + TWO[:-500]) == [*KINDS, "error"]
    assert _kinds(spark, ONE + b"junk") == [*KINDS, "error"]
    members, solid = gzip.compress(ONE) + gzip.compress(TWO), gzip.compress(ONE + TWO)
    assert _kinds(spark, members) == _kinds(spark, solid) == _kinds(spark, members + b"\0" * 9) == KINDS * 2
    assert _kinds(spark, members[:-1000]) == _kinds(spark, solid[:-1000]) == [*KINDS, "error"]
    assert _kinds(spark, gzip.compress(ONE) + b"junk") == [*KINDS, "error"]
    assert _kinds(spark, members[:-6] + b"\xff" + members[-5:]) == [*KINDS * 2, "error"]  # only the check sum is wrong


@pytest.mark.parametrize("cut", [0, 1, 12, 70_000, 100_000])
def test_inflate_keeps_all_before_the_cut(cut):
    data = gzip.compress(ONE)
    got, wrong = warc._inflate(data[: len(data) - cut])
    assert ONE.startswith(got) and bool(wrong) == bool(cut) and (cut > 12 or len(got) > len(ONE) - 100)
