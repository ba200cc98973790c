"""Operator 7, WARC: a derivative builder.

Each response record becomes two records linked to it by WARC-Refers-To: a metadata record (application/warc-fields: title,
charset, out-links, the source's status line, headers and digests) and a conversion record (its text). Record ids are
derived from the response's id and the kind, so that a repeated task writes the same records. A map over records: nothing
is shuffled and no record waits for another.

Chunked and gzip or deflate bodies are decoded before their text is taken; block and payload digests stay those of the source.

Defined cases: null url or html are empty; records of other types (warcinfo, request, metadata ...) have no derivatives and
are passed over; a response that is not well-formed gives a row of record_type 'error' that says why and refers to the
record, and the other records of its row are not touched by it; where a file or its gzip stream breaks off, the records
before that place count and one 'error' row names the place; a null record is one 'error' row, an empty one holds no
records; repeated rows give repeated records; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

VERSION = b"WARC/1.1"
#: The capture date of records that come from a table of pages, which has none.
CAPTURED = "2024-01-01T00:00:00Z"
DERIVED = "page_id long, record_type string, record_id string, refers_to string, target_uri string, content_type string, content_length long, block_digest string, source_payload_digest string, record binary"

#: Elements whose content is no text, and those that stand on lines of their own.
_UNSEEN = ("script", "style", "noscript", "template", "head")
_BLOCKS = frozenset("address article aside blockquote br dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9]*)")
#: The rest of a tag: a value in quotes may hold '>'.
_TAG_END = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>""")
#: Media types that have a conversion: those whose markup is read, and those whose text is taken as it is.
_MARKUP = re.compile(r"(?i)\s*(?:text/html|application/xhtml\+xml|(?:text|application)/xml|[^;\s]+\+xml)\s*(?:;|$)")
_TEXTUAL = re.compile(r"(?i)\s*(?:text/[^;\s]+|application/(?:json|javascript|x-javascript|[^;\s]+\+json))\s*(?:;|$)")
_HREF = re.compile(r"(?is)(?:^|[\s\"'])href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_CHARSET = re.compile(rb"(?i)charset\s*=\s*[\"']?([\w.:-]+)")


#: Bytes of a gzip stream read at once.
_CHUNK = 1 << 16


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(chr(31).join(parts).encode()).digest()[:16], version=4)}>"


def build_record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A whole record. Line breaks in a value would end it, so they become spaces."""
    lines = [("WARC-Type", kind), *headers, ("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block)))]
    head = b"".join(f"{k}: {' '.join(v.splitlines())}\r\n".encode() for k, v in lines)
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def response_record(page_id: int | None, url: str | None, body: str | None) -> bytes:
    """The response record of a page."""
    payload = (body or "").encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    headers = [("WARC-Record-ID", record_id("response", str(page_id), url or "")), ("WARC-Date", CAPTURED), ("WARC-Target-URI", url or ""), ("WARC-Payload-Digest", digest(payload)), ("Content-Type", "application/http;msgtype=response")]
    return build_record("response", headers, block)


def _inflate(data: bytes) -> tuple[bytes, str]:
    """The bytes of gzip members as far as they can be read, and what is wrong with the rest."""
    out, at = [], 0
    while at < len(data):
        member, begin = zlib.decompressobj(31), at
        try:
            while at < len(data) and not member.eof:
                before = member.copy()
                out.append(member.decompress(data[at : at + _CHUNK]))
                at = min(at + _CHUNK, len(data))
        except zlib.error as e:
            for i in range(at, len(data)):  # what the chunk holds before the fault
                try:
                    out.append(before.decompress(data[i : i + 1]))
                except zlib.error:
                    break
            return b"".join(out), f"the gzip member at byte {begin} is broken: {e}"
        if not member.eof:
            return b"".join(out), f"the gzip member at byte {begin} is cut short"
        at -= len(member.unused_data)
        while data.startswith(b"\0", at):  # padding
            at += 1
    return b"".join(out), ""


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of a WARC file's bytes, gzip members or plain.

    ValueError where the records break off, after those before that place.
    """
    wrong = ""
    if data[:2] == b"\x1f\x8b":
        data, wrong = _inflate(data)
    try:
        yield from _split(data)
    except ValueError as e:
        raise ValueError(f"{e}; {wrong}" if wrong else str(e)) from e
    if wrong:
        raise ValueError(wrong)


def _split(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in data[at:end].decode("utf-8", "replace").split("\r\n")[1:])}
        size = int(headers.get("content-length", "-1"))
        if size < 0 or end + 4 + size > len(data):
            raise ValueError(f"a record at byte {at} is cut short")
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size
        while data.startswith(b"\r\n", at):
            at += 2


def _closers(lower: str, name: str) -> Iterator[int]:
    """Where the close tags of an element of just that name begin, in order: each place is searched once however often one is left open."""
    at, size = -1, len(name) + 2
    while (at := lower.find("</" + name, at + 1)) >= 0:
        if lower[at + size : at + size + 1] in ("", ">", "/", " ", "\t", "\n", "\f", "\r"):
            yield at
    while True:
        yield -1


def read_page(page: str) -> tuple[str, str | None, list[str]]:
    """(text, title, link targets) of a page, by one scan from left to right.

    Text: blocks on lines of their own, runs of white space closed up, no empty lines. An element without text that is never
    closed, as a comment, takes the rest of the page; a tag that is never closed is text.
    """
    lower = page.lower()
    if len(lower) != len(page):  # a few letters grow when lower-cased
        lower = "".join(c.lower() if c.isascii() else c for c in page)
    out: list[str] = []
    links: list[str] = []
    title, at = None, 0
    closers = {n: _closers(lower, n) for n in (*_UNSEEN, "title")}
    ahead = {n: -2 for n in closers}

    def close(name: str, place: int) -> int:
        while -1 != ahead[name] < place:
            ahead[name] = next(closers[name])
        return ahead[name]

    while (tag := page.find("<", at)) >= 0:
        out.append(page[at:tag])
        if page.startswith("<!--", tag):
            end = page.find("-->", tag + 4)
            at = len(page) if end < 0 else end + 3
            continue
        found = _NAME.match(page, tag + 1)
        if not found and page[tag + 1 : tag + 2] not in ("!", "?", "/"):
            out.append("<")
            at = tag + 1
            continue
        whole = _TAG_END.match(page, found.end()) if found else None
        end = whole.end() - 1 if whole else page.find(">", tag)
        if end < 0:
            out.append(page[tag:])
            at = len(page)
            break
        at = end + 1
        name = found[1].lower() if found else ""
        if name in _BLOCKS:
            out.append("\n")
        if not found or found[0].startswith("/"):
            continue
        if name == "a" and (link := _HREF.search(page, found.end(), end)):
            links.append(html.unescape(next(x for x in link.groups() if x is not None)).strip())
        elif name == "title" and title is None and (stop := close("title", at)) >= 0:
            title = " ".join(html.unescape(page[at:stop]).split())
        if name == "head":
            if (stop := close(name, at)) >= 0:
                title = read_page(page[at:stop])[1] if title is None else title
                out.append(" ")
                at = stop
        elif name in _UNSEEN:
            out.append(" ")
            at = len(page) if (stop := close(name, at)) < 0 else stop
    out.append(page[at:])
    return "\n".join(x for x in (" ".join(line.split()) for line in html.unescape("".join(out)).split("\n")) if x), title, links


def plain_text(page: str) -> str:
    return read_page(page)[0]


def decoded_body(payload: bytes, fields: list[str]) -> bytes:
    """A payload without its transfer and content encodings; ValueError where it doesn't follow them."""
    said = {k.strip().lower(): v.strip().lower() for k, _, v in (f.partition(":") for f in fields)}
    if "chunked" in said.get("transfer-encoding", ""):
        parts, at = [], 0
        while True:
            end = payload.find(b"\r\n", at)
            size = int(payload[at : max(end, at)].split(b";")[0], 16) if end >= 0 else -1
            if size < 0 or end + 2 + size > len(payload):
                raise ValueError("its chunked body is cut short")
            if not size:
                break
            parts.append(payload[end + 2 : end + 2 + size])
            at = end + 4 + size
        payload = b"".join(parts)
    coding = said.get("content-encoding", "")
    if coding not in ("", "identity", "gzip", "x-gzip", "deflate"):
        raise ValueError(f"its content encoding is not known: {coding}")
    if coding in ("gzip", "x-gzip", "deflate"):
        try:
            return zlib.decompress(payload, 47)
        except zlib.error as e:
            if coding == "deflate":
                try:
                    return zlib.decompress(payload, -15)
                except zlib.error:
                    pass
            raise ValueError(f"its {coding} body is broken: {e}") from e
    return payload


def derivatives(headers: dict[str, str], block: bytes) -> list[tuple[str, list[tuple[str, str]], bytes]]:
    """(kind, headers, block) of the metadata and, where its media type is text, the conversion record of a response.

    A response that names no type is taken for a page. Of other text than markup the lines are taken as they are.
    """
    if headers.get("warc-type") != "response":
        return []
    head, gap, payload = block.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"HTTP/"):
        raise ValueError("its block is no HTTP response")
    status, *fields = head.decode("utf-8", "replace").split("\r\n")
    payload = decoded_body(payload, fields)
    source, uri = headers.get("warc-record-id", ""), headers.get("warc-target-uri", "")
    kind_of = next((v for k, _, v in (f.partition(":") for f in fields) if k.strip().lower() == "content-type"), "")
    markup = not kind_of.strip() or bool(_MARKUP.match(kind_of))
    textual = markup or bool(_TEXTUAL.match(kind_of))
    found = _CHARSET.search(kind_of.encode()) or (_CHARSET.search(payload[:2048]) if markup else None)
    charset = found[1].decode("ascii", "replace").lower() if found else "utf-8"
    try:
        page = payload.decode(charset, "replace")
    except LookupError:
        page = payload.decode("utf-8", "replace")
    text, title, links = read_page(page) if markup else ("\n".join(x for x in (" ".join(line.split()) for line in page.split("\n")) if x) if textual else "", None, [])
    out = [] if title is None else [("title", title)]
    out += [*([("charset", charset)] if textual else []), ("source-status", status), *[("source-header", f) for f in fields]]
    out += [(f"source-{k}", headers[k]) for k in ("warc-payload-digest", "warc-block-digest", "content-length") if k in headers]
    for link in links:
        try:
            out.append(("outlink", urljoin(uri, link)))
        except ValueError:
            out.append(("outlink", link))
    common = [("WARC-Refers-To", source), ("WARC-Date", headers.get("warc-date", "")), ("WARC-Target-URI", uri)]
    fields_block = b"".join(f"{k}: {' '.join(v.splitlines())}\r\n".encode("utf-8", "replace") for k, v in out)
    metadata = ("metadata", [("WARC-Record-ID", record_id("metadata", source)), *common, ("Content-Type", "application/warc-fields")], fields_block)
    if not textual:
        return [metadata]
    return [
        metadata,
        ("conversion", [("WARC-Record-ID", record_id("conversion", source)), *common, ("WARC-Source-Payload-Digest", headers.get("warc-payload-digest", "")), ("Content-Type", "text/plain; charset=utf-8")], text.encode("utf-8", "replace")),
    ]


def _error(page_id: int | None, why: ValueError, headers: dict[str, str]) -> tuple:
    return page_id, "error", None, headers.get("warc-record-id"), headers.get("warc-target-uri"), None, None, None, None, str(why).encode()


def _rows(page_id: int | None, data: bytes | None) -> Iterator[tuple]:
    if data is None:
        yield _error(page_id, ValueError("no record"), {})
        return
    records = parse_records(data)
    while True:
        try:
            headers, block = next(records)
        except StopIteration:
            return
        except ValueError as e:
            yield _error(page_id, e, {})
            return
        try:
            found = derivatives(headers, block)
        except ValueError as e:
            yield _error(page_id, e, headers)
            continue
        for kind, own, derived in found:
            h = dict(own)
            yield page_id, kind, h["WARC-Record-ID"], h["WARC-Refers-To"], h["WARC-Target-URI"], h["Content-Type"], len(derived), digest(derived), headers.get("warc-payload-digest"), build_record(kind, own, derived)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), *[pa.string()] * 5, pa.int64(), pa.string(), pa.string(), pa.binary()]
    names = [c.split()[0] for c in DERIVED.split(", ")]
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            rows = [r for i, d in zip(part.column("page_id").to_pylist(), part.column("record").to_pylist()) for r in _rows(i, d)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _respond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            data = [response_record(*r) for r in zip(*[part.column(c).to_pylist() for c in ("page_id", "url", "html")])]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), pa.array(data, pa.binary())], ["page_id", "record"])


def responses(pages: DataFrame) -> DataFrame:
    """(page_id, record): a response record for each page."""
    return pages.select("page_id", "url", "html").mapInArrow(_respond, "page_id long, record binary")


def build_derivatives(records: DataFrame) -> DataFrame:
    """records: (page_id, record), where record holds whole WARC records, such as a file's content; a row per derivative."""
    return records.select("page_id", "record").mapInArrow(_build, DERIVED)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_derivatives(responses(spark.read.parquet(f"{sf_dir}/pages.parquet")))
