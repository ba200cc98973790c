"""Importers on small files in the formats' own shapes."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from notelake.sources import files, formats
from notelake.streaming import incremental


@pytest.fixture(scope="module")
def notes(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("in")
    put = lambda name, text: (root / name).write_bytes(text if isinstance(text, bytes) else text.encode())
    put("a.txt", "one  two\n & é")
    put(".hidden.txt", "x")
    put("b.md", "---\ntitle: T\ntags: '#x, y'\npinned: true\n---\n# H\n\nbody")
    put("c.html", "<html><head><title>Page</title><meta name=pinned content=true></head><body><p>x</p></body></html>")
    put("s.json", json.dumps({"activeNotes": [{"content": "first\nsecond", "creationDate": "2020-01-02T03:04:05Z", "lastModified": "2020-01-02T03:04:06Z", "tags": ["t"]}, {"content": "bad"}]}))
    put("n.enex", "<en-export><note><title>E</title><content><![CDATA[<?xml?><en-note><div>a </note> b</div></en-note>]]></content><created>20200102T030405Z</created><tag>p</tag><tag>q</tag><task><title>no</title></task></note><note><title>F</title></note></en-export>")
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("top/sub/d.txt", "in zip")
    put("z.zip", data.getvalue())
    put("broken.zip", b"PK junk")
    return files.expand(files.scan(spark, str(root)))


def _rows(result):
    return {r.src_path.rsplit("/", 1)[-1] + "|" + (r.title or ""): r for r in result.notes.collect()}


def test_archives_and_text(notes):
    found, errors = notes
    got = _rows(formats.text(found))
    assert set(got) == {"a.txt|a", "d.txt|d"}
    assert got["a.txt|a"].html == '<p data-spacing="single">one&nbsp;&nbsp;two</p><p data-spacing="single">&nbsp;&amp; &#xe9;</p>'
    assert [r.src_path.rsplit("/", 1)[-1] for r in errors.collect()] == ["broken.zip"]


def test_markdown_html_simplenote_evernote(notes):
    found, _ = notes
    md = _rows(formats.markdown(found))["b.md|T"]
    assert md.tags == ["x", "y"] and md.pinned and md.html == "\n<p>body</p>"
    assert _rows(formats.html(found))["c.html|Page"].html == "<p>x</p>"
    simple = formats.simplenote(found)
    assert _rows(simple)["s.json|first"].date_created == 1577934245000 and [r.note_title for r in simple.errors.collect()] == ["bad"]
    enex = _rows(formats.evernote(found))
    assert enex["n.enex#0|E"].tags == ["p", "q"] and enex["n.enex#0|E"].html == "<p>a  b</p>" and enex["n.enex#0|E"].date_created == 1577934245000 and "n.enex#1|F" in enex


def test_joplin(spark):
    rec = lambda i, text: (f"/j/{i}.md", text.encode())
    rows = [
        rec(1, "Note\n\nhello\nworld\n\nid: n1\nparent_id: f2\ncreated_time: 2020-01-02T03:04:05.000Z\ntype_: 1"), rec(2, "Root\n\nid: f1\nparent_id: \ntype_: 2"), rec(3, "Sub\n\nid: f2\nparent_id: f1\ntype_: 2"),
        rec(4, "tag b\n\nid: t1\ntype_: 5"), rec(5, "id: x\nnote_id: n1\ntag_id: t1\ntype_: 6"), rec(6, "odd\n\nid: q"),
    ]
    f = files.described(spark.createDataFrame(rows, "path string, content binary").withColumn("archive_name", F.lit(None).cast("string")))
    got = formats.joplin(f)
    note = got.notes.first()
    assert (note.title, note.notebooks, note.tags, note.html, note.date_created) == ("Note", [["Root", "Sub"]], ["tag b"], "<p>hello world</p>", 1577934245000)
    assert got.errors.count() == 1


def test_stream_imports_each_note_once(spark, tmp_path):
    for i in range(3):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / str(i)).mkdir()
        (tmp_path / "in" / str(i) / "a.txt").write_text("same" if i else "other")
    q = incremental.write(incremental.notes_once(incremental.text_files(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
