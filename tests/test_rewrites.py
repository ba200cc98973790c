"""Rewrites of markup, resources, and functions on links, styles and tags."""

import pytest
from pyspark.sql import functions as F

from notelake.functions import columns as C
from notelake.operators import joins as J
from notelake.operators import rewrites as R
from notelake.operators import spans as S
from notelake.operators import tokens as T

CASES = [
    ("div-to-p", "<div>plain <b>bold</b></div>", "<p>plain <b>bold</b></p>"),
    ("div-to-p", "</i><div>a </u> b</div></div>", "<p>a  b</p>"),
    ("div-to-p", '<div dir="rtl" class="x" style="color: red">a</div>', '<p dir="rtl" style="color: red">a</p>'),
    ("div-to-p", "<div>one<ul><li>x</li></ul> <hr>two</div>", "<p>one</p><ul><li>x</li></ul><hr><p>two</p>"),
    ("div-to-p", '<div style="text-align: right"><div>a</div><div style="color: red">b</div></div>', '<p style="text-align: right">a</p><p style="color: red; text-align: right">b</p>'),
    ("div-to-p", "<div></div>t<div><div> </div></div>", "<p></p>t<p> </p>"),
    ("br-to-p", "<p>a<br>b<br/>c</p>", '<p>a</p><p data-spacing="single">b</p><p data-spacing="single">c</p>'),
    ("br-to-p", '<p class="k"><b>a<br>b</b> c</p>', '<p class="k"><b>a</b></p><p class="k" data-spacing="single"><b>b</b> c</p>'),
    ("br-to-p", "<p><br></p><p>a<br></p>", "<p></p><p>a</p>"),
    ("br-to-p", "a <i>b</i><br>c<br><p>d</p>", '<p data-spacing="single">a <i>b</i></p><p data-spacing="single">c</p><p>d</p>'),
    ("br-to-p", "<ul></ul><br><p>d</p>", '<ul></ul><p data-spacing="single"></p><p data-spacing="single">d</p>'),
    ("checked-lists", '<ul><li data-checked="true">a</li><li data-checked="false">b</li></ul>', '<ul class="checklist"><li class="checklist--item checked">a</li><li class="checklist--item">b</li></ul>'),
    (
        "collapsibles",
        '<div class="shine-collapsible-section"><div class="shine-section-title-inner">T &amp; U</div><div class="shine-section-content-inner"><p>x</p></div></div>',
        '<div class="callout" data-callout-type="info"><h3>T &amp; U</h3><p>x</p></div>',
    ),
    ("code-languages", '<pre data-code-language="go">x</pre>', '<pre class="language-go">x</pre>'),
    ("aligned-blocks", '<h1 style="text-align: center">x</h1><p style="text-align: left">y</p>', '<h1 style="text-align: center"><p style="text-align: center">x</p></h1><p style="text-align: left">y</p>'),
    ("en-todo", '<ul><li><en-todo checked="true"></en-todo>a</li><li><en-todo/>b</li></ul><en-todo></en-todo>', '<ul class="checklist"><li class="checked">a</li><li>b</li></ul>'),
    ("en-codeblock", '<div style="-en-codeblock: true"><div>a &lt; b</div><div>é</div></div>', "<pre>a &lt; b<br/>&#233;</pre>"),
    ("div-to-p", '<!DOCTYPE html><p title="a&amp;b" hidden>x &nbsp;&#38; <!-- c --></i><img src=u>', '<!DOCTYPE html><p title="a&amp;b" hidden>x &nbsp;&#38; <!-- c --><img src=u>'),
    ("div-to-p", "<div>a<div>b</div><p>c</div>", "<p>a</p><p>b</p><p><p>c</p>"),
    ("div-to-p", "", ""),
    ("br-to-p", "<p><b>a<i>b<br>c<br> <br></i></b></p>", '<p><b>a<i>b</i></b></p><p data-spacing="single"><b><i>c</i></b></p><p data-spacing="single"></p>'),
    ("colors", '<span class="shine-highlight-red" style="x: y;">a</span><span class="shine-text-blue">b</span><span class="shine-text-none">c</span>', '<span style="x: y;background-color: #F9DFDE;">a</span><span style="color: #396FEF;">b</span><span class="shine-text-none">c</span>'),
    ("zn-checklists", '<div class="x checklist">t<checkbox checked="true">a <b>b</b></checkbox> <checkbox/></div>', '<ul class="checklist"><li class="checked">a <b>b</b></li><li></li></ul>'),
    ("div-to-p", None, None),
]


@pytest.mark.parametrize("name", sorted({c[0] for c in CASES}))
def test_rewrite(spark, name):
    cases = {i: c for i, c in enumerate(CASES) if c[0] == name}
    rows = spark.createDataFrame([(i, c[1]) for i, c in cases.items()], "i int, html string")
    got = {r.i: r.html for r in R.rewrite(rows, "i", name).collect()}
    assert got == {i: c[2] for i, c in cases.items()}


def test_pages_skip_rewrites_they_have_nothing_for(spark, monkeypatch):
    pages = [c[1] for c in CASES] + ["<u></i>a</u></div>", '<div class="shine-collapsible-section"><b><div class="shine-section-title-inner">t<i></b></div></i><div class="shine-section-content-inner">x</div></div>']
    rows = spark.createDataFrame(list(enumerate(pages)), "i int, html string")
    names = ["collapsibles", "div-to-p", "aligned-blocks"]
    got = {r.i: r.html for r in R.rewrite(rows, "i", *names).collect()}
    monkeypatch.setattr(R, "NEEDS", {})
    assert got == {r.i: r.html for r in R.rewrite(rows, "i", *names).collect()}
    monkeypatch.undo()

    def never(x, key):
        raise AssertionError("no page has anything for it")

    monkeypatch.setitem(R.REWRITES, "en-todo", never)
    plain = spark.createDataFrame([(1, "<p>a</i></p></b>"), (2, None)], "i int, html string")
    assert {r.i: r.html for r in R.rewrite(plain, "i", "colors", "en-todo").collect()} == {1: "<p>a</p>", 2: None}


def test_title_is_one_pass_and_leaves_the_body(spark):
    page = "<script><h1>no</h1></script><!-- <h2>no</h2> --><body><H1 class=x>A <i>b</i></H1><p>t</p><h2>c</h2></body>"
    many = "<p>x</p>" * 20_000 + "<h2>late</h2>"
    rows = spark.createDataFrame([(page,), ("<p>none</p>",), (many,), ("<h1>open",), (None,)], "h string")
    tags = ["title", "h1", "h2"]
    got = rows.select(T.element_text(T.tokenize(F.col("h")), tags).alias("t"), T.without_first(F.col("h"), tags).alias("w")).collect()
    assert [r.t for r in got] == ["A b", None, "late", "open", None]
    assert got[0].w == page.replace("<H1 class=x>A <i>b</i></H1>", "") and got[1].w == "<p>none</p>" and got[3].w == ""


def test_resources_become_attachments(spark):
    png = bytes.fromhex("89504E470D0A1A0A") + b"data"
    html = '<p><img src="pic.png" title="T"><a href="../doc%20x.pdf">read <b>me</b></a> <a href="http://x/">out</a><img src="gone.png"></p>'
    notes = spark.createDataFrame([("n/a/note.html", html), ("b.html", "<p>x</p>")], "src_path string, html string")
    files = spark.createDataFrame(
        [("n/a/pic.png", "pic.png", "png", bytearray(png), 1), ("n/a/pic.png", "later.png", "png", bytearray(b"z"), 2), ("n/doc x.pdf", "doc x.pdf", "pdf", bytearray(b"abc"), 0)], "path string, name string, ext string, content binary, entry_ord int"
    )
    out, attachments, blobs = T.import_resources(notes, files, "src_path", "src_path")
    got = {r.src_path: r.html for r in out.collect()}
    hashes = {r.filename: (r.hash, r.mime, r.size) for r in attachments.collect()}
    assert set(hashes) == {"T.png", "doc x.pdf"} and hashes["T.png"][1:] == ("image/png", 12) and hashes["doc x.pdf"][1:] == ("application/pdf", 3)
    assert blobs.count() == 2 and got["b.html"] == "<p>x</p>"
    image = f'<img class="attachment" data-filename="T.png" data-size="12" data-hash="{hashes["T.png"][0]}" data-mime="image/png" alt="T.png" />'
    assert got["n/a/note.html"].startswith("<p>" + image + '<span class="attachment" data-filename="doc x.pdf"') and got["n/a/note.html"].endswith('</span> <a href="http://x/">out</a><img src="gone.png"></p>')
    own = spark.createDataFrame([("gone.png", "own.txt", "txt", bytearray(b"own"))], "source string, name string, ext string, content binary")
    assert T.import_resources(notes, files, "src_path", "src_path", given=own)[1].where("filename = 'own.txt'").count() == 1


def test_links_styles_and_tags(spark):
    row = spark.range(1).select(
        C.is_evernote_link(F.lit("evernote:///view/1/s1/a/b/")).alias("own"),
        C.is_evernote_link(F.lit("https://www.evernote.com/shard/s1/nl/1/a/")).alias("web"),
        C.is_evernote_link(F.lit("https://www.evernote.com/shard/s1")).alias("short"),
        C.data_url(F.lit("data:image/png;base64,YWJj")).alias("data"),
        C.data_url(F.lit("http://x")).alias("none"),
        C.web_clip_footer(F.lit("http://x"), F.lit(None)).alias("footer"),
        C.element_type(F.lit("color: red; --en-codeblock: true")).alias("kind"),
        C.distinct_tags(F.array(F.lit("#b"), F.lit("a"), F.lit("b"), F.lit("#"))).alias("tags"),
        C.xml_text(F.lit("A &amp; B &lt;&#233;&#x1F600;&bad; &amp;lt;")).alias("xml"),
        C.bracket_checklist(F.lit("[V] a\n[ ] b\nc")).alias("list"),
        C.human_size(F.lit(0)).alias("zero"),
        R.task_list(F.array(F.struct(F.lit("t").alias("title"), F.lit(True).alias("done")))).alias("tasks"),
    ).first()
    assert (row.own, row.web, row.short) == (True, True, False)
    assert row.data.mime == "image/png" and bytes(row.data.data) == b"abc" and row.none is None
    assert row.footer == '<hr></hr><p>Clipped from: <a href="http://x">http://x</a></p>' and row.kind == "en-codeblock" and row.tags == ["b", "a"]
    assert row.xml == "A & B <é😀&bad; &lt;" and row.list.count("<li") == 2 and row.tasks == '<ul class="checklist"><li class="checked">t</li></ul>'


def test_joins_by_parts_of_paths(spark):
    files = spark.createDataFrame([("/a/b/c.png",), ("/x/resources/0123abcd.pdf",), ("/m/n/k.txt",)], "path string")
    pairs = lambda df, c: sorted((r.path, r[c]) for r in df.collect())
    links = spark.createDataFrame([("c.png",), ("/b/c.png",), ("",), ("nothing.png",)], "suffix string")
    assert pairs(J.suffix_join(files, links, "path", "suffix", 6), "suffix") == [("/a/b/c.png", "/b/c.png"), ("/a/b/c.png", "c.png")]
    ids = spark.createDataFrame([("0123abcd",), ("ffffffff",)], "id string")
    assert pairs(J.token_contains(files, ids, "path", "id", "[0-9a-f]{8}"), "id") == [("/x/resources/0123abcd.pdf", "0123abcd")]
    near = spark.createDataFrame([("n/k.txt",), ("m/k.txt",)], "rel string")
    assert pairs(J.relative_path_join(files, near, "path", "rel"), "rel") == [("/m/n/k.txt", "n/k.txt")]
    lists = spark.createDataFrame([("k", 2, "late"), ("k", 1, "first")], "stem string, ord int, paths string")
    got = J.lookup_left(spark.createDataFrame([("k",), ("l",)], "stem string"), lists, "stem", "ord").collect()
    assert sorted((r.stem, r.paths) for r in got if r.paths) == [("k", "first")] and len(got) == 2
    texts = spark.createDataFrame([(1, "the lazy dog"), (2, "a b"), (3, None)], "t int, text string")
    passages = spark.createDataFrame([(1, "zy d"), (2, "a"), (3, "the lazy dog"), (4, "lazy"), (5, "q")], "p int, text string")
    assert sorted((r.t, r.p) for r in J.contains_join(texts, passages, "t", "p").collect()) == [(1, 1), (1, 2), (1, 3), (1, 4), (2, 2)]


def test_deep_indents(spark):
    items = spark.createDataFrame([("d", i, n) for i, n in enumerate([0, 17, 18, 2, 2])] + [("e", 0, 5)], "k string, pos int, indent int")
    got = {(r.k, r.pos): r.parent for r in S.indent_parents(items, "k", "pos", "indent").collect()}
    assert got == {("d", 0): None, ("d", 1): 0, ("d", 2): 1, ("d", 3): 0, ("d", 4): 0, ("e", 0): None}


# ---- importers with resources


def _files(spark, rows):
    """FILE rows of (path, content)."""
    from notelake.sources import files

    schema = "path string, archive_name string, archive_path string, entry_ord int, size long, modified_at long, content binary, error string"
    return files.described(spark.createDataFrame([(p, None, None, i, len(c), 5, bytearray(c), None) for i, (p, c) in enumerate(rows)], schema))


def test_evernote_media_tasks_and_code(spark):
    import base64
    import hashlib

    from notelake.sources import formats

    data = bytes.fromhex("89504E470D0A1A0A") + b"x"
    h = hashlib.md5(data).hexdigest()
    inner = f'<div>a <en-media hash="{h}" type="image/png" width="9"/></div><ul><li><en-todo checked="true"/>t</li></ul><div style="--en-task-group: true; --en-id: g1"></div><div style="-en-codeblock: true"><div>x</div></div>'
    note = f"<note><title>A &amp; B</title><tag>p &lt; q</tag><created>20200102T030405Z</created><content><![CDATA[<!DOCTYPE x><en-note>{inner}</en-note>]]></content>"
    note += "<task><title>one</title><taskStatus>completed</taskStatus><taskGroupNoteLevelID>g1</taskGroupNoteLevelID></task><task><title>other</title><taskGroupNoteLevelID>g2</taskGroupNoteLevelID></task>"
    note += f'<resource><data encoding="base64">{base64.b64encode(data).decode()}</data><mime>image/png</mime><width>9</width><height>4</height><resource-attributes><file-name>p.png</file-name></resource-attributes></resource></note>'
    got = formats.evernote(_files(spark, [("book.enex", f"<en-export>{note}<note><title>B</title></note></en-export>".encode())]))
    rows = {r.title: r for r in got.notes.collect()}
    assert set(rows) == {"A & B", "B"} and rows["A & B"].tags == ["p < q"] and rows["A & B"].notebooks == [["book"]]
    image = f'<img class="attachment" data-filename="p.png" data-size="9" data-hash="{h}" data-mime="image/png" width="9" height="4" alt="p.png" />'
    assert rows["A & B"].html == f'<p>a {image}</p><ul class="checklist"><li class="checked">t</li></ul><ul class="checklist"><li class="checked">one</li></ul><pre>x</pre>'
    assert [(r.hash, bytes(r.data)) for r in got.blobs.collect()] == [(h, data)] and got.attachments.count() == 1


def test_upnote_and_zoho(spark):
    from notelake.sources import formats

    page = b'<body><div class="shine-editor"><h2>One</h2><div>to <a href="Two.html">two</a><br>b</div><a data-upnote-tag="#t">#t</a><img src="f.bin"></div></body>'
    rows = [("u/One.html", page), ("u/Two.html", b"<p>x</p>"), ("u/f.bin", b"data"), ("u/notebooks/Work/Sub/One.html.lnk", b""), ("u/notebooks/Home/One.html.lnk", b"")]
    got = formats.upnote(_files(spark, rows))
    one = {r.title: r for r in got.notes.collect()}["One"]
    assert one.tags == ["t"] and one.notebooks == [["Home"], ["Work", "Sub"]] and "<h2>" not in one.html
    assert 'href="nn://note/' in one.html and '<p data-spacing="single">b</p>' in one.html and 'data-filename="f.bin"' in one.html and got.attachments.count() == 1
    znel = b'<ZNote znelVersion="1"><ZMeta><ZTitle>Z</ZTitle><ZNoteType>note/mixed</ZNoteType><ZCreatedDate>2020-01-02T03:04:05+0000</ZCreatedDate></ZMeta><ZTag>a</ZTag><ZContent><content><p>x</p><div class="checklist"><checkbox checked="true">k</checkbox><checkbox>l</checkbox></div><znresource relative-path="r.txt" type="text/plain"/></content></ZContent></ZNote>'
    got = formats.zoho(_files(spark, [("root/book/n.znel", znel), ("root/book/meta.json", b'{"name": "Book"}'), ("root/book/r.txt", b"res"), ("root/book/bad.znel", b"<ZNote></ZNote>")]))
    note = got.notes.first()
    assert (note.title, note.tags, note.notebooks) == ("Z", ["a"], [["Book"]])
    assert '<ul class="checklist"><li class="checked">k</li><li>l</li></ul>' in note.html and 'data-filename="r.txt"' in note.html
    assert [r.message for r in got.errors.collect()] == ["no znelVersion; no ZTitle; no ZNoteType; no ZContent"]
