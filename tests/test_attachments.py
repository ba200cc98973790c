"""Importers whose files refer to other files: Keep, Joplin and Fusebase exports in their own shapes."""

import hashlib
import json

import pytest

from notelake.sources import files, formats

PNG = b"\x89PNG\r\n\x1a\n" + b"0" * 20
PDF = b"%PDF-1.4 one"


def _md5(data):
    return hashlib.md5(data).hexdigest()


def _expand(spark, root, made):
    for name, data in made.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data if isinstance(data, bytes) else data.encode())
    return files.expand(files.scan(spark, str(root)))[0]


def _notes(result):
    return {r.src_path.rsplit("/", 1)[-1]: r for r in result.notes.collect()}


def test_keep_attachments(spark, tmp_path):
    note = {"title": "T", "textContent": "a", "attachments": [{"filePath": "pic-1.png", "mimetype": "image/png"}, {"filePath": "none.jpg", "mimetype": "image/jpeg"}, {"filePath": "x/doc.3gp", "mimetype": ""}]}
    found = _expand(spark, tmp_path, {"k/note.json": json.dumps(note), "k/bare.json": json.dumps({"title": "U", "textContent": "b"}), "k/pic-1.png": PNG, "k/doc.bin": PDF})
    result = formats.keep(found)
    notes = _notes(result)
    assert notes["bare.json"].html.strip() == "<p>b</p>"
    assert notes["note.json"].html.count("data-hash") == 2 and notes["note.json"].html.index(_md5(PNG)) < notes["note.json"].html.index(_md5(PDF))
    rows = [(r.pos, r.hash, r.filename, r.mime, r.size) for r in result.attachments.orderBy("pos").collect()]
    assert rows == [(0, _md5(PNG), "pic-1.png", "image/png", len(PNG)), (2, _md5(PDF), "doc.bin", "application/pdf", len(PDF))]
    assert {(r.hash, bytes(r.data)) for r in result.blobs.collect()} == {(_md5(PNG), PNG), (_md5(PDF), PDF)}


A, B, C = "a" * 32, "b" * 32, "c" * 32


def test_joplin_resources(spark, tmp_path):
    body = f"T\n\nOne ![one](:/{A}) and [again](:/{A}) and ![b](:/{B}) and ![gone](:/{C})\n\nid: n1\ntype_: 1\ncreated_time: 2020-01-01T00:00:00.000Z"
    made = {
        "n1.md": body, f"{A}.md": f"pic.png\n\nid: {A}\nmime: image/png\nfilename: p.png\ntype_: 4", f"{B}.md": f"\n\nid: {B}\nmime: \nfilename: f.pdf\ntype_: 4", f"{C}.md": f"lost\n\nid: {C}\ntype_: 4",
        f"resources/{A}.png": PNG, f"resources/{B}.bin": PDF,
    }
    result = formats.joplin(_expand(spark, tmp_path, made))
    html = _notes(result)["n1.md"].html
    rows = sorted((r.hash, r.filename, r.mime) for r in result.attachments.collect())
    assert rows == sorted([(_md5(PNG), "pic.png", "image/png"), (_md5(PDF), "f.pdf", "application/pdf")])
    # of the two references to one resource the last is replaced
    assert html.count(_md5(PNG)) == 1 and f":/{A}" in html and html.index(f":/{A}") < html.index(_md5(PNG)) and f":/{C}" in html and f":/{B}" not in html


PAGE = """<html><body><div id="note-root"><div class="outline">no</div><div class="paragraph x" data-k="1">a <b>b</b></div><div class="horizontal-line"><i></i></div>
<span class="inline-dropdown-list"><u class="select-label-text">L <b>1</b></u></span><date><span class="input-date-text">Mon</span></date><div class="table-text-common">t</div>
<div class="syntax-wrapper"><syntax data-nimbus-language="go"><pre><i>x</i> = 1</pre></syntax></div><div class="syntax-wrapper"><syntax><pre>dropped</pre></syntax></div>
<div class="hintblock"><span classname="nimbus-text q">hint</span></div><div class="nimbus-toggle"><div class="nimbus-toggle-header">H <b>h</b></div><div class="nimbus-toggle-content"><div class="paragraph">in</div></div></div>
<div class="button-single"><nimbus-button class="single-button" data-url="u" data-target="_blank"><i>go</i></nimbus-button></div>
<ul class="editor-list"><li class="list-item-number indent-0">one</li><li class="list-item-number indent-1"><b>two</b></li><li class="list-item-number indent-0">three</li></ul>
<ul class="editor-list"><li class="list-item-checkbox" data-checked="true">c</li></ul>
<div class="image-wrapper"><a href="./assets/g1.png">x</a></div><div class="file-wrapper"><a href="./assets/none.bin">y</a></div>
<mention class="mention" data-mention-type="note" data-mention-name="Other" data-mention-object_id="G2"></mention><mention class="mention" data-mention-type="user" data-mention-name="U" data-mention-object_id="z"></mention>
<div class="nimbus-bookmark"><a class="nimbus-bookmark__info__src" href="http://e"><i class="nimbus-bookmark__info__src-text">e</i></a><p class="nimbus-bookmark__info__desc">D</p><p class="nimbus-bookmark__info__name">N</p></div></div></body></html>"""


@pytest.fixture(scope="module")
def fusebase(spark, tmp_path_factory):
    one = {"globalId": "G1", "title": "First", "createdAt": 0, "dateAdded": 5, "updatedAt": 7, "tags": ["t"], "color": "8bc34a", "favorite": True, "parents": ["Top", "Sub"], "attachments": [{"globalId": "g1", "displayName": "shot.png", "mime": "image/png", "extra": {"width": 3}}]}
    two = {"globalId": "G2", "title": "Second", "parents": []}
    made = {"x/one/metadata.json": json.dumps(one), "x/one/note.html": PAGE, "x/one/assets/g1.png": PNG, "x/two/metadata.json": json.dumps(two), "x/three/metadata.json": "{broken"}
    return formats.fusebase(_expand(spark, tmp_path_factory.mktemp("f"), made))


def test_fusebase_notes(fusebase):
    notes = {r.title: r for r in fusebase.notes.collect()}
    assert notes["Second"].html == "<p></p>" and notes["Second"].notebooks == []
    first = notes["First"]
    assert (first.date_created, first.date_edited, first.color, first.favorite, first.tags, first.notebooks) == (5, 7, "green", True, ["t"], [["Top", "Sub"]])
    assert [r.src_path.rsplit("/", 2)[-2] for r in fusebase.errors.collect()] == ["three"]


def test_fusebase_blocks(fusebase):
    html = next(r.html for r in fusebase.notes.collect() if r.title == "First")
    assert "no" not in html.split("<p")[0] and '<p data-k="1">a <b>b</b></p><hr>' in html
    for part in (
        "<code>L 1</code><span>Mon</span><p>t</p>", '<pre class="lang-go"><code>x = 1</code></pre>', '<div class="callout" data-callout-type="hint"><h3></h3><p>hint</p></div>',
        '<div class="callout" data-callout-type="info"><h3>H h</h3><p>in</p></div>', '<a href="u" target="_blank">go</a>', '<ol><li class=""><p>one</p><ol><li class=""><b>two</b></li></ol></li><li class=""><p>three</p></li></ol>',
        '<ul class="checklist"><li class="checked"><p>c</p></li></ul>', ">Other</a>", '<p><strong>Title:</strong> N</p><p><strong>URL:</strong> <a href="http://e">e</a></p><p><strong>Description:</strong> D</p><hr>',
    ):
        assert part in html, part
    assert "dropped" not in html and "none.bin" not in html and "mention" not in html and f'data-hash="{_md5(PNG)}"' in html and 'width="3"' in html


def test_fusebase_attachments(fusebase):
    assert [(r.hash, r.filename, r.mime) for r in fusebase.attachments.collect()] == [(_md5(PNG), "shot.png", "image/png")]
    assert [bytes(r.data) for r in fusebase.blobs.collect()] == [PNG]


def test_remaining_formats(spark, tmp_path):
    """Skiff, Obsidian and TextBundle."""
    found = _expand(spark, tmp_path, {"a.md": "---\nk: v\n---\n# Head line\nbody", "b.md": "plain", "c.textbundle/text.md": "# B\n\nx", "c.textbundle/__MACOSX/text.md": "no"})
    skiff = _notes(formats.skiff(found))
    assert skiff["a.md"].title == "Head line" and "<p>body</p>" in skiff["a.md"].html and skiff["b.md"].title == "b"
    assert {n.title for n in formats.obsidian(found).notes.collect()} == {"a", "b", "text"}
    bundle = formats.textbundle(found).notes.collect()
    assert all("__MACOSX" not in n.src_path and n.notebooks == [] and n.source == "textbundle" for n in bundle) and any(n.title == "B" for n in bundle)


def _clip(kind, inner, url="http://h/p", title="A title"):
    return f'<div style="--en-clipped-content: {kind}; --en-clipped-source-url: {url}; --en-clipped-source-title: {title}">{inner}</div>'


def test_web_clips(spark, tmp_path):
    import base64

    media = f'<en-media type="image/png" hash="{_md5(PNG)}"></en-media>'
    resource = f"<resource><data>{base64.b64encode(PNG).decode()}</data><mime>image/png</mime></resource>"
    bodies = {
        "simplified": _clip("simplified", "<p>kept</p>"), "bookmark": _clip("bookmark", "gone"), "screenshot": _clip("screenshot", f"<p>x{media}y</p>"), "image": _clip("contextMenuImage", "none"),
        "article": f"<p>before</p>{_clip('article', f'<h1>T</h1>{media}<b>z</b>')}<p>after</p>", "unknown": _clip("unknown", "gone"),
    }
    note = lambda title, body, more="": f"<note><title>{title}</title><content><![CDATA[<en-note>{body}</en-note>]]></content>{more}{resource}</note>"
    text = "<en-export>" + "".join(note(k, v) for k, v in bodies.items()) + note("page", "<p>w</p>", "<source>web.clip</source><source-url>http://s</source-url>") + "</en-export>"
    result = formats.evernote(_expand(spark, tmp_path, {"n.enex": text}))
    html = {r.title: r.html for r in result.notes.collect()}
    footer = '<hr></hr><p>Clipped from: <a href="http://h/p">A title</a></p>'
    squeezed = {k: v.replace("<hr>", "<hr></hr>").replace("</hr></hr>", "</hr>") for k, v in html.items()}
    assert squeezed["simplified"] == "<p>kept</p>" + footer
    assert squeezed["bookmark"] == '<p>A title</p><p><a href="http://h/p">http://h/p</a></p>'
    assert squeezed["screenshot"].count("data-hash") == 1 and squeezed["screenshot"].endswith(footer) and "x" not in squeezed["screenshot"].split("<img")[0]
    assert squeezed["image"] == squeezed["unknown"] == ""
    page = f'<h1>T</h1><img src="data:image/png;base64,{base64.b64encode(PNG).decode()}"><b>z</b>'.encode()
    assert squeezed["article"].startswith("<p>before</p>") and _md5(page) in squeezed["article"] and squeezed["article"].endswith(footer + "<p>after</p>")
    assert _md5(b"<p>w</p>") in squeezed["page"] and 'href="http://s"' in squeezed["page"]
    rows = sorted((r.hash, r.filename, r.mime) for r in result.attachments.collect())
    assert rows == sorted([(_md5(PNG), _md5(PNG), "image/png"), (_md5(page), "a-title.clip", formats.CLIP_MIME), (_md5(b"<p>w</p>"), "http---s.clip", formats.CLIP_MIME)])
    assert {(r.hash, bytes(r.data)) for r in result.blobs.collect()} == {(_md5(PNG), PNG), (_md5(page), page), (_md5(b"<p>w</p>"), b"<p>w</p>")}
