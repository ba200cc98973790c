"""Importers: FILE rows of one format to note rows and error rows, and their registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.functions import columns as C
from notelake.functions import markdown as M
from notelake.operators import joins as J
from notelake.operators import package as P
from notelake.operators import rewrites as W
from notelake.operators import tokens as T
from notelake.scratch import staged
from notelake.sources.colornote import colornote
from notelake.sources.files import visible
from notelake.sources.fusebase import fusebase
from notelake.sources.notes import ImportResult, note_rows, split_required
from notelake.sources.settings import Settings, observed

NO_ERRORS = "src_path string, note_title string, message string"


def _text() -> Column:
    return F.make_valid_utf8(F.col("content").cast("string"))


def _ok(notes: DataFrame, errors: DataFrame | None = None) -> ImportResult:
    return ImportResult(notes, errors if errors is not None else notes.sparkSession.createDataFrame([], NO_ERRORS))


def text(files: DataFrame) -> ImportResult:
    f = visible(files, ["txt"])
    return _ok(note_rows(f, "txt", src_path=F.col("path"), title=F.col("stem"), html=C.text_to_html(_text()), date_created=F.col("modified_at"), date_edited=F.col("modified_at")))


def _html_fields(html: Column) -> dict[str, Column]:
    t = T.tokenize(html)
    body = T.tokenize(T.without_first(html, ["title", "h1", "h2"]))
    meta = lambda k: T.meta_value(t, T.META[k])
    return {"title": T.element_text(t, ["title", "h1", "h2"]), "html": F.array_join(T.body_tokens(body), ""), "created": C.iso_millis(meta("created")), "edited": C.iso_millis(meta("edited")), "pinned": meta("pinned") == "true", "favorite": meta("favorite") == "true", "color": meta("color")}


def html(files: DataFrame) -> ImportResult:
    f = visible(files, ["html", "htm"])
    x = _html_fields(_text())
    folders = F.when(F.col("archive_name").isNotNull(), F.array(C.notebook_path(F.col("dir"))))
    return _with_resources(note_rows(f, "html", src_path=F.col("path"), title=F.coalesce(F.nullif(x["title"], F.lit("")), "stem"), html=x["html"], date_created=F.coalesce(x["created"], "modified_at"), date_edited=F.coalesce(x["edited"], "modified_at"), pinned=x["pinned"], favorite=x["favorite"], color=x["color"], notebooks=folders), files)


def _markdown(files: DataFrame, source: str, title_from: str) -> ImportResult:
    f = visible(files, ["md", "markdown", "mdown"]).withColumns({"m": M.front_matter(_text()), "body": M.to_html(M.without_front_matter(_text()))})
    get = lambda *ks: F.coalesce(*[F.nullif(F.col("m")[k], F.lit("")) for k in ks])
    own = T.element_text(T.tokenize(F.col("body")), ["h1", "h2"]) if title_from == "heading" else F.lit(None).cast("string")
    tags = F.filter(F.transform(F.split(get("tags"), ","), C.clean_tag), lambda x: x != "")
    return _ok(note_rows(f, source, src_path=F.col("path"), title=F.coalesce(get("title"), F.nullif(own, F.lit("")), "stem"), html=T.without_first(F.col("body"), ["h1", "h2"]) if title_from == "heading" else F.col("body"), tags=tags, pinned=F.coalesce(get("pinned") == "true", F.lit(False)), favorite=F.coalesce(get("favorite") == "true", F.lit(False)), color=get("color"), date_created=F.coalesce(C.iso_millis(get("created", "created_at", "date created")), "modified_at"), date_edited=F.coalesce(C.iso_millis(get("updated", "updated_at", "date updated")), "modified_at")))


def markdown(files: DataFrame) -> ImportResult:
    return _markdown(files, "md", "heading")


def obsidian(files: DataFrame) -> ImportResult:
    return _markdown(files, "obsidian", "stem")


def skiff(files: DataFrame) -> ImportResult:
    f = visible(files, ["md"]).withColumn("t", M.without_front_matter(_text()))
    first = F.get(F.split("t", "\n"), F.lit(0))
    rest = F.when(first.startswith("#"), F.regexp_replace("t", r"\A[^\n]*\n?", "")).otherwise(F.col("t"))
    return _ok(note_rows(f, "skiff", src_path=F.col("path"), title=F.when(first.startswith("#"), F.trim(F.substring(first, 2, 1 << 20))).otherwise(F.col("stem")), html=M.to_html(rest)))


def textbundle(files: DataFrame) -> ImportResult:
    f = files.where(~F.col("path").contains("__MACOSX"))
    notes = J.union_all([text(f).notes, markdown(f).notes, html(f).notes])
    return _ok(notes.withColumns({"notebooks": F.array().cast("array<array<string>>"), "source": F.lit("textbundle")}))


SIMPLENOTE = "activeNotes array<struct<id string, content string, creationDate string, lastModified string, pinned boolean, markdown boolean, tags array<string>>>"


def simplenote(files: DataFrame) -> ImportResult:
    rows = visible(files, ["json"]).select(F.col("path").alias("src_path"), F.explode(F.from_json(_text(), SIMPLENOTE)["activeNotes"]).alias("n")).select("src_path", "n.*")
    rows = rows.withColumns({"created": C.iso_millis(F.col("creationDate")), "edited": C.iso_millis(F.col("lastModified")), "note_title": C.first_line_title(F.col("content"))})
    good, bad = split_required(rows, {"created": "no creation date", "edited": "no modification date"})
    body = F.when(F.col("markdown"), M.to_html(F.col("content"))).otherwise(C.text_to_html(F.col("content")))
    notes = note_rows(good, "simplenote", src_path=F.col("src_path"), title=F.col("note_title"), html=body, date_created=F.col("created"), date_edited=F.col("edited"), pinned=F.col("pinned"), tags=F.col("tags"))
    return _ok(notes, bad.select("src_path", "note_title", "message"))


KEEP = "title string, textContent string, listContent array<struct<text string, isChecked boolean>>, color string, isPinned boolean, isArchived boolean, labels array<struct<name string>>, userEditedTimestampUsec long, createdTimestampUsec long, attachments array<struct<filePath string, mimetype string>>"
#: Names of colours that have one of ours.
KEEP_NAMES = {"red": "red", "orange": "orange", "yellow": "yellow", "green": "green", "teal": "green", "cerulean": "blue", "blue": "blue", "pink": "purple", "purple": "purple", "gray": "gray", "brown": "orange"}


def keep(files: DataFrame) -> ImportResult:
    """A JSON file is a note. An attachment is the first file whose stem its path contains, in the order of the entries (J4); those found follow the body."""
    f = visible(files, ["json"]).withColumn("n", F.from_json(_text(), KEEP)).select("path", "stem", "archive_path", "n.*")
    edited = C.micros_to_millis(F.col("userEditedTimestampUsec"))
    items = F.transform("listContent", lambda x: F.struct(x["text"].alias("text"), x["isChecked"].alias("checked")))
    body = F.when(F.col("textContent") != "", M.to_html(C.hard_breaks(F.replace("textContent", F.lit("\r\n"), F.lit("\n"))))).when(F.col("listContent").isNotNull(), C.checklist_html(items)).otherwise("")
    notes = note_rows(f, "keep", src_path=F.col("path"), title=F.coalesce(F.nullif("title", F.lit("")), "stem"), html=body, tags=F.transform("labels", lambda x: x["name"]), color=C.lookup(F.lower("color"), KEEP_NAMES), pinned=F.col("isPinned"), archived=F.col("isArchived"), date_edited=edited, date_created=F.coalesce(C.micros_to_millis(F.nullif("createdTimestampUsec", F.lit(0))), edited))
    found = keep_attachments(f, files)
    tail = found.groupBy("src_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "new"))), lambda x: x["new"]), "").alias("tail"))
    out = notes.join(tail, "src_path", "left").withColumn("html", F.concat("html", F.coalesce("tail", F.lit("")))).select(*notes.columns)
    return ImportResult(out, _ok(out).errors, found.select("src_path", "pos", "hash", "hash_type", "filename", "size", "mime"), found.select("hash", F.col("content").alias("data")).dropDuplicates(["hash"]))


def keep_attachments(notes: DataFrame, files: DataFrame, hash_name: str = "md5") -> DataFrame:
    """(src_path, pos, hash, ..., content) of notes (path, archive_path, attachments): the files that the attachments' paths name.

    A path is looked up among the stems of the files of its own archive, or of those outside of archives.
    """
    unit = F.coalesce("archive_path", F.lit("")).alias("unit")
    links = notes.select(F.col("path").alias("src_path"), unit, F.posexplode("attachments").alias("pos", "a")).select("src_path", "unit", "pos", F.col("a.filePath").alias("text"), F.col("a.mimetype").alias("mime")).where(F.col("text") != "")
    stems = J.first_match(files.where((F.col("stem") != "") & F.col("content").isNotNull()).select(unit, "stem", "entry_ord", F.col("path").alias("file_path")), ["unit", "stem"], ["entry_ord", "file_path"])
    pairs = J.pieces_join(links.select("unit", "text").distinct(), stems, "text", "stem", "unit")
    one = J.first_match(pairs, ["unit", "text"], ["entry_ord", "file_path"]).select("unit", "text", "file_path")
    held = J.first_match(files.select(F.col("path").alias("file_path"), "name", "content", "entry_ord"), ["file_path"], ["entry_ord"])
    x = links.join(one, ["unit", "text"]).join(held, "file_path")
    mark = P.hash_column(F.col("content"), hash_name)
    mime = F.coalesce(F.nullif("mime", F.lit("")), C.sniffed(F.col("content"))["mime"], F.lit("application/octet-stream"))
    x = x.select("src_path", "pos", mark.alias("hash"), F.lit(hash_name).alias("hash_type"), F.col("name").alias("filename"), F.length("content").cast("long").alias("size"), mime.alias("mime"), "content")
    none = F.lit(None).cast("int")
    return x.withColumn("new", C.attachment_html(*(F.col(c) for c in ("filename", "size", "hash", "mime")), none, none))


def _with_resources(notes: DataFrame, files: DataFrame, errors: DataFrame | None = None) -> ImportResult:
    """Notes whose links to files of the import became attachments."""
    out, attachments, blobs = T.import_resources(notes, files, "src_path", "src_path")
    result = _ok(out.select(*notes.columns), errors)
    return ImportResult(result.notes, result.errors, attachments, blobs)


def _enex_rows(files: DataFrame) -> DataFrame:
    """(src_path, stem, x): a row for each note of a file, src_path with its number."""
    pattern = r"(?s)<note>(?:<!\[CDATA\[.*?\]\]>|(?!</note>).)*+</note>"
    rows = visible(files, ["enex"]).select("path", "stem", F.posexplode(F.regexp_extract_all(_text(), F.lit(pattern), F.lit(0))).alias("n", "x"))
    return rows.select(F.concat("path", F.lit("#"), "n").alias("src_path"), "stem", "x")


_ENEX_PART = r"(?s)<content>.*?</content>|<task>.*?</task>|<resource>.*?</resource>"


def enex_resources(rows: DataFrame) -> DataFrame:
    """(src_path, ord, hash, mime, filename, width, height, data): the resources of each note, by the hash that names them in its text."""
    outside = F.regexp_replace("x", r"(?s)<content>.*?</content>", "")
    r = rows.select("src_path", F.posexplode(F.regexp_extract_all(outside, F.lit(r"(?s)<resource>(.*?)</resource>"), F.lit(1))).alias("ord", "r"))
    field = lambda name: F.nullif(F.regexp_extract("r", rf"(?s)<{name}(?:\s[^>]*)?>(.*?)</{name}>", 1), F.lit(""))
    data = F.try_to_binary(F.regexp_replace(field("data"), r"\s|<!\[CDATA\[|\]\]>", ""), F.lit("base64"))
    r = r.select("src_path", "ord", data.alias("data"), C.xml_text(field("mime")).alias("mime"), C.xml_text(field("file-name")).alias("filename"), *[field(k).try_cast("int").alias(k) for k in ("width", "height")])
    return r.where(F.col("data").isNotNull()).withColumn("hash", F.md5("data"))


#: Kinds of web clips that become one attachment; the media type is ours.
WHOLE_CLIPS, IMAGE_CLIPS, CLIP_MIME = ["article", "fullPage"], ["contextMenuImage", "screenshot"], "application/x.web-clip"


def enex_clips(notes: DataFrame, media: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(places, clips) of the web clips of notes (src_path, html, source_url) by kind.

    media: (src_path, pos, last, new, mime, data, type): the media elements that have a resource. A simplified clip keeps what
    is inside, a bookmark becomes two paragraphs, an image or screenshot its first medium; each but the bookmark is followed
    by where it comes from. An article or a full page becomes one attachment, a page of its own whose images are in it as
    base64; clips: (src_path, pos, last, hash, ..., content). Other kinds, and images without a medium, go. A clip inside
    another is part of that.
    """
    x = T.elements(notes, "src_path", r"(?i)^<[a-z][^>]*--en-clipped-content", "source_url")
    style = C.styles(C.xml_text(T.attribute(F.col("tok"), "style")))
    x = x.withColumns({"kind": style["--en-clipped-content"], "url": F.coalesce(style["--en-clipped-source-url"], "source_url"), "title": style["--en-clipped-source-title"]}).drop("source_url", "tok", "tag")
    x = staged(T.outermost(x, "src_path").withColumn("footer", C.web_clip_footer(F.col("url"), F.col("title"))), "clips")
    edit = lambda rows, pos, last, new: rows.select("src_path", pos.alias("pos"), last.alias("last"), new.alias("new"))
    pos, last, empty = F.col("pos"), F.col("last"), F.lit("")
    simple = x.where("kind = 'simplified'")
    text = lambda c: F.coalesce(c, empty)
    bookmark = F.concat(F.lit("<p>"), text(F.col("title")), F.lit('</p><p><a href="'), text(F.col("url")), F.lit('">'), text(F.col("url")), F.lit("</a></p>"))
    places = [edit(simple, pos, pos, empty), edit(simple.where("last > pos"), last, last, F.col("footer")), edit(x.where("kind = 'bookmark'"), pos, last, bookmark)]
    inside = media.withColumnsRenamed({"pos": "at", "last": "to", "new": "medium"}).join(x.select("src_path", "pos", "last", "kind", "footer"), "src_path").where((F.col("at") > pos) & (F.col("to") < last))
    image = J.first_match(inside.where(F.col("kind").isin(IMAGE_CLIPS)), ["src_path", "pos"], ["at"])
    places.append(edit(image, pos, last, F.concat("medium", "footer")))
    whole = x.where(F.col("kind").isin(WHOLE_CLIPS))
    known = ["simplified", "bookmark", *WHOLE_CLIPS]
    places.append(edit(x.where(~F.coalesce("kind", empty).isin(known)).join(image.select("src_path", "pos"), ["src_path", "pos"], "left_anti"), pos, last, empty))
    # the page of a clip: its tokens, with its images replaced there
    key = F.concat_ws("#", "src_path", "pos").alias("clip")
    tokens = notes.select("src_path", T.tokenize(F.col("html")).alias("tokens")).join(whole, "src_path")
    pages = tokens.select(key, "src_path", "pos", "last", "url", "title", "footer", F.array_join(F.slice("tokens", pos + 2, F.greatest(last - pos - 1, F.lit(0))), "").alias("html"))
    images = inside.where(F.col("kind").isin(WHOLE_CLIPS) & F.col("type").startswith("image/"))
    images = images.select(key, (F.col("at") - pos - 1).alias("pos"), (F.col("to") - pos - 1).alias("last"), F.concat(F.lit('<img src="data:'), "type", F.lit(";base64,"), F.base64("data"), F.lit('">')).alias("new"))
    content = F.encode("page", "utf-8")
    clips = pages.drop("html").join(T.replace_elements(pages, "clip", images).withColumnRenamed("html", "page"), "clip").withColumns({"content": content, "hash": F.md5(content)})
    named = F.coalesce(F.nullif("title", empty), F.nullif("url", empty), "hash")
    clips = clips.select("src_path", "pos", "last", "hash", F.lit("md5").alias("hash_type"), F.concat(C.sanitize_filename(named), F.lit(".clip")).alias("filename"), F.length("content").cast("long").alias("size"), F.lit(CLIP_MIME).alias("mime"), "content", "url", "footer", named.alias("named"))
    none = F.lit(None).cast("int")
    shown = C.attachment_html(F.col("filename"), F.col("size"), F.col("hash"), F.col("mime"), none, none, F.col("url"), F.col("named"))
    places.append(edit(clips, pos, last, F.concat(shown, "footer")))
    return J.union_all(places), clips.drop("url", "footer", "named")


def evernote(files: DataFrame) -> ImportResult:
    """A file is a notebook. Notes are cut out by pattern outside CDATA; media become attachments (J2, T18), web clips by their
    kind (T19), task groups and to-dos checklists (J15, T15, T17), code blocks pre elements (T16) and divs paragraphs (T14).

    A note that a web clipper made is one full page clip. Media inside of a whole clip are in its page and no attachments.
    """
    rows = _enex_rows(files)
    field = lambda name: F.nullif(C.xml_text(F.regexp_extract(F.regexp_replace("x", _ENEX_PART, ""), rf"(?s)<{name}>(.*?)</{name}>", 1)), F.lit(""))
    content = F.regexp_extract("x", r"(?s)<content>\s*<!\[CDATA\[(.*?)\]\]>\s*</content>", 1)
    inner = F.regexp_replace(content, r"(?s)\A.*?<en-note[^>]*>|</en-note>.*\z", "")
    clipped = F.coalesce(field("source-application").contains("webclipper"), F.lit(False)) | F.coalesce(field("source").contains("web.clip"), F.lit(False))
    body = F.when(clipped, F.concat(F.lit('<div style="--en-clipped-content: fullPage">'), inner, F.lit("</div>"))).otherwise(inner)
    tags = F.regexp_extract_all(F.regexp_replace("x", r"(?s)<content>.*?</content>", ""), F.lit(r"(?s)<tag>(.*?)</tag>"), F.lit(1))
    notes = note_rows(rows, "evernote", src_path=F.col("src_path"), title=field("title"), html=body, tags=F.transform(tags, C.xml_text), date_created=C.iso_basic_millis(field("created")), date_edited=C.iso_basic_millis(field("updated")), notebooks=F.array(F.array("stem")))
    pages = rows.select("src_path", body.alias("html"), field("source-url").alias("source_url"))

    media = T.elements(notes, "src_path", r"(?i)^<en-media[\s>/]").withColumn("hash", F.lower(T.attribute(F.col("tok"), "hash")))
    held = J.first_match(enex_resources(rows), ["src_path", "hash"], ["ord"])
    x = media.join(held, ["src_path", "hash"])
    side = lambda k: F.coalesce(C.int_attribute(T.attribute(F.col("tok"), k)).cast("int"), F.col(k))
    x = x.withColumns({"size": F.length("data").cast("long"), "hash_type": F.lit("md5"), "filename": F.coalesce(F.nullif("filename", F.lit("")), "hash"), "w": side("width"), "h": side("height"), "type": T.attribute(F.col("tok"), "type")})
    x = x.withColumn("new", C.attachment_html(F.col("filename"), F.col("size"), F.col("hash"), F.col("mime"), F.col("w"), F.col("h")))
    x = staged(x.drop("tok"), "media")
    clip_places, clips = enex_clips(pages, x.select("src_path", "pos", "last", "new", "mime", "data", "type"))
    clips = staged(clips, "clips")
    in_clip = x.join(clips.select("src_path", F.col("pos").alias("__a"), F.col("last").alias("__z")), "src_path").where(F.col("pos").between(F.col("__a"), F.col("__z"))).select("src_path", "pos")
    own = x.join(in_clip, ["src_path", "pos"], "left_anti")

    part = lambda t, name: C.xml_text(F.regexp_extract(t, rf"(?s)<{name}>(.*?)</{name}>", 1))
    tasks = F.transform(F.regexp_extract_all(F.regexp_replace("x", r"(?s)<content>.*?</content>", ""), F.lit(r"(?s)<task>(.*?)</task>"), F.lit(1)), lambda t: F.struct(part(t, "taskGroupNoteLevelID").alias("group"), part(t, "title").alias("title"), (part(t, "taskStatus") == "completed").alias("done")))
    groups = T.elements(notes, "src_path", r"(?i)^<(?:en-task-group\b|div\b[^>]*-en-task-group\s*:\s*true)")
    id_ = F.coalesce(T.attribute(F.col("tok"), "task-group-id"), C.styles(T.attribute(F.col("tok"), "style"))["--en-id"])
    groups = groups.withColumn("group", id_).join(rows.select("src_path", tasks.alias("tasks")), "src_path")
    lists = groups.select("src_path", "pos", "last", W.task_list(J.tasks_of(F.col("tasks"), F.col("group"))).alias("new"))
    places = J.union_all([x.select("src_path", "pos", "last", "new"), lists, clip_places])
    done = W.rewrite(T.replace_elements(notes, "src_path", places), "src_path", "en-todo", "en-codeblock", "div-to-p")
    out = notes.drop("html").join(done, "src_path").select(*notes.columns)
    columns = ["src_path", "pos", "hash", "hash_type", "filename", "size", "mime"]
    blobs = own.select("hash", "data").unionByName(clips.select("hash", F.col("content").alias("data"))).dropDuplicates(["hash"])
    return ImportResult(out, _ok(out).errors, own.select(*columns).unionByName(clips.select(*columns)), blobs)


def upnote(files: DataFrame) -> ImportResult:
    """Pages outside /notebooks/; the folders below it say by links, named after a page, to which notebooks that belongs."""
    f = visible(files, ["html"], ["/notebooks/"]).withColumns({"raw": _text()})
    below = F.regexp_extract("path", r"(?:^|[/\\])notebooks[/\\](.+)[/\\][^/\\]*$", 1)
    links = files.where(F.col("name").endswith(".lnk") | F.col("name").endswith(".html")).withColumn("below", below).where(F.col("below") != "")
    paths = F.transform(F.array_sort(F.collect_list(F.struct("path", F.split("below", r"[/\\]").alias("parts")))), lambda x: x["parts"])
    f = f.join(links.groupBy(F.col("stem").alias("name")).agg(paths.alias("notebooks")), "name", "left")
    body = F.array_join(T.body_tokens(T.tokenize(F.col("raw"))), "")
    head = r"(?is)\A(\s*(?:<div\b[^>]*shine-editor[^>]*>\s*)?)<h2\b[^>]*>(.*?)</h2\s*>"
    body = F.when(F.trim(F.regexp_replace(F.regexp_extract(body, head, 2), "<[^>]*>", "")) == F.col("stem"), F.regexp_replace(body, head, "$1")).otherwise(body)
    tags = F.transform(F.filter(F.transform(T.tokenize(F.col("raw")), lambda t: F.when(t.rlike(r"(?i)^<a\s"), T.attribute(t, "data-upnote-tag"))), lambda t: t.isNotNull()), lambda t: F.regexp_replace(t, "^#", ""))
    notes = note_rows(f, "upnote", src_path=F.col("path"), title=F.col("stem"), html=body, tags=F.array_distinct(F.filter(tags, lambda t: t != "")), notebooks=F.coalesce("notebooks", F.array().cast("array<array<string>>")), date_edited=F.col("modified_at"))
    hrefs = T.elements(notes, "src_path", r"(?i)^<a\s").select(T.attribute(F.col("tok"), "href").alias("href")).distinct().where(F.col("href").endswith(".html"))
    target = notes.select("title").distinct().select("title", F.concat(F.lit("nn://note/"), C.deterministic_id(F.lit("upnote"), F.col("title"))).alias("target"))
    inner = hrefs.withColumn("title", F.regexp_replace(C.decode_uri(F.col("href")), r"\.html$", "")).join(target, "title").select("href", "target")
    linked = W.rewrite(T.rewrite_links(notes, "src_path", inner), "src_path", "checked-lists", "colors", "collapsibles", "code-languages", "div-to-p", "br-to-p", "aligned-blocks")
    return _with_resources(notes.drop("html").join(linked, "src_path").select(*notes.columns), files)


def zoho(files: DataFrame) -> ImportResult:
    """One XML file is a note; what is required and missing gives an error row. The notebook is named by the meta.json of its folder."""
    f = visible(files, ["znel"]).withColumn("x", _text())
    meta = F.regexp_extract("x", r"(?s)<ZMeta\b[^>]*>(.*?)</ZMeta>", 1)
    inside = lambda c, name: F.nullif(C.xml_text(F.regexp_replace(F.regexp_extract(c, rf"(?s)<{name}\b[^>]*>(.*?)</{name}>", 1), r"<!\[CDATA\[|\]\]>", "")), F.lit(""))
    body = F.regexp_replace(F.regexp_extract("x", r"(?s)<ZContent\b[^>]*>(.*)</ZContent>", 1), r"(?s)\A\s*(?:<!\[CDATA\[)?\s*(?:<content\b[^>]*>)?|(?:</content>)?\s*(?:\]\]>)?\s*\z", "")
    rows = f.withColumns({
        "version": F.nullif(F.regexp_extract("x", r"<ZNote\b[^>]*\bznelVersion\s*=\s*[\"']([^\"']+)", 1), F.lit("")), "note_title": inside(meta, "ZTitle"), "type": inside(meta, "ZNoteType"),
        "body": F.when(F.col("x").rlike(r"<ZContent\b"), body), "created": C.iso_millis(inside(meta, "ZCreatedDate")), "edited": C.iso_millis(inside(meta, "ZModifiedDate")),
        "tags": F.transform(F.regexp_extract_all("x", F.lit(r"(?s)<ZTag\b[^>]*>(.*?)</ZTag>"), F.lit(1)), C.xml_text),
    })
    good, bad = split_required(rows, {"version": "no znelVersion", "note_title": "no ZTitle", "type": "no ZNoteType", "body": "no ZContent"})
    folder = F.array_join(F.slice(F.split(F.coalesce("archive_path", "path"), "/"), 1, 2), "/")
    names = files.where(F.col("name") == "meta.json").select(F.col("path").alias("meta_path"), F.get_json_object(_text(), "$.name").alias("notebook"), F.lit(0).alias("ord"))
    good = J.lookup_left(good.withColumn("meta_path", F.concat(folder, F.lit("/meta.json"))), names, "meta_path", "ord")
    html = F.regexp_replace(F.regexp_replace("body", r"(?i)<znresource\b([^>]*?)\srelative-path\s*=", "<img$1 src="), r"(?i)</znresource\s*>", "")
    listed = F.when(F.col("type") == "note/checklist", F.concat(F.lit('<div class="checklist">'), html, F.lit("</div>"))).otherwise(html)
    notes = note_rows(good, "zoho", src_path=F.col("path"), title=F.col("note_title"), html=listed, tags=F.col("tags"), date_created=F.col("created"), date_edited=F.col("edited"), notebooks=F.when(F.col("notebook").isNotNull(), F.array(F.array("notebook"))).otherwise(F.array().cast("array<array<string>>")))
    listed = notes.drop("html").join(W.rewrite(notes, "src_path", "zn-checklists"), "src_path").select(*notes.columns)
    return _with_resources(listed, files, bad.select(F.col("path").alias("src_path"), "note_title", "message"))


def joplin_entities(files: DataFrame) -> DataFrame:
    """(src_path, title, body, props map, type): a record's last paragraph holds its properties."""
    f = visible(files, ["md"]).select(F.col("path").alias("src_path"), F.regexp_replace(_text(), "\r\n", "\n").alias("t"))
    foot = F.regexp_extract("t", r"(?s)(?:\A|\n[ \t]*\n)((?:[^\n]*\S[^\n]*\n?)+)\z", 1)
    head = F.substring("t", F.lit(1), F.length("t") - F.length(foot))
    props = F.map_from_entries(F.transform(F.filter(F.split(foot, "\n"), lambda x: x.contains(":")), lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)), F.trim(F.regexp_replace(x, "^[^:]*:", "")))))
    lines = F.split(F.regexp_replace(head, r"\n[ \t]*\n?\z", ""), "\n")
    return f.select("src_path", F.get(lines, F.lit(0)).alias("title"), F.array_join(F.slice(lines, 3, F.greatest(F.size(lines), F.lit(1))), "\n").alias("body"), props.alias("p")).withColumn("type", F.col("p")["type_"].try_cast("int"))


def joplin_resources(notes: DataFrame, entities: DataFrame, files: DataFrame, hash_name: str = "md5") -> DataFrame:
    """(src_path, pos, last, hash, ..., content): the resource entities that a note's elements refer to, with their files.

    notes (src_path, html). A reference is a src or, without one, an href ':/id'; of the elements of a note that refer to one
    resource the last counts, the others stay as they are. Entity, element and file meet by id in one three-way join: the
    ids are cut out of the references and out of the files' paths (resources/id).
    """
    x = T.elements(notes, "src_path", r"(?i)^<[a-z][^>]*\s(?:src|href)\s*=\s*[\"']?:/")
    src = lambda c: F.nullif(T.attribute(F.col("tok"), c), F.lit(""))
    refs = x.withColumn("id", F.regexp_extract(F.coalesce(src("src"), src("href")), r"^:/([0-9a-zA-Z]+)$", 1)).where(F.col("id") != "")
    refs = J.last_wins(refs.select("src_path", "id", "pos", "last"), ["src_path", "id"], "pos")
    p = lambda k: F.nullif(F.col("p")[k], F.lit(""))
    known = entities.where("type = 4").groupBy(p("id").alias("id")).agg(F.min_by(F.struct(F.nullif("title", F.lit("")).alias("title"), p("filename").alias("filename"), p("mime").alias("mime")), "src_path").alias("e"))
    held = files.withColumn("id", F.regexp_extract("path", r"resources/([0-9a-zA-Z]+)", 1)).where((F.col("id") != "") & (F.length("content") > 0))
    held = J.first_match(held.select("id", "path", "content"), ["id"], ["path"]).select("id", "content")
    x = refs.join(known, "id").join(held, "id")
    mark = P.hash_column(F.col("content"), hash_name)
    mime = F.coalesce("e.mime", C.sniffed(F.col("content"))["mime"], F.lit("application/octet-stream"))
    x = x.select("src_path", "pos", "last", mark.alias("hash"), F.lit(hash_name).alias("hash_type"), F.coalesce("e.title", "e.filename", mark).alias("filename"), F.length("content").cast("long").alias("size"), mime.alias("mime"), "content")
    none = F.lit(None).cast("int")
    return x.withColumn("new", C.attachment_html(*(F.col(c) for c in ("filename", "size", "hash", "mime")), none, none))


def _with_found(notes: DataFrame, found: DataFrame, errors: DataFrame) -> ImportResult:
    """Notes whose places became the attachments found there."""
    out = notes.drop("html").join(T.replace_elements(notes, "src_path", found.select("src_path", "pos", "last", "new")), "src_path").select(*notes.columns)
    return ImportResult(out, errors, found.select("src_path", "pos", "hash", "hash_type", "filename", "size", "mime"), found.select("hash", F.col("content").alias("data")).dropDuplicates(["hash"]))


def joplin(files: DataFrame) -> ImportResult:
    e = joplin_entities(files)
    good, bad = split_required(e, {"type": "no type_"})
    p = lambda k: F.col("p")[k]
    notes = good.where((F.col("type") == 1) & (F.length("body") > 0)).select("src_path", "title", "body", p("id").alias("id"), p("parent_id").alias("folder"), F.coalesce(F.nullif(p("user_created_time"), F.lit("")), p("created_time")).alias("c"), F.coalesce(F.nullif(p("user_updated_time"), F.lit("")), p("updated_time")).alias("u"))
    folders = J.hierarchy(good.where("type = 2").select(p("id").alias("id"), p("parent_id").alias("parent_id"), "title")).select(F.col("id").alias("folder"), "path")
    tags = J.many_to_many(notes.select(F.col("id").alias("note_id")), good.where("type = 6").select(p("note_id").alias("note_id"), p("tag_id").alias("tag_id")), good.where("type = 5").select(p("id").alias("tag_id"), F.col("title").alias("name")), "note_id", "tag_id", "name")
    x = notes.join(folders, "folder", "left").join(tags.withColumnRenamed("note_id", "id"), "id", "left")
    heading = T.element_text(T.tokenize(M.to_html(F.col("body"))), ["h1", "h2", "h3"])
    out = note_rows(x, "joplin", src_path=F.col("src_path"), title=F.coalesce(F.nullif("title", F.lit("")), F.nullif(heading, F.lit("")), F.lit("Untitled note")), html=M.to_html(F.col("body")), tags=F.col("tags"), date_created=C.iso_millis(F.col("c")), date_edited=C.iso_millis(F.col("u")), notebooks=F.when(F.col("path").isNotNull(), F.array("path")))
    return _with_found(out, joplin_resources(out, good, files), bad.select("src_path", F.col("title").alias("note_title"), "message"))


FORMATS: dict[str, Callable[..., ImportResult]] = {"txt": text, "html": html, "md": markdown, "obsidian": obsidian, "skiff": skiff, "textbundle": textbundle, "simplenote": simplenote, "keep": keep, "evernote": evernote, "joplin": joplin, "upnote": upnote, "zoho": zoho, "fusebase": fusebase, "colornote": colornote}


def register_format(name: str, importer: Callable[..., ImportResult]) -> None:
    """importer(files, **options): options are those that Settings hold for its name."""
    FORMATS[name] = importer


def import_notes(files: DataFrame, formats: list[str], settings: Settings | None = None) -> ImportResult:
    """Many formats at once, into one table of notes and one of errors; settings: options of formats and observations."""
    settings = settings or Settings()
    results = [FORMATS[f](files, **settings.options.get(f, {})) for f in formats]
    both = lambda frames: J.union_all(held) if (held := [f for f in frames if f is not None]) else None
    blobs = both([r.blobs for r in results])
    notes = observed(J.union_all([r.notes for r in results]), settings.notes, **{f: F.col("source") == f for f in formats})
    errors = observed(J.union_all([r.errors for r in results]), settings.errors)
    return ImportResult(notes, errors, both([r.attachments for r in results]), blobs.dropDuplicates(["hash"]) if blobs is not None else None)
