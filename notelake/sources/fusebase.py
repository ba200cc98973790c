"""Fusebase export: a JSON file of metadata per note, with note.html beside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from notelake.functions import columns as C
from notelake.operators import joins as J
from notelake.operators import rules as R
from notelake.operators import spans as S
from notelake.operators import tokens as T
from notelake.operators.package import hash_column
from notelake.scratch import staged
from notelake.sources.files import visible
from notelake.sources.notes import ImportResult, note_rows

METADATA = "globalId string, title string, createdAt bigint, dateAdded bigint, updatedAt bigint, dateUpdated bigint, tags array<string>, color string, favorite boolean, parents array<string>, attachments array<struct<globalId string, displayName string, mime string, extra struct<width int, height int>>>"
#: Colours of the export that have one of ours.
COLORS = {"ed5454": "red", "fda639": "orange", "fac92f": "yellow", "8bc34a": "green", "5573a7": "blue", "42a5f5": "blue", "b39ddb": "purple"}
#: The blocks of a page and what a note has in their place.
RULES = [
    *[(None, c, "remove", None, [], None) for c in ("nimbus-board", "outline", "tasks-list", "inline-progress", "step-aggregator")],
    *[("div", c, "rename", "<p{rest}>", [], "</p>") for c in ("paragraph", "table-text-common")],
    (None, "button-single", "replace", '<a href="', [R.part("", "nimbus-button", "single-button", "attr", "data-url"), R.part('" target="', "nimbus-button", "single-button", "attr", "data-target"), R.part('">', "nimbus-button", "single-button", "text")], "</a>"),
    ("date", None, "replace", "<span>", [R.part("", None, "input-date-text")], "</span>"),
    (None, "horizontal-line", "replace", "<hr>", [], ""),
    (None, "inline-dropdown-list", "replace", "<code>", [R.part("", None, "select-label-text", "text")], "</code>"),
    (None, "file-wrapper", "remove", None, [], None),
    (None, "image-wrapper", "remove", None, [], None),
    (None, "syntax-wrapper", "replace", '<pre class="lang-', [R.part("", "syntax", None, "attr", "data-nimbus-language"), R.part('"><code>', "pre", None, "text")], "</code></pre>"),
    (None, "hintblock", "replace", '<div class="callout" data-callout-type="hint"><h3></h3><p>', [R.part("", None, "nimbus-text")], "</p></div>"),
    (None, "nimbus-toggle", "rename", '<div class="callout" data-callout-type="info">', [], "</div>"),
    (None, "nimbus-toggle-header", "replace", "<h3>", [R.part("", None, None, "text")], "</h3>"),
    (None, "nimbus-toggle-content", "rename", "", [], ""),
    ("tfoot", None, "remove", None, [], None),
    ("th", "table-head-item", "replace", "<th><p>", [R.part("", None, None, "text")], "</p></th>"),
    ("td", "table-head-item", "remove", None, [], None),
    (None, "table-wrapper", "rename", "", [], ""),
    (None, "nimbus-html", "replace", "", [R.part("", None, "nimbus-html-body")], ""),
    (
        None, "nimbus-bookmark", "replace", "<p><strong>Title:</strong> ",
        [R.part("", None, "nimbus-bookmark__info__name", "text"), R.part('</p><p><strong>URL:</strong> <a href="', None, "nimbus-bookmark__info__src", "attr", "href"), R.part('">', None, "nimbus-bookmark__info__src-text", "text"), R.part("</a></p><p><strong>Description:</strong> ", None, "nimbus-bookmark__info__desc", "text")],
        "</p><hr>",
    ),
    ("mention", "mention", "remove", None, [], None),
]


def _attr(name: str) -> Column:
    return F.nullif(T.attribute(F.col("tok"), name), F.lit(""))


def _mentions(pages: DataFrame) -> DataFrame:
    """Places of the mentions of notes: links to the notes' ids."""
    m = T.elements(pages, "src_path", r"(?i)^<mention\b").where((_attr("data-mention-type") == "note") & _attr("data-mention-name").isNotNull() & _attr("data-mention-object_id").isNotNull())
    link = F.concat(F.lit('<a href="nn://note/'), note_id(_attr("data-mention-object_id")), F.lit('">'), _attr("data-mention-name"), F.lit("</a>"))
    return m.select("src_path", "pos", "last", link.alias("new"))


def note_id(global_id: Column) -> Column:
    return C.deterministic_id(F.lit("fusebase"), global_id)


def _lists(pages: DataFrame) -> DataFrame:
    """Places of the lists whose items say their indent: nested lists (W5). The kind of a list is that of its first item with one."""
    x = T.elements(pages, "src_path", r"(?i)^<(?:li\b|[a-z]+\b[^>]*\bclass\s*=\s*[\"'][^\"']*\beditor-list\b)")
    on = F.col("tag") != "li"
    so_far = W.partitionBy("src_path").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    x = x.withColumns({"list": F.last(F.when(on, F.col("pos")), True).over(so_far), "end": F.last(F.when(on, F.col("last")), True).over(so_far)})
    items = x.where(~on & (F.col("last") <= F.col("end"))).withColumn("class", F.coalesce(_attr("class"), F.lit("")))
    # items inside items belong to those
    outer = T.outermost(items.withColumn("in", F.concat_ws("#", "src_path", "list")), "in")
    tokens = pages.select("src_path", T.tokenize(F.col("html")).alias("tokens"))
    checked = F.when(_attr("data-checked") == "true", F.lit('<li class="checked">')).otherwise(F.lit('<li class="">'))
    inner = F.slice("tokens", F.col("pos") + 2, F.greatest(F.col("last") - F.col("pos") - 1, F.lit(0)))
    text = F.transform(inner, lambda t: F.when((T.kind_of(t) == "text") & (F.size(inner) == 1), F.concat(F.lit("<p>"), t, F.lit("</p>"))).otherwise(t))
    rows = outer.join(tokens, "src_path").select("in", "src_path", "list", "end", "pos", F.coalesce(F.regexp_extract("class", r"\bindent-(\d+)", 1).try_cast("int"), F.lit(0)).alias("indent"), checked.alias("item"), F.array_join(text, "").alias("body"), F.regexp_extract("class", "list-item-(checkbox|number|bullet)", 1).alias("kind"))
    kinds = rows.groupBy("in", "src_path", "list", "end").agg(F.min_by(F.when(F.col("kind") != "", F.col("kind")), F.when(F.col("kind") != "", F.col("pos"))).alias("kind"))
    made = [S.nested_list(rows.join(kinds.where(test).select("in"), "in").select("in", "pos", "indent", "item", "body"), "in", "pos", "indent", opening, closing) for test, opening, closing in (("kind = 'number'", "<ol>", "</ol>"), ("kind = 'checkbox'", '<ul class="checklist">', "</ul>"), ("coalesce(kind, 'bullet') = 'bullet'", "<ul>", "</ul>"))]
    return kinds.join(J.union_all(made), "in").select("src_path", F.col("list").alias("pos"), F.col("end").alias("last"), F.col("html").alias("new"))


def _attachments(pages: DataFrame, metadata: DataFrame, files: DataFrame, hash_name: str) -> DataFrame:
    """(src_path, pos, last, hash, ..., content): files that the wrappers of a page link to, with what the metadata say of them."""
    x = T.elements(pages, "src_path", r"(?i)^<(?:a\b|[a-z]+\b[^>]*\bclass\s*=\s*[\"'][^\"']*\b(?:file|image)-wrapper\b)")
    on = F.col("tag") != "a"
    so_far = W.partitionBy("src_path").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    x = x.withColumns({"wrapper": F.last(F.when(on, F.col("pos")), True).over(so_far), "end": F.last(F.when(on, F.col("last")), True).over(so_far), "href": _attr("href")})
    first = J.first_match(x.where(~on & (F.col("pos") <= F.col("end"))), ["src_path", "wrapper"], ["pos"]).select("src_path", F.col("wrapper").alias("pos"), F.col("end").alias("last"), F.regexp_replace("href", r"^([^.]*(?:\.(?!/)[^.]*)*)\./", "$1").alias("suffix"))
    own = metadata.select("src_path", F.posexplode("attachments").alias("ord", "a")).where(F.col("a.globalId") != "")
    known = J.first_match(first.join(own, "src_path").where(F.col("suffix").contains(F.col("a.globalId"))), ["src_path", "pos"], ["ord"])
    f = files.select(F.col("path"), "entry_ord", "content")
    held = J.first_match(J.suffix_join(f, known, "path", "suffix", 32), ["src_path", "pos"], ["path", "entry_ord"])
    mark = hash_column(F.col("content"), hash_name)
    mime = F.coalesce(F.nullif("a.mime", F.lit("")), C.sniffed(F.col("content"))["mime"], F.lit("application/octet-stream"))
    out = held.select("src_path", "pos", "last", mark.alias("hash"), F.lit(hash_name).alias("hash_type"), F.coalesce(F.nullif("a.displayName", F.lit("")), mark).alias("filename"), F.length("content").cast("long").alias("size"), mime.alias("mime"), F.col("a.extra.width").alias("width"), F.col("a.extra.height").alias("height"), "content")
    return out.withColumn("new", C.attachment_html(*(F.col(c) for c in ("filename", "size", "hash", "mime", "width", "height"))))


def fusebase(files: DataFrame, hash_name: str = "md5") -> ImportResult:
    """A note per JSON file, its page the file note.html of the same folder (J3) or an empty paragraph; the parents are its notebook path (P5).

    Blocks are rewritten by RULES, lists and attachments beside them; only what is inside the element note-root counts, or
    the whole page where there is none. JSON that can't be read is an error row. Columns of a grid and web clips keep their
    markup in place.
    """
    spark = files.sparkSession
    x = visible(files, ["json"]).select(F.col("path").alias("src_path"), "dir", F.from_json(F.make_valid_utf8(F.col("content").cast("string")), METADATA).alias("m"))
    bad = x.where(F.col("m").isNull() | (F.col("m.globalId").isNull() & F.col("m.title").isNull())).select("src_path", F.lit(None).cast("string").alias("note_title"), F.lit("no metadata of a note").alias("message"))
    x = x.where(F.col("m.globalId").isNotNull() | F.col("m.title").isNotNull()).select("src_path", "dir", "m.*")
    # archives are opened and pages parsed once, for the branches below
    x = J.sibling_file(x, files.withColumn("page", F.make_valid_utf8(F.col("content").cast("string"))), "note.html", "page").withColumn("html", F.coalesce(F.nullif("page", F.lit("")), F.lit("<p></p>")))
    x = staged(x.drop("page"), "fusebase")
    roots = J.first_match(T.elements(x, "src_path", r"(?i)^<[a-z][^>]*\sid\s*=\s*[\"']?note-root[\"'\s>]"), ["src_path"], ["pos"]).select("src_path", "pos", "last")
    tokens = x.select("src_path", "html", T.tokenize(F.col("html")).alias("tokens")).join(roots, "src_path", "left")
    inside = F.array_join(F.slice("tokens", F.col("pos") + 2, F.greatest(F.col("last") - F.col("pos") - 1, F.lit(0))), "")
    pages = tokens.select("src_path", F.coalesce(inside, "html").alias("html"), F.col("pos").isNotNull().alias("whole"))
    pages = staged(pages, "fusebase")
    found = staged(_attachments(pages.where("whole"), x, files, hash_name), "fusebase")
    places = J.union_all([found.select("src_path", "pos", "last", "new"), _mentions(pages.where("whole")), _lists(pages.where("whole"))])
    done = R.apply_rules(pages.where("whole"), "src_path", R.rule_table(spark, RULES), given=places).unionByName(pages.where("not whole").select("src_path", "html"))
    x = x.drop("html").join(done, "src_path")
    folders = F.when(F.size("parents") > 0, F.array("parents")).otherwise(F.array().cast("array<array<string>>"))
    notes = note_rows(
        x, "fusebase", src_path=F.col("src_path"), title=F.col("title"), html=F.col("html"), tags=F.col("tags"), favorite=F.col("favorite"), color=C.lookup(F.col("color"), COLORS), notebooks=folders,
        date_created=C.first_true(F.col("createdAt"), F.col("dateAdded")), date_edited=C.first_true(F.col("updatedAt"), F.col("dateUpdated")),
    )
    return ImportResult(notes, bad, found.select("src_path", "pos", "hash", "hash_type", "filename", "size", "mime"), found.select("hash", F.col("content").alias("data")).dropDuplicates(["hash"]))
