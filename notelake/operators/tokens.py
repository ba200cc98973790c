"""Markup as tokens: a page is one array of tokens in its row, so that rewriting needs no shuffle; explode only to join."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from notelake.functions import columns as C
from notelake.operators import joins as J
from notelake.operators import package as P

#: Script and style elements and comments are one token each, with their content. What isn't closed runs to the end of the
#: page, so that a page is read once, whatever it holds.
TOKEN = r"(?is)<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<!--.*?(?:-->|\z)|<[^>]+(?:>|\z)|[^<]+|<"
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
RESOURCE_TAGS = ["img", "video", "audio", "a"]


def tokenize(html: Column) -> Column:
    """array<string>; their concatenation is the page."""
    return F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0))


def tag_of(token: Column) -> Column:
    return F.lower(F.regexp_extract(token, r"^</?([a-zA-Z][a-zA-Z0-9-]*)", 1))


def kind_of(token: Column) -> Column:
    return (
        F.when(token.rlike(r"(?is)^<(script|style)\b"), "raw").when(token.startswith("<!"), "comment").when(token.rlike("^</[a-zA-Z]"), "close")
        .when(token.rlike("^<[a-zA-Z]") & (tag_of(token).isin(VOID) | token.endswith("/>")), "void").when(token.rlike("^<[a-zA-Z]"), "open").otherwise("text")
    )


def attribute(token: Column, name: str) -> Column:
    """Value of an attribute; null where it is missing."""
    m = rf"(?is)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))"
    return F.when(token.rlike(m), F.concat(*[F.regexp_extract(token, m, i) for i in (1, 2, 3)]))


def explode_tokens(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """TOKEN rows (key, pos, tok, kind, tag)."""
    rows = pages.select(key, F.posexplode(tokenize(F.col(html))).alias("pos", "tok"))
    return rows.select(key, "pos", "tok", kind_of(F.col("tok")).alias("kind"), tag_of(F.col("tok")).alias("tag"))


def _markup(tokens: Column) -> Column:
    """The page without scripts, styles and comments."""
    return F.array_join(F.filter(tokens, lambda t: ~t.rlike(r"(?i)^<(script|style)\b|^<!")), "")


def _first_element(tags: list[str]) -> str:
    return rf"(?is)<({'|'.join(tags)})(?:\s[^>]*)?>(.*?)(?:</\1\s*>|\z)"


def element_text(tokens: Column, tags: list[str]) -> Column:
    """Text of the first element with one of the tags, in document order; null where there is none. One pass over the page."""
    found = F.regexp_extract_all(_markup(tokens), F.lit(_first_element(tags)), F.lit(2))
    return F.trim(F.regexp_replace(F.get(found, F.lit(0)), "<[^>]*>", ""))


def without_first(html: Column, tags: list[str]) -> Column:
    """The page without the first element with one of the tags (outside scripts, styles and comments)."""
    skip = r"(?:<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<!--.*?(?:-->|\z)|[^<]|<(?!(?:" + "|".join(tags) + r")[\s>]))*+"
    return F.regexp_replace(html, rf"(?is)\A({skip})<({'|'.join(tags)})(?:\s[^>]*)?>.*?(?:</\2\s*>|\z)", "$1")


def matched(rows: DataFrame, key: str) -> DataFrame:
    """Token rows (key, pos, kind, tag, ...) with `last` and `depth`.

    last: of an open token the position of its close token, else null; tags are matched apart from each other, a close token
    with the innermost open one of its tag, and one that has none is stray. depth: the closed elements that a token is in.
    Running sums over the tokens of a page, so a page is read once however many elements it leaves open; the windows share
    one partitioning by page.
    """
    return paired(rows.repartition(key), key).drop("first")


def paired(rows: DataFrame, key: str) -> DataFrame:
    """As matched, over rows that lie together by page, and with `first`: the position of the open token, for both of an element's."""
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    of_tag = W.partitionBy(key, "tag").orderBy("pos")
    x = rows.withColumn("__step", step)
    x = x.withColumn("__sum", F.sum("__step").over(of_tag))
    floor = F.least(F.lit(0), F.coalesce(F.min("__sum").over(of_tag.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    # an open token and its close token have one level
    x = x.withColumn("__level", F.when(F.col("__step") == 1, F.col("__sum") - floor).when(F.col("__step") == -1, F.col("__sum") + 1 - floor).otherwise(0))
    of_level = W.partitionBy(key, "tag", "__level").orderBy("pos")
    pair = (F.col("__level") > 0) & (F.col("__step") != 0)
    closes = pair & (F.col("__step") == -1)
    x = x.withColumns({"last": F.when(pair & (F.col("__step") == 1), F.lead("pos").over(of_level)), "__closes": closes, "first": F.when(closes, F.lag("pos").over(of_level))})
    x = x.withColumn("first", F.coalesce("first", F.when(F.col("last").isNotNull(), F.col("pos"))))
    change = F.when(F.col("last").isNotNull(), 1).when(F.col("__closes"), -1).otherwise(0)
    x = x.withColumn("__change", change)
    inside = F.sum("__change").over(W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow))
    return x.withColumn("depth", inside - F.greatest(F.col("__change"), F.lit(0))).drop("__step", "__sum", "__level", "__closes", "__change")


def tag_rows(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, pos, tok, kind, tag) of the tokens that open or close an element, or are one."""
    rows = pages.select(key, F.posexplode(tokenize(F.col(html))).alias("pos", "tok")).where(F.col("tok").rlike("^</?[a-zA-Z]"))
    return rows.select(key, "pos", "tok", kind_of(F.col("tok")).alias("kind"), tag_of(F.col("tok")).alias("tag"))


def visible_text(pages: DataFrame, key: str, removed: list[str], html: str = "html") -> DataFrame:
    """(key, text): text tokens outside the removed elements, scripts, styles and comments; one that isn't closed runs to the end."""
    x = matched(tag_rows(pages, key, html).where(F.col("tag").isin(removed)).drop("tok"), key).where(F.col("kind") == "open")
    gone = x.select(key, "pos", F.coalesce("last", F.lit(1 << 30)).alias("last"), F.lit("").alias("new"))
    return edited(pages, key, gone, html, lambda parts: F.array_join(F.filter(parts, lambda t: kind_of(t) == "text"), "")).withColumnRenamed("html", "text")


def body_tokens(tokens: Column) -> Column:
    """Tokens inside <body>, or all where there is none."""
    at = F.array_position(F.transform(tokens, lambda t: (kind_of(t) == "open") & (tag_of(t) == "body")), True)
    end = F.array_position(F.transform(tokens, lambda t: (kind_of(t) == "close") & (tag_of(t) == "body")), True)
    stop = F.when(end > at, end - at - 1).otherwise(F.size(tokens) - at)
    return F.when(at > 0, F.slice(tokens, (at + 1).cast("int"), F.greatest(stop, F.lit(0)).cast("int"))).otherwise(tokens)


#: Names that set a field of the note.
META = {"created": ["created-on", "created-at", "created"], "edited": ["last-edited-on", "edited-at", "edited", "updated-at", "updated"], "pinned": ["pinned"], "favorite": ["favorite"], "color": ["color"]}


def meta_value(tokens: Column, names: list[str]) -> Column:
    """Content of the last <meta> with one of the names; both name and content are needed."""
    good = F.filter(tokens, lambda t: (tag_of(t) == "meta") & F.lower(attribute(t, "name")).isin(names) & (attribute(t, "content") != ""))
    return attribute(F.get(good, F.size(good) - 1), "content")


#: Distinct links up to which they are sent to all tasks; more are joined.
BROADCAST_LINKS = 100_000


def rewrite_links(pages: DataFrame, key: str, links: DataFrame, html: str = "html") -> DataFrame:
    """(key, html): href of every <a> whose value is in links(href, target) is replaced; others stay.

    Few links go to all tasks as one map, and pages are rewritten in their rows; many links are joined by href and come
    back to their page as a map of its own. Of several targets of one href the smallest counts.
    """
    links = links.groupBy("href").agg(F.min("target").alias("target"))
    page = pages.select(key, tokenize(F.col(html)).alias("tokens"))
    href = lambda t: F.when(t.rlike(r"(?i)^<a\s"), attribute(t, "href"))
    if len(few := links.limit(BROADCAST_LINKS + 1).take(BROADCAST_LINKS + 1)) <= BROADCAST_LINKS:
        spark = pages.sparkSession
        one = spark.createDataFrame([({r.href: r.target for r in few},)], "targets map<string,string>")
        page = page.select("*", one.scalar().alias("targets"))
    else:
        rows = page.select(key, F.explode(F.array_distinct(F.filter(F.transform("tokens", href), lambda h: h.isNotNull()))).alias("href")).join(links, "href")
        page = page.join(rows.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("href", "target"))).alias("targets")), key, "left")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    new = lambda t: F.coalesce(F.replace(t, quoted(href(t)), quoted(F.col("targets")[href(t)])), t)
    return page.select(key, F.array_join(F.transform("tokens", lambda t: F.when(t.rlike(r"(?i)^<a\s"), new(t)).otherwise(t)), "").alias("html"))


def elements(notes: DataFrame, key: str, opening: str, *keep: str, html: str = "html") -> DataFrame:
    """(key, keep..., pos, last, tok, tag): elements whose open tag matches the pattern; last: the position of the close tag, or its own."""
    hit = F.col("tok").rlike(opening) & ~F.col("tok").startswith("</")
    kept = {f"__{c}": F.when(hit, F.col(f"__{c}")) for c in keep if c != key}
    t = notes.select(key, *[F.col(c).alias(f"__{c}") for c in keep if c != key], F.posexplode(tokenize(F.col(html))).alias("pos", "tok")).where(F.col("tok").rlike("^</?[a-zA-Z]"))
    t = t.select(key, "pos", kind_of(F.col("tok")).alias("kind"), tag_of(F.col("tok")).alias("tag"), F.when(hit, F.col("tok")).alias("tok"), *[c.alias(k) for k, c in kept.items()])
    x = matched(t, key).where(F.col("tok").isNotNull())
    return x.select(key, *[F.col(f"__{c}").alias(c) for c in keep if c != key], "pos", F.coalesce("last", "pos").alias("last"), "tok", "tag")


def resource_links(notes: DataFrame, key: str, path: str, html: str = "html") -> DataFrame:
    """(key, pos, last, tag, source, attrs..., file_path): resource elements with the path that src or href resolves to."""
    t = elements(notes.withColumn("__path", F.col(path)), key, rf"(?i)^<({'|'.join(RESOURCE_TAGS)})[\s>/]", "__path", html=html)
    source = F.coalesce(F.nullif(attribute(F.col("tok"), "src"), F.lit("")), F.nullif(attribute(F.col("tok"), "href"), F.lit("")))
    names = {a: attribute(F.col("tok"), a) for a in ("title", "filename", "mime")}
    out = t.select(key, "__path", "pos", "last", "tag", source.alias("source"), *[c.alias(f"attr_{a}") for a, c in names.items()])
    return out.where(F.col("source").isNotNull()).withColumn("file_path", C.decode_uri(C.join_path(C.dirname(F.col("__path")), F.col("source")))).drop("__path")


def outermost(places: DataFrame, key: str) -> DataFrame:
    """The places (key, pos, last, ...) that don't begin inside an earlier one; of those that begin together the longest."""
    before = W.partitionBy(key).orderBy("pos", F.col("last").desc()).rowsBetween(W.unboundedPreceding, -1)
    return places.withColumn("__reach", F.max("last").over(before)).where(F.col("__reach").isNull() | (F.col("pos") > F.col("__reach"))).drop("__reach")


def edited(pages: DataFrame, key: str, places: DataFrame, html: str, render: Callable[[Column], Column], shown: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(key, html): the page's tokens between the places, rendered, with each place's `new`. Each token is copied once.

    places: (key, pos, last, new); shown: what stands for the tokens of the page and a place's new, if that isn't text.
    """
    mine = outermost(places, key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "last", "new"))).alias("__places"))
    page = pages.select(key, F.col(html).alias("html"), tokenize(F.col(html)).alias("__tokens")).join(mine, key, "left")
    spot = F.coalesce("__places", F.array().cast(mine.schema["__places"].dataType))
    start = lambda i: F.when(i > 0, F.get(F.col("__places"), i - 1)["last"] + 1).otherwise(0)
    new = lambda e: shown(F.col("__tokens"), e["new"]) if shown else e["new"]
    part = lambda e, i: F.concat(render(F.slice("__tokens", (start(i) + 1).cast("int"), (e["pos"] - start(i)).cast("int"))), new(e))
    tail = F.slice("__tokens", F.least(F.element_at("__places", -1)["last"] + 2, F.lit(1 << 30)).cast("int"), F.size("__tokens"))
    whole = F.concat(F.array_join(F.transform(spot, part), ""), render(tail))
    return page.select(key, F.when(F.col("__places").isNull(), render(F.col("__tokens"))).otherwise(whole).alias("html"))


def replace_elements(notes: DataFrame, key: str, places: DataFrame, html: str = "html") -> DataFrame:
    """(key, html): the tokens from pos to last become `new`, for each row of places(key, pos, last, new); those inside another are ignored (T4)."""
    return edited(notes, key, places, html, lambda parts: F.array_join(parts, ""))


def import_resources(notes: DataFrame, files: DataFrame, key: str, path: str, hash_name: str = "md5", given: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(notes, attachments, blobs): resource elements that resolve to a file become attachments.

    files: FILE rows; of several with one path the first entry counts. given (source, content, name, ext): resources of the
    caller's own, tried first, by the element's src or href (X4). Elements without a file stay. attachments
    (key, pos, hash, ...) are in document order by pos; blobs (hash, data) hold each content once.
    """
    links = resource_links(notes, key, path)
    one = J.first_match(files.select(F.col("path").alias("file_path"), "name", "ext", "content", "entry_ord"), ["file_path"], ["entry_ord"]).drop("entry_ord")
    x = links.join(one, "file_path", "left")
    if given is not None:
        own = given.groupBy("source").agg(F.min(F.struct("name", "ext", "content")).alias("own"))
        x = x.join(own, "source", "left").withColumns({c: F.coalesce(F.col(f"own.{c}"), F.col(c)) for c in ("name", "ext", "content")}).drop("own")
    x = x.where(F.col("content").isNotNull())
    mark = P.hash_column(F.col("content"), hash_name)
    found = C.sniffed(F.col("content"))
    filename = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("attr_title", "attr_filename", "name")], mark)
    mime = F.coalesce(found["mime"], F.nullif(F.col("attr_mime"), F.lit("")), C.lookup(F.col("ext"), C.RESOURCE_MIME), F.lit("application/octet-stream"))
    x = x.withColumns({"hash": mark, "hash_type": F.lit(hash_name), "filename": F.when(found["ext"].isNotNull(), C.append_extension(filename, found["ext"])).otherwise(filename), "mime": mime, "size": F.length("content").cast("long")})
    none = F.lit(None).cast("int")
    places = x.select(key, "pos", "last", C.attachment_html(F.col("filename"), F.col("size"), F.col("hash"), F.col("mime"), none, none).alias("new"))
    rewritten = notes.drop("html").join(replace_elements(notes, key, places), key)
    blobs = x.select("hash", F.col("content").alias("data")).dropDuplicates(["hash"])
    return rewritten, x.select(key, "pos", "hash", "hash_type", "filename", "size", "mime"), blobs
