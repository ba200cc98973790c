"""Queries over the driver tables, one for each operator, with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from notelake.functions import columns as C
from notelake.functions import markdown as M
from notelake.operators import joins as J
from notelake.operators import package as P
from notelake.operators import rules as U
from notelake.operators import spans as S
from notelake.operators import tokens as T
from notelake.sources import colornote as CN
from notelake.sources import notes as N

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- markup

_TOKENS_SQL = "select page_id, unnest(regexp_extract_all(html, '(?is)<script\\b.*?(?:</script\\s*>|\\z)|<style\\b.*?(?:</style\\s*>|\\z)|<!--.*?(?:-->|\\z)|<[^>]+(?:>|\\z)|[^<]+|<')) as tok, generate_subscripts(regexp_extract_all(html, '(?is)<script\\b.*?(?:</script\\s*>|\\z)|<style\\b.*?(?:</style\\s*>|\\z)|<!--.*?(?:-->|\\z)|<[^>]+(?:>|\\z)|[^<]+|<'), 1) as pos from pages"
_TITLE_SQL = "trim(regexp_extract(html, '(?is)<(title|h1|h2)\\b[^>]*>([^<]*)', 2))"


@query(f"select page_id, {_TITLE_SQL} as title from pages")
def html_title(spark, sf_dir):
    p = _table(spark, sf_dir, "pages")
    return p.select("page_id", T.element_text(T.tokenize(F.col("html")), ["title", "h1", "h2"]).alias("title"))


@query(f"with t as ({_TOKENS_SQL}) select page_id, count(*) as tokens, md5(string_agg(tok, '' order by pos)) as whole, sum(case when regexp_matches(tok, '^</[a-zA-Z]') then 1 else 0 end)::bigint as closes from t group by page_id")
def html_tokens(spark, sf_dir):
    t = T.explode_tokens(_table(spark, sf_dir, "pages"), "page_id")
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "tok"))), lambda x: x["tok"]), "")
    return t.groupBy("page_id").agg(F.count("*").alias("tokens"), F.md5(whole).alias("whole"), F.sum((F.col("kind") == "close").cast("long")).alias("closes"))


@query(
    f"""with t as ({_TOKENS_SQL}), a as (select page_id, pos - 1 as pos, regexp_extract(tok, '(?is)\\shref\\s*=\\s*"([^"]*)"', 1) as href from t where regexp_matches(tok, '(?i)^<a\\b'))
    select page_id, pos::int as pos, href, regexp_replace(regexp_replace(split_part(regexp_replace(url, '^[a-z]+://', ''), '?', 1), '/[^/]*$', '') || '/' || href, '/+', '/', 'g') as resolved
    from a join pages using (page_id)"""
)
def html_links(spark, sf_dir):
    """Links with the path they resolve to, relative to the page's folder."""
    p = _table(spark, sf_dir, "pages")
    t = T.explode_tokens(p, "page_id").where((F.col("tag") == "a") & (F.col("kind") == "open")).select("page_id", "pos", T.attribute(F.col("tok"), "href").alias("href"))
    folder = C.dirname(F.substring_index(F.regexp_replace("url", "^[a-z]+://", ""), "?", 1))
    return t.join(p.select("page_id", folder.alias("folder")), "page_id").select("page_id", "pos", "href", C.decode_uri(C.join_path(F.col("folder"), F.col("href"))).alias("resolved"))


_INTERVALS_SQL = f"""
with t as ({_TOKENS_SQL}),
k as (select page_id, pos - 1 as pos, tok, lower(regexp_extract(tok, '^</?([a-zA-Z][a-zA-Z0-9-]*)', 1)) as tag,
        case when regexp_matches(tok, '(?is)^<(script|style)\\b|^<!') then 0 when regexp_matches(tok, '^</[a-zA-Z]') then -1
             when not regexp_matches(tok, '^<[a-zA-Z]') or tok like '%/>' or regexp_matches(tok, '(?i)^<(area|base|br|col|embed|hr|img|input|link|meta|source|track|wbr)(?:[^a-zA-Z0-9-]|$)') then 0 else 1 end as step from t),
s as (select *, sum(step) over w as total from k window w as (partition by page_id, tag order by pos)),
l as (select *, case step when 1 then total when -1 then total + 1 end - least(0, coalesce(min(total) over (partition by page_id, tag order by pos rows between unbounded preceding and 1 preceding), 0)) as level from s),
m as (select *, case when step = 1 then lead(pos) over (partition by page_id, tag, level order by pos) end as last from l),
c as (select *, case when last is not null then 1 when step = -1 and level > 0 then -1 else 0 end as change from m)
select page_id, pos::int as pos, last::int as last, (sum(change) over (partition by page_id order by pos) - greatest(change, 0))::bigint as depth from c
"""


@query(_INTERVALS_SQL)
def html_intervals(spark, sf_dir):
    """All tokens of all pages with the close token of each element and the depth."""
    t = T.explode_tokens(_table(spark, sf_dir, "pages"), "page_id").drop("tok")
    return T.matched(t, "page_id").select("page_id", "pos", "last", "depth")


@query("select page_id, md5(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->', '', 'g'), '(?is)<title\\b.*?</title\\s*>', '', 'g'), '<[^>]+>', '', 'g')) as text_md5 from pages")
def html_remove(spark, sf_dir):
    p = _table(spark, sf_dir, "pages")
    return T.visible_text(p, "page_id", ["title"]).select("page_id", F.md5("text").alias("text_md5"))


# rules of the query below: (tag, class, op, opening, parts, closing)
PAGE_RULES = [
    (None, "ad", "remove", None, [], None),
    ("nav", None, "replace", "<menu>", [U.part("<i>", "li", None, "text"), U.part("</i><b>", "a", None, "attr", "href"), U.part("</b>", "ul", None, "inner"), U.part("", "table", None, "inner", None, True)], "</menu>"),
    ("h1", None, "replace", "<h2>", [U.part("", None, None, "text")], "</h2>"),
    ("aside", None, "replace", "<q>", [U.part("", "cite", None, "inner")], "</q>"),
    ("article", None, "rename", '<section class="a">', [], "</section>"),
    ("footer", None, "rename", "", [], ""),
    ("p", None, "rename", '<p class="x">', [], "</p>"),
]
_RULES_SQL = """
select page_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(html, '<p>', '<p class="x">'), '<article>', '<section class="a">'), '</article>', '</section>'), '</?footer>', '', 'g')
  , '(?s)<div class="ad">.*?</div>', '', 'g'), '(?s)<nav><ul>(<li><a href="([^"]*)">([^<]*)</a></li>.*?)</ul></nav>', '<menu><i>\\3</i><b>\\2</b>\\1</menu>'), '(?s)<h1>(.*?)</h1>', '<h2>\\1</h2>')) as html_md5 from pages
"""


@query(_RULES_SQL)
def html_rules(spark, sf_dir):
    """Pages rewritten by a table of rules: removed, replaced by parts of their own, renamed and unwrapped elements."""
    pages = _table(spark, sf_dir, "pages")
    return U.apply_rules(pages, "page_id", U.rule_table(spark, PAGE_RULES)).select("page_id", F.md5("html").alias("html_md5"))


@query("select page_id, md5(regexp_replace(regexp_extract(html, '(?is)<body[^>]*>(.*)$', 1), '(?is)</body>.*$', '')) as body_md5 from pages")
def html_body(spark, sf_dir):
    p = _table(spark, sf_dir, "pages")
    return p.select("page_id", F.md5(F.array_join(T.body_tokens(T.tokenize(F.col("html"))), "")).alias("body_md5"))


@query("select page_id, 'c' || (page_id % 7) as color, case when page_id % 2 = 0 then 'true' else 'false' end as pinned, cast(1600000000000 + page_id as varchar) as created from pages")
def html_meta(spark, sf_dir):
    """The last <meta> of each target wins (P3); the tags are put in front of the page, two of them twice."""
    tag = lambda name, c: F.concat(F.lit(f'<meta name="{name}" content="'), c.cast("string"), F.lit('">'))
    i = F.col("page_id")
    head = F.concat(tag("created", F.lit(1)), tag("color", F.lit("red")), tag("Created-At", 1_600_000_000_000 + i), tag("color", F.concat(F.lit("c"), i % 7)), tag("pinned", F.when(i % 2 == 0, "true").otherwise("false")))
    t = _table(spark, sf_dir, "pages").select("page_id", T.tokenize(F.concat(head, F.col("html"))).alias("t"))
    return t.select("page_id", *[T.meta_value(F.col("t"), T.META[k]).alias(k) for k in ("color", "pinned", "created")])


@query(
    f"""with t as ({_TOKENS_SQL}), n as (select lower(split_part({_TITLE_SQL}, ' ', 1)) as w, min(page_id) as id from pages group by 1),
    a as (select *, case when regexp_matches(tok, '(?i)^<a\\b') then regexp_extract(tok, '(?is)\\shref\\s*=\\s*"([^"]*)"', 1) end as href from t),
    b as (select page_id, pos, case when n.id is null then tok else replace(tok, '"' || href || '"', '"nn://note/' || substr(sha256('pages' || chr(31) || n.id::varchar), 1, 24) || '"') end as tok from a left join n on lower(substr(href, 2)) = w)
    select page_id, md5(string_agg(tok, '' order by pos)) as html_md5 from b group by page_id"""
)
def html_attr_rewrite(spark, sf_dir):
    """Links whose last part is the first word of a page's title become links to that page."""
    p = _table(spark, sf_dir, "pages")
    first = F.lower(F.substring_index(T.element_text(T.tokenize(F.col("html")), ["title", "h1", "h2"]), " ", 1))
    target = p.groupBy(first.alias("w")).agg(F.min("page_id").alias("id")).select("w", F.concat(F.lit("nn://note/"), C.deterministic_id(F.lit("pages"), F.col("id").cast("string"))).alias("target"))
    hrefs = T.explode_tokens(p, "page_id").where((F.col("tag") == "a") & (F.col("kind") == "open")).select(T.attribute(F.col("tok"), "href").alias("href")).distinct()
    links = hrefs.join(target, F.lower(F.substring("href", 2, 1 << 20)) == F.col("w")).select("href", "target")
    return T.rewrite_links(p, "page_id", links).select("page_id", F.md5("html").alias("html_md5"))


@query("select page_id, md5(regexp_replace(html, '(?is)<title\\b[^>]*>.*?</title\\s*>|<h1\\b[^>]*>.*?</h1\\s*>|<h2\\b[^>]*>.*?</h2\\s*>', '')) as html_md5 from pages")
def html_without_title(spark, sf_dir):
    """Pages without the element that gives the title."""
    return _table(spark, sf_dir, "pages").select("page_id", F.md5(T.without_first(F.col("html"), ["title", "h1", "h2"])).alias("html_md5"))


@query(
    f"""with t as ({_TOKENS_SQL}), a as (select *, case when regexp_matches(tok, '(?i)^<a\\s') then regexp_extract(tok, '(?is)\\shref\\s*=\\s*"/([^"/]*)"', 1) else '' end as name,
      lead(tok) over (partition by page_id order by pos) as inner_tok, lead(tok, 2) over (partition by page_id order by pos) as after from t),
    f as (select w as name, n::bigint as size, md5(w) as hash from (select word as w, octet_length(encode(word)) as n from (select distinct unnest(string_split(text, ' ')) as word from benchmark) where length(word) % 2 = 1)),
    b as (select a.page_id, pos, tok, f.name is not null as hit, f.name as found, size, hash from a left join f on a.name = f.name and a.name <> ''),
    c as (select *, coalesce(lag(hit, 1) over w, false) or coalesce(lag(hit, 2) over w, false) as gone from b window w as (partition by page_id order by pos)),
    d as (select *, 'class="attachment" data-filename="' || found || '" data-size="' || size || '" data-hash="' || hash || '" data-mime="application/octet-stream"' as attrs from c where not gone)
    select page_id, md5(string_agg(case when hit then '<span ' || attrs || ' contenteditable="false" title="' || found || '">' || chr(10) || '      <em>&nbsp;</em>' || chr(10) || '      <span class="filename">' || found || '</span>' || chr(10) || '    </span>' else tok end, '' order by pos)) as html_md5,
      sum(hit::int)::bigint as attachments from d group by page_id"""
)
def html_resources(spark, sf_dir):
    """Links to files become attachments (J1, T3, T4, P14): a file for each word of odd length that the benchmark has, named and filled with it."""
    words = _table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("name")).distinct().where(F.char_length("name") % 2 == 1)
    files = words.select(F.concat(F.lit("site/"), F.col("name")).alias("path"), "name", F.lit("").alias("ext"), F.col("name").cast("binary").alias("content"), F.lit(0).alias("entry_ord"))
    pages = _table(spark, sf_dir, "pages").select("page_id", "html", F.lit("site/page.html").alias("path"))
    notes, attachments, _ = T.import_resources(pages, files, "page_id", "path")
    counts = attachments.groupBy("page_id").agg(F.count("*").alias("attachments"))
    return notes.join(counts, "page_id", "left").select("page_id", F.md5("html").alias("html_md5"), F.coalesce("attachments", F.lit(0).cast("long")).alias("attachments"))


@query("""select page_id, case when n >= 2 and page_id % 2 = 0 then true when page_id % 2 = 1 and n + 2 >= 4 then true else false end as linked,
    case when page_id % 3 = 0 then '' else '<hr></hr><p>Clipped from: <a href="' || url || '">' || case when page_id % 3 = 1 then url else 'x' end || '</a></p>' end as footer
    from (select *, len(list_filter(string_split(regexp_replace(split_part(url, '?', 1), '^[a-z]+://', ''), '/'), lambda x: x <> '')) as n from pages)""")
def clip_links(spark, sf_dir):
    """Which addresses are links to notes of the same app, and the footer of a clip (F7, F30): the page's path as a note's, in both forms."""
    p = _table(spark, sf_dir, "pages")
    path, i = F.regexp_replace(F.substring_index("url", "?", 1), "^[a-z]+://", ""), F.col("page_id")
    link = F.when(i % 2 == 0, F.concat(F.lit("evernote:///view/a/b/"), path)).otherwise(F.concat(F.lit("https://www.evernote.com/shard/a/b/"), path))
    footer = C.web_clip_footer(F.when(i % 3 > 0, F.col("url")), F.when(i % 3 == 2, F.lit("x")))
    return p.select("page_id", C.is_evernote_link(link).alias("linked"), footer.alias("footer"))


@query("with w as (select doc_id, regexp_replace(trim(replace(w, '#', '')), '^#', '') as tag, spot from (select doc_id, unnest(string_split(text, ' ')) as w, generate_subscripts(string_split(text, ' '), 1) as spot from documents)), f as (select doc_id, trim(tag) as tag, min(spot) as spot from w where trim(tag) <> '' group by all), g as (select doc_id, md5(string_agg(tag, chr(31) order by spot)) as tags_md5, count(*) as n from f group by doc_id) select documents.doc_id, coalesce(tags_md5, md5('')) as tags_md5, coalesce(n, 0)::int as n from documents left join g using (doc_id)")
def distinct_tags(spark, sf_dir):
    """Distinct words of a text in the order of their first occurrence, as tags are taken (A3)."""
    d = _table(spark, sf_dir, "documents").select("doc_id", C.distinct_tags(F.transform(F.split(F.regexp_replace("text", "#", ""), " "), lambda w: F.concat(F.lit("#"), w))).alias("t"))
    return d.select("doc_id", F.md5(F.array_join("t", "\x1f")).alias("tags_md5"), F.size("t").alias("n"))


@query("select page_id, array_to_string(list_filter(string_split(regexp_replace(split_part(url, '?', 1), '/[^/]*$', ''), '/')[3:], lambda x: x <> ''), '|') as notebooks from pages")
def url_notebook_path(spark, sf_dir):
    p = _table(spark, sf_dir, "pages")
    return p.select("page_id", F.array_join(C.notebook_path(C.dirname(F.substring_index("url", "?", 1))), "|").alias("notebooks"))


@query(f"select page_id, {_TITLE_SQL} as title, md5(regexp_replace(regexp_extract(html, '(?is)<body[^>]*>(.*)$', 1), '(?is)</body>.*$', '')) as content_hash, 2 as compatibility_version, 'html' as source, len(regexp_extract_all(html, '(?i)<(img|video|audio|a)[ >/]'))::int as resources from pages")
def html_notes(spark, sf_dir):
    """Pages to stamped note rows: title, body, hash, number of resource elements."""
    p = _table(spark, sf_dir, "pages").select("page_id", T.tokenize(F.col("html")).alias("t"))
    n = p.select("page_id", T.element_text(F.col("t"), ["title", "h1", "h2"]).alias("title"), P.hash_column(F.array_join(T.body_tokens(F.col("t")), "")).alias("content_hash"), F.size(F.filter("t", lambda x: T.tag_of(x).isin(T.RESOURCE_TAGS) & ~T.kind_of(x).isin("close", "text", "raw", "comment"))).alias("resources"))
    return P.stamp(n, "html")


# ---- text

_ESCAPED_SQL = "replace(replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"
_ENTITIES_SQL = f"array_to_string(list_transform(string_split({_ESCAPED_SQL}, ''), lambda c: case when unicode(c) > 127 then '&#x' || lower(to_hex(unicode(c))) || ';' else c end), '')"
_LINE_SQL = f"regexp_replace(replace(replace({_ENTITIES_SQL}, '  ', '&nbsp;&nbsp;'), '&nbsp; ', '&nbsp;&nbsp;'), '^ ', '&nbsp;')"


@query(f"""select doc_id, md5(array_to_string(list_transform(string_split_regex(text, '\\r\\n|\\n'), lambda x: '<p data-spacing="single">' || {_LINE_SQL} || '</p>'), '')) as html_md5 from documents""")
def text_to_html(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(C.text_to_html(F.col("text"))).alias("html_md5"))


@query("select doc_id, md5(replace(replace(replace(replace(text, chr(10) || chr(10), chr(1) || chr(1)), chr(1) || chr(10), chr(1) || chr(1)), chr(10), '  ' || chr(10)), chr(1), chr(10))) as md5 from documents")
def hard_breaks(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(C.hard_breaks(F.col("text"))).alias("md5"))


@query("select doc_id, coalesce(nullif(trim(string_split_regex(text, '\\r\\n|\\n')[1]), ''), 'Untitled note') as title from documents")
def first_line_title(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", C.first_line_title(F.col("text")).alias("title"))


@query("select source, case when l.quality is null then 'no quality label' else 'ok' end as status, count(*) as n from documents d left join labels l using (doc_id) group by all")
def required_split(spark, sf_dir):
    """Rows without a required field go to the error table."""
    d = _table(spark, sf_dir, "documents").select("doc_id", "source").join(_table(spark, sf_dir, "labels"), "doc_id", "left")
    good, errors = N.split_required(d, {"quality": "no quality label"})
    return good.select("source", F.lit("ok").alias("status")).unionByName(errors.select("source", F.col("message").alias("status"))).groupBy("source", "status").agg(F.count("*").alias("n"))


@query("select doc_id, md5(concat_ws('|', coalesce(nullif(trim(string_split_regex(text, '\\r\\n|\\n')[1]), ''), 'Untitled note'), lang, source, '2')) as stamp from documents")
def note_stamp(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    return d.select("doc_id", P.hash_column(F.concat_ws("|", C.first_line_title(F.col("text")), "lang", "source", F.lit(str(P.COMPATIBILITY_VERSION)))).alias("stamp"))


@query("select doc_id, sha256(concat_ws(chr(31), 'documents', doc_id::varchar))[1:24] as note_id, ('0x' || sha256(concat_ws(chr(31), 'documents', doc_id::varchar))[1:8])::bigint as seconds from documents")
def link_ids(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", C.deterministic_id(F.lit("documents"), F.col("doc_id").cast("string")).alias("note_id"))
    return d.withColumn("seconds", C.id_seconds(F.col("note_id")))


# ---- package, dedup, pages


@query("select doc_id, hash from (select doc_id, md5(text) as hash, row_number() over (partition by md5(text) order by doc_id) as rn from documents) where rn = 1")
def exact_dedup_first(spark, sf_dir):
    return P.dedup_first(_table(spark, sf_dir, "documents").select(F.md5("text").alias("hash"), "doc_id", F.col("doc_id").alias("ord")), ["hash"], "ord").select("doc_id", "hash")


def packed(d: DataFrame) -> DataFrame:
    """Paths and sizes of the package of documents (K3, K4)."""
    notes = d.select(F.struct(F.col("lang").alias("title"), "source").alias("note"), F.array(F.md5("text")).alias("hashes"), F.col("doc_id").alias("src_ord"))
    blobs = d.select(F.md5("text").alias("hash"), F.encode("text", "utf-8").alias("data"))
    return P.package(notes, blobs).select("path", F.length("data").alias("size"))


@query(
    """with n as (select doc_id, '{"title":"' || lang || '","source":"' || source || '"}' as json, md5(text) as hash from documents join labels using (doc_id))
    select md5(json) || '/note.json' as path, octet_length(encode(json))::int as size from n union select md5(json) || '/attachments/' || hash, octet_length(encode(text))::int from n join documents using (doc_id)"""
)
def package_paths(spark, sf_dir):
    return packed(_table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels").select("doc_id"), "doc_id"))


@query("select doc_id, ordinal from (select doc_id, row_number() over (order by doc_id) as ordinal from documents) where ordinal between 101 and 200")
def page_slice(spark, sf_dir):
    return P.page(_table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 100, 100).select("doc_id", F.col("ordinal").cast("long").alias("ordinal"))


@query("select lang as source, count(*) as notes, sum(count(*)) over (order by lang)::bigint as running from documents group by lang")
def note_counts(spark, sf_dir):
    n = _table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("source")).agg(F.count("*").alias("notes"))
    return n.withColumn("running", F.sum("notes").over(W.orderBy("source")))


@query("select 'documents' as source, doc_id as id, md5(text) as hash from documents union all select 'pages', page_id, md5(html) from pages union all select 'benchmark', item_id, md5(text) from benchmark")
def union_formats(spark, sf_dir):
    parts = [("documents", "doc_id", "text"), ("pages", "page_id", "html"), ("benchmark", "item_id", "text")]
    return J.union_all([_table(spark, sf_dir, t).select(F.lit(t).alias("source"), F.col(k).alias("id"), F.md5(c).alias("hash")) for t, k, c in parts])


# ---- joins


@query("select doc_id, item_id from documents d join benchmark b on contains(d.text, b.text) where b.text <> ''")
def contains_join(spark, sf_dir):
    return J.contains_join(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), "doc_id", "item_id")


@query("select o_orderkey, c_custkey from orders join customer on ends_with(c_name, lpad(o_custkey::varchar, 9, '0'))")
def suffix_join(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select("o_orderkey", F.lpad(F.col("o_custkey").cast("string"), 9, "0").alias("suffix"))
    return J.suffix_join(_table(spark, sf_dir, "customer").select("c_custkey", "c_name"), o, "c_name", "suffix", 6).select("o_orderkey", "c_custkey")


@query("with m as (select source, lang, min(doc_id) as first_id from documents where lang = 'en' group by all) select d.doc_id, coalesce(m.first_id, -1) as content_id from documents d left join m on d.source = m.source and d.lang = m.lang")
def dir_name_join(spark, sf_dir):
    """A file of the same folder and a fixed name, or a default."""
    d = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    named = d.where(F.col("lang") == "en").groupBy("source", "lang").agg(F.min("doc_id").alias("first_id"))
    return d.join(named, ["source", "lang"], "left").select("doc_id", F.coalesce("first_id", F.lit(-1)).alias("content_id"))


@query("with r as (select md5(text) as hash, min(doc_id) as file from documents group by 1) select d.doc_id, r.file from documents d join r on md5(d.text) = r.hash")
def hash_join_media(spark, sf_dir):
    """Media to the first resource of the same content hash."""
    d = _table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("hash"))
    return d.join(d.groupBy("hash").agg(F.min("doc_id").alias("file")), "hash").select("doc_id", "file")


@query("select o_orderkey, string_agg(p_brand, ',' order by p_brand) as tags from (select distinct o_orderkey, p_brand from orders join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey) group by o_orderkey")
def tags_m2n(spark, sf_dir):
    notes = _table(spark, sf_dir, "orders").select("o_orderkey")
    pairs = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey"))
    return J.many_to_many(notes, pairs, _table(spark, sf_dir, "part"), "o_orderkey", "p_partkey", "p_brand").select("o_orderkey", F.array_join("tags", ",").alias("tags"))


@query("select 'c' || c_custkey as id, r_name || '/' || n_name || '/' || c_name as path from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey union all select 'n' || n_nationkey, r_name || '/' || n_name from nation join region on r_regionkey = n_regionkey union all select 'r' || r_regionkey, r_name from region")
def folder_hierarchy(spark, sf_dir):
    r, n, c = (_table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    key = lambda p, col: F.concat(F.lit(p), F.col(col).cast("string"))
    folders = r.select(key("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("title"))
    folders = folders.unionByName(n.select(key("n", "n_nationkey").alias("id"), key("r", "n_regionkey").alias("parent_id"), F.col("n_name").alias("title")))
    folders = folders.unionByName(c.select(key("c", "c_custkey").alias("id"), key("n", "c_nationkey").alias("parent_id"), F.col("c_name").alias("title")))
    return J.hierarchy(folders).select("id", F.array_join("path", "/").alias("path"))


_DEEP_SQL = """
with recursive f as (select o_orderkey as n, row_number() over (order by o_orderkey) as i from orders),
g as (select i, case when i % 512 = 1 then null else i - 1 end as up, n::varchar as title from f),
t as (select i, title as path, 1 as depth from g where up is null union all select g.i, t.path || '/' || g.title, depth + 1 from g join t on g.up = t.i)
select i as id, depth::int as depth, md5(path) as path_md5 from t
"""


@query(_DEEP_SQL)
def folder_hierarchy_deep(spark, sf_dir):
    """Chains of 512 folders: each order is in the folder of the one before it."""
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("n"))
    f = P.page(o, "n", 0, o.count()).select(F.col("ordinal").cast("long").alias("id"), F.col("n").cast("string").alias("title"))
    f = f.withColumn("parent_id", F.when(F.col("id") % 512 != 1, F.col("id") - 1))
    x = J.hierarchy(f)
    return x.select("id", F.size("path").alias("depth"), F.md5(F.array_join("path", "/")).alias("path_md5"))


@query("select o_custkey, arg_max(o_orderkey, o_orderkey) as o_orderkey, arg_max(o_orderstatus, o_orderkey) as o_orderstatus from orders group by o_custkey")
def self_lookup_last_wins(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return J.last_wins(o, ["o_custkey"], "o_orderkey")


@query("select o_custkey, string_agg(o_orderkey::varchar, ',' order by o_orderkey) as paths from orders group by o_custkey")
def group_paths(spark, sf_dir):
    return _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",").alias("paths"))


@query("select c_custkey, o_orderkey from (select c_custkey, o_orderkey, row_number() over (partition by c_custkey order by o_orderdate, o_orderkey) as rn from customer left join orders on o_custkey = c_custkey) where rn = 1")
def first_match(spark, sf_dir):
    c, o = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "orders")
    joined = c.join(o, c["c_custkey"] == o["o_custkey"], "left").select("c_custkey", "o_orderkey", "o_orderdate")
    return J.first_match(joined, ["c_custkey"], ["o_orderdate", "o_orderkey"]).select("c_custkey", "o_orderkey")


# ---- events as notes with state

_CODE_SQL = "[0, 16, 32, 48, 80, 96, 112, 1][(event_id % 8) + 1]"


@query(
    f"""with e as (select event_id, {_CODE_SQL} as code, epoch_us(ts) // 1000 as base from events), f as (select *, case code when 16 then 'day' when 32 then 'week' when 48 then 'week' when 80 then 'month' when 96 then 'month' when 112 then 'year' end as recurring_mode from e)
    select event_id, base as date, case when recurring_mode is null then 'once' else 'repeat' end as mode, recurring_mode,
    case when code = 32 then '1,2,3,4,5' when recurring_mode = 'week' then dayofweek(make_timestamp(base * 1000))::varchar when recurring_mode = 'month' then day(make_timestamp(base * 1000))::varchar end as selected_days from f"""
)
def reminders(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    code = F.element_at(F.array(*[F.lit(x) for x in (0, 16, 32, 48, 80, 96, 112, 1)]), (F.col("event_id") % 8 + 1).cast("int"))
    base = F.unix_millis(F.col("ts").cast("timestamp"))
    return e.select("event_id", C.reminder(code, F.lit(0).cast("long"), base).alias("r")).select("event_id", "r.date", "r.mode", "r.recurring_mode", F.array_join("r.selected_days", ",").alias("selected_days"))


@query(
    """with e as (select event_id, event_type, (event_id % 5) * 64 as type, case event_id % 4 when 3 then null else event_id % 4 // 3 end as encrypted, (event_id % 3) * 16 as active_state, (event_id % 2) * 16 as space from events)
    select event_id, event_type, case when space = 16 then true end as archived, case event_id % 12 when 1 then '#f28b82' when 2 then '#fbbc04' end as color from e where type not in (128, 256) and encrypted = 0 and active_state not in (16, 32)"""
)
def record_filter(spark, sf_dir):
    i = F.col("event_id")
    e = _table(spark, sf_dir, "events").select("event_id", "event_type", ((i % 5) * 64).alias("type"), F.when(i % 4 != 3, F.lit(0)).alias("encrypted"), ((i % 3) * 16).alias("active_state"), ((i % 2) * 16).alias("space"))
    return N.live_records(e).select("event_id", "event_type", F.when(F.col("space") == 16, True).alias("archived"), C.lookup(i % 12, {1: C.KEEP_COLORS["RED"], 2: C.KEEP_COLORS["ORANGE"]}).alias("color"))


@query(
    f"""with d as (select doc_id, lang, source, [0, 16, 32, 48, 80, 96, 112, 1][(doc_id % 8) + 1] as code, (doc_id % 5) * 86400000 as base,
    array_to_string(list_transform(string_split_regex(coalesce(text, ''), '\\r\\n|\\n'), lambda x: '<p data-spacing="single">' || {_LINE_SQL} || '</p>'), '') as html from documents where doc_id % 6 <> 5),
    m as (select *, case when base > 0 then case code when 16 then 'day' when 32 then 'week' when 48 then 'week' when 80 then 'month' when 96 then 'month' when 112 then 'year' else 'once' end end as mode from d)
    select doc_id, coalesce(nullif(lang, ''), 'Untitled note') as title, md5(html) as html_md5, ['red', 'orange', 'yellow', 'green', 'blue', 'purple', 'black', 'gray', 'white'][doc_id % 11] as color,
    case when doc_id % 3 = 0 then true end as archived, case when doc_id % 4 = 2 then nullif(source, '') end as notebook, mode,
    case when mode = 'week' then case code when 32 then '1,2,3,4,5' else dayofweek(make_timestamp(base * 1000))::varchar end when mode = 'month' then day(make_timestamp(base * 1000))::varchar end as days, null::varchar as message from m
    union all select doc_id, null, null, null, null, null, null, null, case when doc_id % 12 = 5 then 'Password is required to decrypt backup file.' else 'Decryption failed. Incorrect password or corrupted file.' end from documents where doc_id % 6 = 5"""
)
def colornote_backups(spark, sf_dir):
    """Every document as an encrypted backup with a note and a folder, imported again; some files have no password or lack their last byte."""
    i = F.col("doc_id")
    record = lambda **c: F.to_json(F.struct(*[v.alias(k) for k, v in c.items()]))
    note = record(
        title=F.col("lang"), note=F.col("text"), encrypted=F.lit(0), created_date=i + 1, modified_date=i + 2, active_state=F.lit(0), type=F.lit(0), folder_id=i % 4, color_index=i % 11,
        space=F.when(i % 3 == 0, F.lit(16)), reminder_repeat=F.element_at(F.array(*[F.lit(x) for x in (0, 16, 32, 48, 80, 96, 112, 1)]), (i % 8 + 1).cast("int")), reminder_base=F.lit(0), reminder_date=i % 5 * 86400000,
    )
    folder = record(title=F.col("source"), note=F.lit('{"folder_id":2}'), encrypted=F.lit(0), created_date=F.lit(1), modified_date=F.lit(1), active_state=F.lit(0), type=F.lit(128))
    password = F.concat(F.lit("secret "), i % 7)
    key, iv = CN.cipher(password)
    sealed = F.aes_encrypt(F.concat(F.lit("{] "), note, F.lit(" } "), folder), key, F.lit("CBC"), F.lit("PKCS"), iv)
    d = _table(spark, sf_dir, "documents").withColumns({"name": F.concat(F.lit("d"), i, F.lit(".backup")), "sealed": sealed})
    files = d.select(F.concat(F.lit("backups/"), "name").alias("path"), "name", F.lit("backup").alias("ext"), F.concat(F.lit(bytes(CN.HEADER)), F.expr("substring(sealed, 17, length(sealed) - if(doc_id % 12 = 11, 17, 16))")).alias("content"))
    passwords = d.where(i % 12 != 5).select("name", password.alias("password"))
    result = CN.colornote(files, passwords)
    own = F.regexp_extract("src_path", r"/d(-?\d+)\.", 1).cast("long").alias("doc_id")
    notes = result.notes.select(own, "title", F.md5("html").alias("html_md5"), "color", "archived", F.get(F.get("notebooks", F.lit(0)), F.lit(0)).alias("notebook"), F.coalesce("reminder.recurring_mode", "reminder.mode").alias("mode"), F.array_join("reminder.selected_days", ",").alias("days"), F.lit(None).cast("string").alias("message"))
    return notes.unionByName(result.errors.select(own, "message"), allowMissingColumns=True)


# ---- windows

_SPANS_SQL = "select doc_id, n, (doc_id * k) % 40 as s, (doc_id * k) % 40 + 5 * k as e, ['bold', 'italic', 'url'][k] as format from (select doc_id, n_chars::int as n from documents), (values (1), (2), (3)) v(k)"


@query(
    f"""with sp as ({_SPANS_SQL}), cuts as (select doc_id, s as b from sp where s <= n union select doc_id, e from sp where e <= n union select doc_id, 0 from sp union select doc_id, n from sp),
    seg as (select * from (select doc_id, b as start, lead(b) over (partition by doc_id order by b) as stop from cuts) where stop is not null)
    select seg.doc_id, seg.start::bigint as start, seg.stop::bigint as stop, coalesce(string_agg(format, ',' order by case format when 'bold' then 3 when 'italic' then 4 else 8 end), '') as formats
    from seg left join sp on sp.doc_id = seg.doc_id and sp.s <= seg.start and sp.e >= seg.stop group by all"""
)
def span_segments(spark, sf_dir):
    t = _table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("n"))
    span = lambda k, f: F.struct(((F.col("doc_id") * k) % 40).alias("start"), ((F.col("doc_id") * k) % 40 + 5 * k).alias("end"), F.lit(f).alias("format"))
    spans = t.select("doc_id", F.explode(F.array(span(1, "bold"), span(2, "italic"), span(3, "url"))).alias("s")).select("doc_id", "s.*")
    return S.segments(t, spans, "doc_id").select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("stop"), F.array_join("formats", ",").alias("formats"))


# fixed values: five spans of each text, by its length and number
_RUNS_SQL = """
with d as (select doc_id, coalesce(text, '') as text, length(coalesce(text, '')) as n from documents),
s as (select doc_id, ord, fmt, attr, (doc_id * (7919 * (ord + 1))) % (n + 1) as a, n from d, (values (0, 'headline1', null), (1, 'bold', null), (2, 'url', '/a'), (3, 'bg_color', '5'), (4, 'italic', null)) as v(ord, fmt, attr)),
sp as (select doc_id, ord, fmt, attr, a, least(n, a + n // (ord + 3) + 7 * ord) as z from s),
cut as (select distinct doc_id, b from (select doc_id, unnest([a, z]) as b from sp union all select doc_id, unnest([0, n]) from d)),
seg as (select doc_id, b as a, lead(b) over (partition by doc_id order by b) as z from cut),
tag as (select *, case fmt when 'bold' then 3 when 'italic' then 4 when 'bg_color' then 7 when 'url' then 8 end as rank,
          case fmt when 'bold' then '<strong>' when 'italic' then '<em>' when 'url' then '<a href="/a">' when 'bg_color' then '<span style="background-color: red">' end as o,
          case fmt when 'bold' then '</strong>' when 'italic' then '</em>' when 'url' then '</a>' when 'bg_color' then '</span>' end as c from sp),
cov as (select g.doc_id, g.a, g.z, coalesce(string_agg(o, '' order by rank), '') as o, coalesce(string_agg(c, '' order by rank desc), '') as c, coalesce(max(case fmt when 'headline1' then 'h1' end), 'p') as kind
        from seg g left join tag t on t.doc_id = g.doc_id and t.a <= g.a and t.z >= g.z where g.z is not null group by g.doc_id, g.a, g.z),
line as (select doc_id, a, kind, o, c, unnest(string_split(text[a + 1:z], chr(10))) as line, generate_subscripts(string_split(text[a + 1:z], chr(10)), 1) as j from cov join d using (doc_id)),
row as (select *, sum(case when j > 1 then 1 else 0 end) over (partition by doc_id order by a, j) as r from line),
new as (select *, coalesce(r <> lag(r) over w or kind <> lag(kind) over w, true)::int as new from row where line <> '' window w as (partition by doc_id order by a, j)),
run as (select *, sum(new) over (partition by doc_id order by a, j) as run from new)
select doc_id, run::int as run, min(kind) as kind, md5('<' || min(kind) || '>' || string_agg(o || line || c, '' order by a, j) || '</' || min(kind) || '>') as html_md5 from run group by doc_id, run
"""


def document_spans(docs: DataFrame) -> DataFrame:
    """Five spans of each text (doc_id, text), by its length and number."""
    n = F.char_length(F.coalesce("text", F.lit("")))
    kinds = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(f).alias("format"), F.lit(a).cast("string").alias("attribute")) for i, (f, a) in enumerate([("headline1", None), ("bold", None), ("url", "/a"), ("bg_color", "5"), ("italic", None)])])
    s = docs.select("doc_id", n.alias("n"), F.explode(kinds).alias("k")).select("doc_id", "n", "k.*")
    s = s.withColumn("start", (F.col("doc_id") * (F.col("ord") + 1) * 7919) % (F.col("n") + 1))
    return s.withColumn("end", F.least(F.col("n"), F.col("start") + F.floor(F.col("n") / (F.col("ord") + 3)) + 7 * F.col("ord")))


@query(_RUNS_SQL)
def span_runs(spark, sf_dir):
    """Whole texts with spans anywhere, as paragraphs and headlines in inline elements."""
    d = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return S.span_runs(d, document_spans(d), "doc_id", colors={"5": "red"}).select("doc_id", F.col("run").cast("int").alias("run"), "kind", F.md5("html").alias("html_md5"))


@query("select conv_id, turn, (turn % 3)::int as indent, (select max(c2.turn) from conversations c2 where c2.conv_id = c.conv_id and c2.turn < c.turn and c2.turn % 3 < c.turn % 3) as parent from conversations c")
def indent_tree(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") % 3).cast("int").alias("indent"))
    return S.indent_parents(c, "conv_id", "turn", "indent").drop("depth")


@query(
    f"""select conv_id, md5('<ul class="checklist">' || string_agg('<li class="checklist--item' || case when role = 'user' then ' checked' else '' end || '"><p>' || (select {_ENTITIES_SQL} from (select text as x)) || '</p></li>', '' order by turn) || '</ul>') as html_md5 from conversations group by conv_id"""
)
def checklist_html(spark, sf_dir):
    items = F.transform(F.sort_array(F.collect_list(F.struct("turn", F.col("text"), (F.col("role") == "user").alias("checked")))), lambda x: F.struct(x["text"].alias("text"), x["checked"].alias("checked")))
    return _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(items.alias("items")).select("conv_id", F.md5(C.checklist_html(F.col("items"))).alias("html_md5"))


@query(
    """select doc_id, case when doc_id % 3 = 0 then '<img class="attachment" data-filename="' || source || '.png" data-size="' || n_chars || '" data-hash="' || md5(text) || '" data-mime="image/png" width="' || 100 || '" height="' || cast(floor(100 * (doc_id % 50 + 1) / 40.0 + 0.5) as int) || '" alt="' || source || '.png" />'
    else '<span class="attachment" data-filename="' || source || '.pdf" data-size="' || n_chars || '" data-hash="' || md5(text) || '" data-mime="application/pdf" contenteditable="false" title="' || source || '.pdf">' || chr(10) || '      <em>&nbsp;</em>' || chr(10) || '      <span class="filename">' || source || '.pdf</span>' || chr(10) || '    </span>' end as html from documents"""
)
def attachment_html(spark, sf_dir):
    image = F.col("doc_id") % 3 == 0
    ext = F.when(image, "png").otherwise("pdf")
    width = F.when(image, F.lit(100))
    height = F.when(image, C.missing_dimension(F.lit(100), F.lit(40.0), F.col("doc_id") % 50 + 1))
    return _table(spark, sf_dir, "documents").select("doc_id", C.attachment_html(F.concat("source", F.lit("."), ext), F.col("n_chars"), F.md5("text"), C.mime_of(ext), width, height).alias("html"))


@query(
    r"""with a as (select doc_id, string_split_regex(text, '\r\n|\n')[1] as x from documents), b as (select doc_id, regexp_replace(regexp_replace(regexp_replace(x, '\s+', '-', 'g'), '[/?<>\\:*|"]', '-', 'g'), '^\.+$', '-') as x from a),
    c as (select doc_id, lower(regexp_replace(case when regexp_matches(lower(x), '^(con|prn|aux|nul|com[0-9]|lpt[0-9])(\..*)?$') then '-' else x end, '[. ]+$', '-')[1:254]) as x from b) select doc_id, x as name, case when regexp_matches(x, '^.+\.[^.]*$') then x else x || '.md' end as file from c"""
)
def filename_clean(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", C.sanitize_filename(F.get(F.split("text", "\r\n|\n"), F.lit(0))).alias("name"))
    return d.withColumn("file", C.append_extension(F.col("name"), F.lit("md")))


@query(
    """select p_partkey, array_to_string(list_filter(['color: ' || lower(p_brand), case when p_size % 2 = 0 then 'font-size: ' || p_size || 'px' end, case when p_size % 3 = 0 then 'text-align: center' end, case when p_size % 5 <> 0 then 'background-color: #000' end], lambda x: x is not null and not (x like 'color:%' and p_size % 7 = 0)), '; ') as style from part"""
)
def style_filter(spark, sf_dir):
    size = F.col("p_size")
    style = F.concat_ws(
        ";", F.concat(F.lit("COLOR:"), F.when(size % 7 == 0, " RGB(0, 0,0)").otherwise(F.lower("p_brand"))), F.lit("margin: 1px"), F.when(size % 2 == 0, F.concat(F.lit(" font-size : "), size.cast("string"), F.lit("px"))), F.when(size % 3 == 0, "text-align:center"), F.when(size % 5 != 0, "background-color:#000"), F.lit("bogus")
    )
    return _table(spark, sf_dir, "part").select("p_partkey", C.filter_style(style).alias("style"))


@query("select page_id, regexp_extract(p, '([^/]*)/*$', 1) as base, regexp_replace(p, '/[^/]*$', '') as dir, string_split(regexp_replace(p, '/[^/]*$', ''), '/')[1] || '/x/' || regexp_extract(p, '([^/]*)/*$', 1) as joined, contains(p, '/.') as hidden from (select page_id, split_part(regexp_replace(url, '^[a-z]+://', ''), '?', 1) as p from pages)")
def path_algebra(spark, sf_dir):
    p = _table(spark, sf_dir, "pages").select("page_id", F.substring_index(F.regexp_replace("url", "^[a-z]+://", ""), "?", 1).alias("p"))
    top = F.get(F.split(C.dirname(F.col("p")), "/"), F.lit(0))
    return p.select("page_id", C.basename(F.col("p")).alias("base"), C.dirname(F.col("p")).alias("dir"), C.join_path(F.concat(top, F.lit("/y/.././/x/")), C.basename(F.col("p"))).alias("joined"), C.is_hidden(F.col("p")).alias("hidden"))


@query("select event_id, epoch_ms(date_trunc('second', ts)) as millis, null::bigint as bad, event_id // 1000 as from_micros from events")
def iso_dates(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    text = F.date_format(F.col("ts").cast("timestamp"), "yyyyMMdd'T'HHmmss'Z'")
    return e.select("event_id", C.iso_basic_millis(text).alias("millis"), C.iso_basic_millis(F.substring(text, 1, 8)).alias("bad"), C.micros_to_millis(F.col("event_id")).alias("from_micros"))


@query("select doc_id, 'Tag ' || lang as tag, coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) as int), 0) as number, nullif(doc_id % 2, 0) as first_date from documents")
def tags_and_numbers(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    return d.select("doc_id", C.clean_tag(F.concat(F.lit(" #Tag "), "lang", F.lit(" "))).alias("tag"), C.int_attribute(F.concat(F.lit(" "), F.regexp_extract("source", "([0-9]+)$", 1), F.lit("px"))).alias("number"), C.first_true(F.col("doc_id") % 2, F.lit(0)).alias("first_date"))


@query("select doc_id, md5(array_to_string(list_transform(list_filter(string_split_regex(text, '\\n[ \\t]*\\n+'), lambda b: trim(b, ' ' || chr(9) || chr(10)) <> ''), lambda x: '<p>' || replace(trim(x, chr(10)), chr(10), ' ') || '</p>'), '')) as html_md5 from (select doc_id, regexp_replace(text, '[^\\pL\\n .]', '', 'g') as text from documents)")
def markdown_paragraphs(spark, sf_dir):
    """Plain letters as Markdown: blocks to paragraphs, soft breaks to spaces (MD1)."""
    d = _table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"[^\p{L}\n .]", "").alias("text"))
    return d.select("doc_id", F.md5(M.paragraphs(F.col("text"))).alias("html_md5"))


FLAGSHIP = html_notes
