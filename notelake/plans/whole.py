"""Whole jobs beside the queries of registry.py whose SQL states a part of them; those without SQL are held against brute force by tests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.functions import markdown as M
from notelake.operators import rewrites as W
from notelake.operators import spans as S
from notelake.plans import registry as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {
    "package_paths_all": """
with n as (select doc_id, '{"title":"' || lang || '","source":"' || source || '"}' as json, md5(text) as hash, text from documents)
select md5(json) || '/note.json' as path, octet_length(encode(json))::int as size from n union select md5(json) || '/attachments/' || hash, octet_length(encode(text))::int from n
""",
    "span_segments_all": """
with sp as (select doc_id, n, f, (doc_id * 7919 * k) % (n + 1) as s, (doc_id * 7919 * k) % (n + 1) + n // (k + 1) + 5 * k as e from (select doc_id, n_chars as n from documents), (values (1, 'bold'), (2, 'italic'), (3, 'url')) as v(k, f)),
cuts as (select distinct doc_id, b from (select doc_id, unnest([s, e, 0, n]) as b, n from sp) where b <= n),
seg as (select doc_id, b as start, lead(b) over (partition by doc_id order by b) as stop from cuts)
select seg.doc_id, start::bigint as start, stop::bigint as stop, coalesce(string_agg(f, ',' order by case f when 'bold' then 3 when 'italic' then 4 else 8 end), '') as formats
from seg left join sp on sp.doc_id = seg.doc_id and sp.s <= start and sp.e >= stop where stop is not null group by seg.doc_id, start, stop
""",
}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def package_paths_all(spark, sf_dir):
    """package_paths over all documents, labelled or not (K3, K4)."""
    return R.packed(R._table(spark, sf_dir, "documents"))


@query
def span_segments_all(spark, sf_dir):
    """span_segments over whole texts: three spans that begin anywhere in a text and may end past it."""
    t = R._table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("n"))
    start = lambda k: (F.col("doc_id") * (7919 * k)) % (F.col("n") + 1)
    span = lambda k, f: F.struct(start(k).alias("start"), (start(k) + F.floor(F.col("n") / (k + 1)) + 5 * k).alias("end"), F.lit(f).alias("format"))
    spans = t.select("doc_id", F.explode(F.array(span(1, "bold"), span(2, "italic"), span(3, "url"))).alias("s")).select("doc_id", "s.*")
    return S.segments(t, spans, "doc_id").select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("stop"), F.array_join("formats", ",").alias("formats"))


@query
def markdown_html(spark, sf_dir):
    """markdown_paragraphs with all of Markdown and unaltered texts (MD1-MD9)."""
    return R._table(spark, sf_dir, "documents").select("doc_id", F.md5(M.to_html(F.col("text"))).alias("html_md5"))


@query
def markup_rewrites(spark, sf_dir):
    """Whole pages through the rewrites that move elements: divs and breaks to paragraphs, lists, sections, code, alignment."""
    names = ["div-to-p", "br-to-p", "checked-lists", "colors", "collapsibles", "code-languages", "aligned-blocks", "en-todo", "en-codeblock"]
    return W.rewrite(R._table(spark, sf_dir, "pages").select("page_id", "html"), "page_id", *names).select("page_id", F.md5("html").alias("html_md5"))
