"""Formatting spans over a text to segments, and indented items to a tree."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Formats from the outside in.
PRECEDENCE = ["headline1", "headline2", "bold", "italic", "underline", "strike", "bg_color", "url"]


#: The element of an inline format; url and bg_color only count with an attribute.
INLINE = {"bold": "strong", "italic": "em", "underline": "u", "strike": "s"}
#: The element of a headline format.
HEADLINES = {"headline1": "h1", "headline2": "h2"}


def _rank(format_: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in PRECEDENCE]), format_)


def _covered(texts: DataFrame, spans: DataFrame, key: str, length: str) -> DataFrame:
    """(key, start, end, spans): the text between neighbouring span ends, with the spans (rank, ord, format, attribute) over it.

    A span's ends are looked up among the cuts of its text, which numbers the segments it covers: the rows between are
    those of the result, a span that covers nothing makes none.
    """
    extra = {c: F.lit(None).cast(t) for c, t in (("ord", "int"), ("attribute", "string")) if c not in spans.columns}
    s = spans.withColumns(extra).select(key, "start", "end", "format", "ord", "attribute").join(texts.select(key, F.col(length).alias("__n")), key)
    ends = s.select(key, F.explode(F.array("start", "end")).alias("b"), "__n").where((F.col("b") >= 0) & (F.col("b") <= F.col("__n"))).select(key, "b")
    whole = texts.select(key, F.explode(F.array(F.lit(0), F.col(length))).alias("b"))
    in_text = W.partitionBy(key).orderBy("b")
    cuts = ends.unionByName(whole).distinct().withColumns({"__i": F.row_number().over(in_text), "end": F.lead("b").over(in_text)})
    at = cuts.select(F.col(key), F.col("b"), F.col("__i"))
    inside = s.withColumns({"__from": F.greatest("start", F.lit(0)), "__to": F.least("end", "__n")}).where(F.col("start").isNotNull() & F.col("end").isNotNull() & (F.col("__from") < F.col("__to")))
    x = inside.join(at.select(key, F.col("b").alias("__from"), F.col("__i").alias("__a")), [key, "__from"]).join(at.select(key, F.col("b").alias("__to"), F.col("__i").alias("__z")), [key, "__to"])
    x = x.select(key, F.explode(F.sequence("__a", F.col("__z") - 1)).alias("__i"), F.struct(_rank(F.col("format")).alias("rank"), "ord", "format", "attribute").alias("span"))
    over = x.groupBy(key, "__i").agg(F.sort_array(F.collect_list("span")).alias("spans"))
    seg = cuts.where(F.col("end").isNotNull()).select(key, "__i", F.col("b").alias("start"), "end").join(over, [key, "__i"], "left")
    return seg.select(key, "start", "end", F.coalesce("spans", F.array().cast(over.schema["spans"].dataType)).alias("spans"))


def segments(texts: DataFrame, spans: DataFrame, key: str, length: str = "n") -> DataFrame:
    """(key, start, end, formats): the text between neighbouring span ends, with the formats that cover it.

    texts (key, length), spans (key, start, end, format). Ends outside the text are no ends; a text without spans is one
    segment, an empty one has none; a span with a null end covers nothing.
    """
    x = _covered(texts, spans, key, length)
    return x.select(key, "start", "end", F.array_distinct(F.transform("spans", lambda s: s["format"])).alias("formats"))


def _tags(span: Column, colors: dict[str, str]) -> Column:
    """struct<open, close> of an inline span; empty where it has no element."""
    given = F.nullif(span["attribute"], F.lit(""))
    opening, closing = F.lit(""), F.lit("")
    for name, tag in INLINE.items():
        opening, closing = F.when(span["format"] == name, f"<{tag}>").otherwise(opening), F.when(span["format"] == name, f"</{tag}>").otherwise(closing)
    color = given
    for k, v in colors.items():
        color = F.when(given == k, v).otherwise(color)
    for name, start, tag in (("url", F.concat(F.lit('<a href="'), given, F.lit('">')), "a"), ("bg_color", F.concat(F.lit('<span style="background-color: '), color, F.lit('">')), "span")):
        on = (span["format"] == name) & given.isNotNull()
        opening, closing = F.when(on, start).otherwise(opening), F.when(on, f"</{tag}>").otherwise(closing)
    return F.named_struct(F.lit("open"), opening, F.lit("close"), closing)


def span_runs(texts: DataFrame, spans: DataFrame, key: str, text: str = "text", colors: dict[str, str] | None = None) -> DataFrame:
    """(key, run, kind, html): formatted text as runs, each a paragraph (p) or a headline (h1, h2), in order from 1.

    A run goes on over segments until a line ends or its kind changes: a session whose number is the running sum of such
    changes over the pieces of lines between span ends. A piece is in the elements of its spans, from the outside in by
    PRECEDENCE and then by `ord`; of two headlines over a piece the one first by ord counts; formats without an element
    change nothing. Lines without characters make no run; a text without any has no row. Positions count characters; the
    text is taken over as it is. spans: (key, start, end, format, ord, attribute).
    """
    t = texts.select(key, F.coalesce(F.col(text), F.lit("")).alias("__text")).withColumn("__n", F.char_length("__text"))
    cut = _covered(t, spans, key, "__n").groupBy(key).agg(F.collect_list(F.struct("start", "end", "spans")).alias("__segments"))
    part = lambda s: F.struct(s["start"].alias("start"), s["spans"].alias("spans"), F.substr(F.col("__text"), s["start"] + 1, s["end"] - s["start"]).alias("__part"))
    seg = t.select(key, "__text").join(cut, key).select(key, F.explode(F.transform("__segments", part)).alias("s")).select(key, "s.*")
    heads = F.array_sort(F.transform(F.filter("spans", lambda s: s["format"].isin(*HEADLINES)), lambda s: F.struct(s["ord"], s["format"])))
    kind = F.when(F.size(heads) == 0, "p")
    for name, tag in HEADLINES.items():
        kind = kind.when(F.get(heads, F.lit(0))["format"] == name, tag)
    tags = F.transform("spans", lambda s: _tags(s, colors or {}))
    lines = seg.select(key, "start", kind.alias("kind"), F.array_join(F.transform(tags, lambda x: x["open"]), "").alias("__open"), F.array_join(F.reverse(F.transform(tags, lambda x: x["close"])), "").alias("__close"), F.posexplode(F.split("__part", "\n")).alias("__j", "__line"))
    order = W.partitionBy(key).orderBy("start", "__j")
    so_far = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    lines = lines.withColumn("__row", F.sum((F.col("__j") > 0).cast("int")).over(so_far)).where(F.col("__line") != "")
    new = F.coalesce((F.col("__row") != F.lag("__row").over(order)) | (F.col("kind") != F.lag("kind").over(order)), F.lit(True))
    runs = lines.withColumn("__new", new).withColumn("run", F.sum(F.col("__new").cast("int")).over(so_far))
    runs = runs.groupBy(key, "run").agg(F.first("kind").alias("kind"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "__j", F.concat("__open", "__line", "__close").alias("h")))), lambda x: x["h"]), "").alias("__h"))
    return runs.select(key, "run", "kind", F.concat(F.lit("<"), "kind", F.lit(">"), "__h", F.lit("</"), "kind", F.lit(">")).alias("html"))


def formatted(texts: DataFrame, spans: DataFrame, key: str, text: str = "text", colors: dict[str, str] | None = None) -> DataFrame:
    """(key, html): the runs of a text one after the other; an empty paragraph where there are none."""
    runs = span_runs(texts, spans, key, text, colors).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "html"))), lambda x: x["html"]), "").alias("html"))
    return texts.select(key).join(runs, key, "left").select(key, F.coalesce("html", F.lit("<p></p>")).alias("html"))


def indent_parents(items: DataFrame, key: str, pos: str, indent: str) -> DataFrame:
    """items with `parent`: the position of the nearest earlier item of a smaller indent, null at the top; and `depth` from 0.

    Lists are streamed in order with the open items as a stack: time is linear in the items, memory is one stack. A null
    indent is 0.
    """
    spark = items.sparkSession
    shape = T.StructType([*items.schema.fields, T.StructField("parent", items.schema[pos].dataType), T.StructField("depth", T.IntegerType())])
    kind = spark.createDataFrame([], shape).toArrow().schema.field("parent").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, stack = None, []
        for batch in batches:
            parents, depths = [], []
            for k, p, i in zip(*(batch.column(c).to_pylist() for c in (key, pos, indent))):
                if k != last:
                    last, stack = k, []
                while stack and stack[-1][0] >= (i or 0):
                    stack.pop()
                parents.append(stack[-1][1] if stack else None)
                depths.append(len(stack))
                stack.append((i or 0, p))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parents, kind), pa.array(depths, pa.int32())], [*batch.schema.names, "parent", "depth"])

    return items.repartition(key).sortWithinPartitions(key, pos).mapInArrow(run, shape)


def nested_list(items: DataFrame, key: str, pos: str, indent: str, opening: str, closing: str) -> DataFrame:
    """(key, html): the nested list of each key. items: (key, pos, indent, item: the open token of the item, body: its content).

    Where an item is deeper than the one before a list opens inside that; where it is not, the items and lists between them
    close.
    """
    x = indent_parents(items, key, pos, indent)
    order = W.partitionBy(key).orderBy(pos)
    before, after = F.coalesce(F.lag("depth").over(order), F.lit(-1)), F.coalesce(F.lead("depth").over(order), F.lit(-1))
    # a step down opens one list; a step up closes the item and, for each level, a list and the item around it
    start = F.when(F.col("depth") > before, F.lit(opening)).otherwise(F.lit(""))
    end = F.when(after > F.col("depth"), F.lit("")).otherwise(F.concat(F.lit("</li>"), F.repeat(F.lit(closing + "</li>"), (F.col("depth") - F.greatest(after, F.lit(0))).cast("int")), F.when(after < 0, F.lit(closing)).otherwise(F.lit(""))))
    x = x.withColumn("__h", F.concat(start, F.col("item"), F.col("body"), end))
    return x.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, "__h"))), lambda y: y["__h"]), "").alias("html"))
