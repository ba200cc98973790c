"""Markup rewriting by a table of rules: rows that say which elements become what, joined to the elements of the pages.

A rule (RULE) chooses elements by tag, by a word of their class, or by both; of several that fit an element the one with the
smallest number counts. What it does:

    remove   the element goes
    rename   its open token becomes `opening` and its close token `closing`, what is inside stays and is looked at too
             (both '' unwrap it); {rest} in opening stands for its attributes without the class
    replace  the element becomes `opening`, its parts, `closing`; what is inside is not looked at

A part is text before a value and the value itself: of the element (no tag and no class) or of its first descendant that
fits, in page order, its markup (`inner`), its text (`text`) or an attribute (`attr`, not empty). Where a value is missing,
the element goes, unless the part is `optional`.

Elements come from matched tokens and stay spread out; the rules are sent to all tasks. Of rules that replace or remove, an element inside another such element is left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from notelake.operators import tokens as T
from notelake.scratch import staged

PART = "before string, tag string, class string, mode string, attr string, optional boolean"
RULE = f"rule int, tag string, class string, op string, opening string, closing string, parts array<struct<{PART.replace(' string', ':string').replace(' boolean', ':boolean')}>>"
_PIECE = "array<struct<lit:string,a:int,b:int,plain:boolean>>"


def part(before: str = "", tag: str | None = None, class_: str | None = None, mode: str = "inner", attr: str | None = None, optional: bool = False) -> tuple:
    return before, tag, class_, mode, attr, optional


def rule_table(spark: SparkSession, rules: list[tuple]) -> DataFrame:
    """rules: (tag, class, op, opening, parts, closing), numbered in their order."""
    return spark.createDataFrame([(i, tag, class_, op, opening, closing, parts) for i, (tag, class_, op, opening, parts, closing) in enumerate(rules)], RULE)


def attributes(token: Column) -> Column:
    """array<struct<k, v>> of an open token's attributes, names in lower case."""
    found = F.regexp_extract_all(token, F.lit(r"""(?s)\s[^\s=>"'/]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"']+)"""), F.lit(0))
    value = lambda x: F.regexp_replace(F.regexp_replace(x, r"(?s)^[^=]*=\s*", ""), r"""(?s)^(["'])(.*)\1$""", "$2")
    return F.transform(found, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, "=", 1))).alias("k"), value(x).alias("v")))


def _selectors(tag: Column, class_: Column) -> Column:
    return F.concat(F.coalesce(tag, F.lit("")), F.lit("."), F.coalesce(class_, F.lit("")))


def _element_selectors(tag: Column, words: Column) -> Column:
    """All selectors that an element fits."""
    of_class = F.flatten(F.transform(words, lambda w: F.array(F.concat(F.lit("."), w), F.concat(tag, F.lit("."), w))))
    return F.concat(F.array(F.concat(tag, F.lit("."))), of_class)


def page_elements(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, pos, last, tag, attrs, selectors): the elements of each page; last is null where one isn't closed."""
    rows = T.tag_rows(pages, key, html)
    attrs = F.when(F.col("kind").isin("open", "void"), attributes(F.col("tok")))
    x = T.matched(rows.select(key, "pos", "kind", "tag", attrs.alias("attrs")), key).where(F.col("kind").isin("open", "void"))
    named = F.array_join(F.transform(F.filter("attrs", lambda a: a["k"].isin("class", "classname")), lambda a: a["v"]), " ")
    words = F.array_distinct(F.filter(F.split(F.coalesce(named, F.lit("")), r"\s+"), lambda w: w != ""))
    last = F.when(F.col("kind") == "void", F.col("pos")).otherwise(F.col("last"))
    return x.select(key, "pos", last.alias("last"), "tag", "attrs", _element_selectors(F.col("tag"), words).alias("selectors"))


def apply_rules(pages: DataFrame, key: str, rules: DataFrame, html: str = "html", given: DataFrame | None = None) -> DataFrame:
    """(key, html): the pages with the rules applied; given: places (key, pos, last, new) of the caller's own, which go first."""
    e = staged(page_elements(pages, key, html), "elements")
    selected = rules.withColumn("__s", _selectors(F.col("tag"), F.col("class"))).select("__s", F.struct("rule", "op", "opening", "closing", "parts").alias("r"))
    # the rules go to all tasks: left to the planner, it takes the elements for the small side by the size of their files, which are many times smaller than their rows
    hits = e.select(key, "pos", "last", "attrs", F.explode("selectors").alias("__s")).join(F.broadcast(selected), "__s")
    hits = hits.groupBy(key, "pos", "last", "attrs").agg(F.min_by("r", "r.rule").alias("r")).select(key, "pos", "last", "attrs", "r.*")
    lit = lambda c: F.array(F.struct(c.alias("lit"), F.lit(None).cast("int").alias("a"), F.lit(None).cast("int").alias("b"), F.lit(False).alias("plain")))
    rest = F.array_join(F.transform(F.filter("attrs", lambda a: a["k"] != "class"), lambda a: F.concat(F.lit(" "), a["k"], F.lit('="'), a["v"], F.lit('"'))), "")
    renamed = hits.where("op = 'rename'").withColumn("opening", F.replace("opening", F.lit("{rest}"), rest))
    edits = [
        renamed.select(key, "pos", F.col("pos").alias("last"), lit(F.col("opening")).alias("new")),
        renamed.where(F.col("last") > F.col("pos")).select(key, F.col("last").alias("pos"), "last", lit(F.col("closing")).alias("new")),
    ]
    blocks = hits.where("op <> 'rename'").select(key, "pos", F.coalesce("last", "pos").alias("last"), "attrs", "op", "opening", "closing", "parts", F.lit(None).cast("string").alias("text"))
    if given is not None:
        none = {c: F.lit(None).cast(blocks.schema[c].dataType) for c in ("attrs", "opening", "closing", "parts")}
        own = given.select(key, "pos", "last", F.col("new").alias("text")).withColumns({**none, "op": F.lit("given")})
        blocks = blocks.join(own.select(key, "pos"), [key, "pos"], "left_anti").unionByName(own)
    blocks = T.outermost(blocks, key)

    # the first descendant of each block that fits a part: an element belongs to the last block that begins before it
    wanted = blocks.select(key, F.col("pos").alias("block"), "last", "attrs", F.posexplode("parts").alias("i", "p")).select(key, "block", "last", "attrs", "i", "p.*")
    own_value = wanted.where(F.col("tag").isNull() & F.col("class").isNull()).select(key, "block", "i", F.col("block").alias("pos"), F.col("last").alias("to"), "attrs", "mode", "attr")
    inner = wanted.where(F.col("tag").isNotNull() | F.col("class").isNotNull()).withColumn("__s", _selectors(F.col("tag"), F.col("class")))
    starts = blocks.select(key, F.col("pos").alias("block"), F.col("last").alias("block_last"))
    marked = e.select(key, "pos", F.col("last").alias("to"), "attrs", "selectors").unionByName(starts.select(key, F.col("block").alias("pos"), "block_last"), allowMissingColumns=True)
    so_far = W.partitionBy(key).orderBy("pos", F.col("block_last").isNull()).rowsBetween(W.unboundedPreceding, W.currentRow)
    held = marked.withColumns({"block": F.last(F.when(F.col("block_last").isNotNull(), F.col("pos")), True).over(so_far), "until": F.last("block_last", True).over(so_far)})
    held = held.where(F.col("selectors").isNotNull() & (F.col("pos") > F.col("block")) & (F.col("pos") <= F.col("until"))).select(key, "block", "pos", "to", F.col("attrs").alias("own"), F.explode("selectors").alias("__s"))
    first = held.join(inner.select(key, "block", "i", "mode", "attr", "__s"), [key, "block", "__s"]).groupBy(key, "block", "i", "mode", "attr").agg(F.min(F.struct("pos", "to")).alias("at"), F.min_by("own", "pos").alias("attrs"))
    values = first.select(key, "block", "i", "at.pos", "at.to", "attrs", "mode", "attr").unionByName(own_value)
    of_attr = F.get(F.filter("attrs", lambda a: a["k"] == F.col("attr")), F.lit(0))["v"]
    inside = F.struct(F.lit("").alias("lit"), (F.col("pos") + 1).alias("a"), F.greatest(F.coalesce("to", "pos"), F.col("pos") + 1).alias("b"), (F.col("mode") == "text").alias("plain"))
    of_value = F.when(F.col("mode") == "attr", F.when(of_attr != "", F.struct(of_attr.alias("lit"), F.lit(None).cast("int").alias("a"), F.lit(None).cast("int").alias("b"), F.lit(False).alias("plain")))).otherwise(inside)
    values = values.withColumn("value", of_value).where(F.col("value").isNotNull()).groupBy(key, "block").agg(F.collect_list(F.struct("i", "value")).alias("values"))
    x = blocks.join(values.withColumnRenamed("block", "pos"), [key, "pos"], "left")
    of_part = lambda i: F.get(F.filter("values", lambda v: v["i"] == i), F.lit(0))["value"]
    pieces = F.flatten(F.transform("parts", lambda p, i: F.concat(lit(p["before"]), F.when(of_part(i).isNotNull(), F.array(of_part(i))).otherwise(F.array().cast(_PIECE)))))
    lacks = F.exists(F.transform("parts", lambda p, i: ~p["optional"] & of_part(i).isNull()), lambda m: m)
    new = F.when(F.col("op") == "given", lit(F.col("text"))).when((F.col("op") == "remove") | lacks, lit(F.lit(""))).otherwise(F.concat(lit(F.col("opening")), F.coalesce(pieces, F.array().cast(_PIECE)), lit(F.col("closing"))))
    edits.append(x.select(key, "pos", "last", new.cast(_PIECE).alias("new")))
    every = edits[0].unionByName(edits[1]).unionByName(edits[2])
    slice_ = lambda t, p: F.slice(t, (p["a"] + 1).cast("int"), F.greatest(p["b"] - p["a"], F.lit(0)))
    shown = lambda t, p: F.when(p["a"].isNull(), p["lit"]).when(p["plain"], F.array_join(F.filter(slice_(t, p), lambda k: T.kind_of(k) == "text"), "")).otherwise(F.array_join(slice_(t, p), ""))
    return T.edited(pages, key, every, html, lambda parts: F.array_join(parts, ""), lambda tokens, new: F.array_join(F.transform(new, lambda p: shown(tokens, p)), ""))
