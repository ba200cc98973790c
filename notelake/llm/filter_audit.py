"""Operator 11, filter interaction audit: failing-id relations.

1. Facts: one pass over the texts decides the filters that look at one text, and hashes the text for the one that looks at
   all of them (E: the same text under a smaller doc_id).
2. Failing ids: one table per filter in the shared folder, with the rows that fail it. `survivors` runs any order of
   filters over them with left-anti joins.
3. Audit: rows with equal part, labels and failing filters fare alike in every order, so the id tables are folded into
   classes with a count: some dozens per part, whatever the corpus. For the 32 sets that the prefixes of all orders have,
   left-anti joins of classes with the failing relations give the survivors; of these, a left-semi join with a filter's
   relation gives what it removes next, and its relation left-anti the survivors what it would have removed; labels are
   summed along. The 120 orders then only look up their prefixes' sets.

A row is known by a number of its own, so repeated or null doc_ids are rows like others. Defined cases: null text is empty,
null source the part ''; a row with a null doc_id fails E where any other doc_id has its text, and is never a smaller
doc_id itself; rows with equal doc_id and text don't fail E by each other; a doc_id with several labels counts as labelled 1
if any is; an empty table gives no parts; other columns are ignored.
"""

from __future__ import annotations

import itertools
import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm.common import WORD_GAP, documents, scratch_path, stage, text_or_empty

FILTERS = "ABCDE"


GAP_CHARACTERS = " \t\n\x0b\x0c\r"


def text_filters(texts: DataFrame) -> DataFrame:
    """texts (text, ...) with fails: the filters that the text alone fails. Each step is a projection, so words are split once."""
    parts = F.split(F.btrim("text", F.lit(GAP_CHARACTERS)), WORD_GAP)
    x = texts.withColumn("__words", F.when(F.btrim("text", F.lit(GAP_CHARACTERS)) != "", parts).otherwise(F.array().cast("array<string>")))
    x = x.withColumns({"__n": F.size("__words"), "__distinct": F.size(F.array_distinct("__words"))})
    failed = {
        "A": F.col("__n") < 200, "B": 100 * F.col("__distinct") < 50 * F.col("__n"),
        "C": 100 * F.regexp_count("text", F.lit("[A-Z]")) > 2 * F.char_length("text"), "D": F.col("text").rlike("[#$%&*|]"),
    }
    return x.withColumn("fails", F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in failed.items()]))).drop("__words", "__n", "__distinct")


def facts(docs: DataFrame) -> DataFrame:
    """(row, doc_id, part, same, fails) for each row of docs, staged: row is its number, same the hash of its text."""
    x = text_filters(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("source", F.lit("")).alias("part"), text_or_empty().alias("text")))
    return stage(x.select("row", "doc_id", "part", F.unhex(F.sha2("text", 256)).alias("same"), "fails"), "facts")


def failing_ids(found: DataFrame) -> dict[str, DataFrame]:
    """filter to the table of the rows that fail it."""
    spark = found.sparkSession
    least = found.where(F.col("doc_id").isNotNull()).groupBy("same").agg(F.min("doc_id").alias("least"))
    again = found.join(least, "same").where(F.col("doc_id").isNull() | (F.col("doc_id") > F.col("least"))).select("row", F.lit("E").alias("filter"))
    path = scratch_path(spark, "failing")
    found.select("row", F.explode("fails").alias("filter")).unionByName(again).write.partitionBy("filter").parquet(path)
    every = spark.read.schema("row long, filter string").parquet(path)
    return {f: every.where(F.col("filter") == f).select("row") for f in FILTERS}


def survivors(rows: DataFrame, failing: dict[str, DataFrame], order: str) -> DataFrame:
    """The rows that pass the filters of the order, one after the other."""
    return reduce(lambda left, f: left.join(failing[f], "row", "left_anti"), order, rows)


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def classes(found: DataFrame, failing: dict[str, DataFrame], labels: DataFrame) -> DataFrame:
    """(class, part, fails, n, good, toxic): rows that fare alike, and how many of them are good and toxic."""
    one = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("long"), F.lit(0)))
    marks = labels.groupBy("doc_id").agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    tables = [t.withColumn("filter", F.lit(f)) for f, t in failing.items()]
    own = reduce(DataFrame.unionByName, tables).groupBy("row").agg(F.array_sort(F.collect_set("filter")).alias("fails"))
    x = found.select("row", "doc_id", "part").join(own, "row", "left").join(marks, "doc_id", "left")
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    x = x.groupBy("part", F.coalesce("fails", F.array().cast("array<string>")).alias("fails")).agg(F.count("*").alias("n"), count("good"), count("toxic"))
    return stage(x.select(F.monotonically_increasing_id().alias("class"), "*"), "classes")


def set_cells(spark: SparkSession, kinds: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sums by part: (part, set, kept) after the filters of a set; (part, set, filter, removed, redundant, good_lost,
    toxic_lost) of a filter after those of the set; (part, filter, unique_fails)."""
    sets = ["".join(s) for k in range(len(FILTERS) + 1) for s in itertools.combinations(FILTERS, k)]
    members = _table(spark, [(s, f) for s in sets for f in s], "set string, filter string")
    steps = _table(spark, [(s, f) for s in sets for f in FILTERS if f not in s], "set string, filter string")
    fails = kinds.select("class", "part", "n", "good", "toxic", F.explode("fails").alias("filter"))
    each = kinds.select("class", "part", "n", "good", "toxic", F.explode(F.array(*[F.lit(s) for s in sets])).alias("set"))
    gone = fails.select("class", "filter").join(F.broadcast(members), "filter").select("class", "set").distinct()
    left = stage(each.join(gone, ["class", "set"], "left_anti"), "survivors")
    kept = left.groupBy("part", "set").agg(F.sum("n").alias("kept"))
    removed = left.join(F.broadcast(steps), "set").join(fails.select("class", "filter"), ["class", "filter"], "left_semi")
    removed = removed.groupBy("part", "set", "filter").agg(F.sum("n").alias("removed"), F.sum("good").alias("good_lost"), F.sum("toxic").alias("toxic_lost"))
    redundant = fails.join(F.broadcast(steps), "filter").join(left.select("class", "set"), ["class", "set"], "left_anti").groupBy("part", "set", "filter").agg(F.sum("n").alias("redundant"))
    other = fails.select("class", F.col("filter").alias("__other"))
    only = fails.join(other, (fails["class"] == other["class"]) & (fails["filter"] != other["__other"]), "left_anti").groupBy("part", "filter").agg(F.sum("n").alias("unique_fails"))
    return kept, removed.join(redundant, ["part", "set", "filter"], "full"), only


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, with what the step keeps, removes and loses."""
    spark = docs.sparkSession
    found = facts(docs)
    kinds = classes(found, failing_ids(found), labels)
    kept, cells, only = set_cells(spark, kinds)
    orders = ["".join(o) for o in itertools.permutations(FILTERS)]
    key = lambda s: "".join(sorted(s))
    plan = json.dumps([{"filter_order": o, "step": i + 1, "filter": o[i], "set": key(o[:i]), "after": key(o[: i + 1])} for o in orders for i in range(len(o))])
    steps = F.explode(F.from_json(F.lit(plan), "array<struct<filter_order:string,step:int,filter:string,set:string,after:string>>"))
    rows = kinds.select("part").distinct().select("part", steps.alias("s")).select("part", "s.*")
    x = rows.join(cells, ["part", "set", "filter"], "left").join(kept.withColumnRenamed("set", "after"), ["part", "after"], "left").join(only, ["part", "filter"], "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    x = x.select("part", "filter_order", "step", "filter", *[count(c) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")])
    # a set of k filters before a filter is a prefix of k! (4 - k)! orders; summed over the orders' own rows
    share = x.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return x.join(share, ["part", "filter"]).drop("filter")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP11_SQL = """
with w as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws from documents),
f as (select doc_id, part,
        case when len(ws) < 200 then 'A' else '' end || case when 100 * len(list_distinct(ws)) < 50 * len(ws) then 'B' else '' end
        || case when 100 * (strlen(text) - strlen(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) then 'C' else '' end || case when regexp_matches(text, '[#$%&*|]') then 'D' else '' end
        || case when coalesce(doc_id > min(doc_id) over (partition by text), doc_id is null and min(doc_id) over (partition by text) is not null) then 'E' else '' end as fails from w),
l as (select doc_id, max(quality = 1) as good, max(toxic = 1) as toxic from labels group by doc_id),
c as (select part, fails, count(*) as n, count(*) filter (where good) as good, count(*) filter (where toxic) as toxic from f left join l using (doc_id) group by part, fails),
x as (select * from (values ('A'), ('B'), ('C'), ('D'), ('E')) as v(x)),
o as (select a.x || b.x || c.x || d.x || e.x as filter_order from x a, x b, x c, x d, x e where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s as (select filter_order, step::int as step, filter_order[step] as letter, filter_order[:step - 1] as before from o, unnest(range(1, 6)) as u(step)),
r as (select part, filter_order, step, letter, contains(fails, letter) as hit, before <> '' and list_has_any(string_split(before, ''), string_split(fails, '')) and fails <> '' as earlier, fails = letter as alone, n, good, toxic from c, s),
q as (select part, filter_order, step, letter, coalesce(sum(n) filter (where not hit and not earlier), 0)::bigint as kept, coalesce(sum(n) filter (where hit and not earlier), 0)::bigint as removed,
        coalesce(sum(n) filter (where hit and earlier), 0)::bigint as redundant, coalesce(sum(n) filter (where alone), 0)::bigint as unique_fails,
        coalesce(sum(good) filter (where hit and not earlier), 0)::bigint as good_lost, coalesce(sum(toxic) filter (where hit and not earlier), 0)::bigint as toxic_lost from r group by all)
select * exclude (letter), (sum(removed) over (partition by part, letter))::bigint as shapley from q
"""
