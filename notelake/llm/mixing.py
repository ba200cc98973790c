"""Operator 1, mixing sources to target weights: hierarchical token budgets and seeded epochs.

The tree is domain, language, source. A node can take what its leaves hold, `epochs` times over. From the root down, a
node's tokens are shared out by weight; children that cannot take their share are filled, and what they leave goes to
their siblings by weight. As a node never gets more than its subtree can take, a shortage leaves a family only when all
siblings are full. Shares are whole tokens that add up to the parent's.

A leaf with T tokens to give reads its documents over and over, in an order seeded by epoch, and takes those that begin
within the first T tokens: whole epochs, then a prefix of one more. The prefix is found without sorting a source: order
keys fall into 16^`digits` ranges, sums over ranges are chained, and only the range in which the budget ends is sorted.

Defined cases: a token is a word; null text has none and its document is taken in whole epochs only; null lang and
source are names of their own, '' ; rows with a null doc_id are ordered together, those with the same id by their
tokens; a node without a weight has weight 1, and one of weight 0 gets nothing while the others can take it; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from notelake.llm.common import WORD_GAP, documents, stage

LEVELS = ["domain", "lang", "source"]
DOMAINS = ["web", "books", "code"]
#: Target weights; the rest have 1.
WEIGHTS = {"domain": {"web": 5, "books": 3, "code": 2}, "lang": {"en": 6, "de": 2}}
SEED, EPOCHS = 17, 3
#: The row key: ids may be null or repeated.
ROW = "__row"
#: Leaves up to which their budgets are broadcast; more are joined by shuffle.
BROADCAST_LEAVES = 100_000


def domain_of(source: Column) -> Column:
    """The domain of a source, by the number in its name."""
    return F.element_at(F.array(*[F.lit(d) for d in DOMAINS]), (F.coalesce(F.try_to_number(F.regexp_extract(source, "([0-9]{1,9})$", 1), F.lit("999999999")).cast("int"), F.lit(0)) % len(DOMAINS) + 1))


def with_row_key(docs: DataFrame) -> DataFrame:
    """docs with a number of each row, staged, as a number is only good as long as nobody counts again."""
    return stage(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def token_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, domain, lang, source, tokens) and the row key where docs have one, staged: all later steps read this and no text."""
    source, lang = (F.coalesce(F.col(c), F.lit("")) for c in ("source", "lang"))
    tokens = F.size(F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), WORD_GAP), lambda w: w != "")).cast("long")
    return stage(docs.select("doc_id", *[c for c in docs.columns if c == ROW], domain_of(source).alias("domain"), lang.alias("lang"), source.alias("source"), tokens.alias("tokens")), "tokens")


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    out = F.lit(1)
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, F.lit(w)).otherwise(out)
    return out.cast("long")


def share_out(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """nodes (parent..., name, cap, weight, amount of the parent) with a column `share`."""
    family = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
    by_need = family.orderBy(F.col("cap") / F.greatest("weight", F.lit(1)), (F.col("weight") == 0).cast("int"), name)
    before = F.coalesce(F.sum("cap").over(by_need.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(by_need.rowsBetween(0, W.unboundedFollowing))
    x = nodes.withColumns({"before": before, "left": left})
    x = x.withColumn("full", F.col("cap") * F.col("left") <= F.col("weight") * (F.col("amount") - F.col("before")))
    rest = F.col("amount") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(family), F.lit(0))
    x = x.withColumns({"rest": rest, "open": F.sum(F.when(~F.col("full"), F.col("weight"))).over(family)})
    x = x.withColumn("share", F.when(F.col("full"), F.col("cap")).otherwise(F.floor(F.expr("(weight * rest) div greatest(open, 1)"))))
    spare = F.col("rest") - F.sum(F.when(~F.col("full"), F.col("share")).otherwise(0)).over(family)
    place = F.row_number().over(family.orderBy("full", name))
    x = x.withColumns({"spare": spare, "place": place})
    share = F.col("share") + F.when(~F.col("full") & (F.col("place") <= F.col("spare")), 1).otherwise(0)
    return x.withColumn("share", share).drop("before", "left", "full", "rest", "open", "spare", "place")


def leaf_budgets(tokens: DataFrame, budget: Column, epochs: int = EPOCHS, weights: dict[str, dict[str, int]] | None = None) -> DataFrame:
    """(domain, lang, source, supply, share) for each leaf. budget: of the column `total`, all tokens there are."""
    weights = WEIGHTS if weights is None else weights
    leaves = tokens.groupBy(*LEVELS).agg(F.sum("tokens").alias("supply")).withColumn("cap", F.col("supply") * epochs)
    amount = leaves.agg(F.coalesce(F.sum("supply"), F.lit(0)).alias("total"), F.coalesce(F.sum("cap"), F.lit(0)).alias("most")).select(F.least(budget.cast("long"), F.col("most")).alias("amount"))
    level, parent = None, []
    for i, name in enumerate(LEVELS):
        nodes = leaves.groupBy(*LEVELS[: i + 1]).agg(F.sum("cap").alias("cap")).withColumn("weight", _weight(name, weights))
        nodes = nodes.withColumn("amount", amount.scalar()) if level is None else nodes.join(level.select(*parent, F.col("share").alias("amount")), parent)
        level = share_out(nodes, parent, name)
        parent = LEVELS[: i + 1]
    return level.select(*LEVELS, (F.col("cap") / epochs).cast("long").alias("supply"), "share")


def mix(tokens: DataFrame, budget: Column, epochs: int = EPOCHS, weights: dict[str, dict[str, int]] | None = None, seed: int = SEED, digits: int = 3) -> DataFrame:
    """(doc_id, domain, lang, source, epoch, tokens): one row for each time that a document is taken, with its row key where tokens have one."""
    row = [c for c in tokens.columns if c == ROW]
    budgets = stage(leaf_budgets(tokens, budget, epochs, weights), "budgets")
    budgets = budgets.withColumns({"whole": F.when(F.col("supply") > 0, F.expr("share div greatest(supply, 1)")).otherwise(0), "part": F.when(F.col("supply") > 0, F.expr("share % greatest(supply, 1)")).otherwise(0)})
    if budgets.count() <= BROADCAST_LEAVES:
        budgets = F.broadcast(budgets)
    x = tokens.join(budgets.select(*LEVELS, "whole", "part"), LEVELS)
    out = [*[F.col(c) for c in ("doc_id", *row, *LEVELS)], F.col("epoch").cast("int").alias("epoch"), F.col("tokens")]
    repeated = x.where(F.col("whole") > 0).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).alias("epoch")).select(*out)

    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    p = x.where(F.col("part") > 0).withColumns({"epoch": F.col("whole"), "key": key, "range": F.substring(key, 1, digits)})
    sums = p.groupBy(*LEVELS, "range").agg(F.sum("tokens").alias("held"))
    chain = W.partitionBy(*LEVELS).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("held").over(chain), F.lit(0))).drop("held")
    sums = stage(sums, "ranges")
    # of every leaf the ranges that begin within the budget: the last of them is the one that is sorted
    p = p.join(sums, [*LEVELS, "range"]).where(F.col("base") < F.col("part"))
    last = sums.join(budgets.select(*LEVELS, "part"), LEVELS).where(F.col("base") < F.col("part")).groupBy(*LEVELS).agg(F.max("range").alias("last"))
    p = p.join(last, LEVELS)
    inner = W.partitionBy(*LEVELS, "range").orderBy("key", "doc_id", "tokens", *row).rowsBetween(W.unboundedPreceding, -1)
    edge = p.where(F.col("range") == F.col("last")).withColumn("at", F.col("base") + F.coalesce(F.sum("tokens").over(inner), F.lit(0))).where(F.col("at") < F.col("part"))
    return repeated.unionByName(p.where(F.col("range") < F.col("last")).select(*out)).unionByName(edge.select(*out))


def op1_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half as many tokens as there are, at most three epochs of a source."""
    return mix(token_counts(documents(spark, sf_dir)), F.expr("total div 2"))


def _share_sql(name: str, nodes: str, parent: list[str]) -> str:
    by = "partition by " + ", ".join(parent) if parent else ""
    keys = ", ".join(LEVELS[: len(parent) + 1])
    return f"""
{name}_a as (select *, coalesce(sum(cap) over ({by} order by cap / greatest(weight, 1), case when weight = 0 then 1 else 0 end, {LEVELS[len(parent)]} rows between unbounded preceding and 1 preceding), 0) as before,
  sum(weight) over ({by} order by cap / greatest(weight, 1), case when weight = 0 then 1 else 0 end, {LEVELS[len(parent)]} rows between current row and unbounded following) as wleft from {nodes}),
{name}_b as (select *, cap * wleft <= weight * (amount - before) as isfull from {name}_a),
{name}_c as (select *, amount - coalesce(sum(cap) filter (isfull) over ({by}), 0) as rest, sum(weight) filter (not isfull) over ({by}) as isopen from {name}_b),
{name}_d as (select *, case when isfull then cap else (weight * rest) // greatest(isopen, 1) end as part from {name}_c),
{name}_e as (select *, rest - sum(case when isfull then 0 else part end) over ({by}) as spare, row_number() over ({by} order by isfull, {LEVELS[len(parent)]}) as place from {name}_d),
{name} as (select {keys}, cap, part + case when not isfull and place <= spare then 1 else 0 end as share from {name}_e)"""


OP1_SQL = f"""
with t as (
  select doc_id, ['web', 'books', 'code'][coalesce(try_cast(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) as int), 0) % 3 + 1] as domain,
         coalesce(lang, '') as lang, coalesce(source, '') as source,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) as tokens
  from documents),
leaf as (select domain, lang, source, sum(tokens)::bigint as supply, sum(tokens)::bigint * {EPOCHS} as cap from t group by all),
n0 as (select domain, sum(cap)::bigint as cap, case domain when 'web' then 5 when 'books' then 3 when 'code' then 2 else 1 end as weight,
       (select least(sum(supply)::bigint // 2, sum(cap)::bigint) from leaf) as amount from leaf group by domain),
{_share_sql("s0", "n0", []).strip()},
n1 as (select l.domain, l.lang, l.cap, case l.lang when 'en' then 6 when 'de' then 2 else 1 end as weight, s0.share as amount
       from (select domain, lang, sum(cap)::bigint as cap from leaf group by all) l join s0 using (domain)),
{_share_sql("s1", "n1", ["domain"]).strip()},
n2 as (select l.domain, l.lang, l.source, l.cap, 1 as weight, s1.share as amount from leaf l join s1 using (domain, lang)),
{_share_sql("s2", "n2", ["domain", "lang"]).strip()},
g as (select domain, lang, source, case when supply > 0 then share // supply else 0 end as whole, case when supply > 0 then share % supply else 0 end as part
      from s2 join leaf using (domain, lang, source)),
x as (select t.*, whole, part, md5('{SEED}|' || whole::varchar || '|' || coalesce(doc_id::varchar, '')) as ordering from t join g using (domain, lang, source)),
y as (select *, coalesce(sum(tokens) over (partition by domain, lang, source order by ordering, doc_id nulls first, tokens rows between unbounded preceding and 1 preceding), 0) as start from x)
select doc_id, domain, lang, source, e::int as epoch, tokens::bigint as tokens from x, unnest(range(0, whole::bigint)) as r(e)
union all
select doc_id, domain, lang, source, whole::int, tokens::bigint from y where start < part
"""
