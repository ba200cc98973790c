"""Operator 3, chat formatting: cumulative snapshots of a logged conversation collapse to the longest one.

A chat log holds a conversation once per turn: every snapshot is a prefix of the next one. Each turn gets a
digest of role and text; the digests of turns 1..i roll into one prefix hash; a conversation whose whole hash
is a prefix hash of a longer one goes (anti-join), and only the rest is rendered. DataFrame functions only.

The hash columns alone are shuffled to find prefixes; texts move once, after the anti-join. Prefixes and tips are
reduced to one row per value before the join, so a greeting that opens a third of all conversations is one row.

Defined cases: null role or text is the empty string; a null turn sorts first; rows of one conversation with the
same turn are ordered by digest and repeated rows stay separate turns; rows with a null conv_id are one
conversation; of equal conversations the smallest conv_id stays (null only if no other); an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TURN_OPEN, TURN_CLOSE = "<|im_start|>", "<|im_end|>"


def _turns(turns: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(role, F.lit("\x1f"), text), 256))
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), digest.alias("digest"))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, h1, h2, last): the 128-bit rolling hash of turns 1..pos; last marks the whole conversation."""
    order = W.partitionBy("conv_id").orderBy("turn", "digest")
    rolling = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    t = _turns(turns).select("conv_id", "turn", "digest").withColumn("pos", F.row_number().over(order))
    return t.select(
        "conv_id",
        "pos",
        F.bit_xor(F.xxhash64("pos", "digest")).over(rolling).alias("h1"),
        F.bit_xor(F.xxhash64("digest", "pos")).over(rolling).alias("h2"),
        F.lead("pos").over(order).isNull().alias("last"),
    )


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of the conversations that no longer one starts with."""
    h = prefix_hashes(turns)
    key = ["pos", "h1", "h2"]
    prefixes = h.where(~F.col("last")).select(*key).distinct()
    tips = h.where("last").groupBy(*key).agg(F.min("conv_id").alias("conv_id"))
    return tips.join(prefixes, key, "left_anti").select("conv_id", F.col("pos").cast("long").alias("n_turns"))


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, rendered."""
    kept = maximal_conversations(turns).withColumnRenamed("conv_id", "kept_id")
    t = _turns(turns)
    line = lambda x: F.concat(F.lit(TURN_OPEN), x["role"], F.lit("\n"), x["text"], F.lit(TURN_CLOSE + "\n"))
    return (
        t.join(kept, t["conv_id"].eqNullSafe(kept["kept_id"]))
        .groupBy("conv_id", "n_turns")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "role", "text"))).alias("turns"))
        .select("conv_id", "n_turns", F.array_join(F.transform("turns", line), "").alias("rendered"))
    )


def op3_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP3_SQL = """
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text,
         sha256(coalesce(role, '') || chr(31) || coalesce(text, '')) as digest
  from conversations),
c as (
  select conv_id, count(*) as n_turns, list(digest order by turn nulls first, digest) as seq,
         string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), ''
                    order by turn nulls first, digest) as rendered
  from t group by conv_id),
p as (select distinct list_slice(seq, 1, i) as seq from c, unnest(range(1, n_turns)) as u(i)),
k as (select *, row_number() over (partition by seq order by conv_id nulls last) as rn from c where seq not in (select seq from p))
select conv_id, n_turns, rendered from k where rn = 1
"""
