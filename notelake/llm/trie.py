"""Operator 12, conversation prefix trie: subtree figures by the Euler-tour technique.

1. Rebuild: each conversation takes the first h turns of its base (its id rounded down to a multiple of FAMILY) and goes on
   with its own turns after its first h.
2. Nodes: digests of turns 1..d roll into one prefix hash; a distinct (d, hash) is a node, named by its smallest member and
   its depth.
3. Tour: every node has an enter and an exit arc; children follow each other by conv_id. The nodes named by one conversation
   are a path whose first child is always the path's own, so their enter arcs stand together in the tour, and their exit
   arcs too, up to each node that has children of other names. Such runs are contracted to one arc with the sum of their
   weights (window sums along the path). What remains is a linked list, three arcs a path at most.
4. List ranking: pointer jumping over that list, one join and one staged table a round, as many rounds as the logarithm of
   its length; every arc ends with the sum of the weights from there to the end of the tour, which is the total less its
   prefix sum. A node's subtree is the difference between its enter and its exit arc.

Siblings are linked by a global range sort and not by a window of all children of a node, ids of a node are joined in
pieces of a range sort and hashed as a stream: neither a node with very many children nor one with very many ends has to fit
in a task. Defined cases: null role or text is the empty string; null turns come first, rows of one turn in the order of
role and text; rows with a null conv_id belong to no conversation; an empty table has no nodes; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from notelake.llm.common import WORD_GAP, discard, scratch_path, stage

#: Conversations that share a base, and the number of head lengths.
FAMILY, HEADS = 20, 4
#: Characters of ids that are joined in one row.
PIECE = 1 << 20
NONE = hashlib.sha256(b"").hexdigest()
KEY = ["depth", "h1", "h2"]


def word_count(text: Column) -> Column:
    parts = F.split(text, WORD_GAP)
    return F.size(parts).cast("long") - (F.element_at(parts, 1) == "").cast("long") - ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("long")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ids: conv_id of every conversation; turns: conv_id, depth from 1, digest, words)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    t = turns.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", role.alias("role"), text.alias("text"))
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    digest = F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    t = t.withColumn("pos", F.row_number().over(order) - 1).select("conv_id", "pos", digest.alias("digest"), word_count(F.col("text")).alias("words"))
    t = stage(t, "turns")
    ids = t.where("pos = 0").select("conv_id")
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    given = t.where(F.col("pos") < HEADS - 1).select(F.col("conv_id").alias("base"), "pos", "digest", "words")
    taken = ids.select("conv_id", head.alias("head"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base")).join(given, "base").where(F.col("pos") < F.col("head"))
    lengths = taken.groupBy("conv_id").agg(F.count("*").alias("n"))
    own = t.where(F.col("pos") >= head).join(lengths, "conv_id", "left")
    own = own.select("conv_id", (F.coalesce("n", F.lit(0)) + F.col("pos") - head + 1).cast("long").alias("depth"), "digest", "words")
    return ids, own.unionByName(taken.select("conv_id", (F.col("pos") + 1).cast("long").alias("depth"), "digest", "words"))


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, h1, h2, up1, up2, words, last): the hash of turns 1..depth, and that of the parent."""
    order = W.partitionBy("conv_id").orderBy("depth")
    so_far = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    one, two = F.xxhash64("depth", "digest"), F.xxhash64("digest", "depth")
    rolled = turns.select("conv_id", "depth", "words", one.alias("one"), two.alias("two")).select(
        "conv_id", "depth", "words", "one", "two", F.bit_xor("one").over(so_far).alias("h1"), F.bit_xor("two").over(so_far).alias("h2"), F.lead("depth").over(order).isNull().alias("last")
    )
    return rolled.select("conv_id", "depth", "h1", "h2", F.col("h1").bitwiseXOR(F.col("one")).alias("up1"), F.col("h2").bitwiseXOR(F.col("two")).alias("up2"), "words", "last")


def _pieces(limit: int):
    """Sorted (depth, h1, h2, conv_id) to (depth, h1, h2, first, ids), up to about `limit` characters of ids in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, names = [pa.int64()] * 4 + [pa.string()], [*KEY, "first", "ids"]
        key, first, ids, size = None, None, [], 0
        done: list[tuple] = []
        for batch in batches:
            for *k, c in zip(*(batch.column(n).to_pylist() for n in (*KEY, "conv_id"))):
                if k != key or size >= limit:
                    if ids:
                        done.append((*key, first, ",".join(ids)))
                    key, first, ids, size = k, c, [], 0
                ids.append(str(c))
                size += len(ids[-1]) + 1
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), kinds)], names)
                done = []
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*key, first, ",".join(ids)), kinds)], names)

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (depth, h1, h2, first, ids) to (depth, h1, h2, sha)."""
    kinds, names = [pa.int64()] * 3 + [pa.string()], [*KEY, "sha"]
    key, state = None, None
    for batch in batches:
        done = []
        for *k, ids in zip(*(batch.column(n).to_pylist() for n in (*KEY, "ids"))):
            if k != key:
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = k, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), kinds)], names)
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*key, state.hexdigest()), kinds)], names)


def joined_ids(ends: DataFrame, limit: int = PIECE) -> DataFrame:
    """(depth, h1, h2, sha): SHA-256 of the ascending conv_ids of each key, joined by commas."""
    pieces = ends.repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id").mapInArrow(_pieces(limit), "depth long, h1 long, h2 long, first long, ids string")
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(_digests, "depth long, h1 long, h2 long, sha string")


def next_in_group(rows: DataFrame, group: list[str], order: str) -> DataFrame:
    """rows with `next`: the order of the next row of the same group, by one range sort of all rows; null for the last one."""
    x = stage(rows.repartitionByRange(*group, order).withColumn("__p", F.spark_partition_id()), "siblings")
    here = F.struct(*group, order)
    within = F.lead(here).over(W.partitionBy("__p").orderBy(*group, order))
    firsts = x.groupBy("__p").agg(F.min(here).alias("first"))
    after = firsts.select("__p", F.lead("first").over(W.orderBy("__p")).alias("__after"))  # a row for each range
    x = x.withColumn("__next", within).join(after, "__p")
    then = F.coalesce("__next", "__after")
    same = F.lit(True)
    for g in group:
        same = same & (then[g] == F.col(g))
    return x.withColumn("next", F.when(same, then[order])).drop("__p", "__next", "__after")


def trie_nodes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, first_side, leaf, saved, sha) of every node."""
    ids, seq = rebuilt(turns)
    rows = stage(prefixes(seq), "prefixes")
    nodes = rows.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("up1").alias("up1"), F.min("up2").alias("up2"), F.min("words").alias("words"))
    zero = F.lit(0).cast("long")
    root = ids.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        zero.alias("depth"), zero.alias("h1"), zero.alias("h2"), "conv_id", "n_convs", F.lit(None).cast("long").alias("up1"), F.lit(None).cast("long").alias("up2"), zero.alias("words")
    )
    nodes = stage(nodes.unionByName(root), "nodes")
    up = nodes.select((F.col("depth") + 1).alias("depth"), F.col("h1").alias("up1"), F.col("h2").alias("up2"), F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.join(up, ["depth", "up1", "up2"], "left")
    turnless = ids.join(rows.where("depth = 1").select("conv_id"), "conv_id", "left_anti").select(zero.alias("depth"), zero.alias("h1"), zero.alias("h2"), "conv_id")
    nodes = nodes.join(joined_ids(rows.where("last").select(*KEY, "conv_id").unionByName(turnless)), KEY, "left")
    nodes = stage(nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), F.coalesce("sha", F.lit(NONE)).alias("sha")), "named")
    side = F.when(F.col("conv_id") != F.col("parent_conv_id"), F.col("conv_id"))
    children = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"), F.min(side).alias("first_side"))
    out = nodes.join(children, ["conv_id", "depth"], "left")
    return out.withColumns({"n_children": F.coalesce("n_children", zero), "leaf": F.col("n_children").isNull().cast("long")})


def tour(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with exit: the exit run they are in, and the weights before them on their path; the linked list of runs).

    A run is (conv_id, at): at -1 the enter arcs of a path, else the exit arcs from depth `at` upwards.
    """
    path = W.partitionBy("conv_id").orderBy("depth")
    before, below = path.rowsBetween(W.unboundedPreceding, -1), W.partitionBy("conv_id").orderBy(F.col("depth").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    zero = F.lit(0).cast("long")
    end = F.lead("depth").over(path).isNull()
    x = nodes.withColumns({"end": end, "leaves_before": F.coalesce(F.sum("leaf").over(before), zero), "saved_before": F.coalesce(F.sum("saved").over(before), zero), "top": F.min("depth").over(W.partitionBy("conv_id"))})
    x = stage(x.withColumn("exit", F.min(F.when(F.col("end") | F.col("first_side").isNotNull(), F.col("depth"))).over(below)), "tour")
    tops = next_in_group(x.where((F.col("depth") == F.col("top")) & (F.col("depth") > 0)).select("conv_id", "depth", "parent_conv_id"), ["parent_conv_id", "depth"], "conv_id")
    tops = tops.select("conv_id", F.coalesce("next", "parent_conv_id").alias("up"), F.when(F.col("next").isNotNull(), -1).otherwise(F.col("depth") - 1).cast("long").alias("up_at"))
    enter = x.where("end").select("conv_id", F.lit(-1).cast("long").alias("at"), F.coalesce("first_side", "conv_id").alias("to"), F.when(F.col("first_side").isNotNull(), -1).otherwise(F.col("depth")).cast("long").alias("to_at"), (F.col("leaves_before") + F.col("leaf")).alias("leaves"), (F.col("saved_before") + F.col("saved")).alias("saved"))
    starts = x.where(F.col("exit") == F.col("depth"))
    above = F.lag("first_side").over(path)
    exits = starts.select("conv_id", F.col("depth").alias("at"), above.alias("above")).join(tops, "conv_id", "left")
    exits = exits.select("conv_id", "at", F.coalesce("above", "up").alias("to"), F.when(F.col("above").isNotNull(), -1).otherwise(F.col("up_at")).cast("long").alias("to_at"), zero.alias("leaves"), zero.alias("saved"))
    return x, enter.unionByName(exits)


def rank(arcs: DataFrame) -> DataFrame:
    """arcs (conv_id, at, to, to_at, leaves, saved) with leaves and saved summed from each arc to the end of its list."""
    spark = arcs.sparkSession
    held = None
    while True:
        path = scratch_path(spark, "rank")
        arcs.write.parquet(path)
        here = spark.read.schema(arcs.schema).parquet(path)
        if held:
            discard(spark, held)
        held = path
        if here.where(F.col("to").isNotNull()).isEmpty():
            return here
        ahead = here.select(F.col("conv_id").alias("to"), F.col("at").alias("to_at"), F.col("to").alias("far"), F.col("to_at").alias("far_at"), F.col("leaves").alias("more_leaves"), F.col("saved").alias("more_saved"))
        zero = F.lit(0).cast("long")
        jumped = here.where(F.col("to").isNotNull()).join(ahead, ["to", "to_at"])
        jumped = jumped.select("conv_id", "at", F.col("far").alias("to"), F.col("far_at").alias("to_at"), (F.col("leaves") + F.col("more_leaves")).alias("leaves"), (F.col("saved") + F.col("more_saved")).alias("saved"))
        arcs = here.where(F.col("to").isNull()).unionByName(jumped)


def prefix_trie(turns: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: one row per node."""
    nodes, arcs = tour(trie_nodes(turns))
    ranked = rank(arcs)
    enter = ranked.where("at = -1").select("conv_id", F.col("leaves").alias("leaves_in"), F.col("saved").alias("saved_in"))
    leave = ranked.where("at >= 0").select("conv_id", F.col("at").alias("exit"), F.col("leaves").alias("leaves_out"), F.col("saved").alias("saved_out"))
    x = nodes.join(enter, "conv_id").join(leave, ["conv_id", "exit"])
    return x.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("leaves_in") - F.col("leaves_before") - F.col("leaves_out")).alias("n_leaves"),
        (F.col("saved_in") - F.col("saved_before") - F.col("saved_out")).alias("saved_tokens"),
        F.col("sha").alias("ends_sha256"),
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


# DuckDB has no crc32: it is computed bit by bit
OP12_SQL = f"""
with recursive byte(n, v, k) as (
  select range, range::bigint, 0 from range(256) union all
  select n, case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end, k + 1 from byte where k < 8),
crc_table as (select list(v order by n) as v from byte where k = 8),
o as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as pos from conversations where conv_id is not null),
ids as (select distinct conv_id from o),
heads as (select conv_id, conv_id - conv_id % {FAMILY} as base, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda c: ascii(c)::bigint)), lambda a, b: xor(a >> 8, v[(xor(a, b) & 255) + 1])), 4294967295) % {HEADS} as h from ids, crc_table),
r as (
  select h.conv_id, 0 as part, pos, role, text from heads h join o on o.conv_id = h.base and pos < h.h
  union all select h.conv_id, 1, pos, role, text from heads h join o on o.conv_id = h.conv_id and pos >= h.h),
s as (select conv_id, row_number() over (partition by conv_id order by part, pos) as depth, sha256(length(role)::varchar || ':' || role || text) as digest, len(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) as words from r),
p as (select conv_id, depth, words, sha256(string_agg(digest, '') over (partition by conv_id order by depth)) as key from s
      union all select conv_id, 0, 0, '' from ids),
len as (select conv_id, max(depth) as n from p group by conv_id),
ends as (select key, depth, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) as sha from p join len using (conv_id) where depth = n group by key, depth),
node as (select key, depth, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * min(words) as saved from p group by key, depth),
parent as (select n.key, n.depth, n.conv_id, up.conv_id as parent_conv_id, up.key as parent_key from node n join p on p.conv_id = n.conv_id and p.depth = n.depth - 1 join node up on up.key = p.key and up.depth = p.depth),
kids as (select parent_key as key, depth - 1 as depth, count(*) as n_children from parent group by all),
sums as (select p.key, p.depth, sum(n.saved) as saved_tokens, count(*) filter (where k.key is null) as n_leaves
         from node n join p on p.conv_id = n.conv_id and p.depth <= n.depth left join kids k on k.key = n.key and k.depth = n.depth group by p.key, p.depth)
select n.conv_id, n.depth::bigint as depth, parent_conv_id, n_convs, coalesce(n_children, 0)::bigint as n_children, n_leaves::bigint as n_leaves, saved_tokens::bigint as saved_tokens, coalesce(sha, sha256('')) as ends_sha256
from node n join sums using (key, depth) left join parent using (key, depth) left join kids using (key, depth) left join ends using (key, depth)
"""
