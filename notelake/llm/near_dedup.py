"""Operator 8, MinHash near-dedup.

1. One pass over the texts: a document's set of shingles, the minima of 128 universal hashes (16 bits of each are its
   signature), and a digest of the set.
2. Documents with the same set are one class; only its smallest doc_id goes on.
3. Banding, 32 bands of 4 minima: each member of a bucket is tied to the bucket's smallest id, and the components of
   these ties are families. A pair at the limit of 0.8 shares no bucket with probability (1 - 0.8^4)^32 < 5e-8.
4. A family of more than `block` documents, as a common passage makes one, is cut: the members of a bucket meet by
   their signatures, and what no pair of likely partners connects is a family of its own.
5. A family's documents meet in a task, in blocks of about `block` documents (families that are larger still: every
   pair of blocks is a task; as many pairs as ship about twice the text of all families make a wave, and a wave's
   shuffle goes before the next). There signatures rule out partners, and the exact sizes of the intersections of the
   full sets come from an inverted index. A document is compared with all others unless it is in the largest component
   found so far, so that no link between components is lost, and what a task returns is a forest, never all pairs.
6. Components of these links, by alternating large-star and small-star.

Defined cases: null or wordless text has the empty set and no links; fewer words than a shingle make one shingle; rows
with a null doc_id are linked with nothing, have no component_id and are kept; the rows of a repeated doc_id are one
document, with the links of each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import gc
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from notelake.llm.common import ASCII_LOWER, LOWER, UPPER, documents, stage
from notelake.llm.components import connected_components
from notelake.llm.vector_text import ngram_hashes, text_chunks, word_hashes, word_spans

BANDS, ROWS = 32, 4
#: Documents of a family that a task compares with each other.
BLOCK = 4096
#: Members of a bucket whose signatures a task compares.
CROWD = 65536
#: Bands whose buckets are dealt out at once where families are cut.
TURN = 8
#: Standard errors of a signature's estimate below the limit before a pair is ruled out.
DOUBT = 6.0
_rng = np.random.default_rng(20_240_613)
_A = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a column."""
    for _, data, offsets in text_chunks(column, ASCII_LOWER):
        starts, ends, first = word_spans(data, offsets)
        words = word_hashes(data, starts, ends)
        grams = ngram_hashes(words, n)
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
            if hi - lo >= n:
                yield np.unique(grams[lo : hi - n + 1])
            elif hi > lo:
                yield ngram_hashes(words[lo:hi], hi - lo)
            else:
                yield np.empty(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The top 16 bits of the smallest a x + b (mod 2^64) for each hash."""
    least = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        part = shingles[at : at + 1024]
        np.minimum(least, (_A[:, None] * part[None, :] + _B[:, None]).min(axis=1), out=least)
    return (least >> np.uint64(48)).astype(np.uint16)


def _sign(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, signs = [], [], []
            for s in shingle_sets(batch.column("text"), n):
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                signs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(signs, pa.binary())], ["doc_id", "n_shingles", "digest", "sig"])

    return run


def _band(i: Column) -> Column:
    return F.xxhash64(i, F.substring("sig", i * (2 * ROWS) + 1, 2 * ROWS))


def _forest(sets: list[np.ndarray], signs: np.ndarray, block: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (pairs of positions) that connect all documents whose sets are alike, directly or not.

    Where two blocks meet, only pairs across them are compared: each block has a task of its own.
    """
    n = len(sets)
    if n < 2:
        return []
    size = np.array([len(s) for s in sets])
    cross = (block != block[0]).any()
    flat = np.concatenate(sets)
    _, term = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(term, kind="stable")
    posting, counts = owner[order], np.bincount(term)
    begin = np.concatenate([[0], np.cumsum(counts)])
    at = np.concatenate([[0], np.cumsum(size)])
    label, links, done = np.arange(n), [], np.zeros(n, bool)
    limit = percent / 100
    floor = limit - DOUBT * np.sqrt(limit * (1 - limit) / signs.shape[1])
    while True:
        tally = np.bincount(label, minlength=n)
        rest = np.flatnonzero(~done & (label != tally.argmax()))
        if not len(rest):
            return links
        # those in small components first: once they are compared, nothing is left to compare
        for v in rest[:64] if len(rest) > 64 else rest:
            done[v] = True
            may = label != label[v]
            if cross:
                may &= block != block[v]
            may &= (100 * np.minimum(size, size[v])) >= percent * np.maximum(size, size[v])
            near = np.flatnonzero(may)
            near = near[(signs[near] == signs[v]).mean(axis=1) >= floor] if len(near) else near
            if not len(near):
                continue
            terms = term[at[v] : at[v + 1]]
            lens = counts[terms]
            spots = np.repeat(begin[terms] - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))
            shared = np.bincount(posting[spots], minlength=n)[near]
            for u in near[100 * shared >= percent * (size[near] + size[v] - shared)]:
                if label[u] != label[v]:
                    links.append((int(u), int(v)))
                    label[label == label[u]] = label[v]


def _likely(size: np.ndarray, signs: np.ndarray, label: np.ndarray, block: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs of positions that connect all with likely partners, directly or not; those of one label are connected already."""
    limit = percent / 100
    least = int(np.ceil((limit - DOUBT * np.sqrt(limit * (1 - limit) / signs.shape[1])) * signs.shape[1]))
    order = np.argsort(size, kind="stable")
    size, signs, block = size[order], signs[order], block[order]
    label, links = np.unique(label[order], return_inverse=True)[1], []
    cross = (block != block[0]).any()
    for v, end in enumerate(np.searchsorted(percent * size, 100 * size, "right").tolist()):
        may = label[v + 1 : end] != label[v]
        if cross:
            may &= block[v + 1 : end] != block[v]
        near = np.flatnonzero(may) + v + 1
        if len(near):
            # eight comparisons to a word, added up without a carry
            near = near[(signs[near] == signs[v]).view(np.uint64).sum(axis=1).view(np.uint8).reshape(len(near), 8).sum(axis=1) >= least]
        if len(near):
            joined, at = np.unique(label[near], return_index=True)
            links += [(int(order[v]), int(order[u])) for u in near[at]]
            label[np.isin(label, joined)] = label[v]
    return links


def _in_groups(keys: list[str], solve: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by the keys: what solve gives for each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.stack([batch.column(c).to_numpy() for c in keys], axis=1)
            cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if held and tuple(at[lo]) != last:
                    yield from solve(pa.Table.from_batches(held).combine_chunks())
                    held = []
                last = tuple(at[lo])
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from solve(pa.Table.from_batches(held).combine_chunks())

    return run


def _pairs(ids: np.ndarray, links: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    if links:
        u, v = np.array(links).T
        yield pa.RecordBatch.from_arrays([pa.array(ids[u]), pa.array(ids[v])], ["u", "v"])


def _signs(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(t.num_rows, -1)


def _meet(percent: int):
    """Rows sorted by (key, i, j): the likely partners of each group."""

    def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
        size, label, block = (t.column(c).to_numpy() for c in ("n_shingles", "label", "block"))
        yield from _pairs(t.column("doc_id").to_numpy(), _likely(size, _signs(t), label, block, percent))

    return _in_groups(["key", "i", "j"], solve)


def _confirm(n: int, percent: int):
    """Rows sorted by (family, i, j): the links of each group."""

    def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
        sets = [s for c in t.column("text").chunks for s in shingle_sets(c, n)]
        links = _forest(sets, _signs(t), t.column("block").to_numpy(), percent)
        yield from _pairs(t.column("doc_id").to_numpy(), links)

    return _in_groups(["family", "i", "j"], solve)


def _free(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of plans that the driver has forgotten: without a collection they stay."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _keys(bands: range) -> Column:
    return F.explode(F.array(*[_band(F.lit(i)) for i in bands]))


def _partners(members: DataFrame, labels: DataFrame, bands: range, percent: int, crowd: int) -> DataFrame:
    """(u, v): likely partners of different labels that share a bucket of these bands, as many as connect them."""
    rows = members.join(labels, "doc_id").select("doc_id", "label", _keys(bands).alias("key"))
    mixed = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    split = rows.join(mixed.select("key", F.ceil(F.col("n") / crowd).cast("int").alias("blocks")), "key").withColumn("block", own)
    split = split.select("doc_id", "label", "key", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    split = split.select("doc_id", "label", "key", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    met = split.join(members, "doc_id").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return met.select("doc_id", "n_shingles", "label", "key", "block", "i", "j", "sig").mapInArrow(_meet(percent), "u long, v long")


def _cut(members: DataFrame, percent: int, crowd: int) -> DataFrame:
    """(node, root) of the families that likely partners in the buckets of members make: (doc_id, n_shingles, sig)."""
    spark, ties, roots = members.sparkSession, [], None
    for at in range(0, BANDS, TURN):
        own = members.select("doc_id", F.col("doc_id").alias("label")).distinct()
        labels = own if roots is None else own.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("root", "label").alias("label"))
        ties.append(stage(_partners(members, labels, range(at, min(at + TURN, BANDS)), percent, crowd), "partners"))
        roots = connected_components(functools.reduce(DataFrame.union, ties))
        _free(spark)
    return roots


def _waves(sizes: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """(first, past the last) distance of the blocks that meet in a wave, for (blocks, shingles) of all families.

    The first wave has each block by itself; it, and each other one, goes on while it ships at most twice the whole.
    """
    room = 2 * sum(w for _, w in sizes)
    at, now, held = 0, 0, 0
    while any(b // 2 >= now for b, _ in sizes):
        cost = sum(w * (1 if now == 0 or 2 * now == b else 2) for b, w in sizes if b // 2 >= now)
        if now > at and held + cost > room:
            yield at, now
            at, held = now, 0
        held += cost
        now += 1
    yield at, max(now, 1)


def _links(docs: DataFrame, reps: DataFrame, blocked: DataFrame, wave: tuple[int, int], shingle: int, percent: int) -> DataFrame:
    """(u, v): the links between blocks, on a ring, whose distance is in the wave: no pair of blocks is in two waves."""
    b, n = F.col("block"), F.col("blocks")
    far = F.filter(F.sequence(F.lit(wave[0]), F.lit(wave[1] - 1)), lambda d: 2 * d <= n)
    others = F.array_distinct(F.concat(F.transform(far, lambda d: F.pmod(b + d, n)), F.transform(far, lambda d: F.pmod(b - d, n))))
    split = blocked.select("doc_id", "family", "block", F.explode(others).alias("other"))
    split = split.select("doc_id", "family", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    texts = docs.join(split.hint("shuffle_hash"), "doc_id").join(reps.select("doc_id", "sig").hint("shuffle_hash"), "doc_id")
    dealt = texts.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j")
    return dealt.select("doc_id", "family", "block", "i", "j", "text", "sig").mapInArrow(_confirm(shingle, percent), "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, block: int = BLOCK, crowd: int = CROWD) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs."""
    docs = docs.select("doc_id", "text")
    signed = stage(docs.mapInArrow(_sign(shingle), "doc_id long, n_shingles long, digest binary, sig binary"), "signatures")
    able = signed.where(F.col("sig").isNotNull() & F.col("doc_id").isNotNull())
    classes = able.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    member = able.select("doc_id", "digest").join(classes, "digest").select("doc_id", "rep")
    reps = stage(able.join(classes.select(F.col("rep").alias("doc_id"), "digest"), ["doc_id", "digest"], "left_semi").select("doc_id", "digest", "n_shingles", "sig").dropDuplicates(["doc_id", "digest"]), "representatives")

    rows = reps.select("doc_id", _keys(range(BANDS)).alias("key"))
    ties = rows.select("doc_id", F.min("doc_id").over(W.partitionBy("key")).alias("first")).where(F.col("doc_id") != F.col("first"))
    families = stage(connected_components(ties.select(F.col("doc_id").alias("u"), F.col("first").alias("v"))), "families")
    large = families.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > block).select("root")
    if not large.isEmpty():
        members = stage(reps.join(families.join(large, "root").select(F.col("node").alias("doc_id")), "doc_id").select("doc_id", "n_shingles", "sig"), "members")
        families = stage(families.join(large, "root", "left_anti").select("node", "root").unionByName(_cut(members, percent, crowd)), "families")

    sized = families.select(F.col("node").alias("doc_id"), F.col("root").alias("family")).join(reps.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles")), "doc_id")
    counts = sized.groupBy("family").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.sum("n_shingles").alias("shingles"))
    sizes = [(r.blocks, r.shingles) for r in counts.groupBy("blocks").agg(F.sum("shingles").alias("shingles")).collect()]
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    blocked = stage(sized.join(counts.select("family", "blocks"), "family").select("doc_id", "family", "blocks", own.alias("block")), "blocks")
    found = []
    for wave in _waves(sizes):
        if found:
            _free(docs.sparkSession)
        found.append(stage(_links(docs, reps, blocked, wave, shingle, percent), "links"))
    links = functools.reduce(DataFrame.union, found)

    roots = connected_components(links).select(F.col("node").alias("rep"), "root")
    found = member.join(roots, "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("root", "rep")).alias("root"))
    out = signed.select("doc_id", "n_shingles").join(found, "doc_id", "left")
    component = F.coalesce("root", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), shingle=4)


#: Every pair of documents that share a shingle, so for small tables only.
OP8_SQL = f"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws from documents),
s as (select doc_id, case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')]
      else list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) end as shingles from w),
e as (select doc_id, len(shingles) as size, unnest(shingles) as shingle from s),
l as (select a.doc_id as u, b.doc_id as v from e a join e b on a.shingle = b.shingle and a.doc_id <> b.doc_id
      group by a.doc_id, b.doc_id, a.size, b.size having 100 * count(*) >= 80 * (a.size + b.size - count(*))),
reach as (select doc_id as node, doc_id as root from s union select reach.node, l.v from reach join l on reach.root = l.u)
select doc_id, len(shingles)::bigint as n_shingles, min(root) as component_id, doc_id = min(root) as kept from s join reach on node = doc_id group by doc_id, shingles
"""
