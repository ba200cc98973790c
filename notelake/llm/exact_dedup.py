"""Operator 9, exact dedup: Grace hash deduplication.

1. Map side: each task folds its rows in an open-addressing table that compares whole contents, so that a text which
   a third of all rows share leaves a task once for each table it fills, not once a row.
2. Spill: what is left is dealt out by the hash of its content and written as a bucketed table in the shared folder.
   Buckets over `fit_bytes` that hold more than one hash are dealt out again by other bits of the hash and written
   anew, until each fits. (Bucketed scans keep a bucket in one task, so nothing is shuffled to read them.)
3. Resolve: a task streams one bucket through the same table, which holds distinct contents only.

Documents that are not their task's representative travel as 60-byte member rows, dealt out by representative (at
most one task's rows each), never by content.

Two texts are equal when they are identical after lower-casing A-Z. Defined cases: null text is the empty text; of
equal texts the row with the largest doc_id stays, null counting as the smallest, and of rows that repeat doc_id and
text exactly one; an empty table gives an empty result; extra columns pass through dedup_rows untouched.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelake.llm.common import ASCII_LOWER, documents, scratch_path, stage

#: Bytes of text in a bucket that one task resolves.
FIT_BYTES = 64 << 20
#: Buckets that an oversized bucket is dealt out to.
FAN_OUT = 16
NO_ID = -(1 << 63)


class ContentTable:
    """Open addressing with linear probing from whole contents to indices 0, 1, 2, ...; grows at half load."""

    def __init__(self) -> None:
        self.slots, self.hashes, self.contents = [-1] * 1024, [], []

    def index(self, h: int, content: bytes) -> int:
        slots, hashes = self.slots, self.hashes
        mask = len(slots) - 1
        i = h & mask
        while (g := slots[i]) >= 0:
            if hashes[g] == h and self.contents[g] == content:
                return g
            i = (i + 1) & mask
        g = slots[i] = len(hashes)
        hashes.append(h)
        self.contents.append(content)
        if 2 * len(hashes) > len(slots):
            self.slots = slots = [-1] * (4 * len(slots))
            mask = len(slots) - 1
            for j, x in enumerate(hashes):
                i = x & mask
                while slots[i] >= 0:
                    i = (i + 1) & mask
                slots[i] = j
        return g


def _normal(text: str | None) -> bytes:
    return (text or "").encode().translate(ASCII_LOWER)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


class _Fold:
    """Rows folded by content: the winner's row, how many rows each content has."""

    def __init__(self, keep_rows: bool) -> None:
        self.table, self.best, self.n, self.at, self.keep, self.parts, self.rows = ContentTable(), [], [], [], keep_rows, [], 0

    def add(self, batch: pa.RecordBatch, contents: list[bytes], hashes: list[int], order: list[tuple], counts: list[int]) -> list[int]:
        """The group of each row."""
        groups = []
        for j, (h, content) in enumerate(zip(hashes, contents)):
            g = self.table.index(h, content)
            groups.append(g)
            if g == len(self.n):
                self.n.append(counts[j])
                self.best.append(order[j])
                self.at.append(self.rows + j)
            else:
                self.n[g] += counts[j]
                if order[j] > self.best[g]:
                    self.best[g], self.at[g] = order[j], self.rows + j
        if self.keep:
            self.parts.append(batch)
            self.rows += batch.num_rows
        return groups

    def winners(self) -> pa.Table:
        """The rows of the winners, in group order; frees the other rows."""
        out = pa.Table.from_batches(self.parts).take(pa.array(self.at, pa.int64()))
        self.parts, self.at, self.rows = out.combine_chunks().to_batches(), list(range(len(self.at))), len(self.at)
        return out


def _collapse(buckets: int, members: bool, schema: pa.Schema, flush_bytes: int):
    """Map side. Rows out: a representative (with its row) for each content, and a member row for each row in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40

        def flush(fold: _Fold, rows: list) -> Iterator[pa.RecordBatch]:
            nonlocal first
            won, m = fold.winners(), len(fold.n)
            hs = [_signed(h) for h in fold.table.hashes]
            extra = {
                "bucket": [h % buckets for h in hs], "rep": [first + g for g in range(m)], "best": [b[0] for b in fold.best], "best_row": [b[1] for b in fold.best],
                "n": fold.n, "h": hs, "size": [len(c) for c in fold.table.contents], "sha": [None] * m, "whole": [True] * m,
            }
            table = pa.table({f.name: won[f.name[2:]] if f.name.startswith("c_") else pa.array(extra[f.name], f.type) for f in schema}, schema=schema)
            yield from table.to_batches(max_chunksize=2000)
            if members:
                for at in range(0, len(rows), 50_000):
                    part = rows[at : at + 50_000]
                    reps = [first + g for g, *_ in part]
                    own = {
                        "bucket": [xxhash.xxh3_64_intdigest(r.to_bytes(8, "little")) % buckets for r in reps], "rep": reps, "best": [x[1] for x in part], "best_row": [x[2] for x in part],
                        "sha": [x[3] for x in part], "whole": [False] * len(part),
                    }
                    yield from pa.table({f.name: pa.array(own[f.name], f.type) if f.name in own else pa.nulls(len(part), f.type) for f in schema}, schema=schema).to_batches()
            first += m

        fold, rows, held, row = _Fold(True), [], 0, first
        for batch in batches:
            contents = [_normal(t) for t in batch.column("text").to_pylist()]
            hashes = [xxhash.xxh3_64_intdigest(c) for c in contents]
            ids = [NO_ID if x is None else x for x in batch.column("doc_id").to_pylist()]
            order = [(x, row + j) for j, x in enumerate(ids)]
            row += len(ids)
            groups = fold.add(batch, contents, hashes, order, [1] * len(ids))
            if members:
                rows += [(g, *o, hashlib.sha256(c).digest()) for g, o, c in zip(groups, order, contents)]
            held += batch.nbytes
            if held >= flush_bytes:
                yield from flush(fold, rows)
                fold, rows, held = _Fold(True), [], 0
        if fold.n:
            yield from flush(fold, rows)

    return run


def _spill(df: DataFrame, buckets: int) -> DataFrame:
    spark = df.sparkSession
    name = f"grace_{uuid.uuid4().hex}"
    df.repartition(buckets, "bucket").write.bucketBy(buckets, "bucket").option("path", scratch_path(spark, "grace")).saveAsTable(name)
    return spark.table(name)


def _spill_levels(docs: DataFrame, members: bool, fit_bytes: int) -> tuple[list[DataFrame], DataFrame]:
    """The spilled tables, each with the buckets that fit, and the first of them whole (it has the member rows)."""
    spark = docs.sparkSession
    held = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(100_000, math.ceil(2 * held / fit_bytes)))
    shape = T.StructType([T.StructField(c, t) for c, t in (("bucket", T.LongType()), ("rep", T.LongType()), ("best", T.LongType()), ("best_row", T.LongType()), ("n", T.LongType()), ("h", T.LongType()), ("size", T.LongType()), ("sha", T.BinaryType()), ("whole", T.BooleanType()))] + [T.StructField(f"c_{f.name}", f.dataType) for f in docs.schema])
    arrow = docs.sparkSession.createDataFrame([], shape).toArrow().schema
    folded = docs.mapInArrow(_collapse(buckets, members, arrow, fit_bytes), shape)
    whole = level = _spill(folded, buckets)
    levels, depth = [], 0
    while True:
        sizes = level.where("whole").groupBy("bucket").agg(F.sum("size").alias("held"), (F.min("h") != F.max("h")).alias("mixed"))
        big = sizes.where((F.col("held") > fit_bytes) & F.col("mixed")).select("bucket")
        reps = level.where("whole")
        if depth == 16 or big.isEmpty():
            return [*levels, reps], whole
        levels.append(reps.join(big, "bucket", "left_anti"))
        depth += 1
        finer = F.col("bucket") * FAN_OUT + F.pmod(F.xxhash64("h", F.lit(depth)), F.lit(FAN_OUT))
        level = _spill(reps.join(big, "bucket", "left_semi").withColumn("bucket", finer).select(*reps.columns), buckets)


def _resolve(rows_out: bool, names: list[str], fit_bytes: int):
    """One bucket's representatives: rows_out gives the winners' rows, else (rep, keep_id, keep_row, group_size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, reps, groups, held = _Fold(rows_out), [], [], 0
        for b in batches:
            contents = [_normal(t) for t in b.column("c_text").to_pylist()]
            hashes = [h & ((1 << 64) - 1) for h in b.column("h").to_pylist()]
            order = list(zip(b.column("best").to_pylist(), b.column("best_row").to_pylist()))
            at = fold.add(b, contents, hashes, order, b.column("n").to_pylist())
            if rows_out:
                held += b.nbytes
                if held > 2 * fit_bytes:
                    held = fold.winners().nbytes
            else:
                reps += b.column("rep").to_pylist()
                groups += at
        if rows_out:
            if fold.n:
                yield from fold.winners().select([f"c_{n}" for n in names]).rename_columns(names).to_batches(max_chunksize=2000)
        elif reps:
            cols = [reps, [fold.best[g][0] for g in groups], [fold.best[g][1] for g in groups], [fold.n[g] for g in groups]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["rep", "keep_id", "keep_row", "group_size"])

    return run


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dedup_rows(docs: DataFrame, fit_bytes: int = FIT_BYTES) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    levels, _ = _spill_levels(docs, False, fit_bytes)
    run = _resolve(True, docs.columns, fit_bytes)
    return _union([x.groupBy("bucket").applyInArrow(run, docs.schema) for x in levels])


def dedup_groups(docs: DataFrame, fit_bytes: int = FIT_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    levels, whole = _spill_levels(docs.select("doc_id", "text"), True, fit_bytes)
    run = _resolve(False, [], fit_bytes)
    found = _union([x.groupBy("bucket").applyInArrow(run, "rep long, keep_id long, keep_row long, group_size long") for x in levels])
    members = whole.where(~F.col("whole")).select("rep", "best", "best_row", "sha")
    id_of = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return members.join(stage(found, "groups"), "rep").select(
        id_of("best").alias("doc_id"),
        id_of("keep_id").alias("keep_id"),
        "group_size",
        (F.col("best_row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_groups(documents(spark, sf_dir))


OP9_SQL = """
with t as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as body from documents)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, sha256(body) as text_sha256
from t window w as (partition by body)
"""
