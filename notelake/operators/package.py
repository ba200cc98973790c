"""Notes as a package of files named by content: <hash>/note.json and <hash>/attachments/<hash>."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

COMPATIBILITY_VERSION = 2


def hash_column(c: Column, name: str = "md5") -> Column:
    if name == "md5":
        return F.md5(c.cast("binary"))
    if name == "sha256":
        return F.sha2(c.cast("binary"), 256)
    if name == "xxhash64":
        return F.lower(F.hex(F.xxhash64(c)))
    raise ValueError(f"no hash {name}")


def stamp(notes: DataFrame, source: str) -> DataFrame:
    return notes.withColumns({"compatibility_version": F.lit(COMPATIBILITY_VERSION), "source": F.lit(source)})


def dedup_first(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of the rows of each key the first in order; unlike dropDuplicates it is the same one every time."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("__r")).select(*keys, "__r.*")


def package(notes: DataFrame, blobs: DataFrame | None = None) -> DataFrame:
    """(path, data), each path once: notes with a struct column `note` and an array `hashes` of attachments; blobs (hash, data).

    A path is named by what it holds, so rows with one path are equal: which notes have which attachments is decided on
    hashes alone, and the data are joined to the result.
    """
    folded = notes.select(F.to_json("note").alias("json"), "hashes").withColumn("md5", hash_column(F.col("json")))
    files = folded.select("md5", "json").dropDuplicates(["md5"]).select(F.concat("md5", F.lit("/note.json")).alias("path"), F.col("json").cast("binary").alias("data"))
    if blobs is not None:
        held = folded.select("md5", F.explode("hashes").alias("hash")).distinct().join(blobs.select("hash", "data").dropDuplicates(["hash"]), "hash")
        files = files.unionByName(held.select(F.concat("md5", F.lit("/attachments/"), F.col("hash")).alias("path"), "data"))
    return files


def page(rows: DataFrame, order: str, start: int, length: int) -> DataFrame:
    """Rows start+1 .. start+length of the order, counted without sorting all rows in one task.

    Rows are counted in ranges of the order; only the ranges that the page meets are numbered.
    """
    cuts = rows.agg(F.percentile_approx(order, [i / 200 for i in range(1, 200)], 10_000)).first()[0] or []
    block = F.size(F.filter(F.lit(sorted(set(cuts))), lambda c: c < F.col(order))) if cuts else F.lit(0)
    x = rows.withColumn("__b", block)
    sizes = x.groupBy("__b").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__at", F.coalesce(F.sum("__n").over(W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    met = before.where((F.col("__at") < start + length) & (F.col("__at") + F.col("__n") > start)).select("__b", "__at")
    n = F.row_number().over(W.partitionBy("__b").orderBy(order)) + F.col("__at")
    return x.join(F.broadcast(met), "__b").withColumn("ordinal", n).where((F.col("ordinal") > start) & (F.col("ordinal") <= start + length)).drop("__b", "__at")
