"""Scratch tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode, where it is unset, a folder of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="notelake-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def discard(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """df as a table of the shared folder: several branches read it, none makes it again."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Rounds:
    """The tables of an iteration: each round's is written and read back, and the one before the last is deleted."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.name, self.held = spark, name, []

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{shared_dir(self.spark)}/{self.name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.held.append(path)
        if len(self.held) > 2:
            discard(self.spark, self.held.pop(0))
        return self.spark.read.schema(df.schema).parquet(path)
