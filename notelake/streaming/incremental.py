"""New files as a stream: notes are imported as they arrive, each note once, however old the file is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from notelake.functions import columns as C
from notelake.operators import package as P
from notelake.scratch import staged
from notelake.sources import files as S
from notelake.sources.formats import import_notes


def text_files(spark: SparkSession, root: str, per_trigger: int = 1000) -> DataFrame:
    """A stream of (path, text): whole files, at most per_trigger in a batch.

    By default the source passes over files that are 7 days older than the newest one it has seen; maxFileAge ends that.
    """
    rows = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", per_trigger).option("maxFileAge", "36500d").option("recursiveFileLookup", True).load(root)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("seen"), F.col("value").alias("text"))


def notes_once(files: DataFrame) -> DataFrame:
    """Notes of text files with the hash of the whole note, title and text, by which write() takes each note once."""
    notes = files.select("path", "seen", C.stem(F.col("path")).alias("title"), C.text_to_html(F.col("text")).alias("html"))
    return notes.withColumn("hash", F.md5(F.concat_ws("\n", "title", "html")))


def _written(spark: SparkSession, target: str) -> DataFrame | None:
    """The hashes of the table; None where there is none yet."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(jvm.org.apache.hadoop.fs.Path(path, "_spark_metadata")):
        raise ValueError(f"{target} was written by a file sink, whose log hides rows appended by other means: copy it to a new table and use a new checkpoint")
    return spark.read.schema("hash string").parquet(target) if fs.exists(path) else None


def write(notes: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append to a Parquet table what it does not hold yet, and end when the present files are done.

    Of equal contents in a batch the first path counts; contents in the table are left out by an anti-join, so a batch
    that is run again adds nothing twice. One query at a time may write to a table.
    """

    def append(batch: DataFrame, _: int) -> None:
        new, held = P.dedup_first(batch, ["hash"], "path"), _written(batch.sparkSession, target)
        if held is not None:
            new = new.join(held, "hash", "left_anti")
        new.select(*batch.columns).write.mode("append").parquet(target)

    _written(notes.sparkSession, target)
    return notes.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def binary_files(spark: SparkSession, root: str, per_trigger: int = 1000) -> DataFrame:
    """A stream of FILE rows: any format, archives as they are (they are opened in the batch) (ST1)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    rows = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", per_trigger).option("maxFileAge", "36500d").option("recursiveFileLookup", True).load(root)
    return S.file_rows(rows)


#: Hexadecimal digits of a package path that name its partition.
PREFIX = 2


def _partition(path: Column) -> Column:
    return F.substring(path, 1, PREFIX)


def package_batch(files: DataFrame, formats: list[str]) -> DataFrame:
    """(path, data, prefix): the package files of the notes that the formats find in the files; archives are opened."""
    result = import_notes(S.expand(files)[0], formats)
    notes = result.notes
    if result.attachments is not None:
        hashes = result.attachments.groupBy("src_path").agg(F.array_sort(F.collect_set("hash")).alias("hashes"))
        notes = notes.join(hashes, "src_path", "left")
    else:
        notes = notes.withColumn("hashes", F.array().cast("array<string>"))
    # where a note lay is no part of it: the same note from two files is one
    rows = notes.select(F.col("src_path").alias("src_ord"), F.struct(*[c for c in result.notes.columns if c != "src_path"], F.coalesce("hashes", F.array().cast("array<string>")).alias("attachments")).alias("note"), F.coalesce("hashes", F.array().cast("array<string>")).alias("hashes"))
    return P.package(rows, result.blobs).withColumn("prefix", _partition(F.col("path")))


def write_package(files: DataFrame, formats: list[str], target: str, checkpoint: str) -> StreamingQuery:
    """Import a stream of FILE rows into a package table (path, data), partitioned by the first digits of the path (ST2, K3, K4).

    A batch leaves out, by an anti-join on the path, what the table holds: it reads the paths (not the data) of the
    partitions that its own paths are in, and a batch that is run again adds nothing. A note is taken with the files of its
    own batch: files that belong together have to come in one archive or in one batch. One query at a time may write.
    """

    def append(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = staged(package_batch(batch, formats), "batch")
        if _exists(spark, target):
            met = [r.prefix for r in new.select("prefix").distinct().collect()]  # at most 16 ** PREFIX
            held = spark.read.schema("path string, data binary, prefix string").parquet(target).where(F.col("prefix").isin(met)).select("prefix", "path")
            new = new.join(held, ["prefix", "path"], "left_anti")
        new.select("path", "data", "prefix").write.mode("append").partitionBy("prefix").parquet(target)

    return files.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark: SparkSession, target: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def progress(notes: DataFrame, source: str = "source") -> DataFrame:
    """The running number of notes of each source, for an update-mode query (ST3)."""
    return notes.groupBy(source).agg(F.count("*").alias("notes"))
