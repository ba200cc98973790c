"""A corpus from raw documents to packed training sequences: five operators, each on all that the one before kept."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm.common import stage
from notelake.llm.exact_dedup import dedup_rows
from notelake.llm.mixing import ROW, mix, token_counts, with_row_key
from notelake.llm.near_dedup import near_duplicates
from notelake.llm.packing import pack, token_pieces
from notelake.llm.quality import ACCEPT, score_quality, train_quality
from notelake.session import ship

#: Tokens of the mixture over tokens there are. Leaves of small weight get less than one epoch (README: at sf0.1, 20 of 80): what they do not give is left out.
MIXTURE = 1.5


#: The columns that stages read.
READ = ("doc_id", "text", "lang", "source")

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _apart(docs: DataFrame) -> DataFrame:
    """docs with the columns that no stage reads renamed by their place, so that none clashes with a column of a stage's own."""
    return docs.toDF(*[c if c in READ else f"carried_{i}" for i, c in enumerate(docs.columns)])


def _carries_columns(stage_: Stage) -> Stage:
    """A stage that selects among rows, with all columns of its input under their own names."""

    @functools.wraps(stage_)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        inner = _apart(docs)
        return stage_(spark, inner, sf_dir).select(*inner.columns).toDF(*docs.columns)

    return run


@_carries_columns
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; those without labels are scored like all others.

    Null and empty texts are scored too; rows with null or repeated ids each by its own text; no column is changed.
    """
    ship(spark)
    trees = train_quality(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, trees).where(F.col("score") >= ACCEPT)


@_carries_columns
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest doc_id.

    A null text equals the empty one; of rows without an id, or with one id, one stays.
    """
    return dedup_rows(docs)


@_carries_columns
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts that share 0.8 of their five-word shingles: the one with the smallest doc_id.

    Rows without words or without an id stay; rows of one id are one document and stay or go together.
    """
    gone = near_duplicates(docs).where(~F.col("kept")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti")


@_carries_columns
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them: a row for each epoch.

    Each row counts by itself, whatever its id; a document without words comes in whole epochs only.
    """
    rows = with_row_key(docs)
    taken = mix(token_counts(rows), F.floor(F.col("total") * MIXTURE)).groupBy(ROW).agg(F.count("*").cast("int").alias("times"))
    joined = rows.join(taken.hint("shuffle_hash"), ROW)
    return joined.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("times"))))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences; the column row tells copies of one document apart. A null text is its separator."""
    return pack(token_pieces(_apart(docs)))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("MinHash near-dedup", near),
    ("mixing sources", mixture),
    ("best-fit packing", packing),
]

#: Trained trees have no SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stage(docs, f"stage{i}")
    return docs
