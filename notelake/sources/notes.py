"""Rows of notes and errors that every format shares."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.operators.package import stamp

NOTE = ["src_path", "title", "date_created", "date_edited", "html", "tags", "pinned", "favorite", "archived", "color", "notebooks", "reminder"]
KINDS = {"tags": "array<string>", "notebooks": "array<array<string>>", "pinned": "boolean", "favorite": "boolean", "archived": "boolean", "date_created": "bigint", "date_edited": "bigint", "reminder": "struct<title: string, description: string, date: bigint, mode: string, recurring_mode: string, selected_days: array<int>>"}


@dataclass
class ImportResult:
    """notes, errors and, of formats with attachments: attachments (src_path, pos, hash, ...) and blobs (hash, data)."""

    notes: DataFrame
    errors: DataFrame
    attachments: DataFrame | None = None
    blobs: DataFrame | None = None


def split_required(rows: DataFrame, required: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(good rows, error rows with a message): required maps a column to what is said where it is null."""
    message = F.concat_ws("; ", *[F.when(F.col(c).isNull(), F.lit(m)) for c, m in required.items()])
    x = rows.withColumn("message", message)
    return x.where(F.col("message") == "").drop("message"), x.where(F.col("message") != "")


def live_records(rows: DataFrame) -> DataFrame:
    """Records that are notes: no settings (256) or folders (128), not encrypted, neither deleted nor archived away (16, 32).

    A null type or state is none of these; only 0 is not encrypted.
    """
    none = lambda c, *codes: ~F.coalesce(F.col(c).isin(*codes), F.lit(False))
    return rows.where(none("type", 256, 128) & F.col("encrypted").eqNullSafe(F.lit(0)) & none("active_state", 16, 32))


def note_rows(rows: DataFrame, source: str, **columns: Column) -> DataFrame:
    """NOTE rows with the given columns, the others null, and the stamp of their source (K1)."""
    return stamp(rows.select(*[columns.get(c, F.lit(None)).cast(KINDS.get(c, "string")).alias(c) for c in NOTE]), source)
