"""How an import runs: options of formats, and metrics that are observed while it runs."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


@dataclass
class Settings:
    """options: {format: {parameter of its importer: value}}, as {"colornote": {"passwords": table}}.

    notes, errors: observations of the import's two tables (K6). Each is filled by the first action on its table, with
    `rows` and, for notes, the rows of each format under its name: counts without a job of their own.
    Before that action, reading an observation waits.
    """

    options: dict[str, dict[str, Any]] = field(default_factory=dict)
    notes: Observation | None = None
    errors: Observation | None = None


def observed(rows: DataFrame, observation: Observation | None, **counted: Column) -> DataFrame:
    """rows with an observation of their number, and of the number of those for which each condition holds."""
    if observation is None:
        return rows
    return rows.observe(observation, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(name) for name, c in counted.items()])
