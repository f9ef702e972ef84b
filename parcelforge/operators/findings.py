"""Window patterns that several rules share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What a finding of full confidence takes off the integrity score.
SEVERITY_PENALTY = {"info": 0.0, "warning": 0.04, "error": 0.15, "critical": 0.40}


def out_of_sequence(rows: DataFrame, group: str, order: Sequence[str], date: str) -> DataFrame:
    """Rows dated before the dated row just before them in register order; ``previous`` is its date."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.filter(F.col(date).isNotNull()).withColumn("previous", F.lag(date).over(w)).filter(F.col(date) < F.col("previous"))


def repeats(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Every row after the first of its key, with its number ``nth``."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("nth > 1")
