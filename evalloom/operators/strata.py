"""Overlapping strata: each row is in one bin of every family."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stratify(df: DataFrame, bins: dict[str, Column]) -> DataFrame:
    """One row for each stratum that a row is in."""
    keys = F.array_compact(F.array(*[F.when(p, F.lit(k)) for k, p in bins.items()]))
    return df.withColumn("stratum", F.explode(keys))
