"""Global order without a global sort in one task: positions and running sums of any weight, over ranges of one order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.operators import ranged


def _ordered(df: DataFrame, by: list[str], value: str, ties: list[Column]) -> DataFrame:
    """Ranges of the order of ``value`` and ``ties``; equal rows follow a number of their own, so one value may fill many ranges."""
    rows = df.withColumns({f"_t{i}": t for i, t in enumerate(ties)}).withColumn("_id", F.monotonically_increasing_id())
    keys = [value, *[f"_t{i}" for i in range(len(ties))], "_id"]
    return ranged.ranged(rows, by, keys).drop(*keys[1:])


def running_total(df: DataFrame, by: list[str], value: str, weight: Column, out: str, ties: list[Column] | None = None) -> DataFrame:
    """Adds the inclusive running sum of ``weight`` in the order of ``value`` (then ``ties``) within each group."""
    rows = _ordered(df.withColumn(out, weight), by, value, ties or [])
    return ranged.running(rows, by, [out], prefix="_total_").drop(out, "_part", "_row").withColumnRenamed(f"_total_{out}", out)


def positions(df: DataFrame, value: str, ties: list[Column], out: str = "pos") -> DataFrame:
    """Adds 0-based positions in the order of ``value`` and ``ties``, over the whole table."""
    return ranged.numbered(_ordered(df, [], value, ties), [], out).drop("_part", "_row")
