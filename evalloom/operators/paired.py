"""Paired contrasts on (unit, repeat) grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def complete_units(df: DataFrame, unit: str, dims: list[str], cells: int) -> DataFrame:
    """Units that have all cells of the grid, one row for each (unit, dims) with the mean outcome."""
    grid = df.groupBy(unit, *dims).agg(F.avg("outcome").alias("outcome"))
    full = grid.groupBy(unit).agg(F.count("*").alias("n")).where(F.col("n") == cells).select(unit)
    return grid.join(full, unit, "left_semi")


def paired_grid(df: DataFrame, unit: str, repeat: str, condition: str, conditions: list[str], value: str) -> DataFrame:
    """One row for each (unit, repeat) with a column for each condition: one shuffle instead of a self-join."""
    picks = [F.max(F.when(F.col(condition) == c, F.col(value))).alias(c) for c in conditions]
    return df.groupBy(unit, repeat).agg(*picks)


def unit_differences(grid: DataFrame, unit: str, a: str, b: str) -> DataFrame:
    """Mean over repeats of a - b for each unit."""
    return grid.groupBy(unit).agg(F.avg(F.col(a) - F.col(b)).alias("difference"))


def contrast(differences: DataFrame) -> DataFrame:
    return differences.agg(F.avg("difference").alias("point"), F.count("*").alias("n_units"))


def transition(grid: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of both, neither, gained and lost from a to b (0/1 columns), net gain and its percent."""
    x, y = F.col(a) > 0, F.col(b) > 0
    out = grid.agg(F.count_if(x & y).alias("both"), F.count_if(~x & ~y).alias("neither"), F.count_if(~x & y).alias("gained"), F.count_if(x & ~y).alias("lost"), F.count("*").alias("n"))
    return out.withColumn("net", F.col("gained") - F.col("lost")).withColumn("net_percent", F.try_divide(F.col("net") * 100.0, F.col("n")))


def discordance(grid: DataFrame, repeat: str, a: str, b: str) -> DataFrame:
    """Share of unequal outcomes by repeat, its least and greatest."""
    by = grid.groupBy(repeat).agg(F.avg((F.col(a) != F.col(b)).cast("double")).alias("d"))
    return by.agg(F.min("d").alias("low"), F.max("d").alias("high"), F.count("*").alias("repeats"))


def difference_in_differences(first: DataFrame, second: DataFrame, unit: str) -> DataFrame:
    """Unit differences of one outcome less those of another."""
    other = second.withColumnRenamed("difference", "_other")
    return first.join(other, unit).select(unit, (F.col("difference") - F.col("_other")).alias("difference"))
