"""Operators on records: guards, partners, positional pairs, step histograms, running totals, merges and declared orders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalloom.operators import constraints, ranged


def not_binary(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """Rows whose value is not strictly 0 or 1 (null, NaN and fractions included)."""
    return df.select(*key, value).where(~F.coalesce(F.col(value).isin(0, 1), F.lit(False)))


def partner(df: DataFrame, other: DataFrame, key: list[str], columns: list[str], prefix: str = "partner_") -> DataFrame:
    """Each row with columns of the row of the other condition that has its key; null where there is none.

    The other condition must hold a key once at most, else rows would multiply: that is an error.
    """
    constraints.require(constraints.duplicate_keys(other, key), "one partner for each key")
    return df.join(other.select(*key, *[F.col(c).alias(prefix + c) for c in columns]), key, "left")


def zipped(a: Column, b: Column) -> Column:
    """Pairs of two arrays by position; arrays of unequal length are an error, a null array gives null."""
    pairs = F.arrays_zip(a.alias("first"), b.alias("second"))
    fine = a.isNull() | b.isNull() | (F.size(a) == F.size(b))
    return F.when(fine, pairs).otherwise(F.raise_error(F.lit("sequences of unequal length")).cast("array<struct<first:string,second:string>>"))


def detected(targets: Column, missing: Column, extra: Column) -> Column:
    """The set that a detector reported: targets without the missed ones, and what it found beside them."""
    return F.array_sort(F.array_union(F.array_except(targets, missing), extra))


def greatest_cell(df: DataFrame, by: list[str], cell: list[str], hit: Column) -> DataFrame:
    """Of each group's cells the greatest number of hits, and the percent of the cell's rows that it is; ties take the greatest percent."""
    cells = df.groupBy(*by, *cell).agg(F.count_if(hit).alias("count"), F.count("*").alias("_n"))
    best = F.max(F.struct("count", (F.col("count") * 100.0 / F.col("_n")).alias("percent"))).alias("_b")
    return cells.groupBy(*by).agg(best).select(*by, "_b.count", "_b.percent")


def repeat_deviation(df: DataFrame, by: str, repeat: str, value: str, reference: str) -> DataFrame:
    """Percent difference of each condition from the reference of the same repeat: least, greatest and greatest absolute.

    ``df`` has one value for each (condition, repeat); a repeat that the reference lacks gives nothing.
    """
    ref = df.where(F.col(by) == reference).select(repeat, F.col(value).alias("_ref"))
    d = (F.col(value) - F.col("_ref")) * 100.0 / F.col("_ref")
    got = df.where(F.col(by) != reference).join(ref, repeat).withColumn("_d", d)
    return got.groupBy(by).agg(F.min("_d").alias("low"), F.max("_d").alias("high"), F.max(F.abs("_d")).alias("most"))


def step_histogram(df: DataFrame, by: list[str], step: str) -> DataFrame:
    """How often each step is selected, and whether it is its group's usual one (most frequent, then least)."""
    n = df.groupBy(*by, step).agg(F.count("*").alias("n"))
    usual = n.groupBy(*by).agg(F.max_by(step, F.struct(F.col("n"), -F.col(step))).alias("_usual"), F.count("*").alias("_k"))
    return n.join(usual, by).select(*by, step, "n", (F.col(step) == F.col("_usual")).alias("usual"), (F.col("_k") == 2).alias("one_alternate"))


def running_totals(df: DataFrame, by: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Adds ``total_`` columns: sums of a group's values up to and with each row. Groups may be of any size."""
    return ranged.running(ranged.ranged(df, by, order), by, values).drop("_part", "_row")


def disjoint_union(frames: list[DataFrame], key: list[str]) -> DataFrame:
    """All rows of result tables; a key that occurs twice is an error."""
    out = reduce(DataFrame.unionByName, frames)
    constraints.require(constraints.duplicate_keys(out, key), "keys of merged results are disjoint")
    return out


def merged_by_place(nodes: Column, comments: Column) -> Column:
    """Texts of two arrays of (at, text), in order of place; a comment comes before the node at its place."""
    tag = lambda x, late: F.transform(x, lambda e, i: F.struct(e["at"].alias("at"), F.lit(late).alias("late"), i.alias("i"), e["text"].alias("text")))
    return F.transform(F.array_sort(F.concat(tag(comments, 0), tag(nodes, 1))), lambda e: e["text"])


def named(df: DataFrame, key: str, names: dict[str, str], ordinal: str = "ordinal") -> DataFrame:
    """Adds ``name``, the short name of the key, and its place in the declared order; an unknown key is an error."""
    pairs = lambda of: F.create_map(*[F.lit(x) for kv in of for x in kv])
    unknown = F.raise_error(F.concat(F.lit("no declared name: "), F.coalesce(F.col(key), F.lit("null"))))
    name = F.coalesce(F.try_element_at(pairs(names.items()), F.col(key)), unknown.cast("string"))
    place = F.try_element_at(pairs((k, i) for i, k in enumerate(names)), F.col(key))
    return df.withColumn("name", name).withColumn(ordinal, place.cast("long"))


def drawn(n: int, seed: int, index: Column) -> Column:
    """A draw with replacement: for each index a place from 0 to n - 1, by a digest of seed and index."""
    word = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), index.cast("string"))), 1, 12), 16, 10).cast("long")
    return word % n
