"""Repeated-run statistics, two exact percentile families, crosstabs, margins, ratios and rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.operators.labels import ratio
from evalloom.operators.order import running_total


def rate(df: DataFrame, by: list[str], predicate: Column, out: str = "rate") -> DataFrame:
    """Share of rows that satisfy a predicate."""
    return df.groupBy(*by).agg(F.avg(predicate.cast("double")).alias(out))


def repeat_mean_sd(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and sample deviation over repeats; no deviation from one repeat."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"))


def _at_ranks(df: DataFrame, by: list[str], value: str, weight: Column, ranks: dict[str, Column]) -> DataFrame:
    """Values at 1-based ranks (functions of the total ``n``) of weighted rows: distinct values first, then prefix sums."""
    cells = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.sum(weight).cast("long").alias("k")).where("k > 0")
    run = running_total(cells, by, value, F.col("k"), "upto")
    n = cells.groupBy(*by).agg(F.sum("k").alias("n"), F.max(value).alias("max"))
    joined = run.join(n, by) if by else run.crossJoin(n)
    picks = [F.min(F.when(F.col("upto") >= r, F.col(value))).alias(name) for name, r in ranks.items()]
    return joined.groupBy(*by).agg(*picks, F.any_value("max").alias("max"), F.any_value("n").alias("n"))


def nearest_rank(df: DataFrame, by: list[str], value: str, percents: tuple = (50, 90, 95, 99), weight: Column | None = None) -> DataFrame:
    """Percentiles at rank ceil(p/100 * n), with row multiplicities if ``weight`` is given."""
    n = F.col("n")
    ranks = {f"p{p}": F.greatest(F.lit(1), F.ceil(n * p / F.lit(100.0))) for p in percents}
    return _at_ranks(df, by, value, F.lit(1) if weight is None else weight, ranks)


def nearest_index(df: DataFrame, by: list[str], value: str, percents: tuple = (50, 90, 95, 99)) -> DataFrame:
    """Percentiles at index rint(p * (n - 1)), halves to even."""
    n = F.col("n")
    return _at_ranks(df, by, value, F.lit(1), {f"p{p}": F.rint(F.lit(p / 100.0) * (n - 1)) + 1 for p in percents})


def crosstab(df: DataFrame, by: list[str], column: str, values: list[str]) -> DataFrame:
    """Counts of each value as columns, absent ones as 0."""
    return df.groupBy(*by).pivot(column, values).count().na.fill(0, values)


def margins(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts by two columns with both margins and the grand total (nulls stand for "all")."""
    return df.cube(a, b).agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def wide_conditional(df: DataFrame, by: list[str], predicates: dict[str, Column], kind: str = "count") -> DataFrame:
    """Counts, or shares, of many predicates in one pass, one row each."""
    one = F.count_if if kind == "count" else lambda p: F.avg(p.cast("double"))
    wide = df.groupBy(*by).agg(*[one(p).alias(k) for k, p in predicates.items()])
    return wide.unpivot([*map(F.col, by)], list(predicates), "component", "value")


def count_of_counts(df: DataFrame, key: str) -> DataFrame:
    """How many keys have each number of rows."""
    return df.groupBy(key).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("keys"))


def group_range(df: DataFrame, by: list[str], group: list[str], value: Column) -> DataFrame:
    """Least and greatest group mean, and their difference."""
    means = df.groupBy(*by, *group).agg(F.avg(value).alias("m"))
    return means.groupBy(*by).agg(F.min("m").alias("low"), F.max("m").alias("high"), (F.max("m") - F.min("m")).alias("span"))


def mean_of_means(df: DataFrame, by: list[str], inner: list[str], value: Column) -> DataFrame:
    return df.groupBy(*by, *inner).agg(F.avg(value).alias("m")).groupBy(*by).agg(F.avg("m").alias("mean"))


def ratio_to_baseline(df: DataFrame, by: str, value: str, baseline) -> DataFrame:
    """Percent by which each group's mean exceeds the baseline group's."""
    means = df.groupBy(by).agg(F.avg(value).alias("mean"))
    base = means.where(F.col(by) == F.lit(baseline)).select(F.col("mean").alias("base"))
    return means.crossJoin(F.broadcast(base)).select(by, "mean", ((F.col("mean") / F.col("base") - 1) * 100).alias("over_percent"))


def seed_variation(df: DataFrame, by: list[str], repeat: str, value: str, baseline) -> DataFrame:
    """Largest percent deviation of a repeat from the baseline repeat, rounded up to a tenth."""
    base = F.max(F.when(F.col(repeat) == F.lit(baseline), F.col(value)))
    one = df.groupBy(*by).agg(base.alias("base"), F.max(value).alias("hi"), F.min(value).alias("lo"))
    most = F.greatest(F.abs(F.col("hi") - F.col("base")), F.abs(F.col("lo") - F.col("base"))) / F.col("base") * 100
    return one.select(*by, (F.ceil(most * 10) / 10).alias("variation_percent"))


def shares(df: DataFrame, by: list[str], part: str, value: str) -> DataFrame:
    """Each part's mean as a share of the sum of the parts' means."""
    means = df.groupBy(*by, part).agg(F.avg(value).alias("mean"))
    total = means.groupBy(*by).agg(F.sum("mean").alias("total"))
    return means.join(total, by).select(*by, part, "mean", ratio(F.col("mean"), F.col("total")).alias("share"))


def over_repeats(df: DataFrame, unit: list[str], outcome: Column, least: int = 2) -> DataFrame:
    """Whether all, any, or at least so many repeats of a unit succeed."""
    return df.groupBy(*unit).agg(F.bool_and(outcome).alias("all"), F.bool_or(outcome).alias("any"), (F.count_if(outcome) >= least).alias("at_least"))


def first_best(df: DataFrame, by: list[str], step: str, score: str) -> DataFrame:
    """The earliest step of the greatest score."""
    return df.groupBy(*by).agg(F.max_by(step, F.struct(F.col(score), -F.col(step))).alias("best_step"), F.max(score).alias("best_score"))


def budget_guard(df: DataFrame, name: str, tokens: str, reference: str, tolerance: float = 0.05) -> DataFrame:
    """Relative difference of each condition's tokens from the reference's, and whether it exceeds the tolerance."""
    ref = df.where(F.col(name) == reference).select(F.col(tokens).alias("_ref"))
    delta = (F.col(tokens) - F.col("_ref")) / F.col("_ref")
    return df.crossJoin(F.broadcast(ref)).select(name, tokens, delta.alias("delta"), (F.abs(delta) > tolerance).alias("exceeds"))


def two_significant(v: Column) -> Column:
    """Rounds to two significant digits, halves to even."""
    scale = F.pow(F.lit(10.0), F.floor(F.log10(v)) - 1)
    return F.rint(v / scale) * scale


def close(a: Column, b: Column, rel: float = 1e-9, abs_: float = 0.0) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(rel) * F.greatest(F.abs(a), F.abs(b)), F.lit(abs_))
