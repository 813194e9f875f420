"""Multi-label classification metrics over array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered(labels: Column | str, classes: list[str]) -> Column:
    """Known labels, once each, in the order of ``classes``."""
    return F.array_intersect(F.array(*map(F.lit, classes)), labels)


def same_set(a: Column | str, b: Column | str) -> Column:
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def exact_match(df: DataFrame, pred: str, gold: str, by: list[str]) -> DataFrame:
    """Share of rows whose label sets are equal."""
    return df.groupBy(*by).agg(F.avg(same_set(pred, gold).cast("double")).alias("exact_match"))


def per_class_prf(df: DataFrame, pred: str, gold: str, classes: list[str], by: list[str]) -> DataFrame:
    """Precision, recall and F1 of every class in every group: one pass, one count triple a class, then unpivoted."""
    has = lambda c, k: F.array_contains(c, k)
    counts = []
    for i, k in enumerate(classes):
        counts += [F.count_if(has(pred, k) & has(gold, k)).alias(f"tp{i}"), F.count_if(has(pred, k) & ~has(gold, k)).alias(f"fp{i}"), F.count_if(~has(pred, k) & has(gold, k)).alias(f"fn{i}")]
    wide = df.groupBy(*by).agg(*counts)
    long = wide.select(*by, F.inline(F.array(*[F.struct(F.lit(k).alias("class"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"), F.col(f"fn{i}").alias("fn")) for i, k in enumerate(classes)])))
    long = long.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return long.withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def macro_f1(df: DataFrame, pred: str, gold: str, classes: list[str], by: list[str]) -> DataFrame:
    """Mean F1 over all classes, those without support included."""
    return per_class_prf(df, pred, gold, classes, by).groupBy(*by).agg(F.avg("f1").alias("macro_f1"))


def micro_f1(df: DataFrame, pred: str, gold: str, classes: list[str], by: list[str]) -> DataFrame:
    """F1 of label counts pooled over rows, known classes only."""
    known = F.array(*map(F.lit, classes))
    p, g = F.array_intersect(known, F.col(pred)), F.array_intersect(known, F.col(gold))
    sums = df.groupBy(*by).agg(F.sum(F.size(F.array_intersect(p, g))).alias("tp"), F.sum(F.size(p)).alias("np"), F.sum(F.size(g)).alias("ng"))
    return sums.select(*by, _f1(ratio(F.col("tp"), F.col("np")), ratio(F.col("tp"), F.col("ng"))).alias("micro_f1"))


def headline(df: DataFrame, pred: str, gold: str, classes: list[str], by: list[str]) -> DataFrame:
    """Exact match, micro-F1 and macro-F1 of each group."""
    out = exact_match(df, pred, gold, by)
    for other in (micro_f1(df, pred, gold, classes, by), macro_f1(df, pred, gold, classes, by)):
        out = out.join(other, by) if by else out.crossJoin(other)
    return out
