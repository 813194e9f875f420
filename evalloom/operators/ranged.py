"""One global order cut into ranges: positions, running sums and runs without a window over a whole group.

``ranged`` sorts a table by range partitions and saves it with each row's range and place. Everything else works on one
range at a time (about ``ROWS`` rows, whatever the groups are) and on summaries of a few rows a range, whose prefix sums
carry over from range to range. The order should be unique: rows that are equal in all of it share a range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalloom.sources.landing import landed

#: Rows of a range.
ROWS = 1 << 18


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality of keys."""
    return reduce(Column.__and__, [left[k].eqNullSafe(right[k]) for k in keys], F.lit(True))


def joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys that may be null; the right side's keys are dropped."""
    other = right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    on = reduce(Column.__and__, [left[k].eqNullSafe(other[f"_k{i}"]) for i, k in enumerate(keys)])
    return left.join(other, on).drop(*[f"_k{i}" for i in range(len(keys))])


def ranged(df: DataFrame, by: list[str], order: list[str], rows: int | None = None) -> DataFrame:
    """The table, saved in the order of ``by`` and ``order``, with ``_part`` (range) and ``_row`` (place in it, from 0)."""
    parts = max(1, -(-df.count() // (rows or ROWS)))
    keys = [*by, *order]
    placed = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys) if parts > 1 else df.coalesce(1).sortWithinPartitions(*keys)
    mono = F.monotonically_increasing_id()
    return landed(placed.withColumn("_part", F.shiftright(mono, 33).cast("int")).withColumn("_row", mono.bitwiseAND(F.lit((1 << 33) - 1))), "ranged")


def _before(sums: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Sums of the ranges before, by group: a window over one row a range."""
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*by, "_part", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"_before_{c}") for c in columns])


def numbered(ordered: DataFrame, by: list[str], out: str = "_at") -> DataFrame:
    """Adds 0-based positions within each group to a ``ranged`` table."""
    held = ordered.groupBy(*by, "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    start = joined(held, _before(held, by, ["_n"]), [*by, "_part"]).select(*by, "_part", (F.col("_before__n") - F.col("_first")).alias("_shift"))
    return joined(ordered, start, [*by, "_part"]).withColumn(out, F.col("_row") + F.col("_shift")).drop("_shift")


def running(ordered: DataFrame, by: list[str], values: list[str], prefix: str = "total_") -> DataFrame:
    """Adds the inclusive running sums of values within each group to a ``ranged`` table."""
    w = Window.partitionBy("_part", *by).orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    sums = ordered.groupBy(*by, "_part").agg(*[F.sum(v).alias(v) for v in values])
    before = _before(sums, by, values)
    inner = ordered.select("*", *[F.sum(v).over(w).alias(f"_inner_{v}") for v in values])
    got = joined(inner, before, [*by, "_part"])
    for v in values:
        # a group without any value has no total, as in a plain window
        got = got.withColumn(f"{prefix}{v}", F.when(F.col(f"_inner_{v}").isNull() & (F.col(f"_before_{v}") == 0), None).otherwise(F.coalesce(f"_inner_{v}", F.lit(0)) + F.col(f"_before_{v}")))
    return got.drop(*[f"_inner_{v}" for v in values], *[f"_before_{v}" for v in values])


def runs(ordered: DataFrame, by: list[str], key: list[str]) -> DataFrame:
    """Maximal runs of rows with equal keys within each group of a ``ranged`` table: ``(*by, *key, first_pos, run_length)``, positions from 1."""
    cell = F.struct(*[F.col(c) for c in (*by, *key)])
    rows = ordered.select("_part", "_row", *by, *key, cell.alias("_cell"))
    # the last row of the range before stands in for the row before a range's first
    ends = rows.groupBy("_part").agg(F.max_by("_cell", "_row").alias("_end"))
    ends = ends.select("_part", F.lag("_end").over(Window.partitionBy(F.lit(0)).orderBy("_part")).alias("_end"))
    w = Window.partitionBy("_part").orderBy("_row")
    last = F.when(F.col("_row") == 0, F.col("_end")).otherwise(F.lag("_cell").over(w))
    marked = joined(rows, ends, ["_part"]).withColumn("_starts", (~F.col("_cell").eqNullSafe(last)).cast("long"))
    marked = marked.withColumn("_one", F.lit(1).cast("long"))
    sums = marked.groupBy("_part").agg(F.sum("_starts").alias("_starts"), F.sum("_one").alias("_one"))
    inner = marked.withColumn("_run", F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inner = joined(inner, _before(sums, [], ["_starts", "_one"]), ["_part"])
    inner = inner.select(*by, *key, (F.col("_run") + F.col("_before__starts")).alias("_run"), (F.col("_row") + F.col("_before__one")).alias("_place"))
    found = inner.groupBy("_run", *by, *key).agg(F.min("_place").alias("_place"), F.count("*").alias("run_length"))
    first = inner.groupBy(*by).agg(F.min("_place").alias("_first"))
    found = joined(found, first, by) if by else found.crossJoin(first)  # one row
    return found.select(*by, *key, (F.col("_place") - F.col("_first") + 1).alias("first_pos"), "run_length")
