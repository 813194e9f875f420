"""Scatter, process, restore: rows packed into batches, handed whole to a function, brought back in their order.

Rows are packed within groups (what a batch may not mix, such as generation caps) by length: batches of ``size`` rows, or
greedy ones under a cap. The function sees one batch at a time, on executors. What it returns is checked by position: every
position returns exactly once, else reading the result raises.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalloom.operators import ranged, sequence
from evalloom.sources.landing import landed

Process = Callable[[pa.Table], pa.Table]


def packed(df: DataFrame, position: str, group: str, length: str, size: int, cap: int | None = None) -> DataFrame:
    """Adds ``batch``, numbered within each group in order of length, then position."""
    if cap is not None:
        return sequence.greedy_buckets(df, [group], length, position, size, cap).withColumnRenamed("bucket", "batch")
    placed = ranged.numbered(ranged.ranged(df, [group], [length, position]), [group])
    return placed.withColumn("batch", F.floor(F.col("_at") / size)).drop("_at", "_part", "_row")


def restored(df: DataFrame, position: str, group: str, length: str, process: Process, out: T.StructType | str, size: int = 16, cap: int | None = None) -> DataFrame:
    """The rows of ``df`` in order of position, with the columns ``out`` that ``process`` gives for them.

    ``process`` takes the rows of a batch, in order of length, and returns a table with ``position`` and the columns of
    ``out``, in any order. Positions must be unique.
    """
    kinds = T.StructType.fromDDL(out) if isinstance(out, str) else out
    shape = T.StructType([T.StructField(position, df.schema[position].dataType), *kinds.fields])
    batches = packed(df, position, group, length, size, cap)

    def run(t: pa.Table) -> pa.Table:
        got = process(t.sort_by([(length, "ascending"), (position, "ascending")]).drop_columns(["batch"]))
        return got.select([position, *kinds.names])

    # read twice below: what the function returned must not change between
    results = landed(batches.groupBy(group, "batch").applyInArrow(run, shape), "restored")
    held = results.groupBy(position).agg(F.count("*").alias("_n"))
    given = df.groupBy(position).agg(F.count("*").alias("_given"))
    bad = given.join(held, position, "full_outer").where(~(F.col("_given").eqNullSafe(F.lit(1)) & F.col("_n").eqNullSafe(F.lit(1))))
    wrong = bad.agg(F.count("*").alias("_bad"), F.min(F.struct(position, "_given", "_n")).alias("_first"))
    say = F.concat(F.lit("positions must return exactly once: "), F.to_json("_first", {"ignoreNullFields": "false"}))
    checked = df.join(results, position, "left").crossJoin(F.broadcast(wrong))  # one row
    kept = checked.where(F.when(F.col("_bad") == 0, True).otherwise(F.raise_error(say).cast("boolean"))).drop("_bad", "_first")
    return kept.repartitionByRange(position).sortWithinPartitions(position)
