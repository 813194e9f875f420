"""Mixing sources to target weights with a low-discrepancy schedule.

Each source's documents, in a keyed random order, form one stream of words, read at most twice. The stream is cut into
blocks of equal length (``block_words``). Slot ``i`` of the schedule maps the golden-ratio point frac(i * phi) through
the cumulative target shares to a source; its rank among the slots of that source is the block that it joins. Slots
past a source's last block are void, and the blocks that the points leave over (a handful a source, the discrepancy)
follow at the end, so a source takes exactly its target, rounded down.

Ranks and stream positions are two-level prefix sums: within ranges of about sqrt(n) rows, and over the ranges. A
source that holds a third of all rows is spread like any other.

Defined cases: a null text has size 0 and takes 0 words; a null source is a source of its own, the last one; repeated
rows are documents of their own; ties of the keyed order fall back to id, size and a hash of the row; an empty table gives an
empty result. Other columns are carried by ``mixed`` and not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalloom.llm import common

WEIGHTS = (5, 2, 1)
SHARE, REPEATS, SEED = 1.5, 2, 20240607
#: Longest block in words; small corpora get shorter blocks, about 2**14 to a pass.
BLOCK_WORDS = 1024
_PHI = 2654435769  # 2**32 / golden ratio


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = np.fromiter((len(t.split()) for t in common.texts(b.column(b.num_columns - 1))), np.int64, len(b))
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n)], [*b.schema.names[:-1], "size"])


def targets(sizes: list[int], weights: tuple = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> list[float]:
    """Targets of the sources in order: shares by weight, stopped at ``repeats`` sizes, the excess shared again."""
    w = [float(weights[i % len(weights)]) for i in range(len(sizes))]
    out, free = [0.0] * len(sizes), {i for i, n in enumerate(sizes) if n > 0}
    left = share * sum(sizes)
    while free:
        unit = left / sum(w[i] for i in free)
        over = {i for i in free if unit * w[i] > repeats * sizes[i]}
        for i in over or free:
            out[i] = float(repeats * sizes[i]) if over else unit * w[i]
        if not over:
            break
        left -= sum(out[i] for i in over)
        free -= over
    return out


def fold(n: int) -> int:
    """Bits of an even division of n rows into about sqrt(n) / 2 ranges."""
    return max(0, (isqrt(max(1, n)) // 2).bit_length())


def prefix(df: DataFrame, group: str, part: str, order: list[Column], value: Column, out: str) -> DataFrame:
    """Adds the sum of ``value`` over all earlier rows of the group: ``part`` orders ranges, ``order`` rows in them."""
    sums = df.groupBy(group, part).agg(F.sum(value).alias("_sum"))
    before = sums.select(group, part, F.coalesce(F.sum("_sum").over(Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.sum(value).over(Window.partitionBy(group, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - value
    return df.withColumn("_inside", inside).join(before, [group, part]).withColumn(out, F.col("_inside") + F.col("_before")).drop("_inside", "_before")


def schedule(spark: SparkSession, aims: list[int], block: int) -> DataFrame:
    """Slots ``(slot, src, rank)``: each source's ranks are 0 to ceil(aim / block) - 1, once each."""
    need = [-(-a // block) for a in aims]
    m, total = sum(need), sum(aims)
    if not m:
        return spark.createDataFrame([], "slot long, src int, rank long")
    cuts, acc = [], 0
    for a in aims[:-1]:
        acc += a
        cuts.append(acc / total)
    i = F.col("id")
    u = F.pmod(F.pmod(i, F.lit(2**31)) * F.lit(_PHI), F.lit(2**32)) / F.lit(float(2**32))
    bits = max(1, fold(m) + 1)
    points = spark.range(m).select(i.alias("slot"), common.range_of(u, cuts).alias("src"), F.shiftright(i, bits).alias("part"))
    ranked = prefix(points, "src", "part", [F.col("slot")], F.lit(1), "rank")
    wanted = F.element_at(F.array(*[F.lit(n) for n in need]), F.col("src") + 1)
    ranked = ranked.where(F.col("rank") < wanted).select("slot", "src", F.col("rank").cast("long").alias("rank"))
    # what the points leave over: a few blocks a source
    had = {r["src"]: r["n"] for r in points.groupBy("src").agg(F.count("*").alias("n")).collect()}
    rest = [(s, had.get(s, 0), n) for s, n in enumerate(need) if had.get(s, 0) < n]
    if rest:
        more = spark.createDataFrame(rest, "src int, a long, b long").select("src", F.explode(F.sequence("a", F.col("b") - 1)).alias("rank"))
        ranked = ranked.union(more.select((F.col("rank") + F.lit(m)).alias("slot"), "src", "rank"))
    return ranked


def mix(rows: DataFrame, block_words: int = BLOCK_WORDS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Plans the mix of ``rows`` (doc_id, source, size, th: a hash of the content, any payload columns), a table that can be read repeatedly.

    Returns the rows with ``src, source_size, target, at`` (first word's place in the source's stream), and the parts
    taken: ``(src, at, epoch, slot, first, words)``, joined from the schedule's slots and the documents' blocks.
    """
    spark = rows.sparkSession
    per = sorted(rows.groupBy("source").agg(F.sum("size").alias("z"), F.count("*").alias("n")).collect(), key=lambda r: (r["source"] is None, r["source"] or ""))
    aims = targets([r["z"] for r in per])
    whole = [int(t) for t in aims]
    total, n = sum(r["z"] for r in per), sum(r["n"] for r in per)
    block = max(1, min(block_words, total >> 14))
    dim = spark.createDataFrame([(i, r["source"], r["z"], t, w) for i, (r, t, w) in enumerate(zip(per, aims, whole))], "src int, _name string, source_size long, target double, whole long")
    h = F.xxhash64(F.lit(seed), "doc_id", "size", "th")
    bits = fold(n)
    part = F.shiftrightunsigned(h, 64 - bits).cast("int") if bits else F.lit(0)
    named = rows.join(dim, rows["source"].eqNullSafe(dim["_name"])).drop("_name").withColumn("_h", h).withColumn("part", part)
    placed = prefix(named, "src", "part", [F.col("_h"), F.col("doc_id"), F.col("size"), F.col("th")], F.col("size"), "at").drop("_h", "part")
    epochs = F.array(*[F.lit(e) for e in range(REPEATS)])
    spans = placed.where("size > 0").select("src", "at", "size", "source_size", "whole", F.explode(epochs).alias("epoch"))
    lo = F.col("at") + F.col("epoch") * F.col("source_size")
    spans = spans.withColumn("lo", lo).where("lo < whole").withColumn("hi", F.least(F.col("lo") + F.col("size"), "whole"))
    pieces = spans.withColumn("rank", F.explode(F.sequence(F.expr(f"lo div {block}"), F.expr(f"(hi - 1) div {block}"))))
    start, end = F.greatest("lo", F.col("rank") * block), F.least("hi", (F.col("rank") + 1) * block)
    taken = pieces.join(schedule(spark, whole, block), ["src", "rank"]).select("src", "at", "epoch", "slot", (start - F.col("lo")).alias("first"), (end - start).alias("words"))
    return placed, taken


def mixed(docs: DataFrame) -> DataFrame:
    """The mix as documents: each with its columns, once for each time that it is taken; a part taken is cut to its words."""
    common.bounded_batches(docs.sparkSession)
    src = docs.select(common.whole_row(docs).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(*common.hashable(docs)).alias("th"), F.col("text").cast("string").alias("_text"))
    schema = src.drop("_text").schema.add("size", "long")
    rows = common.saved(src.mapInArrow(_sizes, schema), "mix-rows")
    placed, taken = mix(rows)
    whole = taken.groupBy("src", "at", "epoch").agg(F.min("first").alias("first"), F.sum("words").alias("words"))
    out = placed.where("size > 0").join(whole, ["src", "at"])
    part = F.array_join(F.slice(F.filter(F.split("row.text", r"[\x20\x09-\x0D]+"), lambda w: w != ""), (F.col("first") + 1).cast("int"), F.col("words").cast("int")), " ")
    text = F.when(F.col("words") == F.col("size"), F.col("row.text")).otherwise(part)
    return out.select(*[(text if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.bounded_batches(spark)
    docs = common.table(spark, sf_dir, "documents")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    rows = common.saved(src.mapInArrow(_sizes, "doc_id long, source string, th long, size long"), "mix-sizes")
    placed, taken = mix(rows)
    sums = taken.groupBy("src", "at").agg(F.sum("words").alias("taken"))
    some = placed.where("size > 0").join(sums, ["src", "at"], "left")
    cols = ["doc_id", "size", "source_size", "target"]
    none = placed.where("size = 0").select(*cols, F.lit(0).cast("long").alias("taken"))
    return some.select(*cols, F.coalesce("taken", F.lit(0)).cast("long").alias("taken")).unionByName(none)
