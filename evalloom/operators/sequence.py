"""Order-sensitive operators: runs, mixture streams, micro-batches, buckets, nearest neighbours, truncation."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalloom.operators import permute, ranged
from evalloom.operators.order import positions
from evalloom.sources.landing import landed


def run_lengths(df: DataFrame, by: list[str], order: list[str], key: list[str]) -> DataFrame:
    """Maximal runs of equal keys in order: first position, length. Runs are stitched across ranges of the order, so a group may be of any size."""
    return ranged.runs(ranged.ranged(df.select(*dict.fromkeys([*by, *order, *key])), by, order), by, key)


def compress_lines(lines: Column) -> Column:
    """Runs of equal (tier, depth, text) lines of an array as one line with its multiplicity."""

    def put(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        same = last.isNotNull() & (last["tier"] == x["tier"]) & (last["depth"] == x["depth"]) & (last["text"] == x["text"])
        one = F.struct(x["tier"].alias("tier"), x["depth"].alias("depth"), x["text"].alias("text"), F.lit(1).alias("n"))
        more = F.struct(x["tier"].alias("tier"), x["depth"].alias("depth"), x["text"].alias("text"), (last["n"] + 1).alias("n"))
        return F.when(same, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(more))).otherwise(F.concat(acc, F.array(one)))

    start = F.from_json(F.lit("[]"), "array<struct<tier:int,depth:int,text:string,n:int>>")
    folded = F.reduce(lines, start, put)
    return F.transform(folded, lambda x: F.struct(x["tier"].alias("tier"), x["depth"].alias("depth"), F.when(x["n"] > 1, F.concat(x["text"], F.lit(" (×"), x["n"].cast("string"), F.lit(")"))).otherwise(x["text"]).alias("text")))


def interleave(spark: SparkSession, total: int, ratio: float) -> DataFrame:
    """Positions and their pool: auxiliary where floor((i + 1) r) exceeds floor(i r)."""
    i = F.col("id")
    aux = F.floor((i + 1) * F.lit(ratio)) > F.floor(i * F.lit(ratio))
    return spark.range(total).select(i.alias("position"), F.when(aux & F.lit(ratio > 0), "aux").otherwise("main").alias("pool"), F.floor(i * F.lit(ratio)).alias("_aux_before")).withColumn("ordinal", F.when(F.col("pool") == "aux", F.col("_aux_before")).otherwise(F.col("position") - F.col("_aux_before"))).drop("_aux_before")


def mixture_stream(spark: SparkSession, n_main: int, n_aux: int, ratio: float, total: int, seed: int) -> DataFrame:
    """A deterministic stream: each pool is drawn without replacement, epoch after epoch, in a keyed random order, with neither shuffle nor window."""
    positions_ = spark.range(total).select(F.col("id").alias("position"))
    return permute.mixture(positions_, n_main, n_aux, ratio, seed).select("position", "pool", "index")


def nearest(left: DataFrame, value: str, right: DataFrame, other: str, key: str) -> DataFrame:
    """For each left row the right key of least |difference| (ties: the smaller key), without a cross join; null for a null value.

    Only a right value's smallest key can win, so the right side folds to distinct values. Both sides meet in one order cut
    into ranges; within a range the nearest values below and above come from windows, and each range also gets the last
    value of the ranges before it and the first of those after.
    """
    r = right.where(F.col(other).isNotNull()).groupBy(F.col(other).alias("_v")).agg(F.min(key).alias("_k"))
    nulls = F.lit(None)
    rows = left.select(F.struct(*[left[c] for c in left.columns]).alias("_left"), F.col(value).alias("_v"), nulls.cast(right.schema[key].dataType).alias("_k"), F.lit(1).alias("_side"))
    both = rows.unionByName(r.select(nulls.cast(rows.schema["_left"].dataType).alias("_left"), "_v", "_k", F.lit(0).alias("_side")))
    # a number of their own lets equal values fill many ranges
    ordered = ranged.ranged(both.withColumn("_id", F.monotonically_increasing_id()), [], ["_v", "_side", "_id"])
    point = F.when(F.col("_k").isNotNull(), F.struct("_v", "_k"))
    ends = ordered.groupBy("_part").agg(F.max(point).alias("_max"), F.min(point).alias("_min"))
    # the first value after a row is the last one in the reverse order: a frame that ends unbounded is computed anew for every row
    p, w = Window.partitionBy(F.lit(0)), Window.partitionBy("_part")  # p: one row a range
    past = lambda c, over, at, end: F.last(c, True).over(over.orderBy(at).rowsBetween(Window.unboundedPreceding, end))
    carry = ends.select("_part", past("_max", p, F.asc("_part"), -1).alias("_under"), past("_min", p, F.desc("_part"), -1).alias("_over"))
    placed = ordered.withColumn("_lo", past(point, w, F.asc("_row"), 0)).withColumn("_hi", past(point, w, F.desc("_row"), 0))
    got = placed.where("_side = 1").join(carry, "_part")
    picks = [F.when(F.col(c).isNotNull() & F.col("_v").isNotNull(), F.struct(F.abs(F.col(c)["_v"] - F.col("_v")).alias("distance"), F.col(c)["_k"].alias("key"))) for c in ("_lo", "_hi", "_under", "_over")]
    best = F.array_min(F.array_compact(F.array(*picks)))
    return got.select("_left.*", best["key"].alias("nearest"), best["distance"].alias("distance"))


def micro_batches(df: DataFrame, order: str, ties: list[str], size: int) -> DataFrame:
    """Adds the number of each row's batch of ``size`` consecutive rows."""
    return positions(df, order, [F.col(t) for t in ties]).withColumn("batch", F.floor(F.col("pos") / size))


def forwarded_tokens(batched: DataFrame, length: str, cap: int) -> DataFrame:
    """Tokens passed forward: every row up to the (capped) width of its batch, shifted by one."""
    width = batched.groupBy("batch").agg((F.least(F.max(length), F.lit(cap)) - 1).alias("_w"))
    return batched.join(width, "batch").agg(F.sum(F.least(F.col(length), F.col("_w"))).alias("tokens"))


def supervised_tokens(batched: DataFrame, total: str, prompt: str, cap: int) -> DataFrame:
    """Response tokens within the capped width of each batch."""
    width = batched.groupBy("batch").agg(F.least(F.max(total), F.lit(cap)).alias("_w"))
    return batched.join(width, "batch").agg(F.sum(F.greatest(F.lit(0), F.least(F.col(total), F.col("_w")) - F.col(prompt))).alias("tokens"))


def _next_starts(lengths: np.ndarray, group: np.ndarray, batch: int, cap: int) -> np.ndarray:
    """Of rows in order, the first row that a bucket starting at each row leaves out; rows past the end count as one more group.

    The cost (count times longest) rises with every row, so a bucket ends at most ``batch`` rows on and at the first row that
    breaks a rule: each distance is looked at for all rows at once.
    """
    n = len(lengths)
    out = np.minimum(np.arange(n) + batch, n)
    for step in range(min(batch, n) - 1, 0, -1):
        here, there = slice(0, n - step), slice(step, n)
        breaks = (group[there] != group[here]) | ((step + 1) * lengths[there] > cap)
        out[here] = np.where(breaks, np.arange(n - step) + step, out[here])
    return out


def _walk(n: int, nexts: np.ndarray, entries: int) -> tuple[list[int], list[int]]:
    """From each of the first rows of a range: buckets that start in it, and how far past its end the next one starts."""
    count, past = [0] * n, [0] * n
    to = nexts.tolist()
    for i in range(n - 1, -1, -1):
        count[i], past[i] = (1, to[i] - n) if to[i] >= n else (count[to[i]] + 1, past[to[i]])
    return count[:entries], past[:entries]


def greedy_buckets(df: DataFrame, by: list[str], length: str, key: str, batch: int = 16, cap: int = 32_768, rows: int | None = None) -> DataFrame:
    """Adds ``bucket``, in order of length (then key): a new one where the count passes ``batch`` or count times the longest passes ``cap``.

    Where a bucket starts decides where the next one does, but it starts at most ``batch`` rows on. So each range of the
    order answers for every one of its first ``batch`` rows how many buckets start in it if one starts there, and how far
    into the next range the following one starts. Folding these answers, ``batch`` pairs of numbers a range, gives the
    row at which each range is entered; then each range numbers its rows. Ranges see the ``batch`` rows that follow them.
    """
    size = max(rows or ranged.ROWS, batch)
    ordered = ranged.numbered(ranged.ranged(df, by, [length, key], size), [], "_place")
    # ranges of exactly so many rows, so that none but the last is shorter than a bucket
    ordered = landed(ordered.withColumn("_part", F.floor(F.col("_place") / size).cast("int")).withColumn("_row", F.col("_place") % size).drop("_place"), "buckets")
    names = F.struct(*[F.col(c) for c in by]) if by else F.lit(0)
    cells = ordered.select("_part", "_row", F.coalesce(F.col(length).cast("long"), F.lit(0)).alias("_len"), F.to_json(F.struct(names.alias("g")), {"ignoreNullFields": "false"}).alias("_group"))
    first = cells.where(F.col("_row") < batch).select((F.col("_part") - 1).alias("_part"), (F.col("_row") + (1 << 33)).alias("_row"), "_len", "_group").where("_part >= 0")
    halo = cells.unionByName(first)

    def arrays(t: pa.Table) -> tuple[np.ndarray, np.ndarray, int]:
        t = t.sort_by("_row")
        row = t["_row"].to_numpy()
        own = int((row < 1 << 33).sum())
        group = t["_group"].combine_chunks().dictionary_encode().indices.to_numpy()
        return row[:own], _next_starts(t["_len"].to_numpy(), group, batch, cap)[:own], own

    def answer(t: pa.Table) -> pa.Table:
        _, nexts, own = arrays(t)
        count, past = _walk(own, nexts, min(own, batch))
        return pa.table({"_part": t["_part"][:1], "_count": pa.array([count], pa.list_(pa.int64())), "_past": pa.array([past], pa.list_(pa.int64()))})

    answers = halo.groupBy("_part").applyInArrow(answer, "_part int, _count array<long>, _past array<long>")
    # the fold: two short arrays a range, in order
    steps = F.array_sort(F.collect_list(F.struct("_part", "_count", "_past")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("n"), F.expr("cast(array() as array<struct<_part:int,_enter:bigint,_bucket:bigint>>)").alias("out"))

    def enter(s: Column, x: Column) -> Column:
        place = s["at"].cast("int")
        row = F.array(F.struct(x["_part"].alias("_part"), s["at"].alias("_enter"), s["n"].alias("_bucket")))
        return F.struct(F.get(x["_past"], place).alias("at"), (s["n"] + F.get(x["_count"], place)).alias("n"), F.concat(s["out"], row).alias("out"))

    entered = landed(answers.agg(F.aggregate(steps, start, enter)["out"].alias("o")).select(F.explode("o").alias("o")).select("o.*"), "entered")

    def number(t: pa.Table, e: pa.Table) -> pa.Table:
        row, nexts, own = arrays(t)
        at, bucket = e["_enter"][0].as_py(), e["_bucket"][0].as_py()
        starts = np.zeros(own, np.int64)
        while at < own:
            starts[at] = 1
            at = int(nexts[at])
        return pa.table({"_part": pa.array([e["_part"][0].as_py()] * own, pa.int32()), "_row": row, "_bucket": bucket - 1 + np.cumsum(starts)})

    numbers = halo.groupBy("_part").cogroup(entered.groupBy("_part")).applyInArrow(number, "_part int, _row long, _bucket long")
    got = ordered.join(numbers, ["_part", "_row"]).drop("_part", "_row")
    low = got.groupBy(*by).agg(F.min("_bucket").alias("_low"))
    got = ranged.joined(got, low, by) if by else got.crossJoin(low)  # one row
    return got.withColumn("bucket", F.col("_bucket") - F.col("_low")).drop("_bucket", "_low")


def render(lines: Column) -> Column:
    """Lines indented by two spaces a depth."""
    return F.array_join(F.transform(lines, lambda x: F.concat(F.repeat(F.lit("  "), x["depth"]), x["text"])), "\n")


def truncated(lines: Column, budget: Column, count: Callable[[Column], Column], most: int = 16) -> Column:
    """The text of the first stage that fits: without tier 2, without tiers 1 and 2, runs compressed, then ever fewer depths.

    ``count`` gives a text's tokens as a column; depths above ``most`` count as ``most``.
    """
    no2 = F.filter(lines, lambda x: x["tier"] != 2)
    no1 = F.filter(no2, lambda x: x["tier"] != 1)
    short = compress_lines(no1)
    levels = F.array_sort(F.array_distinct(F.transform(short, lambda x: x["depth"])))
    stages = [render(no2), render(no1), render(short)]
    # candidate texts by greatest depth kept, deepest first; the shallowest one is taken whether it fits or not
    keeps = F.transform(F.reverse(levels), lambda d: render(F.filter(short, lambda x: x["depth"] <= d)))
    fit = F.filter(F.concat(F.array(*stages), keeps), lambda t: count(t) <= budget)
    # with no line left above depth 0 the loop ends: the least text is that of depth 0
    least = render(F.filter(short, lambda x: x["depth"] <= 0))
    return F.coalesce(F.try_element_at(fit, F.lit(1)), least)


def delivered(df: DataFrame, ok: str, lines: str, code_tokens: str, count: Callable[[Column], Column], skip: int = 40) -> DataFrame:
    """Adds ``status`` and ``summary``: failed, skipped (short code or no lines), present, or truncated to the code's tokens."""
    whole = render(F.col(lines))
    status = (
        F.when(~F.coalesce(F.col(ok), F.lit(False)), "failed")
        .when((F.col(code_tokens) < skip) | (F.size(lines) == 0), "skipped")
        .when(count(whole) <= F.col(code_tokens), "present")
        .otherwise("present_truncated")
    )
    text = F.when(F.col("status") == "present", whole).when(F.col("status") == "present_truncated", truncated(F.col(lines), F.col(code_tokens), count)).otherwise("")
    return df.withColumn("status", status).withColumn("summary", text)


def warmup_cosine(step: Column, total: int, warmup: int, least: float = 0.0) -> Column:
    """Linear warm-up, then a cosine from 1 to ``least``."""
    progress = F.least(F.lit(1.0), (step - warmup) / F.lit(float(max(1, total - warmup))))
    decayed = F.lit(least) + F.lit(1 - least) * 0.5 * (1 + F.cos(F.lit(math.pi) * progress))
    return F.when(step < warmup, step / F.lit(float(max(1, warmup)))).otherwise(decayed)
