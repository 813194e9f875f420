"""Cluster-bootstrap intervals.

``intervals`` draws by a counter: draw k of a replicate is a hash of (seed, replicate, k), spread over all of a contrast's
units, so any task can make any draw, and how units are cut changes nothing. Units are numbered in lexicographic order and
stay cut into ranges of at most ``CELLS`` numbers (or ``RANGE`` units). A task makes all draws of one block of replicates and
sums the statistics of those that fall into its range; the sums of ranges merge, and the statistic is taken of the merged
sums. A contrast of several ranges hashes its draws once for each, which costs processors but no memory and no shuffle; no
task and no group holds all units.

``stream_intervals`` makes the draws of one sequential generator instead, as published intervals did: a contrast's units
are then one task's, at most ``STREAM_UNITS`` of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from evalloom.operators import ranged
from evalloom.operators.constraints import ConstraintError
from evalloom.sources.landing import landed

#: Units of a range at least, numbers of a range, replicates of a block, draws held at once.
RANGE, CELLS, REPLICATES, DRAWS = 1 << 14, 1 << 22, 128, 1 << 21
STREAM_UNITS = 1 << 17
#: Drawn indices held at once by the sequential stream.
BLOCK = 4_000_000
# Multipliers of the 32-bit mixing function.
MULTIPLIERS = (0x7FEB352D, 0x2C1B3C6D)
LOW32 = np.uint64(0xFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit words (held in 64 bits) whose values look random."""
    x = x & LOW32
    x = ((x ^ (x >> np.uint64(16))) * np.uint64(MULTIPLIERS[0])) & LOW32
    x = ((x ^ (x >> np.uint64(15))) * np.uint64(MULTIPLIERS[1])) & LOW32
    return x ^ (x >> np.uint64(16))


def root(seed: int, at: int) -> np.ndarray:
    """The word that a seed gives a stream of draws; contrasts use stream 0."""
    return mixed(mixed(np.uint64([seed & 0xFFFFFFFF])) + np.uint64(at))


def _drawn(roots: np.ndarray, units: int, first: int, last: int) -> np.ndarray:
    """Units drawn by the counters from ``first`` to ``last`` of each replicate: ``mixed`` in 32-bit words, scaled."""
    x = roots.astype(np.uint32)[:, None] + np.arange(first, last, dtype=np.uint64).astype(np.uint32)
    for shift, multiplier in ((16, MULTIPLIERS[0]), (15, MULTIPLIERS[1])):
        x ^= x >> np.uint32(shift)
        x *= np.uint32(multiplier)
    x ^= x >> np.uint32(16)
    return (x.astype(np.uint64) * np.uint64(units)) >> np.uint64(32)


def _weights(seed: int, units: int, low: int, own: int, replicates: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """How often each of the ``own`` units from ``low`` on is drawn, for a few replicates at a time: every draw is looked at."""
    roots = mixed(root(seed, 0) + replicates.astype(np.uint64))
    step = max(1, DRAWS // max(1, units, own))
    for s in range(0, len(replicates), step):
        few = roots[s : s + step]
        weights = np.zeros(len(few) * own, np.int64)
        for first in range(0, units, DRAWS):
            unit = _drawn(few, units, first, min(units, first + DRAWS)) - np.uint64(low)  # what lies below wraps around
            cell = unit.astype(np.int64) + (np.arange(len(few)) * own)[:, None]
            weights += np.bincount(cell.ravel() if own == units else cell[unit < own], minlength=len(weights))
        yield slice(s, s + step), weights.reshape(len(few), own)


def fallen(seed: int, units: int, at: int, block: int, replicates: int) -> np.ndarray:
    """How many of the ``units`` draws of each of the first replicates of a block fall into range ``at``."""
    low = at * RANGE
    of = block * REPLICATES + np.arange(replicates)
    return np.concatenate([w.sum(1) for _, w in _weights(seed, units, low, min(units, low + RANGE) - low, of)])


def _sums(x: np.ndarray, seed: int, units: int, at: int, block: int, draws: int, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Replicates of a block and the sums of the drawn rows of ``x``, the statistics of range ``at`` (``width`` units each)."""
    replicates = np.arange(block * REPLICATES, min(draws, (block + 1) * REPLICATES))
    out = np.zeros((len(replicates), x.shape[1]))
    for s, weights in _weights(seed, units, at * (width or RANGE), len(x), replicates):
        out[s] = weights @ x
    return replicates, out


SCHEMA = "point double, low double, high double, p_value double, n_units long, excludes_zero boolean"


def intervals(units: DataFrame, by: list[str], unit: str, values: list[Column], statistic: Callable[[list[Column], Column], Column], draws: int = 10_000, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """``(*by, point, low, high, p_value, n_units, excludes_zero)`` of each contrast of ``units`` (one row a unit).

    ``statistic`` maps the sums of ``values`` over the (drawn) units and their number to a value. A column ``seed`` in
    ``by`` sets a contrast's seed. Null values count as zero.
    """
    seeds = F.col("seed").cast("long") if "seed" in by else F.lit(seed).cast("long")
    cells = F.array(*[F.coalesce(v.cast("double"), F.lit(0.0)) for v in values])
    rows = units.select(*by, F.col(unit).cast("string").alias("_unit"), cells.alias("_x"), seeds.alias("_seed"))
    rows = landed(ranged.numbered(ranged.ranged(rows, by, ["_unit"]), by).drop("_part", "_row", "_unit"), "bootstrap")
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_n"), *[F.sum(F.col("_x")[i]).alias(f"_s{i}") for i in range(len(values))])
    # one row for each RANGE of units: blocks of replicates get arrays, not rows
    chunks = rows.groupBy(*by, F.floor(F.col("_at") / RANGE).cast("int").alias("_chunk")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_x"))), lambda s: s["_x"])).alias("_x"), F.first("_seed").alias("_seed"))
    work = ranged.joined(chunks, sizes.select(*by, "_n"), by) if by else chunks.crossJoin(sizes.select("_n"))  # one row
    columns = len(values)
    ranges = max(1, CELLS // columns // RANGE)  # chunks of a range
    work = work.withColumn("_range", F.floor(F.col("_chunk") / ranges).cast("int")).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(max(0, -(-draws // REPLICATES) - 1)))))
    kept = work.select(*by, "_range", "_block", "_chunk", "_x", "_n", "_seed")
    kind, width = to_arrow_schema(kept.select(*by).schema) if by else pa.schema([]), ranges * RANGE

    def part(t: pa.Table) -> pa.Table:
        t = t.sort_by("_chunk")
        one = {c: t[c][0].as_py() for c in ("_seed", "_n", "_range", "_block")}
        x = t["_x"].combine_chunks().flatten().to_numpy().reshape(-1, columns)
        replicates, sums = _sums(x, one["_seed"], one["_n"], one["_range"], one["_block"], draws, width)
        keys = [pa.array([t[c][0].as_py()] * len(replicates), kind.field(c).type) for c in by]
        return pa.Table.from_arrays([*keys, pa.array(replicates), pa.array(list(sums), pa.list_(pa.float64()))], [*by, "_r", "_sums"])

    shape = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.select(*by).schema) if by else ""
    parts = kept.groupBy(*by, "_range", "_block").applyInArrow(part, f"{shape}_r long, _sums array<double>")
    merged = parts.groupBy(*by, "_r").agg(*[F.sum(F.col("_sums")[i]).alias(f"_s{i}") for i in range(len(values))])
    merged = ranged.joined(merged, sizes.select(*by, "_n"), by) if by else merged.crossJoin(sizes.select("_n"))
    taken = lambda: statistic([F.col(f"_s{i}") for i in range(len(values))], F.col("_n"))
    drawn = merged.select(*by, taken().alias("_v")).groupBy(*by).agg(
        F.percentile("_v", F.lit(alpha / 2)).alias("low"),
        F.percentile("_v", F.lit(1 - alpha / 2)).alias("high"),
        F.least(F.lit(1.0), 2 * F.least(F.avg((F.col("_v") <= 0).cast("double")), F.avg((F.col("_v") >= 0).cast("double")))).alias("p_value"),
    )
    points = sizes.select(*by, taken().alias("point"), F.col("_n").alias("n_units"))
    both = ranged.joined(points, drawn, by) if by else points.crossJoin(drawn)
    return both.select(*by, "point", "low", "high", "p_value", "n_units", ((F.col("low") > 0) | (F.col("high") < 0)).alias("excludes_zero"))


def mean_intervals(differences: DataFrame, by: list[str], unit: str, value: str, draws: int = 10_000, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """Interval of the mean of unit values, for every contrast."""
    return intervals(differences, by, unit, [F.col(value)], lambda sums, n: sums[0] / n, draws, seed, alpha)


def macro_f1_interval(df: DataFrame, unit: str, repeat: str, condition: str, a: str, b: str, pred: str, gold: str, classes: list[str], draws: int = 10_000, seed: int = 45, alpha: float = 0.05) -> DataFrame:
    """Interval of macro-F1(a) - macro-F1(b), recomputed on each resample of units and averaged over repeats (a few, a dimension).

    Without a unit there is one row, whose numbers are null.
    """
    # saved, and so are the units: repeats are listed, and ranges count, sample and sort, without making the sets anew
    rows = landed(df.where(F.col(condition).isin(a, b)).select(*dict.fromkeys([unit, repeat, condition, pred, gold])), "sets")
    repeats = sorted((r[0] for r in rows.select(repeat).distinct().limit(1001).collect()), key=str)
    if len(repeats) > 1000:
        raise ConstraintError("repeats are a dimension of at most 1,000 values")
    repeats = repeats or [None]
    has = lambda c, k: F.array_contains(c, k)
    cells = []
    for r in repeats:
        for c in (a, b):
            here = F.col(repeat).eqNullSafe(F.lit(r)) & (F.col(condition) == c)
            for k in classes:
                cells += [F.count_if(here & hit) for hit in (has(pred, k) & has(gold, k), has(pred, k) & ~has(gold, k), ~has(pred, k) & has(gold, k))]
    units = landed(rows.groupBy(unit).agg(*[c.alias(f"_c{i}") for i, c in enumerate(cells)]), "units")

    def statistic(sums: list[Column], n: Column) -> Column:
        def f1(at: int) -> Column:
            tp, fp, fn = sums[at : at + 3]
            return F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0))

        macro = [sum((f1(3 * (i * len(classes) + j)) for j in range(len(classes))), F.lit(0.0)) / len(classes) for i in range(2 * len(repeats))]
        return F.when(n > 0, sum((macro[2 * i] - macro[2 * i + 1] for i in range(len(repeats))), F.lit(0.0)) / len(repeats))

    return intervals(units, [], unit, [F.col(f"_c{i}") for i in range(len(cells))], statistic, draws, seed, alpha)


def sql_mixed(rel: str, value: str, out: str) -> str:
    """SQL: the relation with the mixed word of a value."""
    cut = lambda x: f"({x}) & 4294967295"
    return (
        f"SELECT * EXCLUDE ({out}0, {out}1, {out}2) FROM (SELECT *, {cut(f'({value})::UBIGINT')} AS {out}0, {cut(f'xor({out}0, {out}0 >> 16) * {MULTIPLIERS[0]}')} AS {out}1, "
        f"{cut(f'xor({out}1, {out}1 >> 15) * {MULTIPLIERS[1]}')} AS {out}2, xor({out}2, {out}2 >> 16) AS {out} FROM {rel})"
    )


def sql_drawn(seed: int, draws: int, units: str) -> str:
    """SQL: (r, spot) of every draw among the units counted by a query, of one range."""
    words = sql_mixed(f"range({draws}) t(r)", f"{int(root(seed, 0)[0])} + r", "w")
    each = f"(SELECT r, w, k, n FROM ({words}), ({units}) c(n), LATERAL range(n) s(k))"
    return f"SELECT r, ((v * n::UBIGINT) >> 32)::BIGINT AS spot FROM ({sql_mixed(each, 'w + k::UBIGINT', 'v')})"


def bootstrap(n_units: int, statistic: Callable[[np.ndarray], np.ndarray], draws: int, seed: int, alpha: float = 0.05) -> tuple[float, float, float]:
    """(low, high, p) from ``statistic``, which maps (replicates, units) indices of the sequential stream to values."""
    rng, out, at = np.random.default_rng(seed), np.empty(draws), 0
    rows = max(1, BLOCK // max(1, n_units))
    while at < draws:
        k = min(rows, draws - at)
        out[at : at + k] = statistic(rng.integers(0, n_units, size=(k, n_units)))
        at += k
    low, high = np.quantile(out, [alpha / 2, 1 - alpha / 2])
    p = min(1.0, 2 * min((out <= 0).mean(), (out >= 0).mean()))
    return float(low), float(high), float(p)


def stream_intervals(differences: DataFrame, by: list[str], unit: str, value: str, draws: int = 10_000, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """As ``mean_intervals``, by the sequential stream that the study's published intervals used."""
    most = differences.groupBy(*by).count().agg(F.max("count").alias("n")).first()["n"] or 0
    if most > STREAM_UNITS:
        raise ConstraintError(f"a contrast has {most} units; the sequential stream takes at most {STREAM_UNITS}, use mean_intervals")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values(unit, key=lambda s: s.astype(str), kind="stable")[value].to_numpy(float)
        s = int(pdf["seed"].iloc[0]) if "seed" in by else seed
        low, high, p = bootstrap(len(v), lambda ix: v[ix].mean(axis=1), draws, s, alpha)
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in by}, "point": [v.mean()], "low": [low], "high": [high], "p_value": [p], "n_units": [len(v)], "excludes_zero": [low > 0 or high < 0]})

    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in differences.schema if f.name in by)
    ordered = ", ".join(k for b in by for k in keys.split(", ") if k.split()[0] == b)
    return differences.select(*by, unit, value).groupBy(*by).applyInPandas(one, f"{ordered}, {SCHEMA}" if by else SCHEMA)
