"""Validation of prepared training data: tasks by split, quarantine, adjudications, summaries, auxiliary rows, lengths."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalloom.operators import constraints, ranged, records, sequence, stats
from evalloom.operators.constraints import ConstraintError
from evalloom.sources import strict
from evalloom.sources.landing import landed

SPLITS = ["train", "validation", "test"]


def read_projection(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Some string columns of JSON lines, the rest ignored; rows are unique and complete."""
    rows = spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns])).option("mode", "FAILFAST").json(path)
    incomplete = rows.where(" or ".join(f"{c} is null" for c in columns))
    constraints.require(incomplete, "complete projection")
    constraints.require(constraints.duplicate_keys(rows, columns[:1]), "unique id")
    return rows


def read_adjudications(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType(), False) for c in ("id", "split", "resolution", "reason")])
    rows = strict.read_json_lines(spark, path, schema, ["id"])
    constraints.require(constraints.failing(rows, ["id"], {"resolution": F.col("resolution").isin("exclude", "fixture_fix"), "reason": F.trim("reason") != ""}), "adjudication")
    return rows


def require_files(spark: SparkSession, root: str, names: list[str]) -> None:
    """Every file exists, in whatever file system the root is."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for n in names:
        if not fs.exists(jvm.org.apache.hadoop.fs.Path(base, n)):
            raise ConstraintError(f"{root} lacks {n}")


def check_tasks(tasks: DataFrame, file_split: str, kinds: list[str]) -> None:
    """A row's split is its file's, every id has every kind once, and ids are in one split."""
    constraints.require(tasks.where(~F.col("split").eqNullSafe(F.col(file_split))), "split of file")
    grid = tasks.groupBy("id").agg(F.count("*").alias("n"), F.collect_set("task_type").alias("kinds"))
    constraints.require(grid.where((F.col("n") != len(kinds)) | (F.size(F.array_except(F.array(*map(F.lit, kinds)), "kinds")) > 0)), "complete tasks")
    constraints.require(constraints.overlapping_splits(tasks, "id", "split"), "disjoint splits")


def check_cover(summaries: DataFrame, ids: DataFrame) -> None:
    """Summaries are unique and cover exactly the ids."""
    constraints.require(constraints.duplicate_keys(summaries, ["id"]), "unique summary")
    constraints.require(constraints.outside(summaries, ids.select("id"), ["id"]), "summary of a known id")
    constraints.require(constraints.outside(ids, summaries.select("id"), ["id"]), "every id has a summary")


def check_subset(part: DataFrame, whole: DataFrame, rule: str) -> None:
    constraints.require(constraints.outside(part, whole.select("id"), ["id"]), rule)


def check_checksum(ids: DataFrame, expected: str) -> None:
    found = constraints.id_checksum(ids, [], "id").first()
    got = found["checksum"] if found else None
    if got != expected:
        raise ConstraintError(f"ids have checksum {got}, not {expected}")


def check_auxiliary(auxiliary: DataFrame, source: DataFrame, key: list[str], columns: list[str]) -> None:
    """Auxiliary rows equal their source rows, field by field; source rows may be more."""
    present = source.join(auxiliary.select(*key), key, "left_semi")
    constraints.require(constraints.mismatches(auxiliary, present, key, columns), "auxiliary agrees with source")


@dataclass(frozen=True)
class Prepared:
    """Prepared training data: tasks (id, split, task_type, file: the split of their file), and what refers to their ids."""

    tasks: DataFrame
    kinds: list[str]
    length_exclusions: DataFrame
    exclusion_checksum: str
    adjudications: DataFrame
    quarantine: DataFrame
    composite: DataFrame
    summaries: DataFrame | None = None
    auxiliary: DataFrame | None = None
    source: DataFrame | None = None
    auxiliary_key: tuple[str, ...] = ("id",)
    auxiliary_columns: tuple[str, ...] = ()


def validate(p: Prepared) -> None:
    """Everything that must hold between the tables of a prepared study, in the order in which it depends on each other."""
    check_tasks(p.tasks, "file", p.kinds)
    ids = p.tasks.select("id", "split").distinct()
    of = lambda s: ids.where(F.col("split") == s).select("id")
    check_subset(p.length_exclusions, of("train"), "length exclusions are train ids")
    for name, table in (("adjudication", p.adjudications), ("quarantine", p.quarantine)):
        constraints.require(constraints.outside(table, ids, ["id", "split"]), f"{name} ids are of their declared split")
    dropped = p.adjudications.where("split = 'validation' and resolution = 'exclude'").select("id").union(p.quarantine.select("id"))
    kept = of("validation").join(dropped, "id", "left_anti")
    if p.composite.isEmpty():
        raise ConstraintError("composite validation ids are missing")
    check_subset(p.composite, kept, "composite ids are retained validation ids")
    check_checksum(p.length_exclusions, p.exclusion_checksum)
    if p.summaries is not None:
        check_cover(p.summaries, ids)
    if p.auxiliary is not None:
        check_auxiliary(p.auxiliary, p.source, list(p.auxiliary_key), list(p.auxiliary_columns))


def stratified_sample(main: DataFrame, aux: DataFrame, length: str, key: str, n: int, seed: int) -> DataFrame:
    """(draw, main_key, nearest, distance): n main rows drawn with replacement, each with the auxiliary row of nearest length (ties: the smaller key).

    Draw i is a digest of seed and i, so neither the order nor the number of tasks matters; ``key`` numbers main rows. The
    match is a length's, so it is sought once for each length of the main rows and joined to these; draws then only take
    their row. Main rows are saved first: they are counted, sampled for ranges and sorted.
    """
    held = landed(main.select(F.col(key).alias("main_key"), F.col(length).alias("_len")), "main")
    placed = ranged.numbered(ranged.ranged(held, [], ["main_key"]), [], "_at").select("_at", "main_key", "_len")
    others = aux.select(F.col(key).alias("_key"), F.col(length).alias("_other"))
    matched = sequence.nearest(held.select("_len").where("_len is not null").distinct(), "_len", others, "_other", "_key")
    draws = main.sparkSession.range(n).select(F.col("id").alias("draw"), records.drawn(max(1, held.count()), seed, F.col("id")).alias("_at"))
    return draws.join(placed.join(matched, "_len", "left"), "_at").select("draw", "main_key", "nearest", "distance")


def length_distributions(examples: DataFrame, by: list[str], length: str) -> DataFrame:
    """Nearest-rank percentiles of lengths."""
    return stats.nearest_rank(examples, by, length)


def realised(stream: DataFrame, total: str, prompt: str, micro_batch: int, cap: int) -> DataFrame:
    """Forwarded and supervised tokens and truncated items of a stream in order of ``position``."""
    if stream.count() % micro_batch:
        raise ConstraintError("the stream doesn't fill its last micro-batch")
    b = sequence.micro_batches(stream, "position", [], micro_batch)
    one = sequence.forwarded_tokens(b, total, cap).withColumnRenamed("tokens", "forwarded")
    two = sequence.supervised_tokens(b, total, prompt, cap).withColumnRenamed("tokens", "supervised")
    return one.crossJoin(two).crossJoin(stream.agg(F.count_if(F.col(total) > cap).alias("truncated")))


def check_stored(stored: DataFrame, computed: DataFrame, key: list[str], columns: list[str], tolerance: float = 1e-12) -> None:
    """Stored numbers equal the recomputed ones within a relative tolerance."""
    other = computed.select(*key, *[F.col(c).alias(f"_{c}") for c in columns])
    same: Column = F.lit(True)
    for c in columns:
        same = same & F.coalesce(stats.close(F.col(c), F.col(f"_{c}"), tolerance, tolerance), F.lit(False))
    constraints.require(stored.join(other, key, "full_outer").where(~same), "stored equals computed")


def check_trace(trace: DataFrame, results: DataFrame, steps: list[int], metrics: list[str]) -> None:
    """Each run's trace has exactly the steps, and its selected step carries the run's metrics."""
    run = ["condition", "seed"]
    shape = trace.groupBy(*run).agg(F.array_sort(F.collect_list("step")).alias("steps"))
    constraints.require(shape.where(F.col("steps") != F.array(*[F.lit(s).cast("long") for s in steps])), "trace steps")
    at = trace.select(*run, F.col("step").alias("selected_step"), *metrics)
    constraints.require(constraints.mismatches(results.select(*run, "selected_step", *metrics), at.join(results.select(*run, "selected_step"), [*run, "selected_step"], "left_semi"), [*run, "selected_step"], metrics), "selected step")
