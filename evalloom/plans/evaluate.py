"""From model responses to scored records and validation scores. Generation and code checking are injected functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.functions import scalars, textops
from evalloom.operators import constraints, labels
from evalloom.plans.study import ALIASES, CHECKS

#: Adds parse_ok, lint_ok, build_status, tool_status and found (array of checks) to distinct rows of one column ``code``.
Checker = Callable[[DataFrame], DataFrame]
CHECKED = ["parse_ok", "lint_ok", "build_status", "tool_status", "found"]


def exclusions(quarantine: DataFrame, adjudications: DataFrame, split: str) -> DataFrame:
    """Ids of a split that are quarantined or adjudicated as excluded."""
    q = quarantine.where(F.col("split") == split).select("id")
    return q.union(adjudications.where((F.col("split") == split) & (F.col("resolution") == "exclude")).select("id")).distinct()


def without(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return df.join(ids.select(F.col("id").alias(key)).distinct(), key, "left_anti")


def selected(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows of the ids; an id without rows is an error."""
    constraints.require(constraints.outside(ids.select(F.col("id").alias(key)), df.select(key), [key]), "selected ids exist")
    return df.join(ids.select(F.col("id").alias(key)).distinct(), key, "left_semi")


def prompted(df: DataFrame, summaries: DataFrame, uses_summary: bool, render: Callable[[Column, Column], Column], count: Callable[[Column], Column]) -> DataFrame:
    """Adds prompt and prompt_tokens; summaries (id, status, summary) join where the condition shows them."""
    if uses_summary:
        constraints.require(constraints.outside(df, summaries.select("id"), ["id"]), "summaries cover every id")
        out = df.join(summaries.select("id", "status", "summary"), "id")
    else:
        out = df.withColumn("status", F.lit("not_applicable")).withColumn("summary", F.lit(""))
    out = out.withColumn("prompt", render(F.col("code"), F.col("summary")))
    return out.withColumn("prompt_tokens", count(F.col("prompt")).cast("long"))


def rule_records(df: DataFrame, response: str, gold: str, header: str | None = None) -> DataFrame:
    """Adds pred, n_emitted, rejected_label_count, normalization_status and exact_match."""
    text = scalars.after_header(F.col(response), header) if header else F.col(response)
    rows = df.withColumn("_p", textops.parsed_labels(text, CHECKS, ALIASES))
    out = rows.select(*df.columns, F.col("_p.pred").alias("pred"), F.col("_p.n_emitted").alias("n_emitted"), F.col("_p.rejected").alias("rejected_label_count"), F.col("_p.status").alias("normalization_status"))
    return out.withColumn("exact_match", labels.same_set("pred", gold))


def _checked(df: DataFrame, code: str, checker: Checker, prefix: str) -> DataFrame:
    """Checker results of a code column, each distinct text checked once."""
    distinct = df.select(F.col(code).alias("code")).where("code is not null").distinct()
    results = checker(distinct).select(F.col("code").alias(code), *[F.col(c).alias(prefix + c) for c in CHECKED])
    return df.join(results, code, "left")


def repair_records(df: DataFrame, response: str, original: str, targets: str, checker: Checker, parseable: Callable[[str], bool]) -> DataFrame:
    """Adds the outcome of repairs: extracted code, its checks, and the decision table against the original's checks."""
    rows = df.withColumn("_x", textops.extracted(F.col(response), parseable)).withColumn("_code", F.col("_x.code"))
    rows = _checked(_checked(rows, original, checker, "_o_"), "_code", checker, "_n_")
    none = F.array().cast("array<string>")
    valid = F.col("_code").isNotNull() & F.coalesce("_n_parse_ok", F.lit(False)) & F.coalesce("_n_lint_ok", F.lit(False))
    known = lambda c: labels.ordered(F.coalesce(c, none), CHECKS)
    got = textops.outcome(valid, F.col(targets), known("_o_found"), known("_n_found"))
    rows = rows.withColumn("_r", got)
    outcome = F.struct(
        F.col("_r.target_fixed").alias("target_fixed"),
        F.col("_r.fix_rate_hit").alias("overall_fixed"),
        F.col("_r.regression").alias("studied_regression"),
        F.lit(None).cast("boolean").alias("enabled_regression"),
        F.col("_code").isNotNull().alias("extracted"),
        F.col("_x.status").alias("extraction_status"),
        F.coalesce("_n_parse_ok", F.lit(False)).alias("parse_ok"),
        F.coalesce("_n_lint_ok", F.lit(False)).alias("lint_ok"),
        F.coalesce("_o_tool_status", F.lit("load_failed")).alias("original_tool_status"),
        F.coalesce("_n_tool_status", F.lit("load_failed")).alias("output_tool_status"),
        F.coalesce("_n_build_status", F.lit("NA")).alias("build_status"),
        F.col("_r.category").alias("category"),
        F.col("_r.introduced").alias("introduced_checks"),
        F.array_intersect(F.col(targets), known("_n_found")).alias("residual_checks"),
    )
    return rows.select(*df.columns, outcome.alias("outcome"))


def records(*parts: DataFrame) -> DataFrame:
    """The union of record variants; fields that a variant lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


@dataclass(frozen=True)
class Scorer:
    """A component of a validation composite: its name, the task whose rows it sees, the cap of their answers, and its value over them.

    ``value`` takes the condition that picks the task's rows and returns one aggregate, so any number of scorers share a pass.
    """

    name: str
    task: str
    cap: int
    value: Callable[[Column], Column]


def macro_f1_of(pred: str, gold: str, classes: list[str]) -> Callable[[Column], Column]:
    """Macro-F1 as one aggregate; a class without rows counts 0."""

    def value(mine: Column) -> Column:
        def f1(k: str) -> Column:
            p, g = F.array_contains(pred, k), F.array_contains(gold, k)
            n = lambda c: F.count_if(mine & F.coalesce(c, F.lit(False)))
            return F.coalesce(F.try_divide(2.0 * n(p & g), n(p) + n(g)), F.lit(0.0))

        return sum((f1(k) for k in classes[1:]), f1(classes[0])) / len(classes)

    return value


def rate_of(hit: Column | str) -> Callable[[Column], Column]:
    """Share of the task's rows that hit (a condition or a boolean column); null where there is none."""
    return lambda mine: F.avg(F.when(mine, F.coalesce(F.col(hit) if isinstance(hit, str) else hit, F.lit(False)).cast("double")))


# Names, tasks and answer caps of the study's components.
SCORERS = [
    Scorer("macro_f1", "rule_identification", 64, macro_f1_of("pred", "target_checks", CHECKS)),
    Scorer("correction_fix_rate", "correction", 512, rate_of("outcome.overall_fixed")),
    Scorer("joint_fix_rate", "joint", 512, rate_of("outcome.overall_fixed")),
]


def composite(scored: DataFrame, scorers: list[Scorer], by: list[str] | None = None, whole: bool = False) -> DataFrame:
    """(*by, a column a scorer, composite): the unweighted mean of the components, 0 for a task without rows.

    With ``whole`` a component without a value is an error. Names must differ.
    """
    if len({s.name for s in scorers}) < len(scorers) or not scorers:
        raise ValueError("a composite needs scorers of different names")
    rows = scored.groupBy(*(by or [])).agg(*[s.value(F.col("task_type") == s.task).alias(s.name) for s in scorers], *[F.count_if(F.col("task_type") == s.task).alias(f"_n{i}") for i, s in enumerate(scorers)])

    def part(i: int, s: Scorer) -> Column:
        none = F.raise_error(F.lit(f"{s.name} has no rows")).cast("double") if whole else F.lit(0.0)
        return F.when(F.col(f"_n{i}") == 0, none).otherwise(F.coalesce(F.col(s.name), F.lit(0.0)))

    parts = rows.select(*(by or []), *[part(i, s).alias(s.name) for i, s in enumerate(scorers)])
    total = sum((F.col(s.name) for s in scorers[1:]), F.col(scorers[0].name))
    return parts.withColumn("composite", total / len(scorers))


def validation_scores(scored: DataFrame) -> DataFrame:
    """Macro-F1 and the two repair rates, 0 where a task has no rows, and their unweighted mean."""
    return composite(scored, SCORERS)
