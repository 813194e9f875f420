"""The study as one binding of the operators: schemas, checks, population, result tables and leaves.

Every function takes and returns DataFrames; only final tables of a few rows are rendered on the driver
(``sources.sinks``). Percent values are times 100.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalloom.operators import constraints, labels, paired, resample, stats, strata

# The vocabulary of the study's records.
CONDITIONS = ["C0", "C1", "C2", "C2-control", "zero-shot-raw", "zero-shot-syntax"]
TUNED = ["C0", "C1", "C2", "C2-control"]
SEEDS = [42, 43, 44]
TASKS = ["rule_identification", "correction", "joint", "explanation"]
CHECKS = ["assignOp", "builtinShadow", "captLocal", "commentFormatting", "elseif", "ifElseChain", "paramTypeCombine", "singleCaseSwitch"]
SUMMARY_STATUS = ["present", "present_truncated", "skipped", "failed", "not_applicable"]
CATEGORIES = ["A", "B", "C", "D", "INVALID"]
# Bootstrap seeds of the task contrasts against C0.
CONTRAST_SEEDS = {("rule_identification", "C1"): 44, ("correction", "C1"): 43, ("joint", "C1"): 42, ("rule_identification", "C2"): 42, ("correction", "C2"): 42, ("joint", "C2"): 42}
# Compute quantities and what divides them.
COMPUTE = {"total_tokens_m": ("total_tokens", 1e6), "supervised_tokens_m": ("supervised_tokens", 1e6), "optimizer_steps": ("optimizer_steps", 1.0), "training_minutes": ("wall_clock_train_s", 60.0), "end_to_end_minutes": ("wall_clock_total_s", 60.0), "peak_allocated_gpu_memory_gib": ("peak_allocated_gpu_memory_gib", 1.0)}
# Label spellings that answers use besides the checks' own names.
ALIASES = {
    "capitalized local": "captLocal",
    "builtin shadow": "builtinShadow",
    "builtin shadowing": "builtinShadow",
    "else if": "elseif",
    "if else chain": "ifElseChain",
    "single case switch": "singleCaseSwitch",
    "param type combine": "paramTypeCombine",
    "parameter type combine": "paramTypeCombine",
    "assignment operator": "assignOp",
    "comment formatting": "commentFormatting",
}


def ddl(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)


OUTCOME_DDL = "struct<target_fixed:boolean,overall_fixed:boolean,studied_regression:boolean,enabled_regression:boolean,extracted:boolean,extraction_status:string,parse_ok:boolean,lint_ok:boolean,original_tool_status:string,output_tool_status:string,build_status:string,category:string,introduced_checks:array<string>,residual_findings:array<struct<check:string,line:bigint,column:bigint>>>"
RECORD_DDL = f"base_snippet_id string not null, condition string not null, seed bigint not null, task_type string not null, target_checks array<string> not null, summary_status string not null, prompt_tokens bigint not null, retokenized_response_token_proxy bigint not null, latency_ms double, gold array<string>, pred array<string>, rejected_label_count bigint, exact_match boolean, n_emitted bigint, normalization_status string, outcome {OUTCOME_DDL}, extracted_similarity double, sensitivity_class string"


def record_checks() -> dict[str, Column]:
    """Row rules of released records; each must be true."""
    c, rule = F.col, F.col("task_type") == "rule_identification"
    repair = c("task_type").isin("correction", "joint")
    none = c("normalization_status") == "no_recognized_array"
    return {
        "condition": c("condition").isin(CONDITIONS),
        "task": c("task_type").isin(TASKS),
        "summary status": c("summary_status").isin(SUMMARY_STATUS),
        "id": c("base_snippet_id").rlike("^sha256:[0-9a-f]{64}$"),
        "counts": (c("prompt_tokens") > 0) & (c("retokenized_response_token_proxy") >= 0),
        "latency": c("latency_ms").isNull() | (constraints.finite(c("latency_ms")) & (c("latency_ms") >= 0)),
        "targets": F.size(F.array_except("target_checks", F.array(*map(F.lit, CHECKS)))) == 0,
        "rule fields": rule == c("pred").isNotNull(),
        "outcome": repair == c("outcome").isNotNull(),
        "empty answer": ~rule | ~none | (F.size("pred") == 0),
        "emitted": ~rule | (c("n_emitted") >= F.size("pred") + c("rejected_label_count")),
        "similarity": c("extracted_similarity").isNull() == c("sensitivity_class").isNull(),
    }


def validate(records: DataFrame) -> None:
    """Row rules, unique keys and, for each run, the complete grid of ids and tasks."""
    constraints.require(constraints.failing(records, ["base_snippet_id", "condition", "seed", "task_type"], record_checks()), "record rule")
    constraints.require(constraints.duplicate_keys(records, ["condition", "seed", "base_snippet_id", "task_type"]), "unique record")
    constraints.require(constraints.grid_gaps(records, [["condition", "seed"], ["base_snippet_id"], ["task_type"]]), "complete grid")


def scored_ids(rows: DataFrame) -> DataFrame:
    """Test snippets that the oracle did not exclude and that are not quarantined."""
    return rows.where((F.col("split") == "test") & (F.col("oracle.status") != "excluded") & ~F.coalesce("quarantined", F.lit(False))).select("base_snippet_id")


def scored(records: DataFrame, rows: DataFrame) -> DataFrame:
    return records.join(scored_ids(rows), "base_snippet_id", "left_semi")


def success(records: DataFrame) -> DataFrame:
    """Adds 0/1 success: exact labels, or a fix without regression."""
    s = F.when(F.col("task_type") == "rule_identification", F.col("exact_match")).otherwise(F.col("outcome.overall_fixed"))
    return records.withColumn("success", s.cast("double"))


def rank_of(c: Column, values: list[str]) -> Column:
    return F.array_position(F.array(*map(F.lit, values)), c)


def table_8_1(records: DataFrame) -> DataFrame:
    """Mean and deviation over seeds of five metrics by condition; macro-F1 is averaged after, not before, the seeds."""
    by = ["condition", "seed"]
    rule = records.where(F.col("task_type") == "rule_identification")
    wide = labels.headline(rule, "pred", "gold", CHECKS, by)
    fixed = F.col("outcome.overall_fixed").cast("double")
    fixes = records.groupBy(*by).agg(F.avg(F.when(F.col("task_type") == "correction", fixed)).alias("correction_fix_rate"), F.avg(F.when(F.col("task_type") == "joint", fixed)).alias("joint_fix_rate"))
    long = wide.join(fixes, by).unpivot(by, ["exact_match", "micro_f1", "macro_f1", "correction_fix_rate", "joint_fix_rate"], "metric", "value")
    out = stats.repeat_mean_sd(long, ["condition", "metric"], "value")
    return out.select("condition", "metric", (F.col("mean") * 100).alias("mean"), (F.col("sd") * 100).alias("sd"))


def repair_predicates() -> dict[str, Column]:
    o = F.col("outcome")
    via = lambda s: o["extraction_status"] == s
    return {"extraction_success": o["extracted"], "go_fence": via("go_block"), "untagged_fence": via("fenced_block"), "parse_probe": via("largest_parseable"), "parse_validity": o["parse_ok"], "target_fixed": o["target_fixed"], "regression_adjusted_fix": o["overall_fixed"]}


def repairs(records: DataFrame) -> DataFrame:
    return records.where(F.col("condition").isin(TUNED) & F.col("task_type").isin("correction", "joint"))


def table_8_2(records: DataFrame) -> DataFrame:
    """Shares of repair stages by condition and task, seeds pooled."""
    out = stats.wide_conditional(repairs(records), ["condition", "task_type"], repair_predicates(), "share")
    return out.withColumn("value", F.col("value") * 100)


def task_differences(records: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Unit differences from C0 of C1 and C2 by task (and ``by``), with the contrasts' seeds."""
    by, rows = by or [], success(records.where(F.col("condition").isin("C0", "C1", "C2") & (F.col("task_type") != "explanation")))
    picks = [F.max(F.when(F.col("condition") == c, F.col("success"))).alias(c) for c in ("C0", "C1", "C2")]
    grid = rows.groupBy(*by, "task_type", "base_snippet_id", "seed").agg(*picks)
    means = grid.groupBy(*by, "task_type", "base_snippet_id").agg(F.avg(F.col("C1") - F.col("C0")).alias("C1"), F.avg(F.col("C2") - F.col("C0")).alias("C2"))
    long = means.unpivot([*by, "task_type", "base_snippet_id"], ["C1", "C2"], "against", "difference")
    seed = F.create_map(*[x for (t, c), s in CONTRAST_SEEDS.items() for x in (F.lit(f"{t}:{c}"), F.lit(s))])[F.concat_ws(":", "task_type", "against")]
    return long.withColumn("seed", seed)


def table_8_3(records: DataFrame, draws: int = 10_000) -> DataFrame:
    """Paired contrasts with 95 % intervals."""
    out = resample.stream_intervals(task_differences(records), ["task_type", "against", "seed"], "base_snippet_id", "difference", draws)
    return out.select("task_type", "against", *[(F.col(c) * 100).alias(c) for c in ("point", "low", "high")], "p_value", "n_units")


def table_8_4(records: DataFrame) -> DataFrame:
    """Outcome categories by condition and task."""
    return stats.crosstab(repairs(records).withColumn("category", F.col("outcome.category")), ["condition", "task_type"], "category", CATEGORIES)


def contributions(rows: DataFrame) -> DataFrame:
    return rows.select("base_snippet_id", F.inline("training_contributions"))


def table_8_5(rows: DataFrame) -> DataFrame:
    """Training length percentiles by condition and task, contributions counted with their multiplicity."""
    return stats.nearest_rank(contributions(rows), ["condition", "task_type"], "total_tokens", weight=F.col("multiplicity"))


def same_main_training(rows: DataFrame, a: str = "C1", b: str = "C2") -> bool:
    """Whether two conditions' main contributions are one bag."""
    side = lambda c: contributions(rows).where((F.col("condition") == c) & (F.col("pool") == "main")).drop("condition")
    return constraints.bag_difference(side(a), side(b)).isEmpty()


def table_8_6(results: DataFrame) -> DataFrame:
    """Means over seeds of compute quantities in their units, by condition."""
    means = [(F.avg(f"metrics.compute.{c}") / d).alias(k) for k, (c, d) in COMPUTE.items()]
    return results.where(F.col("condition").isin(TUNED)).groupBy("condition").agg(*means).unpivot(["condition"], list(COMPUTE), "quantity", "value")


def check_f1(records: DataFrame, conditions: list[str]) -> DataFrame:
    """F1 of each check by condition: the mean over its seeds."""
    rule = records.where((F.col("task_type") == "rule_identification") & F.col("condition").isin(conditions))
    return labels.per_class_prf(rule, "pred", "gold", CHECKS, ["condition", "seed"]).groupBy("condition", "class").agg((F.avg("f1") * 100).alias("f1"), F.min(F.col("tp") + F.col("fn")).alias("support"))


def table_8_7(records: DataFrame) -> DataFrame:
    """Support, F1 and joint fix rate of each check by condition, with differences from C0."""
    joint = records.where((F.col("task_type") == "joint") & F.col("condition").isin("C0", "C1", "C2")).select("condition", "base_snippet_id", "seed", F.explode("target_checks").alias("class"), F.col("outcome.overall_fixed").cast("double").alias("fixed"))
    fix = joint.groupBy("condition", "class", "base_snippet_id").agg(F.avg("fixed").alias("m")).groupBy("condition", "class").agg((F.avg("m") * 100).alias("joint_fix"))
    both = check_f1(records, ["C0", "C1", "C2"]).join(fix, ["condition", "class"], "left")
    base = both.where("condition = 'C0'").select("class", F.col("f1").alias("_f"), F.col("joint_fix").alias("_j"))
    return both.join(base, "class").select("class", "condition", "support", "f1", "joint_fix", (F.col("f1") - F.col("_f")).alias("f1_delta"), (F.col("joint_fix") - F.col("_j")).alias("joint_fix_delta"))


def bins() -> dict[str, Column]:
    v, n, d = F.col("violation_count"), F.col("source_line_count"), F.col("serializer.maximum_depth")
    return {"violations_1": v == 1, "violations_2_plus": v >= 2, "length_lt_50": n < 50, "length_50_199": (n >= 50) & (n < 200), "length_200_plus": n >= 200, "depth_0_1": d <= 1, "depth_2_3": (d >= 2) & (d <= 3), "depth_gt_3": d > 3}


def table_8_8(records: DataFrame, rows: DataFrame, draws: int = 10_000) -> DataFrame:
    """C0 baselines and contrasts in every stratum, for rule identification and joint repair; all contrasts in one pass."""
    where = strata.stratify(rows.select("base_snippet_id", "violation_count", "source_line_count", "serializer"), bins()).select("base_snippet_id", "stratum")
    two = records.where(F.col("task_type").isin("rule_identification", "joint")).join(where, "base_snippet_id")
    base = success(two.where("condition = 'C0'")).groupBy("stratum", "task_type", "base_snippet_id").agg(F.avg("success").alias("m")).groupBy("stratum", "task_type").agg((F.avg("m") * 100).alias("baseline"))
    diff = task_differences(two, ["stratum"]).withColumn("seed", F.lit(42))
    out = resample.stream_intervals(diff, ["stratum", "task_type", "against", "seed"], "base_snippet_id", "difference", draws)
    return out.join(base, ["stratum", "task_type"]).select("stratum", "task_type", "against", "baseline", *[(F.col(c) * 100).alias(c) for c in ("point", "low", "high")], "n_units")


def table_8_9(records: DataFrame) -> DataFrame:
    """F1 of each check without tuning and for C0."""
    return check_f1(records, ["zero-shot-raw", "zero-shot-syntax", "C0"])


def zero_shot_transition(records: DataFrame, task: str) -> DataFrame:
    rows = success(records.where((F.col("task_type") == task) & F.col("condition").isin("zero-shot-raw", "zero-shot-syntax")))
    grid = paired.paired_grid(rows, "base_snippet_id", "seed", "condition", ["zero-shot-raw", "zero-shot-syntax"], "success")
    return paired.transition(grid, "zero-shot-raw", "zero-shot-syntax")


def rq3_contrasts(records: DataFrame, draws: int = 10_000) -> DataFrame:
    """The joint task's effect of C1 less that of each single task, by unit."""
    diff = task_differences(records).where("against = 'C1'").groupBy("base_snippet_id").pivot("task_type", TASKS[:3]).agg(F.max("difference"))
    long = diff.select("base_snippet_id", (F.col("joint") - F.col("rule_identification")).alias("rule_identification"), (F.col("joint") - F.col("correction")).alias("correction")).unpivot(["base_snippet_id"], ["rule_identification", "correction"], "reference", "difference")
    out = resample.stream_intervals(long, ["reference"], "base_snippet_id", "difference", draws, seed=42)
    return out.withColumn("reject", F.col("low") > 0)


def error_leaves(records: DataFrame) -> DataFrame:
    """Snippets correct in all, any and two or more seeds by condition and task."""
    by = stats.over_repeats(success(records), ["condition", "task_type", "base_snippet_id"], F.col("success") > 0)
    return by.groupBy("condition", "task_type").agg(F.count_if("all").alias("all_seeds"), F.count_if("any").alias("any_seed"), F.count_if("at_least").alias("two_or_more"), F.count("*").alias("n"))


def unique_wins(records: DataFrame, task: str = "joint") -> DataFrame:
    """By seed, snippets that only C2 of C0, C1 and C2 solves."""
    rows = success(records.where((F.col("task_type") == task) & F.col("condition").isin("C0", "C1", "C2")))
    grid = paired.paired_grid(rows, "base_snippet_id", "seed", "condition", ["C0", "C1", "C2"], "success")
    return grid.where("C2 > 0 and C0 = 0 and C1 = 0").groupBy("base_snippet_id").agg(F.count("*").alias("seeds"))


def dataset_leaves(rows: DataFrame) -> DataFrame:
    """Row counts by split and task with margins."""
    return stats.margins(rows.select("split", F.explode("task_types").alias("task_type")), "split", "task_type")


def repository_overlap(rows: DataFrame) -> DataFrame:
    """Repository groups shared by train and test, and test rows in them."""
    per = rows.groupBy("repository_group_id").agg(F.count_if(F.col("split") == "train").alias("a"), F.count_if(F.col("split") == "test").alias("b"))
    both = (F.col("a") > 0) & (F.col("b") > 0)
    return per.agg(F.count_if(both).alias("groups"), F.coalesce(F.sum(F.when(both, F.col("b"))), F.lit(0)).alias("test_rows"), F.count("*").alias("all_groups"))


def exclusion_mechanisms(rows: DataFrame) -> DataFrame:
    """Excluded evaluation rows by mechanism; a row that no mechanism explains is an error."""
    missing, extra = F.col("oracle.missing_checks"), F.col("oracle.extra_checks")
    some, more = F.size(missing) > 0, F.size(extra) > 0
    kind = (
        F.when(~some & more, "extra_detection")
        .when(F.to_json(missing) == '["paramTypeCombine"]', F.when(~more, "multiline_param"))
        .when(some & ~more & labels.same_set(missing, "target_checks"), "generated_suppression")
    )
    told = F.coalesce(kind, F.raise_error(F.concat(F.lit("unexplained exclusion "), F.col("base_snippet_id"))).cast("string"))
    excluded = rows.where(F.col("split").isin("validation", "test") & (F.col("oracle.status") == "excluded"))
    return excluded.groupBy(told.alias("mechanism")).agg(F.count("*").alias("n"))


def label_normalisation(records: DataFrame) -> DataFrame:
    """Rejected over emitted labels by condition."""
    rule = records.where(F.col("task_type") == "rule_identification").groupBy("condition").agg(F.sum("rejected_label_count").alias("rejected"), F.sum("n_emitted").alias("emitted"))
    return rule.withColumn("share", labels.ratio(F.col("rejected"), F.col("emitted")))


def regressions(records: DataFrame) -> DataFrame:
    """Known regressions by condition and task: unknown ones are not counted as false."""
    r = F.coalesce(F.col("outcome.studied_regression"), F.lit(False))
    return repairs(records).groupBy("condition", "task_type").agg(F.count_if(r).alias("regressions"), F.count("*").alias("n"), (F.avg(r.cast("double")) * 100).alias("percent"))


def prompt_distribution(records: DataFrame) -> DataFrame:
    return stats.nearest_index(records, ["condition", "task_type"], "prompt_tokens")


def discordance(records: DataFrame, task: str, a: str = "C1", b: str = "C0") -> DataFrame:
    rows = success(records.where((F.col("task_type") == task) & F.col("condition").isin(a, b)))
    return paired.discordance(paired.paired_grid(rows, "base_snippet_id", "seed", "condition", [a, b], "success"), "seed", a, b)


def run_accounting(results: DataFrame) -> DataFrame:
    """Sweep hours and overheads of C1 over C0 in percent, from run results."""
    c = lambda k: F.col(f"metrics.compute.{k}")
    over = lambda k: (F.avg(F.when(F.col("condition") == "C1", c(k))) / F.avg(F.when(F.col("condition") == "C0", c(k))) - 1) * 100
    tuned = results.where(F.col("condition").isin(TUNED))
    return tuned.agg((F.sum(c("wall_clock_train_s")) / 3600).alias("training_hours"), (F.sum(c("wall_clock_total_s")) / 3600).alias("total_hours"), over("wall_clock_train_s").alias("training_time_over"), over("wall_clock_total_s").alias("total_time_over"), over("total_tokens").alias("tokens_over"), over("peak_allocated_gpu_memory_gib").alias("memory_over"))


def selected_steps(trace: DataFrame) -> DataFrame:
    """The first best checkpoint of each run."""
    return stats.first_best(trace, ["condition", "seed"], "step", "composite_score")
