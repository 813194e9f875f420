"""A study's bundle: configuration, runs, study rows, metadata and inventory, read once and checked exactly.

``load_bundle`` is where an analysis starts. Every file is parsed once into typed tables; rules on fields that depend on
each other, run matrices, identities across files and selection traces are checked as queries over those tables. The
study's own fixed values (revisions, commits, counts) come in as a ``Study``.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalloom.operators import constraints
from evalloom.operators.constraints import ConstraintError
from evalloom.plans import prepared, study
from evalloom.sources import strict
from evalloom.sources.landing import landed

RUN_FILES = ["manifest.yaml", "records.jsonl", "results.yaml", "selection_trace.json"]
SELECTION = "selected_step bigint, best_composite double, rule_id_macro_f1 double, correction_fix_rate double, joint_fix_rate double"
COMPUTE = "optimizer_steps bigint, examples_seen bigint, total_tokens bigint, supervised_tokens bigint, peak_allocated_gpu_memory_gib double, wall_clock_train_s double, wall_clock_total_s double"
LENGTH = "allowed_max_length bigint, realized_truncation bigint"
PROVENANCE = "dataset_revision string not null, model_identifier string not null, data_fraction double not null, historical_source_commit string not null, run_kind string not null"
IDENTITY = "historical_run_id string not null, condition string not null, seed bigint not null, profile string not null"
RESULTS_DDL = f"{IDENTITY}, metrics struct<checkpoint_selection: struct<{SELECTION}>, compute: struct<{COMPUTE}>, length: struct<{LENGTH}>, provenance: struct<{PROVENANCE}>> not null"
MANIFEST_DDL = f"{IDENTITY}, dataset_revision string not null, historical_source_commit string not null, configuration_id string not null"
TRACE_DDL = "step bigint not null, validation_loss double not null, composite_score double not null, rule_id_macro_f1 double not null, correction_fix_rate double not null, joint_fix_rate double not null"
CONTRIBUTION = "condition string not null, pool string not null, task_type string not null, prompt_tokens bigint not null, response_tokens bigint not null, total_tokens bigint not null, multiplicity bigint not null"
PAIR = "other_base_snippet_id string not null, kind string not null, threshold double, score double, matched boolean not null"
STUDY_DDL = f"""base_snippet_id string not null, split string not null, task_types array<string> not null, target_checks array<string> not null, violation_count bigint not null,
repository_group_id string not null, length_excluded boolean not null, quarantined boolean not null, oracle struct<status: string not null, missing_checks: array<string> not null, extra_checks: array<string> not null> not null,
source_line_count bigint not null, serializer struct<parse_ok: boolean not null, parse_strategy: string, excluded_construct_count: bigint not null, maximum_depth: bigint not null, summary_status: string not null> not null,
dataset_qc struct<exact_collision: boolean not null, canonical_normalization_sampled: boolean not null, canonical_normalization_changed: boolean not null, pair_indicators: array<struct<{PAIR}>> not null> not null,
reference_qc struct<correction_status: string not null, explanation_present: boolean not null, primary_category_a: boolean, secondary_category_a: boolean, normalized_fixes_equal: boolean, selected_generator_role: string not null, generation_attempts: bigint not null, skip_mechanism: string not null, generated_marker_retained: boolean not null, accepted_correction_byte_identical: boolean, build_status: string not null> not null,
training_contributions array<struct<{CONTRIBUTION}>> not null, serializer_audit_stage1_pool_member boolean not null,
serializer_audit struct<parse_bucket: string not null, length_bucket: string not null, depth_bucket: string not null, summary_line_count: bigint not null, faithful: boolean, relevant_omission: boolean, known_loss_categories: array<string> not null, has_note: boolean not null, closure_scored: boolean not null>,
violation_in_closure boolean, license_class string not null"""
CONDITION_DDL = "kind string not null, path string not null, seeds array<bigint> not null, configuration_id string not null, use_summary boolean, auxiliary_pool string, auxiliary_ratio double, prompt_form string"
INVENTORY_DDL = "schema_version bigint not null, results array<struct<id: string not null, manuscript_locations: array<string> not null, target: struct<kind: string not null, file: string not null, identifier: string, row: string, column: string> not null>> not null"
# Statuses of the study's tools.
TOOL_STATUS = ["ok", "load_degraded", "load_failed"]
BUILD_STATUS = ["OK", "NA", "FAIL"]
SENSITIVITY = ["same_file_truncated", "same_pkg_no_shared_func"]
SHA = "^sha256:[0-9a-f]{64}$"


@dataclass(frozen=True)
class Study:
    """What a bundle must hold: conditions in order, each with its row of the matrix, and the identities files share."""

    conditions: dict[str, dict]
    revision: str
    model: str
    commits: dict[str, str]
    profiles: dict[str, dict]
    tasks: list[str] = field(default_factory=lambda: study.TASKS)
    checks: list[str] = field(default_factory=lambda: study.CHECKS)
    steps: list[int] = field(default_factory=lambda: [120, 240, 360, 480, 600])
    counts: dict[str, int] = field(default_factory=dict)

    def runs(self) -> list[tuple[str, str, int, str, str]]:
        """(condition, path, seed, kind, configuration_id) in order."""
        return [(c, r["path"], s, r["kind"], r["configuration_id"]) for c, r in self.conditions.items() for s in r["seeds"]]


class Bundle(NamedTuple):
    config: dict
    runs: DataFrame
    records: DataFrame
    results: DataFrame
    manifests: DataFrame
    traces: DataFrame
    study_rows: DataFrame
    scored: DataFrame
    metadata: dict | None
    inventory: DataFrame | None


def record_rules(tasks: list[str], checks: list[str]) -> dict[str, Column]:
    """Fields of a record that depend on its task and on each other: the task names which of the four kinds a record is."""
    c = F.col
    rule, repair = c("task_type") == "rule_identification", c("task_type").isin("correction", "joint")
    known = F.array(*map(F.lit, checks))
    among = lambda x: F.coalesce(F.size(F.array_except(x, known)) == 0, F.lit(True))
    mine = ["gold", "pred", "rejected_label_count", "exact_match", "n_emitted", "normalization_status"]
    none = c("normalization_status") == "no_recognized_array"
    whole = F.lit(True)
    for f in study.ddl(f"o {study.OUTCOME_DDL}")["o"].dataType.names:
        whole = whole & (F.lit(f in ("studied_regression", "enabled_regression")) | c(f"outcome.{f}").isNotNull())
    findings = F.coalesce(F.forall("outcome.residual_findings", lambda x: (x["line"] > 0) & (x["column"] > 0)), F.lit(True))
    out = {
        "base_snippet_id": c("base_snippet_id").rlike(SHA),
        "task_type": c("task_type").isin(tasks),
        "summary_status": c("summary_status").isin(study.SUMMARY_STATUS),
        "prompt_tokens": c("prompt_tokens") >= 0,
        "retokenized_response_token_proxy": c("retokenized_response_token_proxy") >= 0,
        "target_checks": among(c("target_checks")),
        "gold": among(c("gold")),
        "pred": among(c("pred")),
        "no_recognized_array needs empty pred and zero counts": ~rule | ~none | ((F.size("pred") == 0) & (c("n_emitted") == 0) & (c("rejected_label_count") == 0)),
        "n_emitted is no less than kept and rejected labels": ~rule | (c("n_emitted") >= F.size("pred") + c("rejected_label_count")),
        "outcome": repair == c("outcome").isNotNull(),
        "outcome.category": ~repair | c("outcome.category").isin(study.CATEGORIES),
        "outcome.extraction_status": ~repair | c("outcome.extraction_status").isin("go_block", "fenced_block", "largest_parseable", "failed"),
        "outcome.original_tool_status": ~repair | c("outcome.original_tool_status").isin(TOOL_STATUS),
        "outcome.output_tool_status": ~repair | c("outcome.output_tool_status").isin(TOOL_STATUS),
        "outcome.build_status": ~repair | c("outcome.build_status").isin(BUILD_STATUS),
        "outcome is complete": ~repair | whole,
        "outcome.residual_findings": ~repair | findings,
        "extracted_similarity": c("extracted_similarity").isNull() | (repair & c("extracted_similarity").between(0, 1)),
        "sensitivity_class": c("sensitivity_class").isNull() | (repair & c("sensitivity_class").isin(SENSITIVITY)),
        "normalization_status": ~rule | c("normalization_status").isin("recognized_array", "no_recognized_array"),
    }
    # fields of rule identification, and of it alone
    return out | {f"{f} of rule_identification": rule == c(f).isNotNull() for f in mine}


def result_rules() -> dict[str, Column]:
    """Tuned runs have all of selection, compute and length, zero-shot runs none; counts aren't negative."""
    m = "metrics"
    parts = {"checkpoint_selection": SELECTION, "compute": COMPUTE, "length": LENGTH}
    cells = [F.col(f"{m}.{p}.{x.split()[0]}") for p, ddl in parts.items() for x in ddl.split(", ")]
    zero = F.col("condition").startswith("zero-shot")
    none, all_ = F.lit(True), F.lit(True)
    for x in cells:
        none, all_ = none & x.isNull(), all_ & x.isNotNull()
    positive = F.lit(True)
    for x in cells[5:]:
        positive = positive & (x.isNull() | (x >= 0))
    return {"run kind": F.col(f"{m}.provenance.run_kind") == F.when(zero, "zero_shot").otherwise("fine_tuned"), "null fields of zero-shot results, complete fields of tuned ones": F.when(zero, none).otherwise(all_), "negative count": positive, "data_fraction": F.col(f"{m}.provenance.data_fraction") == 1.0}


def study_rules(tasks: list[str], checks: list[str]) -> dict[str, Column]:
    c = F.col
    known, kinds = F.array(*map(F.lit, checks)), F.array(*map(F.lit, tasks))
    pairs = F.forall(
        "dataset_qc.pair_indicators",
        lambda p: F.when(p["kind"] == "near_duplicate", p["threshold"].isNotNull() & p["score"].isNotNull() & (p["matched"] == (p["score"] >= p["threshold"])))
        .when(p["kind"] == "aggressive_normalization", p["threshold"].isNull() & p["score"].isNull() & p["matched"])
        .otherwise(F.lit(False)),
    )
    ser = "serializer"
    return {
        "base_snippet_id": c("base_snippet_id").rlike(SHA),
        "split": c("split").isin(prepared.SPLITS),
        "task_types": F.size(F.array_except("task_types", kinds)) == 0,
        "target_checks": F.size(F.array_except("target_checks", known)) == 0,
        "repository_group_id": c("repository_group_id").rlike("^repository-group-[0-9]{4}$"),
        "oracle.status": c("oracle.status").isin("reproduced", "excluded", "fixture_fix", "not_applicable"),
        "parse_ok needs a strategy, a failure none": c(f"{ser}.parse_ok") == c(f"{ser}.parse_strategy").isNotNull(),
        "failed summary is parse failure": (c(f"{ser}.summary_status") == "failed") == ~c(f"{ser}.parse_ok"),
        "pair_indicators": pairs,
        "training_contributions": F.forall("training_contributions", lambda t: (t["prompt_tokens"] >= 0) & (t["response_tokens"] >= 0) & (t["total_tokens"] >= 0) & (t["multiplicity"] > 0)),
        "counts": (c("violation_count") >= 0) & (c("source_line_count") > 0) & (c(f"{ser}.maximum_depth") >= 0) & (c(f"{ser}.excluded_construct_count") >= 0),
        "license_class": c("license_class").isin("permissive", "no_detected_license"),
    }


def _refuse(bad: DataFrame, what: str) -> None:
    """Raises with the file and record of the first violation."""
    for r in bad.take(1):
        d = r.asDict()
        where = d.pop("_file", None)
        raise ConstraintError(f"{where}: {what}: " + ", ".join(f"{k} {v}" for k, v in d.items()))


def load_config(spark: SparkSession, path: str, want: Study) -> dict:
    """The experiment file: exactly the study's profiles, and its conditions in order with exactly its rows."""
    conditions = T.MapType(T.StringType(), study.ddl(CONDITION_DDL), False)
    identity = lambda *names: T.StructType([T.StructField(n, T.StringType(), False) for n in names])
    kinds = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType()}

    def typed(v: object) -> T.DataType:
        if isinstance(v, dict):
            return T.StructType([T.StructField(k, typed(x), x is None) for k, x in v.items()])
        return T.ArrayType(typed(v[0]), False) if isinstance(v, list) else kinds[type(v)]

    shape = T.StructType([
        T.StructField("schema_version", T.LongType(), False),
        T.StructField("dataset", identity("identifier", "doi", "revision"), False),
        T.StructField("model", identity("identifier"), False),
        T.StructField("profiles", typed(want.profiles), False),
        T.StructField("conditions", conditions, False),
    ])
    got = strict.require_parsed(strict.parsed_documents(spark, path, shape, strict.load_yaml)).select("value.*").first().asDict(True)
    if got["schema_version"] != 1:
        raise ConstraintError(f"{path}: schema_version is not 1")
    if got["profiles"] != want.profiles:
        name = next(k for k in want.profiles if got["profiles"][k] != want.profiles[k])
        field_ = next((k for k in want.profiles[name] if got["profiles"][name].get(k) != want.profiles[name][k]), "")
        raise ConstraintError(f"{path}: profiles.{name}.{field_} differs from the study's")
    if list(got["conditions"]) != list(want.conditions):
        raise ConstraintError(f"{path}: conditions are not exactly {list(want.conditions)}, in order")
    blank = dict.fromkeys(study.ddl(CONDITION_DDL).names)
    for c, row in want.conditions.items():
        if got["conditions"][c] != blank | row:
            bad = next(k for k in blank if got["conditions"][c][k] != (blank | row)[k])
            raise ConstraintError(f"{path}: conditions.{c}.{bad} is not the study's: a condition's path, seeds and settings are fixed")
    if got["dataset"]["revision"] != want.revision or got["model"]["identifier"] != want.model:
        raise ConstraintError(f"{path}: dataset revision or model isn't the study's")
    return got


def load_study_rows(spark: SparkSession, path: str, want: Study) -> DataFrame:
    rows = strict.require_parsed(strict.parsed_lines(spark, path, study.ddl(STUDY_DDL), "base_snippet_id")).select("_file", "value.*")
    if rows.isEmpty():
        raise ConstraintError(f"{path}: no rows")
    _refuse(constraints.failing(rows, ["_file", "base_snippet_id"], study_rules(want.tasks, want.checks)), "study row")
    constraints.require(constraints.duplicate_keys(rows, ["base_snippet_id"]), f"{path}: unique snippet ids")
    return rows.drop("_file")


def load_inventory(spark: SparkSession, path: str) -> DataFrame:
    """(id, manuscript_locations, target) of each result; ids and targets are unique."""
    doc = strict.require_parsed(strict.parsed_documents(spark, path, study.ddl(INVENTORY_DDL), strict.load_yaml))
    rows = doc.select(F.explode("value.results").alias("r")).select("r.*")
    constraints.require(constraints.duplicate_keys(rows, ["id"]), f"{path}: unique result ids")
    constraints.require(constraints.duplicate_keys(rows, ["target"]), f"{path}: unique output targets")
    return rows


def load_runs(spark: SparkSession, root: str, want: Study, test_ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(runs, records, results, manifests, traces) of every expected run under ``root``, checked within and across files."""
    runs = spark.createDataFrame(want.runs(), "run_condition string, path string, run_seed long, kind string, configuration string")
    folders = strict.check_runs(spark, root, [(p, s) for _, p, s, _, _ in want.runs()], RUN_FILES)
    each = lambda name: [f"{f}/{name}" for f in folders]
    on = ["path", "run_seed"]

    def documents(name: str, kind: T.DataType, load) -> DataFrame:
        return strict.placed(strict.require_parsed(strict.parsed_documents(spark, each(name), kind, load)), name).join(runs, on)

    results = documents("results.yaml", study.ddl(RESULTS_DDL), strict.load_yaml).select("_file", "value.*", *on, "run_condition", "kind", "configuration")
    manifests = documents("manifest.yaml", study.ddl(MANIFEST_DDL), strict.load_yaml).select("_file", "value.*", *on)
    points = documents("selection_trace.json", T.ArrayType(study.ddl(TRACE_DDL), False), strict.strict_loads)
    records = strict.placed(strict.require_parsed(strict.parsed_lines(spark, each("records.jsonl"), study.ddl(study.RECORD_DDL), "base_snippet_id")), "records.jsonl")
    records = landed(records.join(runs, on).select("_file", "value.*", *on, "run_condition"), "bundle-records")

    _refuse(constraints.failing(records, ["_file", "base_snippet_id"], record_rules(want.tasks, want.checks)), "record")
    elsewhere = ~F.col("condition").eqNullSafe(F.col("run_condition")) | ~F.col("seed").eqNullSafe(F.col("run_seed"))
    _refuse(records.where(elsewhere).select("_file", "base_snippet_id", "condition", "seed"), "record condition or seed isn't its run's")
    _refuse(constraints.duplicate_keys(records, ["_file", "base_snippet_id", "task_type"]), "duplicate cell of the record matrix")
    cells = records.groupBy(*on, "base_snippet_id").agg(F.count("*").alias("n"), F.any_value("_file").alias("_file")).where(F.col("n") != len(want.tasks))
    _refuse(cells.select("_file", "base_snippet_id", "n"), "incomplete record matrix")
    held = runs.join(records.groupBy(*on).agg(F.count("*").alias("n")), on, "left").select(*on, F.coalesce("n", F.lit(0)).alias("n"))
    if "records" in want.counts:
        constraints.require(held.where(F.col("n") != want.counts["records"]), f"a run has {want.counts['records']} records")
    if test_ids is not None:
        ids = records.select(*on, "base_snippet_id").distinct()
        missing = runs.select(*on).crossJoin(test_ids).join(ids, [*on, "base_snippet_id"], "left_anti")  # runs, a dimension, by ids
        constraints.require(missing, "every run has every test id")
        constraints.require(constraints.outside(ids, test_ids, ["base_snippet_id"]), "a run's ids are test ids")

    _refuse(constraints.failing(results, ["_file", "historical_run_id"], result_rules()), "run results")
    other = manifests.select(*on, *[F.col(c).alias(f"m_{c}") for c in study.ddl(MANIFEST_DDL).names])
    both = results.join(other, on)
    commit = F.create_map(*[F.lit(x) for kv in want.commits.items() for x in kv])
    prov, c = "metrics.provenance", F.col
    agree = {
        "run id": c("historical_run_id") == c("m_historical_run_id"),
        "condition": (c("condition") == c("run_condition")) & (c("m_condition") == c("run_condition")),
        "seed": (c("seed") == c("run_seed")) & (c("m_seed") == c("run_seed")),
        "profile": c("profile").isin(list(want.profiles)) & (c("m_profile") == c("profile")),
        "dataset revision": (c(f"{prov}.dataset_revision") == want.revision) & (c("m_dataset_revision") == want.revision),
        "model": c(f"{prov}.model_identifier") == want.model,
        "source commit (provenance)": (c(f"{prov}.historical_source_commit") == F.try_element_at(commit, c("kind"))) & (c("m_historical_source_commit") == F.try_element_at(commit, c("kind"))),
        "configuration": c("m_configuration_id") == c("configuration"),
    }
    _refuse(constraints.failing(both, ["_file", "historical_run_id"], agree), "identities must agree")
    constraints.require(constraints.duplicate_keys(results, ["historical_run_id"]), "unique run ids")

    _refuse(points.where((F.col("kind") == "zero_shot") & (F.size("value") > 0)).select("_file"), "selection trace of a zero-shot run must be empty")
    tuned = points.where(F.col("kind") != "zero_shot")
    _refuse(tuned.where(F.transform("value", lambda p: p["step"]) != F.array(*[F.lit(s).cast("long") for s in want.steps])).select("_file", F.transform("value", lambda p: p["step"]).alias("steps")), "selection trace has other steps")
    traces = points.select("_file", *on, F.col("run_condition").alias("condition"), F.explode("value").alias("p")).select("_file", *on, "condition", F.col("run_seed").alias("seed"), "p.*")
    s = "metrics.checkpoint_selection"
    chosen = results.where("kind <> 'zero_shot'").select(*on, c(f"{s}.selected_step").alias("step"), *[c(f"{s}.{k}").alias(f"r_{k}") for k in ("best_composite", "rule_id_macro_f1", "correction_fix_rate", "joint_fix_rate")])
    at = chosen.join(traces, [*on, "step"], "left")
    same = at["composite_score"].eqNullSafe(c("r_best_composite"))
    for k in ("rule_id_macro_f1", "correction_fix_rate", "joint_fix_rate"):
        same = same & c(k).eqNullSafe(c(f"r_{k}"))
    constraints.require(at.where(~same).select(*on, "step"), "selected point disagrees with the selection")
    return runs, records.drop("_file", "run_condition"), results.drop("_file", "run_condition", "kind", "configuration"), manifests.drop("_file"), traces.drop("_file")


def select_scored(records: DataFrame, rows: DataFrame, want: Study) -> DataFrame:
    """Records of scored test ids, in the study's order; the test population and every run's counts are exact."""
    test = rows.where("split = 'test'")
    one = {
        "test": (F.col("split") == "test"),
        "excluded": (F.col("split") == "test") & (F.col("oracle.status") == "excluded"),
        "quarantined": (F.col("split") == "test") & F.col("quarantined"),
    }
    constraints.require(constraints.cardinalities(rows, {k: (v, want.counts[k]) for k, v in one.items() if k in want.counts}), "scored population")
    constraints.require(constraints.outside(records, test.select("base_snippet_id"), ["base_snippet_id"]), "records of test ids")
    kept = study.scored(records, rows)
    if "scored" in want.counts:
        per = kept.groupBy("condition", "seed").agg(F.count("*").alias("n")).where(F.col("n") != want.counts["scored"])
        constraints.require(per, f"a run has {want.counts['scored']} scored records")
    return kept.withColumn("_rank", study.rank_of(F.col("condition"), list(want.conditions))).withColumn("_task", study.rank_of(F.col("task_type"), want.tasks)).orderBy("_rank", "seed", "base_snippet_id", "_task").drop("_rank", "_task")


def load_bundle(spark: SparkSession, root: str, want: Study, metadata: T.StructType | None = None) -> Bundle:
    """Everything under ``root``: config/experiments.yaml, data/runs, data/study, and the inventory of results if there is one."""
    config = load_config(spark, f"{root}/config/experiments.yaml", want)
    rows = load_study_rows(spark, f"{root}/data/study/analysis_inputs.jsonl", want)
    test_ids = rows.where("split = 'test'").select("base_snippet_id")
    runs, records, results, manifests, traces = load_runs(spark, f"{root}/data/runs", want, test_ids)
    present = dict(strict.entries(spark, f"{root}/data/study") or [])
    meta = None
    if metadata is not None:
        if "analysis_metadata.yaml" not in present:
            raise ConstraintError(f"{root}/data/study/analysis_metadata.yaml is missing")
        meta = strict.read_yaml(spark, f"{root}/data/study/analysis_metadata.yaml", metadata).first().asDict(True)
    inventory = f"{root}/config/manuscript_results.yaml"
    known = dict(strict.entries(spark, f"{root}/config") or [])
    return Bundle(config, runs, records, results, manifests, traces, rows, select_scored(records, rows, want), meta, load_inventory(spark, inventory) if "manuscript_results.yaml" in known else None)
