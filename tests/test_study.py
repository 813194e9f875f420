import random

import pytest
from published_runs import DIGITS, LEAVES, RUNS, TABLE
from pyspark.sql import functions as F

from evalloom.operators.constraints import ConstraintError
from evalloom.plans import study
from evalloom.sources.sinks import cell_text


def results(spark):
    keys = "total_tokens bigint,supervised_tokens bigint,optimizer_steps bigint,wall_clock_train_s double,wall_clock_total_s double,peak_allocated_gpu_memory_gib double"
    flat = spark.createDataFrame(RUNS, "condition string,seed bigint," + keys)
    names = [k.split()[0] for k in keys.split(",")]
    return flat.select("condition", "seed", F.struct(F.struct(*names).alias("compute")).alias("metrics"))


def test_published_compute_table(spark):
    got = {(r.quantity, r.condition): r.value for r in study.table_8_6(results(spark)).collect()}
    for q, cells in TABLE.items():
        assert tuple(cell_text(got[q, c], DIGITS[q]) for c in study.TUNED) == cells
    leaves = study.run_accounting(results(spark)).first()
    assert all(abs(leaves[k] - v) < 1e-7 for k, v in LEAVES.items())


IDS = [f"sha256:{i:064x}" for i in range(6)]
RUNS_ = [(c, s) for c in study.TUNED for s in study.SEEDS] + [("zero-shot-raw", 42), ("zero-shot-syntax", 42)]


def records(seed=1):
    r, rows = random.Random(seed), []
    for c, s in RUNS_:
        for i, snippet in enumerate(IDS):
            targets = study.CHECKS[i : i + 2]
            for task in study.TASKS:
                row = dict(base_snippet_id=snippet, condition=c, seed=s, task_type=task, target_checks=targets, summary_status="present", prompt_tokens=r.randint(1, 99), retokenized_response_token_proxy=5, latency_ms=1.0)
                if task == "rule_identification":
                    pred = targets if r.random() < 0.5 else r.sample(study.CHECKS, r.randint(0, 3))
                    row |= dict(gold=targets, pred=sorted(pred), rejected_label_count=0, exact_match=sorted(pred) == targets, n_emitted=len(pred), normalization_status="recognized_array")
                elif task != "explanation":
                    cat = r.choice(study.CATEGORIES)
                    row["outcome"] = dict(target_fixed=cat in "AB", overall_fixed=cat == "A", studied_regression=None if cat == "INVALID" else cat in "BD", enabled_regression=None, extracted=cat != "INVALID", extraction_status=r.choice(["go_block", "fenced_block"]), parse_ok=cat != "INVALID", lint_ok=True, original_tool_status="ok", output_tool_status="ok", build_status="OK", category=cat, introduced_checks=[], residual_findings=[])
                rows.append(row)
    return rows


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(records(), study.ddl(study.RECORD_DDL)).cache()


def mean(x):
    x = list(x)
    return sum(x) / len(x)


def test_valid_and_mutated(spark, frame):
    study.validate(frame)
    for change in ("drop", "double", "status", "order"):
        rows = records()
        if change == "drop":
            rows.pop(3)
        elif change == "double":
            rows[4] = rows[0]
        elif change == "status":
            rows[0]["summary_status"] = "unknown"
        else:
            rows[0]["n_emitted"] = -1
        with pytest.raises(ConstraintError):
            study.validate(spark.createDataFrame(rows, study.ddl(study.RECORD_DDL)))


def test_headline_table_averages_after_seeds(frame):
    rows = [r for r in records() if r["task_type"] == "rule_identification"]
    got = {(r.condition, r.metric): r for r in study.table_8_1(frame).collect()}

    def macro(rs):
        out = []
        for k in study.CHECKS:
            tp = sum(k in r["pred"] and k in r["gold"] for r in rs)
            n = sum((k in r["pred"]) + (k in r["gold"]) for r in rs)
            out.append(2 * tp / n if n else 0)
        return mean(out)

    for c in study.CONDITIONS:
        seeds = [s for d, s in RUNS_ if d == c]
        want = mean(macro([r for r in rows if (r["condition"], r["seed"]) == (c, s)]) for s in seeds) * 100
        assert abs(got[c, "macro_f1"].mean - want) < 1e-9
        exact = mean(mean(r["exact_match"] for r in rows if (r["condition"], r["seed"]) == (c, s)) for s in seeds) * 100
        assert abs(got[c, "exact_match"].mean - exact) < 1e-9
        assert (got[c, "macro_f1"].sd is None) == (len(seeds) == 1)


def test_repair_tables(frame):
    rows = [r for r in records() if r["task_type"] in ("correction", "joint") and r["condition"] in study.TUNED]
    shares = {(r.condition, r.task_type, r.component): r.value for r in study.table_8_2(frame).collect()}
    counts = {(r.condition, r.task_type): r for r in study.table_8_4(frame).collect()}
    for c in study.TUNED:
        for t in ("correction", "joint"):
            own = [r["outcome"] for r in rows if r["condition"] == c and r["task_type"] == t]
            assert abs(shares[c, t, "regression_adjusted_fix"] - 100 * mean(o["overall_fixed"] for o in own)) < 1e-9
            assert [counts[c, t][k] for k in study.CATEGORIES] == [sum(o["category"] == k for o in own) for k in study.CATEGORIES]
    known = {(r.condition, r.task_type): r.regressions for r in study.regressions(frame).collect()}
    assert known["C0", "joint"] == sum(bool(r["outcome"]["studied_regression"]) for r in rows if r["condition"] == "C0" and r["task_type"] == "joint")


def test_contrasts(frame):
    rows = {(r["condition"], r["seed"], r["base_snippet_id"]): float(r["outcome"]["overall_fixed"]) for r in records() if r["task_type"] == "joint"}
    got = {(r.task_type, r.against): r for r in study.table_8_3(frame, 200).collect()}
    want = mean(mean(rows["C1", s, i] - rows["C0", s, i] for s in study.SEEDS) for i in IDS) * 100
    x = got["joint", "C1"]
    assert abs(x.point - want) < 1e-9 and x.low <= x.point <= x.high and len(got) == 6 and x.n_units == 6
    assert study.rq3_contrasts(frame, 100).count() == 2
    assert study.zero_shot_transition(frame, "joint").first().n == 6
    assert study.discordance(frame, "joint").first().repeats == 3
    assert {r.condition for r in study.table_8_9(frame).collect()} == {"C0", "zero-shot-raw", "zero-shot-syntax"}
    assert all(r.f1_delta == 0 for r in study.table_8_7(frame).where("condition = 'C0'").collect())
    assert study.error_leaves(frame.where("task_type <> 'explanation'")).count() == 18
    study.unique_wins(frame).collect()
    study.label_normalisation(frame).collect()
    assert study.prompt_distribution(frame).count() == 24


def study_rows(spark):
    rows = []
    for i, snippet in enumerate(IDS):
        rows.append(dict(base_snippet_id=snippet, split="test", task_types=study.TASKS, target_checks=study.CHECKS[i : i + 2], violation_count=1 + i % 2, repository_group_id=f"g{i // 2}", quarantined=i == 0, oracle=dict(status="excluded" if i == 1 else "reproduced", missing_checks=["paramTypeCombine"] if i == 1 else [], extra_checks=[]), source_line_count=[10, 50, 199, 200, 49, 300][i], serializer=dict(maximum_depth=i), training_contributions=[dict(condition=c, pool="main", task_type="joint", prompt_tokens=1, response_tokens=1, total_tokens=10 * i, multiplicity=i) for c in ("C1", "C2")]))
    rows.append(rows[0] | dict(base_snippet_id="sha256:" + "f" * 64, split="train"))
    ddl = "base_snippet_id string,split string,task_types array<string>,target_checks array<string>,violation_count bigint,repository_group_id string,quarantined boolean,oracle struct<status:string,missing_checks:array<string>,extra_checks:array<string>>,source_line_count bigint,serializer struct<maximum_depth:bigint>,training_contributions array<struct<condition:string,pool:string,task_type:string,prompt_tokens:bigint,response_tokens:bigint,total_tokens:bigint,multiplicity:bigint>>"
    return spark.createDataFrame(rows, ddl)


def test_population_strata_and_dataset(spark, frame):
    rows = study_rows(spark)
    assert sorted(r[0] for r in study.scored_ids(rows).collect()) == IDS[2:]
    assert study.scored(frame, rows).count() == 4 * len(study.TASKS) * len(RUNS_)
    got = study.table_8_8(frame, rows.where("split = 'test'"), 50)
    assert {r.stratum for r in got.collect()} == set(study.bins())
    assert got.where("stratum = 'length_50_199'").first().n_units == 2
    assert study.exclusion_mechanisms(rows).first().asDict() == {"mechanism": "multiline_param", "n": 1}
    bad = rows.withColumn("oracle", F.struct(F.lit("excluded").alias("status"), F.array().cast("array<string>").alias("missing_checks"), F.array().cast("array<string>").alias("extra_checks")))
    with pytest.raises(Exception, match="unexplained exclusion"):
        study.exclusion_mechanisms(bad).collect()
    p = {r.condition: r for r in study.table_8_5(rows).collect()}
    assert (p["C1"].n, p["C1"].max, p["C1"].p50) == (15, 50, 40)
    assert study.same_main_training(rows)
    assert study.repository_overlap(rows).first().asDict() == {"groups": 1, "test_rows": 2, "all_groups": 3}
    assert study.dataset_leaves(rows).where("split is null and task_type is null").first().n == 28
