import json
import os

import pytest
from bundle_fixture import CONDITIONS, IDS, STUDY, build, manifest, record, results, trace
from pyspark.sql import functions as F

from evalloom.operators.constraints import ConstraintError
from evalloom.plans import bundle, study
from evalloom.sources import publish, strict

C0 = "data/runs/c0/seed-42"


def test_whole_bundle(spark, tmp_path):
    got = bundle.load_bundle(spark, build(tmp_path), STUDY)
    assert got.records.count() == 5 * 16 and got.results.count() == got.manifests.count() == 5 and got.traces.count() == 20
    assert got.scored.count() == 5 * 12 and got.study_rows.count() == 5 and got.inventory.count() == 2
    first = got.scored.first()
    assert (first.condition, first.seed, first.base_snippet_id, first.task_type) == ("C0", 42, IDS[1], "rule_identification")
    assert [(r.condition, r.seed) for r in got.scored.select("condition", "seed").dropDuplicates().collect()].__len__() == 5


# file, text to replace, text to put, what the message must say
MUTATIONS = [
    ("config/experiments.yaml", "max_steps: 600", "max_steps: 600\n    max_steps: 600", "duplicate key max_steps"),
    ("config/experiments.yaml", "max_steps: 600", "max_steps: .nan", "non-finite"),
    ("config/experiments.yaml", "max_steps: 600", "max_steps: 601", "profiles.main.max_steps"),
    ("config/experiments.yaml", "joint: 512", "joint: 512.0", "joint"),
    ("config/experiments.yaml", "      joint: 512\n", "", "joint"),
    ("config/experiments.yaml", "joint: 512", "joint: 512\n      other: 1", "other"),
    ("config/experiments.yaml", "path: c0", "path: c1", "path"),
    ("config/experiments.yaml", "  main:\n", "  other:\n", "profiles"),
    (f"{C0}/results.yaml", "profile: main", "profile: other", "identities must agree"),
    (f"{C0}/results.yaml", "condition: C0", "condition: C1", "identities must agree"),
    (f"{C0}/manifest.yaml", "seed: 42", "seed: 43", "identities must agree"),
    (f"{C0}/manifest.yaml", "historical_run_id: run-c0-42", "historical_run_id: run-c0-x", "identities must agree"),
    (f"{C0}/manifest.yaml", "main-c0", "main-c1", "configuration"),
    (f"{C0}/manifest.yaml", "a" * 40, "f" * 40, "provenance"),
    (f"{C0}/results.yaml", "selected_step: 480", "selected_step: null", "complete fields"),
    (f"{C0}/results.yaml", "total_tokens: 1042", "total_tokens: '1042'", "total_tokens"),
    (f"{C0}/results.yaml", "realized_truncation: 0", "realized_truncation: -1", "negative"),
    (f"{C0}/selection_trace.json", '"step": 240', '"step": 121', "selection trace"),
    (f"{C0}/selection_trace.json", '"composite_score": 0.7', '"composite_score": 0.6', "selected point disagrees"),
    ("data/runs/zero-shot-raw/seed-42/selection_trace.json", "[]", json.dumps(trace("C0")), "zero-shot"),
    ("data/runs/zero-shot-raw/seed-42/results.yaml", "run_kind: zero_shot", "run_kind: fine_tuned", "run kind"),
    (f"{C0}/records.jsonl", '"seed": 42', '"seed": "42"', "row 1: record " + IDS[0] + ": seed"),
    (f"{C0}/records.jsonl", '"exact_match": true', '"exact_match": "false"', "exact_match"),
    (f"{C0}/records.jsonl", '"latency_ms": 1.5', '"latency_ms": NaN', "non-finite"),
    (f"{C0}/records.jsonl", '"latency_ms": 1.5', '"latency_ms": 1.5, "raw_output": "x"', "raw_output: unknown field"),
    (f"{C0}/records.jsonl", '"build_status": "FAIL"', '"build_status": "FAIL", "build_status": "OK"', "row 2: record " + IDS[0] + ": duplicate key build_status"),
    (f"{C0}/records.jsonl", '"summary_status": "present"', '"summary_status": "error"', "summary_status"),
    (f"{C0}/records.jsonl", '"original_tool_status": "ok"', '"original_tool_status": "degraded"', "original_tool_status"),
    (f"{C0}/records.jsonl", '"output_tool_status": "ok"', '"output_tool_status": "failed"', "output_tool_status"),
    (f"{C0}/records.jsonl", '"recognized_array"', '"no_recognized_array"', "empty pred"),
    (f"{C0}/records.jsonl", '"n_emitted": 1', '"n_emitted": 0', "n_emitted"),
    (f"{C0}/records.jsonl", '"line": 1', '"line": 0', "residual_findings"),
    (f"{C0}/records.jsonl", '"lint_ok": true, ', "", "complete"),
    (f"{C0}/records.jsonl", IDS[1], IDS[0], "duplicate cell"),
    (f"{C0}/records.jsonl", '"task_type": "explanation"', '"task_type": "other"', "task_type"),
    (f"{C0}/records.jsonl", json.dumps(record(IDS[2], "C0", 42, "joint")) + "\n", "", "incomplete record matrix"),
    (f"{C0}/records.jsonl", json.dumps(record(IDS[2], "C0", 42, "joint")) + "\n", "\n", "row 11: blank line"),
    (f"{C0}/records.jsonl", json.dumps(record(IDS[2], "C0", 42, "joint")), json.dumps(record(IDS[2], "C1", 42, "joint")), "isn't its run's"),
    ("data/study/analysis_inputs.jsonl", IDS[3], IDS[2], "unique snippet ids"),
    ("data/study/analysis_inputs.jsonl", '"score": 0.9', '"score": 0.7', "pair_indicators"),
    ("data/study/analysis_inputs.jsonl", '"parse_strategy": "file"', '"parse_strategy": null', "parse_ok"),
    ("data/study/analysis_inputs.jsonl", '"quarantined": false', '"quarantined": true', "scored population"),
    ("data/study/analysis_inputs.jsonl", '"reproduced"', '"excluded"', "scored population"),
    ("config/manuscript_results.yaml", "id: r.1\n", "id: r.0\n", "unique result ids"),
    ("config/manuscript_results.yaml", "identifier: r.1", "identifier: r.0", "unique output targets"),
]


@pytest.mark.parametrize(("file", "old", "new", "said"), MUTATIONS)
def test_each_mutation_is_refused(spark, tmp_path, file, old, new, said):
    path = f"{build(tmp_path)}/{file}"
    text = open(path).read()
    assert old in text
    with open(path, "w") as f:
        f.write(text.replace(old, new) if old in IDS and "runs" in file else text.replace(old, new, 1))
    with pytest.raises(ConstraintError) as caught:
        if file == "config/experiments.yaml":
            bundle.load_config(spark, path, STUDY)
        elif "/runs/" in file:
            bundle.load_runs(spark, f"{tmp_path}/data/runs", STUDY)
        elif "/study/" in file:
            bundle.select_scored(spark.createDataFrame([], study.ddl(study.RECORD_DDL)), bundle.load_study_rows(spark, path, STUDY), STUDY)
        else:
            bundle.load_inventory(spark, path)
    assert said in str(caught.value), str(caught.value)
    if "/records" in file and "row" in said:
        assert "records.jsonl" in str(caught.value)


@pytest.mark.parametrize("change", ["missing run", "stray run", "stray condition", "missing file", "extra file", "stray file beside runs"])
def test_folders_are_exact(spark, tmp_path, change):
    root = build(tmp_path)
    runs = f"{root}/data/runs"
    if change == "missing run":
        os.rename(f"{runs}/c0/seed-42", f"{root}/moved")
    if change == "stray run":
        os.makedirs(f"{runs}/c0/seed-99")
    if change == "stray condition":
        os.makedirs(f"{runs}/c9")
    if change == "missing file":
        os.rename(f"{runs}/c0/seed-42/results.yaml", f"{root}/moved")
    if change in ("extra file", "stray file beside runs"):
        open(f"{runs}/c0/{'seed-42/' if change == 'extra file' else ''}notes.txt", "w").close()
    with pytest.raises(ConstraintError, match="files of a run" if "file" in change and "beside" not in change else "run matrix"):
        bundle.load_runs(spark, runs, STUDY)


def test_rows_are_counted_over_blocks(spark, tmp_path):
    """A file that is read in many blocks still names the row."""
    schema = strict.T.StructType([strict.T.StructField("a", strict.T.LongType(), False)])
    path = f"{tmp_path}/x.jsonl"
    with open(path, "w") as f:
        f.write("".join('{"a": %d}\n' % i if i != 4321 else '{"b": 1}\n' for i in range(6000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        with pytest.raises(ConstraintError, match="row 4322: b: unknown field"):
            strict.read_json_lines(spark, path, schema)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def published(spark, root, change=lambda d: d, rows=None):
    runs = {(p, s): c for c, p, s, _, _ in STUDY.runs()}
    out = rows or [record(i, c, s, t) for (p, s), c in runs.items() for i in IDS[:4] for t in STUDY.tasks]
    paths = {c: r["path"] for c, r in CONDITIONS.items()}
    text = spark.createDataFrame([(paths[r["condition"]], r["seed"], json.dumps(r)) for r in out], "path string, run_seed long, t string")
    df = text.withColumn("v", F.from_json("t", study.ddl(study.RECORD_DDL))).select("path", "run_seed", "v.*")
    docs = {(p, s): {"results.yaml": results(c, s), "manifest.yaml": manifest(c, s), "selection_trace.json": trace(c)} for (p, s), c in runs.items()}
    return publish.publish_runs(df, change(docs), runs, root, ["historical_run_id", "profile"])


def test_published_runs_load_again(spark, tmp_path):
    root = build(tmp_path)
    os.rename(f"{root}/data/runs", f"{root}/old")
    published(spark, f"file://{root}/data/runs")
    got = bundle.load_bundle(spark, root, STUDY)
    assert got.records.count() == 80 and got.traces.count() == 20
    with open(f"{root}/{C0}/{publish.RECEIPT}") as f:
        assert json.load(f)["rows"] == 16
    with pytest.raises(ConstraintError, match="exists"):
        published(spark, f"file://{root}/data/runs")


def test_mixed_identities_are_refused_and_leave_nothing(spark, tmp_path):
    def other(docs):
        docs["c0", 42]["manifest.yaml"]["historical_run_id"] = "another"
        return docs

    with pytest.raises(ConstraintError, match="disagree on historical_run_id"):
        published(spark, f"file://{tmp_path}/a", other)
    bad = [record(IDS[0], "C0", 43, "joint") | {"seed": 42, "condition": "C1"}, record(IDS[0], "C1", 42, "joint") | {"condition": "C0"}]
    text = spark.createDataFrame([("c0", 42, json.dumps(r)) for r in bad], "path string, run_seed long, t string")
    df = text.withColumn("v", F.from_json("t", study.ddl(study.RECORD_DDL))).select("path", "run_seed", "v.*")
    with pytest.raises(ConstraintError, match="one identity"):
        publish.publish_runs(df, {("c0", 42): {"results.yaml": results("C0", 42)}}, {("c0", 42): "C0"}, f"file://{tmp_path}/a")
    assert not os.path.exists(f"{tmp_path}/a")


def test_a_job_that_dies_leaves_no_run(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(publish, "yaml_bytes", lambda value: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        published(spark, f"file://{tmp_path}/b")
    assert not [x for x in os.listdir(f"{tmp_path}/b") if not x.startswith(".")]
