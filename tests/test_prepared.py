import json

import pytest
from pyspark.sql import functions as F

from evalloom.operators.constraints import ConstraintError
from evalloom.plans import evaluate, prepared


def lines(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


def test_files_and_projections(spark, tmp_path):
    p = lines(tmp_path / "q.jsonl", [{"id": "a", "split": "test", "other": 1}, {"id": "b", "split": "test"}])
    q = prepared.read_projection(spark, p, ["id", "split"])
    a = prepared.read_adjudications(spark, lines(tmp_path / "a.jsonl", [{"id": "c", "split": "test", "resolution": "exclude", "reason": "r"}, {"id": "d", "split": "test", "resolution": "fixture_fix", "reason": "r"}]))
    assert sorted(r.id for r in evaluate.exclusions(q, a, "test").collect()) == ["a", "b", "c"]
    with pytest.raises(ConstraintError):
        prepared.read_adjudications(spark, lines(tmp_path / "b.jsonl", [{"id": "c", "split": "test", "resolution": "drop", "reason": "r"}]))
    prepared.require_files(spark, str(tmp_path), ["q.jsonl"])
    with pytest.raises(ConstraintError):
        prepared.require_files(spark, str(tmp_path), ["absent"])


def test_tasks_and_cover(spark):
    good = [(i, s, s, k) for i, s in (("a", "train"), ("b", "test")) for k in ("x", "y")]
    ddl = "id string, split string, file string, task_type string"
    df = spark.createDataFrame(good, ddl)
    prepared.check_tasks(df, "file", ["x", "y"])
    for bad in (good[1:], [*good, good[0]], [("a", "test", "train", "x"), *good[1:]]):
        with pytest.raises(ConstraintError):
            prepared.check_tasks(spark.createDataFrame(bad, ddl), "file", ["x", "y"])
    ids = df.select("id").distinct()
    prepared.check_cover(ids, ids)
    with pytest.raises(ConstraintError):
        prepared.check_cover(ids.limit(1), ids)
    with pytest.raises(ConstraintError):
        prepared.check_checksum(ids, "no")
    assert evaluate.without(df, ids.limit(1)).count() == 2
    with pytest.raises(ConstraintError):
        evaluate.selected(df, spark.createDataFrame([("z",)], "id string"))


def test_lengths_and_trace(spark):
    s = spark.createDataFrame([(0, 10, 4), (1, 6, 5), (2, 20, 18), (3, 2, 1)], "position long, total long, prompt long")
    r = prepared.realised(s, "total", "prompt", 2, 12).first()
    assert (r.forwarded, r.supervised, r.truncated) == (9 + 6 + 11 + 2, 7 + 1, 1)
    with pytest.raises(ConstraintError):
        prepared.realised(s.limit(3), "total", "prompt", 2, 12)
    trace = spark.createDataFrame([("C0", 42, 120, 0.1), ("C0", 42, 240, 0.5)], "condition string, seed long, step long, m double")
    ok = spark.createDataFrame([("C0", 42, 240, 0.5)], "condition string, seed long, selected_step long, m double")
    prepared.check_trace(trace, ok, [120, 240], ["m"])
    with pytest.raises(ConstraintError):
        prepared.check_trace(trace, ok.withColumn("m", F.lit(0.4)), [120, 240], ["m"])
    with pytest.raises(ConstraintError):
        prepared.check_trace(trace.limit(1), ok, [120, 240], ["m"])
    prepared.check_stored(ok, ok, ["condition"], ["m"])
    with pytest.raises(ConstraintError):
        prepared.check_stored(ok, ok.withColumn("m", F.lit(0.4)), ["condition"], ["m"])


def test_scoring(spark):
    def checker(df):
        found = F.array_compact(F.array(F.when(F.contains("code", F.lit("else if")), F.lit("elseif")), F.when(F.contains("code", F.lit("+ ")), F.lit("assignOp"))))
        return df.select("code", (~F.contains("code", F.lit("bad"))).alias("parse_ok"), F.lit(True).alias("lint_ok"), F.lit("OK").alias("build_status"), F.lit("ok").alias("tool_status"), found.alias("found"))

    f = lambda body: f"text\n```go\n{body}\n```"
    rows = [("joint", f("x := 1"), "A"), ("joint", f("a = a + 1"), "B"), ("correction", f("else if"), "C"), ("correction", f("else if a + 1"), "D"), ("joint", f("bad"), "INVALID"), ("joint", "nothing", "INVALID")]
    df = spark.createDataFrame([(*r, "if else if", ["elseif"]) for r in rows], "task_type string, response string, want string, code string, target_checks array<string>")
    got = evaluate.repair_records(df, "response", "code", "target_checks", checker, lambda c: False)
    assert all(r.outcome.category == r.want for r in got.collect()) and got.count() == 6
    rule = spark.createDataFrame([("rule_identification", 'so ["else-if"]', ["elseif"])], "task_type string, response string, target_checks array<string>")
    rule = evaluate.rule_records(rule, "response", "target_checks")
    assert rule.first().exact_match
    s = evaluate.validation_scores(evaluate.records(rule, got)).first()
    assert (s.correction_fix_rate, s.joint_fix_rate) == (0.0, 0.25) and abs(s.composite - (1 / 8 + 0.25) / 3) < 1e-12
    p = evaluate.prompted(spark.createDataFrame([("a", "x y")], "id string, code string"), None, False, lambda c, s: F.concat(F.lit("Review: "), c), lambda t: F.size(F.split(t, " "))).first()
    assert p.prompt_tokens == 3 and p.status == "not_applicable"
