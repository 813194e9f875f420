"""Errors and edge cases of the record operators, prompts, fixtures and the record stream."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalloom.functions import prompts, textops
from evalloom.operators import records
from evalloom.operators.constraints import ConstraintError
from evalloom.streaming import ingest


def test_guard_refuses_all_but_zero_and_one(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 0.5), (4, None), (5, float("nan"))], "k int, v double")
    assert sorted(r.k for r in records.not_binary(df, ["k"], "v").collect()) == [3, 4, 5]


def test_partner_is_unique_and_may_lack(spark):
    a, b = spark.createDataFrame([(1, 2.0), (2, 3.0)], "k int, v double"), spark.createDataFrame([(1, 5.0)], "k int, v double")
    assert sorted((r.k, r.partner_v) for r in records.partner(a, b, ["k"], ["v"]).collect()) == [(1, 5.0), (2, None)]
    with pytest.raises(ConstraintError):
        records.partner(a, b.union(b), ["k"], ["v"])


def test_positions_must_agree(spark):
    df = spark.createDataFrame([(["a"], ["x"]), (None, ["x"])], "a array<string>, b array<string>")
    assert [r.z for r in df.select(records.zipped(F.col("a"), F.col("b")).alias("z")).collect()] == [[("a", "x")], None]
    df = spark.createDataFrame([(["a"], ["x", "y"])], df.schema)
    with pytest.raises(Exception, match="unequal length"):
        df.select(records.zipped(F.col("a"), F.col("b"))).collect()


def test_merge_and_names_refuse_the_unknown(spark):
    df = spark.createDataFrame([("a",)], "k string")
    with pytest.raises(ConstraintError):
        records.disjoint_union([df, df], ["k"])
    with pytest.raises(Exception, match="no declared name"):
        records.named(df, "k", {"b": "x"}).collect()


def test_histogram_with_one_alternate(spark):
    df = spark.createDataFrame([(600,), (600,), (500,)], "step int")
    got = records.step_histogram(df.withColumn("g", F.lit(1)), ["g"], "step").orderBy("step").collect()
    assert [(r.step, r.n, r.usual, r.one_alternate) for r in got] == [(500, 1, False, True), (600, 2, True, True)]


def test_comments_come_before_the_node_at_their_place(spark):
    kind = "array<struct<at:int,text:string>>"
    df = spark.createDataFrame([([(1, "n1"), (3, "n3")], [(3, "c3"), (9, "c9")]), ([], [(1, "c")])], f"n {kind}, c {kind}")
    assert [r.m for r in df.select(records.merged_by_place(F.col("n"), F.col("c")).alias("m")).collect()] == [["n1", "c3", "n3", "c9"], ["c"]]


def test_prompts(spark):
    df = spark.createDataFrame([("a", "x"), ("b", None)], "task string, code string")
    text = prompts.by_task(F.col("task"), {"a": "do {code}!", "b": "see {code}"}, {"code": F.col("code")})
    assert [r.p for r in df.select(text.alias("p")).collect()] == ["do x!", "see "]
    with pytest.raises(ValueError):
        prompts.filled("{other}", {})
    with pytest.raises(Exception, match="unknown task"):
        df.select(prompts.by_task(F.col("task"), {"a": "x"}, {})).collect()


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x85", " ", " "])
def test_fixture_cuts_at_every_line_end(spark, end):
    df = spark.createDataFrame([(f"x := 1{end}y := 2{end}",)], "code string")
    assert df.select(textops.fixture(F.col("code"))["source"]).first()[0] == "package p\n\nfunc _gocheck_body() {\n\tx := 1\n\ty := 2\n}\n"


def test_stream_reads_typed_lines_and_stops_at_a_broken_one(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"id": "a", "n": 1}\n{"id": "b", "n": 2}\n')
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.LongType())])

    def run():
        rows = ingest.record_stream(spark, str(tmp_path / "in"), schema)
        rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    run()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [("a", 1), ("b", 2)]
    (tmp_path / "in" / "b.jsonl").write_text('{"id": "c", "n": oops}\n')
    with pytest.raises(Exception):
        run()
