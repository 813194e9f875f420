import pytest
from pyspark.sql import functions as F

from evalloom.functions import summaries, tools


def test_checker_runs_once_a_text(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None)], "id int, t string")
    got = {r.id: r for r in tools.checked(df, "t", ["grep", "-c", "b"]).collect()}
    assert got[1].ok and got[2].output == "1\n" and got[3].ok is None
    assert not tools.run_tool(["grep", "zzz"], "a", 5)[0] and tools.run_tool(["sleep", "5"], "", 0.2)[1]
    with pytest.raises(tools.ToolMissing):
        tools.checked(df, "t", ["no-such-program"])


def test_summary_columns(spark):
    df = spark.createDataFrame([("//go:embed x\nfunc f[T any]() { unsafe.Pointer(p) } /* c */",)], "c string")
    r = df.select(summaries.construct_flags(F.col("c")).alias("f"), summaries.verbatim(F.col("c")).alias("v")).first()
    assert r.f == ["generics", "go:embed", "unsafe_ptr"] and r.v == "func f[T any]() { unsafe.Pointer(p) }"
    seg = spark.createDataFrame([([{"a": "loop over secret"}, {"v": "x y"}],)], "s array<map<string,string>>")
    assert seg.select(summaries.unknown_words(F.col("s"), ["loop", "over"]).alias("u")).first().u == ["secret"]
    with pytest.raises(tools.ToolMissing):
        summaries.summarised(df, "c", ["no-such-program"])
    out = spark.createDataFrame([('{"id":"x","ok":true,"parse_strategy":"file","lines":[{"tier":0,"depth":1,"text":"t","segments":[{"a":"t"}]}]}',)], "c string")
    got = summaries.summarised(out, "c", ["cat"]).select("summary", summaries.failure_is_empty(F.col("summary")).alias("good")).first()
    assert got.good and got.summary.lines[0].depth == 1
