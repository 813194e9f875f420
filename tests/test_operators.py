import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalloom.functions import scalars, textops
from evalloom.operators import constraints, labels, mixed, paired, resample, sequence, stats
from evalloom.plans.study import ALIASES, CHECKS


def test_token_accounting(spark):
    df = spark.createDataFrame([(0, 5), (1, 3)], "k long, len long")
    assert sequence.forwarded_tokens(sequence.micro_batches(df, "k", [], 2), "len", 10).first()[0] == 7
    df = spark.createDataFrame([(0, 10, 4), (1, 6, 5), (2, 20, 18)], "k long, total long, prompt long")
    assert sequence.supervised_tokens(sequence.micro_batches(df, "k", [], 2), "total", "prompt", 12).first()[0] == 7


@pytest.mark.parametrize("n", [1, 2, 3, 7, 19, 100])
def test_percentiles(spark, n):
    v = [(i * 37) % 50 for i in range(n)]
    df = spark.createDataFrame([(x,) for x in v], "v long")
    rank, index, s = stats.nearest_rank(df, [], "v").first(), stats.nearest_index(df, [], "v").first(), sorted(v)
    for p in (50, 90, 95, 99):
        assert rank[f"p{p}"] == s[max(1, math.ceil(p / 100 * n)) - 1]
        assert index[f"p{p}"] == s[round(p / 100 * (n - 1))]
    assert rank["max"] == s[-1] and rank["n"] == n


def test_prf_zero_division(spark):
    df = spark.createDataFrame([(["a"], ["a"]), (["b", "x"], ["a"]), ([], [])], "p array<string>, g array<string>")
    got = {r["class"]: r for r in labels.per_class_prf(df, "p", "g", ["a", "b", "c"], []).collect()}
    assert (got["a"].precision, got["a"].recall) == (1.0, 0.5) and got["b"].f1 == got["c"].f1 == 0
    one = labels.headline(df, "p", "g", ["a", "b", "c"], []).first()
    assert one.exact_match == 2 / 3 and abs(one.macro_f1 - (2 / 3) / 3) < 1e-12 and one.micro_f1 == 0.5


def test_constraints(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 1)], "x string, y int")
    assert {tuple(r) for r in constraints.grid_gaps(df, [["x"], ["y"]]).collect()} == {("b", 1, 2), ("b", 2, 0)}
    assert constraints.uniform(df, ["x"], "y").first().x == "a"
    with pytest.raises(constraints.ConstraintError):
        constraints.require(constraints.duplicate_keys(df, ["x", "y"]), "key")
    assert constraints.mismatches(df.limit(0), df, ["x"], ["y"]).count() == 4
    for bad in (True, float("nan"), "1", None):
        with pytest.raises(constraints.ConstraintError):
            constraints.finite_number(bad, "n")
    with pytest.raises(constraints.ConstraintError):
        constraints.alpha(1)


def test_bootstrap_is_the_sequential_stream(spark):
    v = np.random.default_rng(0).normal(size=25)
    rng = np.random.default_rng(42)
    seq = np.array([np.mean(v[rng.integers(0, 25, size=25)]) for _ in range(300)])
    df = spark.createDataFrame([(f"u{i:02d}", float(x)) for i, x in reversed(list(enumerate(v)))], "u string, d double")
    got = resample.stream_intervals(df, [], "u", "d", 300).first()
    assert got.low == np.quantile(seq, 0.025) and got.high == np.quantile(seq, 0.975)


def test_mixture(spark):
    rows = sequence.mixture_stream(spark, 7, 3, 0.2, 70, 1).orderBy("position").collect()
    assert [r.pool for r in rows[:10]] == ["main"] * 4 + ["aux"] + ["main"] * 4 + ["aux"]
    main = [r["index"] for r in rows if r.pool == "main"]
    assert all(sorted(main[i : i + 7]) == list(range(7)) for i in range(0, len(main) - 6, 7))
    assert sequence.interleave(spark, 19_200, 0.2).where("pool = 'aux'").count() == 3_840


def test_nearest(spark):
    a, b = [(i, (i * 31) % 97) for i in range(60)], [(i, (i * 53) % 211) for i in range(40)]
    left, right = spark.createDataFrame(a, "id long, v long"), spark.createDataFrame(b, "key long, w long")
    got = {r.id: (r.distance, r.nearest) for r in sequence.nearest(left, "v", right, "w", "key").collect()}
    assert got == {i: min((abs(w - v), k) for k, w in b) for i, v in a}


def test_greedy_buckets(spark):
    df = spark.createDataFrame([(0, n, i) for i, n in enumerate([5, 1, 9, 4, 4])], "g int, n long, k long")
    got = sorted((r.n, r.bucket) for r in sequence.greedy_buckets(df, ["g"], "n", "k", 2, 9).collect())
    assert got == [(1, 0), (4, 0), (4, 1), (5, 2), (9, 3)]


def test_summary_truncation(spark):
    lines = [(0, 0, "top"), (1, 1, "detail"), (0, 1, "same"), (0, 1, "same"), (2, 0, "type"), (0, 2, "deep")]
    count = lambda t: F.size(F.filter(F.split(t, r"\s+"), lambda x: x != ""))
    rows = [(b, lines, True) for b in (6, 5, 4, 3, 1)] + [(50, lines, False), (50, [], True)]
    df = spark.createDataFrame(rows, "budget int, lines array<struct<tier:int,depth:int,text:string>>, ok boolean")
    got = [(r.status, r.summary) for r in sequence.delivered(df, "ok", "lines", "budget", count, 0).collect()]
    assert got[0][0] == "present" and got[1] == ("present_truncated", "top\n  detail\n  same\n  same\n    deep")
    assert got[2][1] == "top\n  same\n  same\n    deep" and got[3][1] == "top\n  same (×2)" and got[4][1] == "top"
    assert got[5][0] == "failed" and got[6][0] == "skipped"


def test_label_answers(spark):
    cases = {
        'x ["elseif"]': ("recognized_array", ["elseif"], 1, 0),
        '["else if", "Assign-Op", "what"] tail [': ("recognized_array", ["assignOp", "elseif"], 3, 1),
        "none": ("no_recognized_array", [], 0, 0),
        '[1] then ["elseif", ["captLocal"]]': ("recognized_array", ["elseif"], 2, 1),
        'see [the ["elseif"] list]': ("recognized_array", ["elseif"], 1, 0),
        '["a]b", "elseif"]': ("recognized_array", ["elseif"], 2, 1),
        "[]": ("recognized_array", [], 0, 0),
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = df.select("t", textops.parsed_labels(F.col("t"), CHECKS, ALIASES).alias("g")).collect()
    for r in got:
        assert tuple(r.g) == cases[r.t], r


def test_code_extraction(spark):
    tick = "```"
    cases = {f"{tick}go\n// only\n{tick}\n{tick}Go\nx := 1\n{tick}": ("x := 1", "go_block"), f"{tick}\ny()\n{tick}": ("y()", "fenced_block"), "bad\nok line\nbad": ("ok line", "largest_parseable"), "no": (None, "failed")}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = df.select("t", textops.extracted(F.col("t"), lambda c: c == "ok line").alias("g")).collect()
    assert {r.t: tuple(r.g) for r in got} == cases
    seen = []
    assert textops.probe_windows("\n".join("abcdefghijklmnopqrst"), lambda c: seen.append(c)) is None and len(seen) == 32


def test_fixture_and_outcome(spark):
    df = spark.createDataFrame([("package p\nx",), ("func f() {}",), ("a := 1\nb()",)], "t string")
    got = [tuple(r.g) for r in df.select(textops.fixture(F.col("t")).alias("g")).collect()]
    assert got[0] == ("package p\nx", "file") and got[1] == ("package p\n\nfunc f() {}\n", "decl")
    assert got[2] == ("package p\n\nfunc _gocheck_body() {\n\ta := 1\n\tb()\n}\n", "stmt")
    rows = [(True, ["a"], ["a"], [], "A"), (True, ["a"], ["a"], ["b"], "B"), (True, ["a"], ["a"], ["a"], "C"), (True, ["a"], ["a"], ["a", "b"], "D"), (False, ["a"], ["a"], [], "INVALID")]
    df = spark.createDataFrame(rows, "v boolean, t array<string>, b array<string>, a array<string>, want string")
    out = df.select("want", textops.outcome(F.col("v"), F.col("t"), F.col("b"), F.col("a")).alias("o")).collect()
    assert all(r.o.category == r.want for r in out) and out[1].o.introduced == ["b"] and out[4].o.regression is None


def test_scalars(spark):
    df = spark.createDataFrame([("a ```` b", "//go:embed x", "go version go1.26.5 linux", "f.go:3:7: elseif: x\nf.go:9:1: other: y")], "a string, d string, v string, o string")
    r = df.select(
        scalars.fence(F.col("a")).alias("f"),
        scalars.is_directive(F.col("d"), "//go:embed").alias("d"),
        scalars.version_between(F.col("v"), (1, 26, 4), (1, 27, 0)).alias("v"),
        scalars.findings(F.col("o"), ["elseif"]).alias("o"),
        scalars.build_status(F.lit(False), F.lit("Cannot FIND package"), ["cannot find package"]).alias("b"),
        scalars.after_header(F.lit("x HEAD  y "), "HEAD").alias("h"),
        stats.two_significant(F.lit(12022.0)).alias("s"),
    ).first()
    assert (r.f, r.d, r.v, r.b, r.h, r.s) == ("`" * 5, True, True, "NA", "y", 12000.0)
    assert [tuple(x) for x in r.o] == [("elseif", 3, 7)]


def test_paired(spark):
    rows = [(u, s, c, v) for u, s, a, b in [(1, 1, 1, 0), (1, 2, 1, 1), (2, 1, 0, 1), (2, 2, 0, 0)] for c, v in (("A", float(a)), ("B", float(b)))]
    g = paired.paired_grid(spark.createDataFrame(rows, "u int, s int, c string, v double"), "u", "s", "c", ["A", "B"], "v")
    assert {r.u: r.difference for r in paired.unit_differences(g, "u", "A", "B").collect()} == {1: 0.5, 2: -0.5}
    t = paired.transition(g, "A", "B").first()
    assert (t.both, t.neither, t.gained, t.lost, t.net) == (1, 1, 1, 1, 0)
    assert tuple(paired.discordance(g, "s", "A", "B").first())[:2] == (0.0, 1.0)


def test_mixed_model_finds_the_interaction(spark):
    r, rows = np.random.default_rng(3), []
    for u in range(300):
        b = r.normal() * 0.8
        for c in (0, 1):
            for t in (0, 1):
                for _ in range(3):
                    rows.append((u, c, t, int(r.random() < 1 / (1 + np.exp(-(b + 0.3 * c - 0.2 * t + 1.0 * c * t))))))
    df = spark.createDataFrame(rows, "u int, c int, t int, y int")
    got = mixed.interaction(df, "u", "c", "t", "y", (0, 1), (0, 1))
    assert got["low"] < 1.0 < got["high"] and 0.4 < got["intercept_sd"] < 1.2


def test_an_outlier_does_not_put_all_rows_in_one_bucket(spark):
    from evalloom.operators import order

    df = spark.range(4000).select(F.when(F.col("id") == 0, 1e12).otherwise(F.col("id").cast("double")).alias("v"), (F.col("id") % 2).alias("g"))
    for by in ([], ["g"]):
        got = order._bucketed(df, by, "v", 16, 100)
        assert got.count() == 4000
        assert max(r["count"] for r in got.groupBy(*by, "_b").count().collect()) <= 200
        lows = got.groupBy(*by, "_b").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy(*by, "_b").collect()
        assert all(a.hi < b.lo for a, b in zip(lows, lows[1:]) if not by or a.g == b.g)
    at = {r.v: r.pos for r in order.positions(df, "v", []).collect()}
    assert at[1e12] == 3999 and at[1.0] == 0 and at[2500.0] == 2499
