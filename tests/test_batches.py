import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evalloom.functions import scanner
from evalloom.operators import batches, ranged
from evalloom.plans import evaluate


def lines(spark, n=300):
    return spark.range(n).select(F.col("id").alias("pos"), (F.col("id") % 3).alias("g"), (F.col("id") * 7 % 41 + 1).alias("len"))


def widths():
    def widest(t):
        n = t["len"].to_numpy()
        return pa.table({"w": np.full(len(n), n.max()), "pos": t["pos"]})

    return widest


@pytest.mark.parametrize("cap", [None, 200])
def test_restored_in_order(spark, monkeypatch, cap):
    monkeypatch.setattr(ranged, "ROWS", 70)
    got = batches.restored(lines(spark), "pos", "g", "len", widths(), "w long", 8, cap).collect()
    assert [r.pos for r in got] == list(range(300))
    want = {}
    for g in range(3):
        own = sorted((r.len, r.pos) for r in got if r.g == g)
        batch = []
        for n, p in [*own, (None, None)]:
            if batch and (n is None or len(batch) == 8 or (cap and (len(batch) + 1) * n > cap)):
                want |= {q: batch[-1][0] for _, q in batch}
                batch = []
            batch.append((n, p))
    assert {r.pos: r.w for r in got} == want


@pytest.mark.parametrize("fault", ["lost", "doubled", "strange"])
def test_every_position_returns_once(spark, fault):
    widest = widths()

    def bad(t):
        import pyarrow.compute  # noqa: F401

        out = widest(t)
        if pa.compute.any(pa.compute.equal(out["pos"], 17)).as_py():
            i = out["pos"].to_pylist().index(17)
            if fault == "lost":
                return pa.concat_tables([out[:i], out[i + 1 :]])
            if fault == "doubled":
                return pa.concat_tables([out, out[i : i + 1]])
            return pa.table({"w": out["w"], "pos": [p if p != 17 else -5 for p in out["pos"].to_pylist()]})
        return out

    with pytest.raises(Exception, match="exactly once"):
        batches.restored(lines(spark, 60), "pos", "g", "len", bad, "w long", 8).collect()


def test_nothing_to_restore(spark):
    assert batches.restored(lines(spark, 0), "pos", "g", "len", widths(), "w long").count() == 0


def test_composite(spark):
    df = spark.createDataFrame([("a", ["x"], ["x"]), ("a", ["y"], ["x"]), ("b", None, None)], "task_type string, p array<string>, g array<string>")
    f1 = evaluate.Scorer("f1", "a", 64, evaluate.macro_f1_of("p", "g", ["x", "y"]))
    hit = evaluate.Scorer("hit", "b", 64, evaluate.rate_of(F.col("p").isNull()))
    none = evaluate.Scorer("none", "c", 64, evaluate.rate_of(F.lit(True)))
    got = evaluate.composite(df, [f1, hit, none]).first()
    assert (got.f1, got.hit, got.none) == (pytest.approx((2 / 3) / 2), 1.0, 0.0) and got.composite == pytest.approx((1 / 3 + 1) / 3)
    with pytest.raises(Exception, match="none has no rows"):
        evaluate.composite(df, [f1, none], whole=True).collect()
    with pytest.raises(ValueError):
        evaluate.composite(df, [f1, f1])


SOURCES = [
    ('package p\nvar u = "http://x" // y', [], 'package p var u = "http://x"'),
    ('// import "C"\npackage p\nvar s = `import "C"`', [], 'package p var s = `import "C"`'),
    ('package p\nimport . "C"\n', ["cgo"], 'package p import . "C"'),
    ('package p\nimport (\n"fmt"; _ "C"\n)', ["cgo"], None),
    ('package p\nimport (\n"fmt"\n)\nvar c = "C"', [], None),
    ("//go:build a\npackage p\n//go:build b", ["build_tags"], "package p"),
    ("package p\n//go:build b", [], None),
    ("package p\n//go:embed x\nvar a string", ["go:embed"], None),
    ("package p\nvar b = '\"' /* uintptr */ + '\\''", [], "package p var b = '\"' + '\\''"),
    ("func (r R) M(x uintptr) {}", ["unsafe_ptr"], None),
    ("type A[T interface{ ~int }] struct{}", ["generics"], None),
    ("type A [n]int\nfunc f(a []int) { x[a] = y }", [], None),
    ("type (\n B struct { x [3]int }\n C[K comparable, V any] map[K]V\n)", ["generics"], None),
    ("type B struct {\n x [n]int\n}\nfunc Map[K, V any](m map[K]V) {}", ["generics"], None),
    ('var broken = "unclosed\nvar x uintptr', ["unsafe_ptr"], 'var broken = "unclosed var x uintptr'),
    ("", [], ""),
    ("/* open", [], "/* open"),
]


def test_scanner(spark):
    df = spark.createDataFrame([(i, s[0]) for i, s in enumerate(SOURCES)], "i int, c string")
    got = {r.i: r for r in df.select("i", "c", scanner.construct_flags(F.col("c")).alias("f"), scanner.verbatim(F.col("c")).alias("v"), F.array_join(scanner.tokens(F.col("c")), "").alias("t")).collect()}
    for i, (code, flags, bare) in enumerate(SOURCES):
        assert got[i].t == code
        assert got[i].f == flags, (code, got[i].f)
        assert bare is None or got[i].v == bare, (code, got[i].v)
    long = 'package p\nvar s = "' + "a\\n" * 3000 + '"\n' + "x = y // z\n" * 4000 + "var p unsafe.Pointer"
    r = spark.createDataFrame([(long,)], "c string").select(scanner.construct_flags(F.col("c")).alias("f"), scanner.verbatim(F.col("c")).alias("v")).first()
    assert r.f == ["unsafe_ptr"] and "z" not in r.v
