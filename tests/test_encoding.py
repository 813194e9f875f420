import hashlib
import json

import pytest
from pyspark.sql import functions as F

from evalloom.functions import encoding, summaries
from evalloom.operators import constraints
from evalloom.operators.constraints import ConstraintError
from evalloom.plans import prepared

SPECIALS = {"begin": 1, "start_header": 2, "end_header": 3, "end_turn": 4}


def letters(c):
    """Ids of a text: its characters' code points."""
    return F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))


def ids(text):
    return [ord(c) for c in text]


def test_chat_framing_and_example(spark):
    df = spark.createDataFrame([("sy", "hello", "out")], "s string, u string, t string")
    prompt = encoding.framed(F.col("s"), F.col("u"), letters, SPECIALS)
    got = df.select(encoding.example(prompt, F.col("t"), letters, 4).alias("e")).select("e.*").first()
    head = lambda role: [2, *ids(role), 3, 10, 10]
    want = [1, *head("system"), *ids("sy"), 4, *head("user"), *ids("hello"), 4, *head("assistant")]
    assert got.prompt_len == len(want) and got.input_ids == [*want, *ids("out"), 4]


@pytest.mark.parametrize("cap", [None, 5, 2, 1])
def test_collated(spark, cap):
    rows = [(0, 0, [11, 12, 13, 14], 2), (1, 0, [21, 22, 23, 24, 25, 26, 27], 4), (2, 1, [31], 1), (3, 1, [41, 9, 43], 1)]
    df = spark.createDataFrame(rows, "k int, batch long, ids array<long>, p long")
    got = {r.k: r for r in encoding.collated(df, "ids", "p", 9, cap).collect()}
    for b in (0, 1):
        own = [r for r in rows if r[1] == b]
        width = max(len(r[2]) for r in own)
        width = width if cap is None else min(width, cap)
        for k, _, x, p in own:
            full = x[:width] + [9] * max(0, width - len(x))
            targets = [-100 if i < min(max(0, p - 1), width - 1) or t == 9 else t for i, t in enumerate(full[1:])]
            assert (got[k].inputs, got[k].targets) == (full[:-1], targets)


def test_output_line(spark):
    ddl = f"i string, s {summaries.OUTPUT_DDL}"
    full = ("x", True, "file", [(1, 0, "a b", [{"a": "a"}, {"v": "b"}]), (2, 1, "c", None)], ["cgo"], None)
    df = spark.createDataFrame([("x", full), ("y", ("y", False, None, None, None, "bad"))], ddl)
    got = [json.loads(r[0]) for r in df.select(summaries.output_line(F.col("i"), F.col("s"))).collect()]
    assert got[0] == {"id": "x", "ok": True, "parse_strategy": "file", "lines": [{"tier": 1, "depth": 0, "text": "a b", "segments": [{"a": "a"}, {"v": "b"}]}, {"tier": 2, "depth": 1, "text": "c", "segments": []}], "excluded_constructs": ["cgo"], "parse_error": ""}
    assert got[1] == {"id": "y", "ok": False, "parse_strategy": "", "lines": [], "excluded_constructs": [], "parse_error": "bad"}
    bad = spark.createDataFrame([("x", ("x", True, "file", [(1, 0, "a", [{"a": "a", "v": "b"}])], [], None))], ddl)
    with pytest.raises(Exception, match="one key"):
        bad.select(summaries.output_line(F.col("i"), F.col("s"))).collect()


def study(spark, change=None):
    """Tables of a small prepared study; ``change`` spoils one of them."""
    t = {
        "tasks": [(i, s, s, k) for i, s in (("a", "train"), ("b", "train"), ("c", "validation"), ("d", "validation"), ("e", "test")) for k in ("x", "y")],
        "length_exclusions": [("b",)],
        "adjudications": [("c", "validation", "exclude", "r"), ("e", "test", "fixture_fix", "r")],
        "quarantine": [("e", "test")],
        "composite": [("d",)],
        "summaries": [(i,) for i in "abcde"],
        "auxiliary": [("a", 1), ("b", 2)],
        "source": [("a", 1), ("b", 2), ("c", 3)],
    }
    ddl = {"tasks": "id string, split string, file string, task_type string", "adjudications": "id string, split string, resolution string, reason string", "quarantine": "id string, split string", "auxiliary": "id string, v int", "source": "id string, v int"}
    if change:
        change(t)
    frames = {k: spark.createDataFrame(v, ddl.get(k, "id string")) for k, v in t.items()}
    return prepared.Prepared(kinds=["x", "y"], exclusion_checksum=hashlib.sha256(b"b").hexdigest(), auxiliary_columns=("v",), **frames)


def swap(table, at, row):
    def change(t):
        t[table][at : at + 1] = [row] if row else []

    return change


def test_prepared_study(spark):
    prepared.validate(study(spark))


@pytest.mark.parametrize(("change", "said"), [
    (swap("tasks", 0, None), "complete tasks"),
    (swap("tasks", 0, ("a", "test", "train", "x")), "split of file"),
    (swap("length_exclusions", 0, ("c",)), "train ids"),
    (swap("length_exclusions", 0, ("a",)), "checksum"),
    (swap("adjudications", 0, ("c", "test", "exclude", "r")), "adjudication ids"),
    (swap("quarantine", 0, ("e", "train")), "quarantine ids"),
    (swap("composite", 0, None), "composite validation ids are missing"),
    (swap("composite", 0, ("c",)), "retained validation ids"),
    (swap("summaries", 0, None), "every id has a summary"),
    (swap("summaries", 0, ("z",)), "known id"),
    (swap("auxiliary", 0, ("a", 9)), "agrees with source"),
])
def test_each_fault_is_found(spark, change, said):
    with pytest.raises(ConstraintError, match=said):
        prepared.validate(study(spark, change))


def test_checksum_tree_and_multiset(spark):
    names = [f"id{i:04d}" for i in range(100)]
    df = spark.createDataFrame([("g", n) for n in names] + [("h", "x"), (None, "y"), ("g", "id0003")], "g string, n string")
    one = {r.g: (r.checksum, r.n) for r in constraints.id_checksum(df, ["g"], "n").collect()}
    digest = lambda xs: hashlib.sha256("\n".join(xs).encode()).hexdigest()
    assert one == {"g": (digest(names), 100), "h": (digest(["x"]), 1), None: (digest(["y"]), 1)}
    tree = {r.g: r.checksum for r in constraints.id_checksum(df, ["g"], "n", rows=30).collect()}
    assert tree["g"] == digest([digest(names[a : a + 30]) for a in range(0, 100, 30)]) and tree["h"] == one["h"][0]
    a = {r.g: (r.n, r.digest) for r in constraints.multiset_digest(df, ["g"], "n").collect()}
    b = {r.g: (r.n, r.digest) for r in constraints.multiset_digest(df.repartition(7), ["g"], "n").collect()}
    c = {r.g: (r.n, r.digest) for r in constraints.multiset_digest(df.where("n <> 'id0003'"), ["g"], "n").collect()}
    assert a == b and a["g"][0] == 101 and c["g"] != a["g"] and c["h"] == a["h"]


def test_checksum_of_many_leaves(spark, monkeypatch):
    """A group's digest is that of its lines, of however many leaves and batches; ids in their order as text, distinct, nulls left out."""
    monkeypatch.setattr(constraints, "CHECKSUM_ROWS", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        df = spark.range(400).select(F.when(F.col("id") < 300, "big").when(F.col("id") < 307, "one").when(F.col("id") < 315, None).otherwise("two").alias("g"), "id")
        df = df.union(df.where("id < 9")).union(spark.sql("select 'big', cast(null as bigint)"))
        got = {r.g: (r.checksum, r.n) for r in constraints.id_checksum(df, ["g"], "id").collect()}
        lines = lambda a, b: (hashlib.sha256("\n".join(sorted(map(str, range(a, b)))).encode()).hexdigest(), b - a)
        assert got == {"big": lines(0, 300), "one": lines(300, 307), None: lines(307, 315), "two": lines(315, 400)}
        whole = constraints.id_checksum(df, [], "id").first()
        assert (whole.checksum, whole.n) == lines(0, 400)
        assert constraints.id_checksum(df.limit(0), ["g"], "id").count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
