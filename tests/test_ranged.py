import random
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalloom.operators import permute, ranged, records, sequence


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(ranged, "ROWS", 40)


def table(spark, n=700, seed=1):
    """One user (and the null user) holds half of the rows; ties in time are broken by the id."""
    r = random.Random(seed)
    rows = [(r.choice(["hot", "hot", "hot", None, "a", "b", "c"]), r.randrange(200), i, r.choice("xxxxy") if r.random() < 0.9 else None, r.randrange(9) if r.random() < 0.9 else None) for i in range(n)]
    return rows, spark.createDataFrame(rows, "user string, ts long, id long, kind string, v long")


def by_user(rows):
    out = {}
    for x in sorted(rows, key=lambda x: (x[1], x[2])):
        out.setdefault(x[0], []).append(x)
    return out


def test_runs(spark, small):
    rows, df = table(spark)
    got = sorted(map(str, sequence.run_lengths(df, ["user"], ["ts", "id"], ["kind"]).collect()))
    want = []
    for user, own in by_user(rows).items():
        at = 1
        for kind, run in groupby(own, key=lambda x: x[3]):
            n = len(list(run))
            want.append(str(spark_row(user=user, kind=kind, first_pos=at, run_length=n)))
            at += n
    assert got == sorted(want)


def spark_row(**kw):
    from pyspark.sql import Row

    return Row(**kw)


def test_one_run_over_all_ranges(spark, small):
    df = spark.range(500).select(F.lit(1).alias("g"), F.col("id"), F.lit("k").alias("k"))
    assert sequence.run_lengths(df, ["g"], ["id"], ["k"]).collect() == [spark_row(g=1, k="k", first_pos=1, run_length=500)]


def test_totals_and_positions(spark, small):
    rows, df = table(spark, seed=2)
    got = {x.id: x for x in records.running_totals(df, ["user"], ["ts", "id"], ["v"]).collect()}
    at = {x.id: x._at for x in ranged.numbered(ranged.ranged(df, ["user"], ["ts", "id"]), ["user"]).collect()}
    assert len(got) == len(rows)
    for own in by_user(rows).values():
        total = None
        for i, x in enumerate(own):
            total = total if x[4] is None else (total or 0) + x[4]
            assert got[x[2]].total_v == total or (total in (None, 0) and got[x[2]].total_v in (None, 0)), x
            assert at[x[2]] == i


def test_empty(spark):
    df = spark.createDataFrame([], "user string, ts long, id long, kind string, v long")
    assert sequence.run_lengths(df, ["user"], ["ts"], ["kind"]).count() == 0
    assert records.running_totals(df, ["user"], ["ts"], ["v"]).count() == 0
    assert sequence.greedy_buckets(df, ["user"], "v", "id").count() == 0


def greedy(rows, batch, cap):
    """(group, length, key) in order: the plain loop."""
    out = {}
    for _, own in groupby(sorted(rows, key=lambda x: (x[0] is not None, x[0], x[1], x[2])), key=lambda x: x[0]):
        bucket = held = 0
        for g, n, k in own:
            if held and (held + 1 > batch or (held + 1) * n > cap):
                bucket, held = bucket + 1, 0
            held += 1
            out[g, k] = bucket
    return out


@pytest.mark.parametrize(("batch", "cap", "groups"), [(16, 400, 3), (16, 400, 1), (7, 60, 2), (1, 10, 2), (50, 10_000, 1), (5, 1, 1)])
def test_greedy_buckets(spark, batch, cap, groups):
    """Many ranges, one of the groups over most of them; a row too long for the cap fills a bucket of its own."""
    r = random.Random(batch)
    rows = [(r.randrange(groups) if r.random() < 0.4 else 0, r.randrange(1, 80), i) for i in range(900)]
    df = spark.createDataFrame(rows, "g int, n int, k int")
    got = {(x.g, x.k): x.bucket for x in sequence.greedy_buckets(df, ["g"], "n", "k", batch, cap, rows=60).collect()}
    assert got == greedy(rows, batch, cap)
    whole = sequence.greedy_buckets(df, [], "n", "k", batch, cap, rows=60)
    assert {x.k: x.bucket for x in whole.collect()} == {k: b for (_, k), b in greedy([(0, n, k) for _, n, k in rows], batch, cap).items()}


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 100, 1025, 4097])
def test_permutation(spark, n):
    rows = spark.range(n).select(permute.permuted(F.col("id"), n, F.lit("k"), F.lit(1)).alias("a"), permute.permuted(F.col("id"), n, F.lit("k"), F.lit(2)).alias("b")).collect()
    a, b = [x.a for x in rows], [x.b for x in rows]
    assert sorted(a) == sorted(b) == list(range(n))
    assert n < 16 or (a != b and abs(np.corrcoef(a, range(n))[0, 1]) < 0.75 and a != list(range(n)))


def test_stream_without_shuffle(spark):
    big = permute.mixture(spark.range(10**9).select(F.col("id").alias("position")), 10**7 + 3, 999_999, 0.2, 42)
    plan = big._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    some = big.where("position % 100000007 = 5").collect()
    assert all(0 <= x["index"] < (999_999 if x.pool == "aux" else 10**7 + 3) for x in some) and len(some) == 10


def test_condition_stream(spark):
    mixed = permute.mixture(spark.range(200).select(F.col("id").alias("position")), 11, 4, 0.25, 3)
    main = spark.range(11).select(F.col("id").alias("index"), F.concat(F.lit("m"), "id").alias("item"))
    aux = spark.range(4).select(F.col("id").alias("index"), F.concat(F.lit("a"), "id").alias("item"))
    other = spark.createDataFrame([(10, 2, "x"), (30, 2, "y"), (0, 1, "z")], "from_ordinal long, index long, item string")
    got = permute.condition_stream(mixed, main, aux, other).collect()
    assert len(got) == 200 and sum(x.pool == "aux" for x in got) == 50
    for x in got:
        want = f"{x.pool[0]}{x['index']}"
        if x.pool == "aux" and x["index"] == 1:
            want = "z"
        if x.pool == "aux" and x["index"] == 2 and x.ordinal >= 10:
            want = "y" if x.ordinal >= 30 else "x"
        assert x.item == want
    aux_draws = [x["index"] for x in sorted(got, key=lambda x: x.position) if x.pool == "aux"]
    assert all(sorted(aux_draws[i : i + 4]) == [0, 1, 2, 3] for i in range(0, 48, 4))


def test_nearest_over_ranges(spark, small):
    """Half of the left rows have one value; nulls; right values far from some ranges."""
    r = random.Random(6)
    left = [(i, None if i % 50 == 0 else 500 if i % 2 else r.randrange(1000)) for i in range(400)]
    right = [(r.randrange(0, 300, 7), k) for k in range(60)] + [(900, 70), (900, 69), (None, 71)]
    got = sequence.nearest(spark.createDataFrame(left, "id int, v int"), "v", spark.createDataFrame(right, "w int, key int"), "w", "key").collect()
    assert len(got) == 400
    for x in got:
        want = min(((abs(w - x.v), k) for w, k in right if w is not None), default=None) if x.v is not None else (None, None)
        assert (x.distance, x.nearest) == want


def test_positions_of_one_value(spark, small):
    """A value that fills many ranges, and values of very different size."""
    from evalloom.operators import order

    df = spark.range(500).select(F.when(F.col("id") < 300, 1.0).when(F.col("id") == 499, 1e12).otherwise(F.col("id").cast("double")).alias("v"), F.lit(1).alias("w"))
    got = order.positions(df, "v", []).orderBy("pos").collect()
    assert [x.pos for x in got] == list(range(500)) and [x.v for x in got] == sorted(x.v for x in got)
    parts = ranged.ranged(df.withColumn("i", F.monotonically_increasing_id()), [], ["v", "i"]).groupBy("_part").count().collect()
    assert len(parts) >= 10 and max(x["count"] for x in parts) < 150
    total = order.running_total(df, [], "v", F.col("w"), "upto").agg(F.max("upto")).first()[0]
    assert total == 500


def test_nearest_is_one_pass_a_range(spark):
    """A range's rows each look at one row more, not at all that follow: frames grow from the range's start."""
    left = spark.range(150_000).select("id", ((F.col("id") * 7919) % 1_000_003).alias("v"))
    right = spark.range(20_000).select(F.col("id").alias("key"), ((F.col("id") * 104_729) % 1_000_003).alias("w"))
    got = sequence.nearest(left, "v", right, "w", "key")
    assert "unboundedfollowing" not in got._jdf.queryExecution().toString().lower()
    w = np.sort(np.arange(20_000) * 104_729 % 1_000_003)
    v = np.arange(150_000) * 7919 % 1_000_003
    at = np.searchsorted(w, v)
    want = np.minimum(np.abs(w[np.minimum(at, len(w) - 1)] - v), np.abs(w[np.maximum(at - 1, 0)] - v))
    pdf = got.toPandas().sort_values("id")
    assert (pdf["distance"].to_numpy() == want).all() and ((pdf["nearest"] * 104_729 % 1_000_003 - pdf["v"]).abs() == pdf["distance"]).all()


def test_stratified_sample_is_one_pass_a_range(spark):
    """More draws than main rows, all in one range; each goes to the auxiliary row of nearest length."""
    from evalloom.plans import prepared

    main = spark.range(500).select("id", (F.col("id") * 37 % 1009).alias("n"))
    aux = spark.range(1000, 1100).select("id", (F.col("id") * 53 % 1009).alias("n"))
    got = prepared.stratified_sample(main, aux, "n", "id", 3_000, 5)
    assert "unboundedfollowing" not in got._jdf.queryExecution().toString().lower()
    rows = got.collect()
    assert sorted(r.draw for r in rows) == list(range(3_000)) and len({r.main_key for r in rows}) > 450
    for r in rows:
        assert (r.distance, r.nearest) == min((abs(k * 53 % 1009 - r.main_key * 37 % 1009), k) for k in range(1000, 1100))


def test_stratified_sample_seeks_a_length_once(spark, small, monkeypatch):
    """A thousand draws over a few lengths (one of half the rows, a null one): each length meets the auxiliary rows once."""
    from evalloom.plans import prepared

    nearest, sought = sequence.nearest, []
    monkeypatch.setattr(sequence, "nearest", lambda left, *of: (sought.append(left.count()), nearest(left, *of))[1])
    lengths = {i: None if i % 50 == 0 else 7 if i % 2 else i % 9 * 3 for i in range(300)}
    main = spark.createDataFrame(list(lengths.items()), "id long, n long")
    aux = spark.createDataFrame([(900, 5), (901, 5), (902, 9), (903, None), (904, 20)], "id long, n long")
    rows = prepared.stratified_sample(main, aux, "n", "id", 1_000, 5).collect()
    assert sought == [len({v for v in lengths.values() if v is not None})]
    assert sorted(r.draw for r in rows) == list(range(1_000))
    for r in rows:
        v = lengths[r.main_key]
        assert (r.distance, r.nearest) == (min((abs(w - v), k) for k, w in ((900, 5), (902, 9), (904, 20))) if v is not None else (None, None))


def test_stratified_sample_of_no_rows(spark):
    from evalloom.plans import prepared

    none, one = spark.createDataFrame([], "id long, n long"), spark.createDataFrame([(1, 2)], "id long, n long")
    assert prepared.stratified_sample(none, one, "n", "id", 5, 5).count() == 0
    assert [(r.main_key, r.nearest) for r in prepared.stratified_sample(one, none, "n", "id", 2, 5).collect()] == [(1, None)] * 2
