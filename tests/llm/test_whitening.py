import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalloom.llm import whitening

KINDS = "vec_id long, embedding array<float>, label int, x string, component int"


def written(spark, tmp_path, rows):
    spark.createDataFrame([(*r, "z", 7) for r in rows], KINDS).write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def brute(rows):
    """By Python integers and numpy, from the contract."""
    fit = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in e]) for i, e, _ in rows]
    n, d = len(fit), len(fit[0][1])
    total = [sum(x[j] for _, x in fit) for j in range(d)]
    deviation = [sum((n * v - s) ** 2 for v, s in zip(x, total)) for _, x in fit]
    y = np.array([[(n * v - s) / n for v, s in zip(x, total)] for _, x in fit])
    e, w = np.linalg.eigh(y.T @ y / n)
    e, w = e[::-1], w[:, ::-1]
    return deviation, y @ w / np.sqrt(np.maximum(e, 1e-300)), e / e.sum()


def test_against_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(whitening, "ROW_BLOCK", 50)
    r = np.random.default_rng(3)
    mix = r.normal(size=(40, 40)) * np.linspace(0.2, 2, 40)
    good = [(i, (r.normal(size=40) @ mix + 3).tolist(), 1) for i in range(300)]
    good += [(None, good[4][1], 2), (4, good[4][1], None)]
    bad = [(500 + i, v, 1) for i, v in enumerate([None, [], [float("nan")] * 40, [float("inf")] * 40, [None] * 40, [1.0, 2.0]])]
    out = whitening.op13_embedding_whitening(spark, written(spark, tmp_path, good + bad)).collect()
    assert len(out) == 32 * len(good) and {x.n for x in out} == {len(good)}
    deviation, white, explained = brute(good)
    by = {}
    for x in out:
        by.setdefault(x.component, []).append(x)
    for c in range(1, 33):
        rows = [x for x in by[c] if x.vec_id is not None and x.vec_id != 4]
        want = {i: (deviation[k], white[k, c - 1]) for k, (i, _, _) in enumerate(good)}
        sign = np.sign(sum(x.whitened * want[x.vec_id][1] for x in rows))
        assert all(x.deviation == want[x.vec_id][0] for x in rows)
        assert max(abs(x.whitened * sign - want[x.vec_id][1]) for x in rows) < 1e-9
        assert {round(x.explained, 12) for x in rows} == {round(explained[c - 1], 12)}
    assert {x.identity_error for x in out} == {out[0].identity_error} and out[0].identity_error < 1e-9


def test_no_scale(spark, tmp_path):
    same = [(i, [0.5, float(i % 2), 1.0], 1) for i in range(6)]
    out = whitening.op13_embedding_whitening(spark, written(spark, tmp_path, same)).collect()
    assert len(out) == 18 and {(x.component, x.whitened is None, x.explained) for x in out} == {(1, False, 1.0), (2, True, 0.0), (3, True, 0.0)}
    assert all(x.identity_error < 1e-12 for x in out)


def test_one_row_and_empty(spark, tmp_path):
    one = whitening.op13_embedding_whitening(spark, written(spark, tmp_path / "a", [(1, [1.0, 2.0], 1)])).collect()
    assert [(x.deviation, x.whitened, x.explained, x.identity_error) for x in one] == [(0, None, 0.0, None)] * 2
    none = whitening.op13_embedding_whitening(spark, written(spark, tmp_path / "b", []))
    assert none.count() == 0 and dict(none.dtypes)["deviation"] == "bigint"


def test_exact_beyond_longs(spark):
    rows = spark.range(3).select(F.col("id").alias("vec_id"), F.array(F.col("id") * (1 << 40), F.lit(5).cast("long")).alias("x"))
    out = {x.vec_id: int(x.deviation) for x in whitening.whitened(rows).where("component = 1").collect()}
    assert out == {0: (3 << 40) ** 2, 1: 0, 2: (3 << 40) ** 2}


def test_too_large(spark, tmp_path):
    with pytest.raises(Exception, match="too large"):
        whitening.op13_embedding_whitening(spark, written(spark, tmp_path, [(1, [1e30, 2.0], 1)])).collect()
