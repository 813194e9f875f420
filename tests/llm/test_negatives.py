import math

import numpy as np
import pytest
from oracle import compare
from pyspark.sql import functions as F

from evalloom.llm import negatives

KINDS = "vec_id long, embedding array<float>, label int, x string, rank int"


def written(spark, tmp_path, rows):
    spark.createDataFrame([(*r, "z", 7) for r in rows], KINDS).write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def brute(rows):
    ok = []
    for at, (i, v, lab) in enumerate(rows):
        if lab is not None and v and None not in v and np.isfinite(v).all():
            ok.append((at, i, [math.floor(256 * float(np.float32(c))) for c in v], (lab + 1) % 10 if i is not None and i % 7 == 0 else lab))
    out, last = [], 1 << 62
    for at, i, x, lab in ok:
        if i is None or i % 100:
            continue
        s = sorted(((-sum(a * b for a, b in zip(x, y)), last if j is None else j, to, other) for to, j, y, other in ok if to != at and len(y) == len(x)))
        for p, j, _, _ in [r for r in s if r[3] == lab][:5]:
            window = [r for r in s if r[3] != lab and 80 * -p <= 100 * -r[0] <= 100 * -p][:5]
            out += [(i, None if j == last else j, k + 1, None if m == last else m, -p, -n) for k, (n, m, _, _) in enumerate(window)]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=str)


@pytest.mark.parametrize("piece", [4096, 60])
def test_against_brute_force(spark, tmp_path, monkeypatch, piece):
    """Norms of many sizes, a label with a third of the rows, copies, ties, nulls; with several buckets and waves, and one."""
    monkeypatch.setattr(negatives, "PIECE", piece)
    r = np.random.default_rng(2)
    rows = [(i, (r.normal(size=8) * math.exp(r.normal())).round(1).tolist(), int(r.integers(10)) if i % 3 else 1) for i in range(900)]
    rows += [(1000 + i, rows[5][1], i % 3) for i in range(150)] + [(None, rows[8][1], 2), (200, rows[9][1], 4), (None, rows[200][1], 5)]
    rows += [(2000 + 100 * i, v, 1) for i, v in enumerate([None, [], [float("nan")] * 8, [float("inf")] * 8, [None] * 8, [0.0] * 8, [1.0, 2.0], [2.0, 1.0]])]
    rows += [(3001, [3.0, 3.0], 1), (3002, [3.0, 2.8], 2), (2900, [-1.0] * 8, None)]
    out = got(negatives.op11_norm_bucket_negatives(spark, written(spark, tmp_path, rows)))
    assert out == brute(rows)


def test_pruned(spark, monkeypatch):
    """Short vectors can't reach the running scores: their buckets aren't visited."""
    monkeypatch.setattr(negatives, "PIECE", 50)
    r = np.random.default_rng(4)
    rows = [(i, i % 2, (r.normal(size=6) * (1000 if i < 100 else 5)).astype(int).tolist()) for i in range(1500)]
    df, visited = spark.createDataFrame(rows, "vec_id long, label int, x array<long>"), []
    out = got(negatives.hard_negatives(df, F.col("vec_id") == 0, visited=visited))
    s = sorted((-int(np.dot(x, rows[0][2])), i, lab) for i, lab, x in rows[1:])
    want = []
    for p, i, _ in [x for x in s if x[2] == 0][:5]:
        window = [x for x in s if x[2] == 1 and 80 * -p <= 100 * -x[0] <= 100 * -p][:5]
        want += [(0, i, k + 1, j, -p, -n) for k, (n, j, _) in enumerate(window)]
    assert out == sorted(want, key=str) and out
    assert sum(n for _, _, n in visited) < 0.5 * sum(b - a for a, b, _ in visited)


def test_whole_numbers_beyond_doubles(spark):
    big = 1 << 30
    rows = [(0, 1, [big, big]), (1, 1, [big, big - 1]), (2, 2, [big - 1, big - 1]), (3, 2, [big - 1, big - 2])]
    df = spark.createDataFrame(rows, "vec_id long, label int, x array<long>")
    out = got(negatives.hard_negatives(df, F.col("vec_id") == 0))
    assert out == [(0, 1, 1, 2, 2 * big * big - big, 2 * big * big - 2 * big), (0, 1, 2, 3, 2 * big * big - big, 2 * big * big - 3 * big)]


@pytest.mark.parametrize("rows", [[], [(1, [1.0], 1)], [(100, [1.0], 1)], [(100, [1.0], None), (1, [1.0], 1)], [(100, [1.0], 1), (2, [1.0], 1)]])
def test_nothing_to_find(spark, tmp_path, rows):
    assert negatives.op11_norm_bucket_negatives(spark, written(spark, tmp_path, rows)).count() == 0


def test_same_as_sql(spark):
    want = compare(spark, negatives.op11_norm_bucket_negatives, negatives.OP11_SQL, "/root/testdata/sf0.001")
    assert want[0] == want[1] and len(want[0][1]) > 50
