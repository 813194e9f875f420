import os
import random
from collections import defaultdict

import pytest

from evalloom.llm import mixing


def brute_targets(z):
    w = [(5, 2, 1)[i % 3] for i in range(len(z))]
    cap = [None] * len(z)
    while True:
        left = 1.5 * sum(z) - sum(2 * z[i] for i in range(len(z)) if cap[i])
        free = sum(w[i] for i in range(len(z)) if not cap[i] and z[i])
        t = [2.0 * z[i] if cap[i] else (left * w[i] / free if z[i] else 0.0) for i in range(len(z))]
        new = [i for i in range(len(z)) if not cap[i] and t[i] > 2 * z[i]]
        if not new:
            return t
        for i in new:
            cap[i] = True


def test_mix(spark, tmp_path):
    r = random.Random(3)
    rows = [(i, " ".join("x" * r.randint(1, 400)), r.choice(["a", "b", "b", "c", "c", "c", "é", None])) for i in range(400)]
    rows += [(900, None, "a"), (901, "", None), (902, " \n", "only"), (977, "same row", "b"), (977, "same row", "b"), (None, "no id at all", "c"), (903, "y " * 30000, "b")]
    spark.createDataFrame([(*x, "clash", 5) for x in rows], "doc_id long, text string, source string, target string, rank int").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = mixing.op3_source_mixing(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    assert sorted((x.doc_id, x.size) for x in got if x.doc_id is not None) == sorted((d, len((t or "").split())) for d, t, _ in rows if d is not None)
    z = defaultdict(int)
    for _, t, s in rows:
        z[s] += len((t or "").split())
    order = sorted(z, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, brute_targets([z[s] for s in order])))
    of = {d: s for d, _, s in rows}
    taken = defaultdict(int)
    for x in got:
        assert 0 <= x.taken <= 2 * x.size
        assert x.source_size == z[of[x.doc_id]] and abs(x.target - want[of[x.doc_id]]) < 1e-6
        taken[of[x.doc_id]] += x.taken
    for s in order:
        assert int(want[s] + 1e-9) - 1 <= taken[s] <= want[s] + 1e-6
    again = mixing.op3_source_mixing(spark, str(tmp_path)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    docs = mixing.mixed(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    assert docs.columns == ["doc_id", "text", "source", "target", "rank"]
    n = defaultdict(int)
    for x in docs.collect():
        n[x.source] += len(x.text.split())
    assert dict(n) == {s: t for s, t in taken.items() if t}


def test_schedule_is_even(spark):
    rows = sorted((x.slot, x.src, x["rank"]) for x in mixing.schedule(spark, [700, 200, 95, 0, 5], 1).collect())
    assert len(rows) == 1000 and len({x[1:] for x in rows}) == 1000
    first = [s for i, s, _ in rows if i < 100]
    assert abs(first.count(0) - 70) <= 3 and abs(first.count(1) - 20) <= 3


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert mixing.op3_source_mixing(spark, str(tmp_path)).count() == 0
    assert mixing.mixed(spark.read.parquet(f"{tmp_path}/documents.parquet")).count() == 0


def test_taken_by_document_recomputed(spark):
    """``taken`` of every row by plain Python: hash order, places in the source's stream, the part of two passes below the target."""
    import re
    import struct
    from fractions import Fraction

    import duckdb
    from xxhash import xxh64_intdigest

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    rows = duckdb.sql(f"SELECT doc_id, source, text FROM '{folder}/documents.parquet'").fetchall()
    size = {i: len(re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for i, _, t in rows}
    sources = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    whole = {s: sum(size[i] for i, z, _ in rows if z == s) for s in sources}
    # targets by exact shares, reshared until none passes twice its size
    weight = {s: Fraction((5, 2, 1)[k % 3]) for k, s in enumerate(sources)}
    left, free, aim = Fraction(3, 2) * sum(whole.values()), {s for s in sources if whole[s]}, dict.fromkeys(sources, Fraction(0))
    while free:
        unit = left / sum(weight[s] for s in free)
        over = {s for s in free if unit * weight[s] > 2 * whole[s]}
        for s in over or free:
            aim[s] = Fraction(2 * whole[s]) if over else unit * weight[s]
        if not over:
            break
        left, free = left - sum(aim[s] for s in over), free - over

    def place(i, t):
        h = xxh64_intdigest((t or "").encode(), 42) if t is not None else 42
        h = h - (1 << 64) if h >= 1 << 63 else h
        seed = xxh64_intdigest(struct.pack("<i", mixing.SEED), 42)
        for v in (i, size[i], h):
            seed = xxh64_intdigest(struct.pack("<q", v), seed)
        return seed

    bits = mixing.fold(len(rows))
    signed = lambda h: h - (1 << 64) if h >= 1 << 63 else h
    want = {}
    for s in sources:
        at, cut = 0, int(aim[s])
        for _, _, i in sorted(((h := place(i, t)) >> (64 - bits), signed(h), i) for i, z, t in rows if z == s):
            spans = [(at + e * whole[s], at + e * whole[s] + size[i]) for e in range(2)]
            want[i] = (size[i], whole[s], float(aim[s]), sum(max(0, min(b, cut) - a) for a, b in spans))
            at += size[i]
    got = {r.doc_id: r for r in mixing.op3_source_mixing(spark, folder).collect()}
    assert len(got) == len(rows)
    for i, (n, z, t, k) in want.items():
        assert (got[i]["size"], got[i].source_size, got[i].taken) == (n, z, k) and got[i].target == pytest.approx(t, rel=1e-12)
