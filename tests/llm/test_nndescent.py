import numpy as np

from evalloom.llm import nndescent


def brute(rows):
    ok = [i for i, (_, e, lab) in enumerate(rows) if lab is not None and e and None not in e and np.isfinite(e).all() and np.any(np.array(e))]
    x = {i: np.array(rows[i][1], float) / np.linalg.norm(np.array(rows[i][1], float)) for i in ok}
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    n = [0] * len(rows)
    for k, i in enumerate(ok):
        for j in ok[:k]:
            if rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]) and x[i] @ x[j] >= 0.93:
                n[i] += 1
                n[j] += 1
                root[find(i)] = find(j)
    return {r[0]: (n[i], min(rows[j][0] for j in range(len(rows)) if find(j) == find(i))) for i, r in enumerate(rows)}


def test_against_brute_force(spark, tmp_path):
    r = np.random.default_rng(1)
    rows = []
    add = lambda v, lab: rows.append((len(rows), v, lab))
    for _ in range(900):
        add(r.normal(size=16).tolist(), int(r.integers(3)))
    for size in (2, 2, 3, 5, 20, 150):
        c = r.normal(size=16)
        for _ in range(size):
            add((c + 0.05 * r.normal(size=16)).tolist(), 1)
    for i in range(40):
        add(rows[7][1], rows[7][2])
        add([2 * v for v in rows[i][1]], rows[i][2])
    for v in (None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] * 16, [None] * 16, [1.0, 2.0]):
        add(v, 1)
    add(rows[0][1], None)
    spark.createDataFrame([(*x, "z") for x in rows], "vec_id long, embedding array<float>, label int, node string").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = [(i, None if e is None else [None if v is None else float(np.float32(v)) for v in e], lab) for i, e, lab in rows]
    got = {x.vec_id: x for x in nndescent.op4_embedding_near_dedup(spark, str(tmp_path)).collect()}
    want = brute(rows)
    assert len(got) == len(rows)
    wrong = [i for i in want if (got[i].n_links, got[i].component_id) != want[i]]
    assert sum(got[i].n_links for i in got) >= 0.995 * sum(n for n, _ in want.values())
    assert len(wrong) <= 4, [(i, got[i], want[i]) for i in wrong[:5]]
    assert all(x.kept == (x.vec_id == x.component_id) for x in got.values())


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert nndescent.op4_embedding_near_dedup(spark, str(tmp_path)).count() == 0
