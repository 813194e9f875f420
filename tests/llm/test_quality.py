import random
import zlib

import numpy as np

from evalloom.llm import quality
from evalloom.llm.gam import PairwiseGam


def corpus(r, n=900):
    docs, labels = [], []
    for i in range(n):
        good = r.random() < 0.7
        w = [r.choice(["alpha", "beta", "gamma", "delta"]) + str(r.randint(0, 50)) for _ in range(r.randint(5, 80))]
        docs.append((i, " ".join(w) + "." if good else " | ".join(w).upper() + "!!", "x", 0.0))
        if i % 2:
            labels.append((i, int(good), 0))
    return docs, labels


def test_held_out_accuracy(spark, tmp_path):
    docs, labels = corpus(random.Random(4))
    truth = {d[0]: int("|" not in d[1]) for d in docs if len(d[1]) > 9}
    docs += [(5000, None, "x", 0.0), (5001, "", "x", 0.0), (5002, "long " * 200000, None, 0.0), (3, docs[3][1], "x", 0.0), (None, "no id", None, None)]
    labels += [(None, 1, 1), (7, None, None), (5, 1 - truth[5], 0)]
    spark.createDataFrame(docs, "doc_id long, text string, source string, score double").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = quality.op1_quality_gam(spark, str(tmp_path)).collect()
    assert len(got) == len(docs)
    for x in got:
        assert 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5)
        if x.doc_id is not None:
            assert x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1)
    held = [x for x in got if x.held_out and x.doc_id in truth]
    assert np.mean([x.predicted == truth[x.doc_id] for x in held]) > 0.97
    again = quality.op1_quality_gam(spark, str(tmp_path)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    kept = quality.accepted(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert kept.columns == ["doc_id", "text", "source", "score"]
    assert sorted(str(x.doc_id) for x in kept.collect()) == sorted(str(x.doc_id) for x in got if x.predicted)


def test_empty_and_unlabelled(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.fit(docs, labels) is None
    assert quality.scored(docs.limit(0), None).count() == 0
    assert quality.scored(docs, None).first().score == 0.5


def test_interactions_are_learned():
    r = np.random.default_rng(1)
    x = r.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.5)).astype(float)
    m = PairwiseGam().fit(x, y)
    assert (0, 2) in m.pairs and np.mean((m.score(x) > 0.5) == y) > 0.9


def test_sample_of_repeated_ids(spark):
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(i, f"text {i}") for i in ids] + [(ids[0], f"other {k}") for k in range(3000)] + [(ids[1], f"text {ids[1]}")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, k) for i in ids for k in (0, 1, None)] + [(None, 1)], "doc_id long, quality int")
    got = quality.training_rows(docs, labels, "quality").collect()
    assert {x.y for x in got} == {1.0} and len({x.text for x in got}) == len(got)
    some = [x.text for x in got if x.text.startswith("other") or x.text == f"text {ids[0]}"]
    assert len(some) < 30 and sorted(x.text for x in got if x.text not in some) == sorted(f"text {i}" for i in ids[1:])


def test_score_is_the_sum_of_looked_up_bins(spark, tmp_path):
    """Each row's score again from the fitted tables, text by text: a bisection a feature, a look-up a table, a sum."""
    import math
    from bisect import bisect_right

    from evalloom.llm import gam

    docs, labels = corpus(random.Random(9), 400)
    docs += [(6000, None, "x", 0.0), (6001, "", "x", 0.0), (6002, "A" * 5000, "x", 0.0)]
    spark.createDataFrame(docs, "doc_id long, text string, source string, score double").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    model = quality.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert any(np.abs(t).max() > 0 for t in model.tables) and any(np.abs(t).max() > 0 for t in model.pair_tables)
    got = {x.doc_id: x for x in quality.op1_quality_gam(spark, str(tmp_path)).collect()}
    assert len(got) == len(docs)
    for i, text, *_ in docs:
        x = quality.features([(text or "").encode()])[0].tolist()
        bins = [bisect_right(list(e), v) for e, v in zip(model.edges, x)]
        f = model.intercept + sum(t[b] for t, b in zip(model.tables, bins))
        for (a, b), t in zip(model.pairs, model.pair_tables):
            f += t[bins[a] * gam.PAIR_BINS // (len(model.edges[a]) + 1)][bins[b] * gam.PAIR_BINS // (len(model.edges[b]) + 1)]
        assert abs(got[i].score - 1 / (1 + math.exp(-f))) < 1e-9 and got[i].predicted == int(got[i].score >= 0.5)
