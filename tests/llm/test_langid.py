import random

import numpy as np

from evalloom.llm import langid
from evalloom.llm.bigru import BiGru

PARTS = {"aa": ["the", "ing", "tion", "er", "ou"], "bb": ["der", "sch", "keit", "ü", "ung"], "cc": ["réu", "que", "eau", "ê", "ment"]}


def test_gradients():
    g = BiGru(3, 4)
    g.p = {k: v.astype(np.float64) for k, v in g.p.items()}
    r = np.random.default_rng(0)
    x, y = r.integers(97, 122, (7, 5)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    grads = g.gradients(x, y)[1]
    for k, p in g.p.items():
        i = (int(x[0, 0]), 1) if p.shape[0] == 256 else (0,) * p.ndim
        p[i] += 1e-3
        a = g.gradients(x, y)[0]
        p[i] -= 2e-3
        b = g.gradients(x, y)[0]
        p[i] += 1e-3
        assert abs((a - b) / 2e-3 - grads[k][i]) < 2e-5


def test_pooling_equals_mean_of_positions():
    g, r = BiGru(3), np.random.default_rng(0)
    x = r.integers(32, 140, (64, 9)).astype(np.uint8)
    from evalloom.llm.bigru import letters

    s, n = g.pooled(x)
    want = (g.probabilities(x) * letters(x)[:, :, None]).sum(0)
    assert np.allclose(s, want, atol=1e-4) and (n == letters(x).sum(0)).all()


def test_held_out(spark, tmp_path):
    r = random.Random(8)
    rows = []
    for i in range(1200):
        k = r.choice(list(PARTS))
        rows.append((i, " ".join("".join(r.choices(PARTS[k], k=r.randint(1, 4))) for _ in range(r.randint(3, 60))), k, "z"))
    rows += [(5000, None, "aa", "z"), (5001, "", "bb", "z"), (5002, "12 %% 34 —", None, "z"), (5003, "der schkeit ungsch", None, "z"), (None, "the tion ing", None, "z"), (5004, "sch keit ung " * 50000, None, "z"), (5003, "der schkeit ungsch", None, "z")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string").write.parquet(f"{tmp_path}/documents.parquet")
    got = langid.op9_language_bigru(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 for x in got)
    truth = {d: k for d, _, k, _ in rows[:1200]}
    held = [x for x in got if x.held_out and x.doc_id in truth]
    assert np.mean([x.lang_pred == truth[x.doc_id] for x in held]) > 0.97
    by = {x.doc_id: x.lang_pred for x in got}
    assert by[5000] == by[5001] == by[5002] == "und" and by[5003] == by[5004] == "bb" and by[None] == "aa"


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.learn(docs) is None and langid.predicted(docs, None).count() == 0


def test_stray_languages_and_repeats_keep_the_sample_bounded(spark, monkeypatch):
    seen = {}

    def fit(self, x, y):
        seen["windows"], seen["languages"] = len(x), len(set(y.tolist()))
        return self

    monkeypatch.setattr(langid.BiGru, "fit", fit)
    monkeypatch.setattr(langid, "PER_LANGUAGE", 50)
    monkeypatch.setattr(langid, "IN_ALL", 90)
    monkeypatch.setattr(langid, "LANGUAGES", 3)
    rows = [(i, f"word{i}", k) for i in range(900) for k in ("aa", "bb")]
    rows += [(i, f"stray{i}", f"x{i}") for i in range(300)] + [(7, "again and again", "cc")] * 500 + [(None, f"null {i}", "cc") for i in range(500)]
    names, _ = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert names == ["aa", "bb", "cc"] and seen["languages"] == 3 and 30 <= seen["windows"] <= 180
