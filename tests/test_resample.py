import numpy as np
import pytest
from pyspark.sql import functions as F

from evalloom.operators import resample
from evalloom.operators.constraints import ConstraintError


def frame(spark, values):
    return spark.createDataFrame([(g, f"u{i:05d}", v) for g, vs in values.items() for i, v in enumerate(vs)], "g string, u string, d double")


def brute(values, draws, seed):
    """One range: every draw by the counter."""
    n, out = len(values), []
    for r in range(draws):
        base = resample.mixed(resample.root(seed, 0) + np.uint64(r))
        at = [int(resample.mixed(base + np.uint64(k))[0]) * n >> 32 for k in range(n)]
        out.append(np.mean([values[i] for i in at]))
    return np.array(out)


def test_each_draw_is_a_hash(spark):
    r = np.random.default_rng(0)
    values = {"a": r.normal(size=23).tolist(), None: (r.normal(size=40) + 1).tolist()}
    got = {x.g: x for x in resample.mean_intervals(frame(spark, values), ["g"], "u", "d", 700, seed=9).collect()}
    for g, v in values.items():
        want = brute(v, 700, 9)
        assert got[g].n_units == len(v) and got[g].point == pytest.approx(np.mean(v))
        assert (got[g].low, got[g].high) == pytest.approx(tuple(np.quantile(want, [0.025, 0.975])))
        assert got[g].p_value == pytest.approx(min(1, 2 * min((want <= 0).mean(), (want >= 0).mean())))
    assert got[None].excludes_zero


def test_ranges_share_the_draws(spark, monkeypatch):
    """Ranges of eight units: every replicate draws as many units as there are, and the means spread as they should."""
    monkeypatch.setattr(resample, "RANGE", 8)
    for units in (8, 9, 61, 64):
        total = sum(resample.fallen(5, units, at, 2, 100) for at in range(-(-units // 8)))
        assert (total == units).all()
    v = np.random.default_rng(1).normal(size=150)
    x = [np.stack([v[a : a + 8], np.ones(len(v[a : a + 8]))], 1) for a in range(0, 150, 8)]
    sums = sum(resample._sums(part, 3, 150, at, 0, 512)[1] for at, part in enumerate(x))
    assert (sums[:, 1] == 150).all()
    means = sums[:, 0] / 150
    assert abs(means.mean() - v.mean()) < 0.02 and 0.85 < means.std() / (v.std() / np.sqrt(150)) < 1.15


def test_ranges_change_no_draw(spark, monkeypatch):
    """Contrasts of several ranges (16 units each) have the draws that one range has."""
    monkeypatch.setattr(resample, "RANGE", 8)
    monkeypatch.setattr(resample, "CELLS", 16)
    r = np.random.default_rng(3)
    values = {"a": r.normal(size=150).tolist(), "b": (r.normal(size=33) + 1).tolist(), None: r.normal(size=16).tolist()}
    got = {x.g: x for x in resample.mean_intervals(frame(spark, values), ["g"], "u", "d", 300, seed=7).collect()}
    for g, v in values.items():
        want = brute(v, 300, 7)
        assert got[g].n_units == len(v) and got[g].point == pytest.approx(np.mean(v))
        assert (got[g].low, got[g].high) == pytest.approx(tuple(np.quantile(want, [0.025, 0.975])))
        assert got[g].p_value == pytest.approx(min(1, 2 * min((want <= 0).mean(), (want >= 0).mean())))


def test_slices_change_no_draw(monkeypatch):
    x = np.random.default_rng(5).normal(size=(150, 2))
    one = resample._sums(x, 3, 150, 0, 0, 60, 150)[1]
    monkeypatch.setattr(resample, "DRAWS", 40)
    cut = sum(resample._sums(x[a : a + 70], 3, 150, a // 70, 0, 60, 70)[1] for a in range(0, 150, 70))
    assert one == pytest.approx(cut) and one[:, 0] / 150 == pytest.approx(brute(x[:, 0], 60, 3))


def test_words_are_even():
    w = resample.mixed(resample.root(1, 0) + np.arange(200_000, dtype=np.uint64))
    counts = np.bincount((w * np.uint64(50) >> np.uint64(32)).astype(int), minlength=50)
    assert len(set(w.tolist())) == len(w) and ((counts - 4000) ** 2 / 4000).sum() < 100
    assert len({int(resample.root(s, a)[0]) for s in range(40) for a in range(40)}) == 1600


def test_macro_f1(spark):
    r = np.random.default_rng(2)
    names = ["x", "y"]
    rows = [(f"u{u:03d}", rep, c, [k for k in names if r.random() < 0.6], [k for k in names if r.random() < 0.5]) for u in range(30) for rep in (1, 2) for c in ("A", "B", "other")]
    df = spark.createDataFrame(rows, "u string, rep int, c string, p array<string>, g array<string>")
    got = resample.macro_f1_interval(df, "u", "rep", "c", "A", "B", "p", "g", names, draws=200, seed=4).first()

    def value(weights):
        out = []
        for rep in (1, 2):
            f = {}
            for c in ("A", "B"):
                f1 = []
                for k in names:
                    own = [(weights[int(x[0][1:])], k in x[3], k in x[4]) for x in rows if x[1] == rep and x[2] == c]
                    tp, fp, fn = (sum(w for w, p, g in own if (p, g) == s) for s in ((True, True), (True, False), (False, True)))
                    f1.append(2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0)
                f[c] = np.mean(f1)
            out.append(f["A"] - f["B"])
        return np.mean(out)

    want = []
    for rep in range(200):
        base = resample.mixed(resample.root(4, 0) + np.uint64(rep))
        at = (resample.mixed(base + np.arange(30, dtype=np.uint64)) * np.uint64(30)) >> np.uint64(32)
        want.append(value(np.bincount(at.astype(int), minlength=30)))
    assert got.point == pytest.approx(value(np.ones(30))) and got.n_units == 30
    assert (got.low, got.high) == pytest.approx(tuple(np.quantile(want, [0.025, 0.975])))


def test_macro_f1_over_ranges(spark, monkeypatch):
    """Units in several ranges (of 8, 24 numbers each and more) give the interval of one range."""
    r = np.random.default_rng(6)
    rows = [(f"u{u:03d}", 1, c, [k for k in "xy" if r.random() < 0.6], [k for k in "xy" if r.random() < 0.5]) for u in range(70) for c in "AB"]
    df = spark.createDataFrame(rows, "u string, rep int, c string, p array<string>, g array<string>")
    take = lambda: resample.macro_f1_interval(df, "u", "rep", "c", "A", "B", "p", "g", ["x", "y"], draws=200, seed=4).first()
    one = take()
    monkeypatch.setattr(resample, "RANGE", 8)
    monkeypatch.setattr(resample, "CELLS", 24)
    many = take()
    assert tuple(many) == pytest.approx(tuple(one)) and one.n_units == 70


def test_no_units(spark):
    assert resample.mean_intervals(frame(spark, {}), ["g"], "u", "d", 100).count() == 0


def test_stream_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(resample, "STREAM_UNITS", 5)
    with pytest.raises(ConstraintError):
        resample.stream_intervals(frame(spark, {"a": [1.0] * 6}), ["g"], "u", "d", 10)
    assert resample.stream_intervals(frame(spark, {"a": [1.0] * 5}).withColumn("seed", F.lit(1)), ["g", "seed"], "u", "d", 10).first().low == 1.0
