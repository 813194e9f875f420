import random
from itertools import product

import numpy as np

from evalloom.llm import quality, toxicity


def distance(a, b):
    d = np.arange(len(b) + 1)
    for i, x in enumerate(a, 1):
        p, d = d, np.full(len(b) + 1, i)
        for j, y in enumerate(b, 1):
            d[j] = min(p[j] + 1, d[j - 1] + 1, p[j - 1] + (x != y))
    return int(d[-1])


def test_automaton_against_edit_distance():
    terms = ["abc", "abcab", "bcabc", "abcabcabc", "cabba"]
    a = toxicity.TermAutomaton(terms)
    for n in range(1, 7):
        for w in map("".join, product("abc", repeat=n)):
            near = [(distance(w, t), k) for k, t in enumerate(terms) if distance(w, t) <= toxicity.edits(t)]
            got = a.match(w)
            assert (got[1] if got else None) == (min(near)[0] if near else None)
    assert a.match("") is None and a.match("abcabXcXbc") == (3, 2)


def test_held_out(spark, tmp_path):
    r = random.Random(6)
    vocab = [a + b for a, b in product(["lo", "mi", "ta", "ru", "ne"], ["sel", "dor", "win", "pak", "fum", "gri"])]
    bad = ["nastyword", "viletalk", "grimslur"]
    docs, labels, truth = [], [], {}
    for i in range(1500):
        w = r.choices(vocab, k=r.randint(10, 60))
        toxic = r.random() < 0.2
        if toxic:
            for _ in range(2):
                w.insert(r.randrange(len(w)), r.choice(bad))
        docs.append((i, " ".join(w), "z", 1.0))
        truth[i] = int(toxic)
        if i % 2:
            labels.append((i, 1, int(toxic)))
    docs += [(9000, "losel dor nastyw0rd you vileta1k misel", "z", 1.0), (9001, None, None, None), (9002, "", "z", 1.0), (9003, "losel " * 100000, "z", 1.0), (None, "tador", "z", 1.0), (0, docs[0][1], "z", 1.0)]
    labels += [(1, 1, None), (None, 1, 1)]
    spark.createDataFrame(docs, "doc_id long, text string, score string, term double").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = toxicity.op8_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(docs) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7) for x in got)
    held = [x for x in got if x.held_out and x.doc_id in truth]
    assert np.mean([x.predicted == truth[x.doc_id] for x in held]) > 0.98
    by = {x.doc_id: x.predicted for x in got}
    assert by[9000] == 1 and by[9001] == by[9002] == by[9003] == 0
    kept = toxicity.accepted(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert kept.columns == ["doc_id", "text", "score", "term"] and kept.count() == sum(1 - x.predicted for x in got)


def test_lexicon_counts_all_labelled_rows(spark, monkeypatch):
    # the bound of the sample, here 100, is the additive model's alone
    monkeypatch.setattr(quality.training_rows, "__defaults__", (100,))
    monkeypatch.setattr(toxicity, "TRAIN_ROWS", 100, raising=False)
    fitted = []
    fit = toxicity.PairwiseGam.fit
    monkeypatch.setattr(toxicity.PairwiseGam, "fit", lambda self, x, y: fitted.append(len(y)) or fit(self, x, y))
    docs = [(i, f"losel {i} " + ("nastyword" if i % 10 == 0 else "nastiword" if i % 100 == 1 else "tador")) for i in range(3000)]
    docs = spark.createDataFrame([(i, t + " raregrim" if i % 250 == 0 else t) for i, t in docs], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "int(doc_id % 10 = 0) as toxic")
    train = docs.where(toxicity.common.remainder("doc_id", 3) != 1)
    lexicon, usual, _ = toxicity.learn(docs, labels)
    assert lexicon["nastyword"] == (train.where("text like '%nastyword%'").count(), 0)
    assert usual == {"nastiword"} and 50 < fitted[0] < 150


def test_quotation_lowers_the_window():
    m = toxicity.Matcher({"nastyword": (50, 0)}, frozenset())
    plain, quoted = m.features(b"you are a nastyword friend"), m.features('he used "nastyword" there'.encode())
    assert plain[0] > 3 and quoted[0] == 0 and quoted[3] > 3


def test_own_label_is_left_out_of_exact_hits_only():
    m = toxicity.Matcher({"nastyword": (3, 0)}, frozenset())
    assert m.features(b"a nastyw0rd", 0.0)[0] > 0 and m.features(b"a nastyword", 1.0)[0] < m.features(b"a nastyword")[0]


def test_empty(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.learn(docs, labels) is None and toxicity.accepted(docs, labels).count() == 0


def test_cover_is_greedy(spark):
    r = random.Random(4)
    terms, rows = 120, []
    for _ in range(900):
        rows.append((sorted({min(terms - 1, int(r.expovariate(0.05))) for _ in range(r.randint(1, 9))}), r.randint(1, 3)))
    # a chain, in which each term's fate hangs on the one before it
    rows += [([i, i + 1], 40) for i in range(90, 110)]
    want, explained = np.zeros(terms, bool), set()
    for t in range(terms):
        holds = {d for d, (at, _) in enumerate(rows) if t in at}
        want[t] = sum(rows[d][1] for d in holds - explained) >= 30
        if want[t]:
            explained |= holds
    held = spark.createDataFrame(rows, "at array<int>, n long")
    assert (toxicity.cover(held, lambda fresh: fresh >= 30, terms) == want).all() and 0 < want.sum() < terms
    assert toxicity.cover(held.limit(0), lambda fresh: fresh >= 30, 0).size == 0
