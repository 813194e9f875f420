import random
import zlib
from collections import Counter, defaultdict
from math import exp, log, log10

import pytest
from pyspark.sql import functions as F

from evalloom.llm import pst

START = object()


def tokens(text):
    return [*(text or "").encode().lower().split(), b""]


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 10 == 0 if doc_id is not None else True


class ByHand:
    """The same tree from dictionaries, one document and one position at a time."""

    def __init__(self, docs, depth):
        self.c = Counter(w for d in docs for w in d)
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.unknown = (sum(k == 1 for k in self.c.values()) + 0.5) / (self.n + 1)
        self.seen = [{(w,): k for w, k in self.c.items()} | {(START,): len(docs)}]
        self.kept = [{}]
        for k in range(1, depth + 1):
            found, p = Counter(), {}
            for d in docs:
                line = [START, *d]
                for i in range(k, len(line)):
                    gram = tuple(line[i - k : i + 1])
                    if self.allowed(k, gram):
                        found[gram] += 1
                        p[gram] = p.get(gram) or self.p(k - 1, line, i)
            nexts = defaultdict(dict)
            for gram, n in found.items():
                nexts[gram[:-1]][gram] = n
            kept = {}
            for context, grams in nexts.items():
                v = self.seen[k - 1][context]
                m = sum(n - pst.DISCOUNT for n in grams.values())
                gain = 0
                for gram, n in grams.items():
                    q = -pst.STEP * min(255, round(-log(p[gram]) / pst.STEP))
                    gain += n * (log(max(n - 1 - pst.DISCOUNT, 0) / v + (v - m) / v * exp(q)) - q)
                if gain >= pst.NATS:
                    kept[context] = m
            self.seen.append(dict(found))
            self.kept.append(kept)

    def allowed(self, k, gram):
        return self.seen[k - 1].get(gram[:-1], 0) >= 2 and self.seen[k - 1].get(gram[1:], 0) >= 2

    def p(self, level, line, i):
        w = line[i]
        p = (1 - self.unknown) * self.c[w] / self.n if w in self.c else self.unknown
        for k in range(1, min(level, i) + 1):
            gram = tuple(line[i - k : i + 1])
            if gram[:-1] in self.kept[k]:
                n, v = self.seen[k].get(gram, 0) if self.allowed(k, gram) else 0, self.seen[k - 1][gram[:-1]]
                p = (max(n - pst.DISCOUNT, 0) + (v - self.kept[k][gram[:-1]]) * p) / v
        return p

    def score(self, doc, depth):
        line = [START, *doc]
        return sum(log10(self.p(depth, line, i)) for i in range(1, len(line)))


def corpus():
    r = random.Random(10)
    words = ["w%d" % i for i in range(60)] + ["É", "Größe"]
    follows = {w: r.choices(words, k=3) for w in words}
    rows = []
    for i in range(500):
        w, out = r.choice(words), []
        for _ in range(r.randint(0, 60)):
            out.append(w)
            w = r.choice(follows[w]) if w in follows and r.random() < 0.8 else r.choice([*words, "rare%d" % r.randrange(10**6)])
        rows.append((i, " ".join(out), "z"))
    return rows + [(900, None, "z"), (901, "", "z"), (902, "Same Row", "z"), (902, "Same Row", "z"), (None, "no id", "z"), (903, "deep\x00byte " * 3000, None)]


@pytest.fixture(scope="module")
def scored(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("pst")
    spark.createDataFrame(corpus(), "doc_id long, text string, block string").repartition(3).write.parquet(f"{at}/documents.parquet")
    return pst.op2_suffix_tree_scoring(spark, str(at)).collect()


def test_against_brute_force(scored):
    rows = corpus()
    assert len(scored) == len(rows)
    model = ByHand([tokens(t) for d, t, _ in rows if not held(d)], pst.DEPTH)
    assert all(model.kept[1:])
    text = {d: t for d, t, _ in rows}
    for x in scored:
        ws = tokens(text[x.doc_id])
        assert x.held_out == held(x.doc_id) and x.n_tokens == len(ws) and x.n_known == sum(w in model.c for w in ws) and x.train_tokens == model.n
        assert abs(x.base_score - sum(log10((model.c[w] + 0.1) / (model.n + 0.1 * (model.v + 1))) for w in ws)) < 1e-6 * len(ws)
        assert abs(x.score - model.score(ws, pst.DEPTH)) < 1e-4 * len(ws)
    out = [x for x in scored if x.held_out and x.n_tokens > 20]
    assert sum(x.score for x in out) > sum(x.base_score for x in out)


def test_distributions_are_proper():
    model = ByHand([tokens(t) for d, t, _ in corpus() if not held(d)], pst.DEPTH)
    some = tokens(corpus()[3][1])[:12]
    for i in range(1, len(some)):
        line = [START, *some[:i]]
        total = sum(model.p(pst.DEPTH, [*line, w], i + 1) for w in model.c) + model.p(pst.DEPTH, [*line, b"never"], i + 1)
        assert abs(total - 1) < 1e-9


def test_order_of_words_counts(spark):
    r = random.Random(3)
    rows = [(i, t, "plain") for i, t, _ in corpus() if t]
    mixed = [(i, " ".join(r.sample(t.split(), len(t.split()))), "mixed") for i, t, _ in rows if held(i)]
    df = spark.createDataFrame(rows + mixed, "doc_id long, text string, kind string")
    docs = df.select(F.when(F.col("kind") == "mixed", -F.col("doc_id") - 1).otherwise(F.col("doc_id")).alias("doc_id"), "text")
    train = F.col("doc_id").isin([i for i, _, _ in rows if not held(i)])
    got = {x.doc_id: x for x in pst.scored(docs, train)[0].collect()}
    long = [i for i, _, _ in mixed if i is not None and got[i].n_tokens > 15]
    assert long and all(got[i].n_tokens == got[-i - 1].n_tokens for i in long)
    assert sum(got[-i - 1].score for i in long) < 1.1 * sum(got[i].score for i in long) < 0


def test_partitions_and_hot_contexts(spark, scored, monkeypatch):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, block string")
    train = ~F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(True))
    before = sorted((x.doc_id or -1, round(x.score, 3)) for x in scored)
    monkeypatch.setattr(pst, "BLOCK_BYTES", 5000)
    monkeypatch.setattr(pst, "PART_BYTES", 5000)
    got, n = pst.scored(df.repartition(7, "text"), train)
    assert sorted((x.doc_id or -1, round(x.score, 3)) for x in got.collect()) == before
    monkeypatch.setattr(pst, "HOT", 10**9)
    monkeypatch.setattr(pst, "HOT_LEAST", 40)
    hot = sorted((x.doc_id or -1, x.score) for x in pst.scored(df, train)[0].collect())
    # parts of a hot context judge by their own share, so the tree may differ, but little
    assert abs(sum(a[1] for a in hot) / sum(b[1] for b in before) - 1) < 0.02


def test_small(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/e/documents.parquet")
    assert pst.op2_suffix_tree_scoring(spark, f"{tmp_path}/e").count() == 0
    spark.createDataFrame([(None, "a b")], "doc_id long, text string").write.parquet(f"{tmp_path}/o/documents.parquet")
    x = pst.op2_suffix_tree_scoring(spark, f"{tmp_path}/o").first()
    assert x.train_tokens == 0 and x.n_known == 0 and x.base_score == 0 and x.score == 0 and x.n_tokens == 3
