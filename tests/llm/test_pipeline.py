import base64
import hashlib
import random
from collections import Counter

import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from evalloom.llm import mixing, quality, simhash, toxicity


def corpus(spark, folder, n=400):
    r = random.Random(12)
    vocab = [a + b for a in ("lo", "mi", "ta", "ru", "ne") for b in ("sel", "dor", "win", "pak", "fum", "gri")]
    docs, labels = [], []
    for i in range(n):
        w = r.choices(vocab, k=r.randint(30, 80))
        bad, toxic = r.random() < 0.2, r.random() < 0.15
        if toxic:
            w[3:3] = ["nastyword", "viletalk"]
        text = " | ".join(w).upper() + " !!" if bad else " ".join(w) + "."
        docs.append((i, text, "en", r.choice(["a", "b", None]), len(text), "extra", 1))
        if i % 2:
            labels.append((i, int(not bad), int(toxic)))
    good = next(d for d in docs if "|" not in d[1] and "nasty" not in d[1])
    docs += [(n + k, good[1], "en", "a", None, "extra", 1) for k in range(5)]
    docs += [(good[0], *good[1:])]
    docs += [(900, None, None, None, None, None, None), (901, "", "en", "a", 0, None, None), (None, " ".join(r.choices(vocab, k=50)) + ".", None, None, None, None, None), (902, " ".join(r.choices(vocab, k=30000)) + ".", "en", "b", 1, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, row string, score int").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_columns_with_dots_and_maps(spark, tmp_path):
    """Names with dots and quotes, maps inside columns, and names that clash with the stages' own pass through every stage."""
    folder = str(tmp_path)
    corpus(spark, folder, 60)
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = docs.select("*", F.create_map(F.lit("k"), F.col("doc_id")).alias("a.b"), F.array(F.create_map(F.lit("m"), F.lit(1))).alias("best"), F.struct(F.lit(2).alias("x.y")).alias("h1"), F.lit(3).alias("q`t"))
    for name, stage in corpus_pipeline.STAGES:
        odd = stage(spark, odd, folder)
        if name != "encoding":
            assert odd.columns == [*docs.columns, "a.b", "best", "h1", "q`t"]
            odd.write.parquet(f"{folder}/odd-{name}")
            odd = spark.read.parquet(f"{folder}/odd-{name}")
            r = odd.where("doc_id is not null").first()
            assert r["a.b"] == {"k": r["doc_id"]} and r["best"] == [{"m": 1}] and r["q`t"] == 3 and r["h1"]["x.y"] == 2
    assert odd.count() > 0


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    corpus(spark, folder)
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {"documents": None}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = out[name] = spark.read.parquet(f"{folder}/{name}")
    return folder, out


def test_stages_keep_columns_and_follow_their_operators(spark, stages):
    folder, out = stages
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_dedup", "mixing", "encoding"]
    for n in ("quality", "toxicity", "near_dedup", "mixing"):
        assert out[n].columns == out["documents"].columns
    rows = lambda df: Counter(map(str, df.collect()))
    scored = quality.scored(out["documents"], quality.fit(out["documents"], labels))
    assert rows(out["quality"]) == rows(scored.where("score >= 0.5").select("row.*"))
    assert not any("|" in (r.text or "") for r in out["quality"].collect())
    model = toxicity.learn(out["quality"], labels)
    m = toxicity.Matcher(*model[:2])
    want = [r for r in out["quality"].collect() if model[2].score(__import__("numpy").array([m.features((r.text or "").encode())]))[0] < 0.7]
    assert rows(out["toxicity"]) == Counter(map(str, want))
    assert sum("nastyword" in (r.text or "") for r in out["toxicity"].collect()) == 0
    groups = {}
    for r in out["toxicity"].collect():
        groups.setdefault(simhash.fingerprint((r.text or "").encode()), []).append(r.doc_id)
    kept = [r.doc_id for r in out["near_dedup"].collect()]
    assert len(kept) == len(set(kept)) and all(any(d in kept for d in g) for g in groups.values() if g != [None] or None in kept)
    for g in groups.values():
        assert sum(d in kept for d in set(g)) <= 1 or len({d for d in g if d in kept}) == 1


def test_near_dedup_keeps_one_row_of_each_group(spark):
    r = random.Random(5)
    text = lambda: " ".join(f"w{r.randrange(10000)}" for _ in range(40))
    a, b = text(), text()
    # nulls with texts of their own, a null with a copy that has an id, an id with two texts, a row repeated as a whole
    docs = [(None, text(), k) for k in range(5)] + [(None, a, 9), (3, a, 1), (3, b, 1), (7, b, 1), (8, a, 1), (5, text(), 1), (5, text(), 2), (6, text(), 1)] + [(4, text(), 1)] * 2
    df = spark.createDataFrame(docs, "doc_id long, text string, nth int")
    got = Counter(map(tuple, corpus_pipeline.near_dedup_stage(spark, df, "").collect()))
    assert len({simhash.fingerprint(t.encode()) for _, t, _ in docs}) == 11
    assert got == Counter(set(docs) - {(None, a, 9), (7, b, 1), (8, a, 1)})


def test_mix_and_encoding(spark, stages):
    folder, out = stages
    size = lambda t: len((t or "").split())
    before, after = Counter(), Counter()
    for r in out["near_dedup"].collect():
        before[r.source] += size(r.text)
    for r in out["mixing"].collect():
        after[r.source] += size(r.text)
    order = sorted(before, key=lambda s: (s is None, s or ""))
    for s, t in zip(order, mixing.targets([before[s] for s in order])):
        assert abs(after[s] - t) <= 1
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    want = Counter()
    for r in out["mixing"].collect():
        ids = enc.encode_ordinary(r.text or "")
        want[r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, out["encoding"].collect())) == want
    assert Counter(map(tuple, corpus_pipeline.run(spark, folder).collect())) == want


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
