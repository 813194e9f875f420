import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from evalloom.llm import bpe


@pytest.fixture(scope="module")
def encoder():
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=table, special_tokens={})


def texts():
    r = random.Random(9)
    alphabet = "abcdefgh ABC  é日本ßñ 0123 '!|.\n\t  \x1c😀"
    out = ["", None, " ", "\n\n  x", "it's we'll DON'T", "the the   the", "naïve    x", "a\x00b,\x00", "x\u0085y\x1cz"]
    out += ["".join(r.choices(alphabet, k=r.randint(1, 80))) for _ in range(150)]
    return out + ["".join(r.choices("abcdehtn", k=3000)), "=" * 700 + " tail", "word " * 20000]


@pytest.mark.parametrize("block", [bpe.BLOCK_BYTES, 500])
def test_like_the_library(spark, encoder, block, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_BYTES", block)
    rows = [(i, t, "clash") for i, t in enumerate(texts())] + [(None, "no id", "x"), (1, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(2)
    got = sorted(bpe.digests(df).collect(), key=str)
    want = []
    for d, t, _ in rows:
        ids = encoder.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert [tuple(x) for x in got] == sorted(want, key=lambda x: f"Row(doc_id={x[0]}, n_tokens={x[1]}, ids_sha256='{x[2]}', decoded_sha256='{x[3]}')")


def test_empty(spark):
    assert bpe.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_round_trip_keeps_columns(spark):
    from pyspark.sql import functions as F

    rows = [(i, t, "kept", None) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, _ids string").drop("_ids").withColumn("rows", F.lit(1))
    out = bpe.encoded(df)
    assert out.columns == ["doc_id", "text", "ids", "rows", "_ids"]
    got = out.select("doc_id", "text", "ids", bpe.decoded(F.col("_ids")).alias("b")).collect()
    assert len(got) == len(rows)
    assert all(bytes(r["b"]) == (r["text"] or "").encode() and r["ids"] == "kept" for r in got)
