import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from evalloom.llm import bpe, training_order as t


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutation(n):
    x = np.arange(n)
    y = t.permuted(x, n)
    assert sorted(y) == list(range(n)) and (t.permuted(y, n, inverse=True) == x).all()
    if n > 500:
        assert abs(np.corrcoef(x, y)[0, 1]) < 0.2 and (t.permuted(x, n, key=5) != y).mean() > 0.9


def test_round_trip(spark, tmp_path):
    r = random.Random(11)
    rows = [(i, " ".join(r.choices(["alpha", "béta", "γ", "delta"], k=r.randint(0, 90))), "z") for i in range(120)]
    rows += [(500, None, "z"), (501, "", "z"), (None, "no id", "z"), (7, rows[7][1], "z"), (502, "long text " * 9000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot string").repartition(3)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks(bpe.vocabulary_path()), special_tokens={})
    written, n, total = t.shards(docs, length=32, records=16)
    got = {x.shard: x for x in written.collect()}
    assert sorted(got) == list(range(-(-n // 16)))
    assert all(x.records == 16 and len(x.payload) == 16 * 64 for k, x in got.items() if k < max(got))
    t.export(written, str(tmp_path))
    by_slot = list(t.read(str(tmp_path), 0, n, 32, 16))
    assert list(map(list, t.read(str(tmp_path), n // 2, 3, 32, 16))) == list(map(list, by_slot[n // 2 : n // 2 + 3]))
    stream = np.concatenate([by_slot[s] for s in t.permuted(np.arange(n), n)])
    assert (stream[total:] == 50256).all()
    ends = np.flatnonzero(stream[:total] == 50256)
    found, at = [], 0
    for e in ends:
        found.append(tuple(stream[at:e].tolist()))
        at = e + 1
    assert at == total and sorted(found) == sorted(tuple(enc.encode_ordinary(x[1] or "")) for x in rows)
    rows = sorted(t.index(docs, length=32, records=16).collect())
    assert [x.slot for x in rows] == list(range(n)) and sorted(x.seq for x in rows) == list(range(n))
    assert sum(x.n_tokens for x in rows) == total
    assert all(x.record_sha256 == hashlib.sha256(by_slot[x.slot].tobytes()).hexdigest() and x.byte_offset == x.slot % 16 * 64 for x in rows)


def test_order_does_not_depend_on_partitions(spark):
    r = random.Random(12)
    rows = [(i if i % 7 else None, " ".join(r.choices(["alpha", "béta", "γ"], k=r.randint(0, 60)))) for i in range(300)] + [(None, "twice")] * 3
    one = spark.createDataFrame(rows, "doc_id long, text string")
    other = spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(7)
    got = [sorted((x.slot, x.record_sha256) for x in t.index(d, length=32, records=16).collect()) for d in (one, other)]
    assert got[0] == got[1] and len(got[0]) > 100


def test_empty(spark):
    assert t.index(spark.createDataFrame([], "doc_id long, text string")).count() == 0
