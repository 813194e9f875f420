import hashlib
import random

import pytest

from evalloom.llm import imatch


def test_against_brute_force(spark, tmp_path):
    r = random.Random(5)
    vocab = [f"w{i}é" for i in range(900)]
    rows = [(i, " ".join(r.choices(vocab, k=r.randint(0, 300)))) for i in range(1500)]
    rows += [(5000, rows[3][1]), (5001, None), (5002, ""), (5003, "x"), (5004, "The the\tTHE"), (None, "no id"), (5005, "é" * 5000)]
    r.shuffle(rows)
    spark.createDataFrame([(*x, "c") for x in rows], "doc_id long, text string, bucket string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in imatch.op10_imatch_fingerprints(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    df = {}
    for _, t in rows:
        for w in set((t or "").encode().lower().split()):
            df[w] = df.get(w, 0) + 1
    n = len(rows)
    lex = sorted(w for w, c in df.items() if c >= max(1, n / 2000) and c <= max(1, n / 5))
    maker = imatch.Fingerprinter(lex)
    line = sorted(rows, key=lambda x: -1 if x[0] is None else x[0], reverse=True)
    better = 0
    for (d, t), (_, nt) in zip(line, [*line[1:], line[0]]):
        t, nt, x = t or "", nt or "", got[d]
        k = len(t) // 3
        e = t[: len(t) - k] + nt[:k]
        assert x.n_chars == len(t) and x.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        a, b, c = (maker.parts(s.encode()) for s in (t, e, nt))
        assert x.fingerprint == imatch.shown(a) and x.edited_fingerprint == imatch.shown(b)
        assert x.near_edited == imatch.likeness(a, b) and x.near_next == imatch.likeness(a, c)
        better += x.near_edited - x.near_next
    assert better / n > 0.1
    assert got[5000].fingerprint == got[3].fingerprint and got[5001].fingerprint == got[5002].fingerprint


def test_small_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/e/documents.parquet")
    assert imatch.op10_imatch_fingerprints(spark, f"{tmp_path}/e").count() == 0
    spark.createDataFrame([(1, "one two three four"), (1, "one two three four")], "doc_id long, text string").write.parquet(f"{tmp_path}/o/documents.parquet")
    got = imatch.op10_imatch_fingerprints(spark, f"{tmp_path}/o").collect()
    assert len(got) == 2 and all(x.near_next == 1.0 for x in got)
    spark.createDataFrame([(None, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/n/documents.parquet")
    got = imatch.op10_imatch_fingerprints(spark, f"{tmp_path}/n").collect()
    assert len(got) == 1 and got[0].n_chars == 0


def test_lexicon_over_its_bound_is_refused(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"term{i} {'x' * 300}{i % 50}") for i in range(100)], "doc_id long, text string")
    assert len(imatch.lexicon(docs)[0]) == 150
    monkeypatch.setattr(imatch, "LEXICON_BYTES", 10_000)
    with pytest.raises(RuntimeError, match="bound"):
        imatch.lexicon(docs)


def plain_fingerprint(text, lex):
    """40 parts and a last one, by Python integers: for each subset, a hash of the kept terms' hashes in order of the terms."""
    import struct

    from xxhash import xxh64_intdigest as xxh

    full = (1 << 64) - 1

    def mixed(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & full
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & full
        return x ^ (x >> 31)

    distinct = set(text.encode().lower().split())
    mine = sorted(distinct & lex)
    out = []
    for k in range(40):
        salt, least = (78 + k) * 0x9E3779B97F4A7C15 & full, 3 + k // 4
        kept = [t for t in mine if mixed(xxh(t, 77) ^ salt) < 1 << (64 - least)]
        out.append(1 + xxh(b"".join(struct.pack("<Q", xxh(t, 77)) for t in kept), k) % (2**24 - 1) if kept else 0)
    out.append(1 + xxh(b" ".join(sorted(distinct)), 77) % (2**24 - 1) if distinct and not any(out) else 0)
    return out


def plain_likeness(a, b):
    set_ = [(x, y) for x, y in zip(a, b) if x or y]
    return sum(x == y for x, y in set_) / len(set_) if set_ else 1.0


def test_fingerprints_of_the_table_recomputed(spark):
    """Every row of a whole table against fingerprints and likenesses that share no code with the module."""
    import os

    import duckdb

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    rows = duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{folder}/documents.parquet' ORDER BY doc_id DESC").fetchall()
    df = {}
    for _, t in rows:
        for w in set(t.encode().lower().split()):
            df[w] = df.get(w, 0) + 1
    lex = {w for w, c in df.items() if max(1, len(rows) / 2000) <= c <= max(1, len(rows) / 5)}
    hexed = lambda parts: "".join(f"{p:06x}" for p in parts)
    got = {r.doc_id: r for r in imatch.op10_imatch_fingerprints(spark, folder).collect()}
    assert len(got) == len(rows)
    for (i, t), (_, following) in zip(rows, [*rows[1:], rows[0]]):
        k = len(t) // 3
        a, b, c = (plain_fingerprint(x, lex) for x in (t, t[: len(t) - k] + following[:k], following))
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (hexed(a), hexed(b))
        assert (got[i].near_edited, got[i].near_next) == (pytest.approx(plain_likeness(a, b)), pytest.approx(plain_likeness(a, c)))
