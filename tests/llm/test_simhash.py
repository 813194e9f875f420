import random

import xxhash

from evalloom.llm import simhash


def brute(rows):
    fps = {}
    for i, (_, t) in enumerate(rows):
        w = (t or "").encode().lower().split()
        sh = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] * bool(w)
        hs = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in fps:
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        out.append((d, f"{fps[i]:016x}", min((rows[j][0] for j in fps if find(j) == find(i) and rows[j][0] is not None), default=None)))
    return sorted(out, key=str)


def test_against_brute_force(spark, tmp_path):
    r = random.Random(1)
    vocab = [f"w{i}" for i in range(300)]
    base = " ".join(r.choices(vocab, k=400))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one two"), (6, "ONE  two\x0bThree"), (7, "one two three"), (7, "one two three"), (None, "one two three"), (None, "alone here ok")]
    rows += [(100 + i, " ".join(w if r.random() > 0.004 else r.choice(vocab) for w in base.split())) for i in range(120)]
    rows += [(500 + i, " ".join(r.choices(vocab, k=r.randint(1, 60)))) for i in range(60)]
    spark.createDataFrame([(*x, "z", 1) for x in rows], "doc_id long, text string, fp string, u int").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(x) for x in simhash.op5_simhash_near_dedup(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_large_blocks_give_the_same_components(spark):
    r = random.Random(2)
    fps = {0, -1}
    for _ in range(6):
        x = r.getrandbits(63)
        fps |= {x} | {x ^ (1 << r.randrange(63)) ^ (1 << r.randrange(63)) for _ in range(60)}
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    from evalloom.llm.common import components

    a, b = (sorted(map(tuple, components(simhash.links(df, dense)).collect())) for dense in (1, 10**6))
    assert a == b and len(a) > 300


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert simhash.op5_simhash_near_dedup(spark, str(tmp_path)).count() == 0
