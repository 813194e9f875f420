import random

import pyarrow as pa
from pyspark.sql import functions as F

from evalloom.llm import common


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(3000), r.randrange(3000)) for _ in range(1400)] + [(5000, 6000 + i) for i in range(500)] + [(7000 + i, 7001 + i) for i in range(200)] + [(1, 1), (None, 2)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges[:-2]:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "u long, v long").repartition(5)
    got = {x.u: x.root for x in common.components(df).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert common.components(df.limit(0)).count() == 0


def test_ranges(spark):
    df = spark.range(10_000).select((F.col("id") * F.col("id") % 7919).alias("k"))
    bounds = common.ranges(df, "k", 37)
    at = df.select("k", common.range_of(F.col("k"), bounds).alias("r")).distinct().collect()
    assert all(x.r == sum(b <= x.k for b in bounds) for x in at) and len({x.r for x in at}) > 30
    assert spark.range(1).select(common.range_of(F.lit(None).cast("long"), bounds)).first()[0] == 0 and common.ranges(df.limit(0), "k", 5) == []


def test_buffers_of_slices_and_nulls():
    a = pa.array(["ab", None, "", "é", "x"])
    assert common.texts(a) == [b"ab", b"", b"", "é".encode(), b"x"] and common.texts(a.slice(3)) == ["é".encode(), b"x"]
    assert common.texts(pa.array(["q"], pa.large_string())) == [b"q"] and common.texts(pa.array([], pa.string())) == []


def test_saved_tables(spark):
    df = common.saved(spark.range(5).toDF("x"), "t")
    assert df.count() == 5 and df.schema["x"].dataType.simpleString() == "bigint"


def test_buckets_stay_within_the_session_limit(spark):
    before = spark.conf.get("spark.sql.sources.bucketing.maxBuckets")
    spark.conf.set("spark.sql.sources.bucketing.maxBuckets", "5")
    try:
        got = common.bucketed(spark.range(40).withColumnRenamed("id", "k"), "k", 2_000_000, "limit")
        assert got.groupBy("k").count().count() == 40
    finally:
        spark.conf.set("spark.sql.sources.bucketing.maxBuckets", before)
