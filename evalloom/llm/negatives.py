"""Hard negatives by norm-bucketed search.

A row's score is its integer inner product with an anchor. Candidates are sorted by norm into at most ``MOST_BUCKETS``
ranges of about ``PIECE`` rows or more, the longest vectors first; large buckets are dealt into pieces. No candidate of a
bucket can score more than its largest norm times the anchor's (Cauchy-Schwarz), so the buckets that an anchor still has
to see are a prefix, which ends where that bound falls below the anchor's limit. Buckets are visited in waves, each four
times as many as the one before; after each wave the limit of a search rises to its running k-th score, once it has k.

Two searches of this kind run: the best rows of the anchor's own label (the positives), then, for each positive, the best
rows of other labels within its window of scores, whose lower end is the limit from the start. In a wave, blocks of
anchors meet pieces of candidates; each meeting is one matrix product, and returns at most k rows a search.

Scores are exact: where products could pass 2^53 they are multiplied as Python integers, and one beyond a long is an
error. Ties go to the smaller id. Defined cases: rows with a null label, and vectors that are null, empty or hold null,
NaN or infinite components, take no part; vectors of different lengths have no score; an anchor isn't its own positive,
but a repeated row is a row of its own, as candidate and as anchor; a null id is no anchor and counts as the largest; a
negative positive score leaves an empty window; an empty table, or one without anchors, gives an empty result. Only the
id, the vector and the label are read.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalloom.llm import common

POSITIVES, NEGATIVES, LOW, HIGH, UNIT = 5, 5, 80, 100, 100
MOST_BUCKETS, PIECE, ANCHORS, GROWTH = 1024, 4096, 2048, 4
MAX, MIN = (1 << 63) - 1, -(1 << 63)
FOUND = "anchor long, want int, score long, id long, row long"


def _scores(a: pa.Table, c: pa.Table, own: slice) -> np.ndarray:
    """Inner products of anchors and candidates, as doubles that hold whole numbers, or as Python integers."""
    x, y = common.matrix(a["x"], np.int64)[own], common.matrix(c["x"], np.int64)
    fx, fy = x.astype(np.float64), y.astype(np.float64)
    if np.sqrt((fx * fx).sum(1).max(initial=0) * (fy * fy).sum(1).max(initial=0)) < 1 << 52:
        return fx @ fy.T
    return x.astype(object) @ y.astype(object).T


def _best(scores: np.ndarray, able: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of each row's k largest able scores; ties go to the earlier column."""
    n = scores.shape[1]
    whole = scores.dtype != object and np.abs(scores).max(initial=0) < (1 << 52) // max(1, n)
    if whole and n > k:
        keys = np.where(able, scores * n + np.arange(n, 0, -1), -np.inf)
        col = np.argpartition(keys, n - k, 1)[:, n - k :]
        row = np.repeat(np.arange(len(scores)), k)
        col = col.ravel()
        kept = able[row, col]
        return row[kept], col[kept]
    out = [(i, j) for i in range(len(scores)) for j in sorted(np.flatnonzero(able[i]), key=lambda j: (-scores[i, j], j))[:k]]
    return np.array([i for i, _ in out], int), np.array([j for _, j in out], int)


def _meet(k: int, same: bool, a: pa.Table, c: pa.Table) -> pa.Table:
    """The best candidates of a piece for each search ``wants(want, floor, ceil)`` of a block of anchors."""
    out: list[list] = [[], [], [], [], []]
    if a.num_rows and c.num_rows:
        c = c.take(pa.array(np.lexsort((c["row"].to_numpy(), c["id"].to_numpy()))))
        ids, rows, labels = c["id"].to_numpy(), c["row"].to_numpy(), np.array(c["label"].to_pylist(), object)
        own_row, own_label = a["row"].to_numpy(), np.array(a["label"].to_pylist(), object)
        wants = a["wants"].to_pylist()
        step = max(1, (1 << 20) // c.num_rows)
        for s in range(0, a.num_rows, step):
            own = slice(s, s + step)
            scores = _scores(a, c, own)
            able = (own_label[own, None] == labels[None, :]).astype(bool) == same
            able &= own_row[own, None] != rows[None, :]
            for w in range(max(map(len, wants[own]))):
                edge = np.array([[x[w]["floor"], x[w]["ceil"]] if len(x) > w else [1, 0] for x in wants[own]], object if scores.dtype == object else np.float64)
                i, j = _best(scores, able & (scores >= edge[:, :1]).astype(bool) & (scores <= edge[:, 1:]).astype(bool), k)
                out[0].append(own_row[own][i])
                out[1].append(np.array([wants[s + x][w]["want"] for x in i], np.int64))
                out[2].append(np.array([int(v) for v in scores[i, j]], object))
                out[3].append(ids[j])
                out[4].append(rows[j])
    cols = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
    return pa.Table.from_arrays([pa.array(col.tolist(), pa.int32() if n == 1 else pa.int64()) for n, col in enumerate(cols)], ["anchor", "want", "score", "id", "row"])


def _top(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("anchor", "want").orderBy(F.desc("score"), "id", "row"))
    return found.withColumn("place", place).where(F.col("place") <= k)


class Candidates:
    """Rows ``(row, id, label, x, norm)`` saved by falling norm: bucket, piece, and the largest norm of each bucket."""

    def __init__(self, rows: DataFrame):
        n = rows.count()
        norms = common.ranges(rows, "norm", min(MOST_BUCKETS, -(-n // PIECE)))
        placed = rows.withColumn("bucket", (F.lit(len(norms)) - common.range_of(F.col("norm"), norms)).cast("int"))
        summary = {r["bucket"]: (r["n"], r["top"]) for r in placed.groupBy("bucket").agg(F.count("*").alias("n"), F.max("norm").alias("top")).collect()}
        self.count = len(norms) + 1
        self.pieces = [max(1, -(-summary.get(b, (0, 0.0))[0] // PIECE)) for b in range(self.count)]
        self.tops = [summary.get(b, (0, 0.0))[1] for b in range(self.count)]
        pieces = F.element_at(F.array(*map(F.lit, self.pieces)), F.col("bucket") + 1)
        placed = placed.withColumn("piece", F.pmod(F.xxhash64("row"), pieces).cast("int"))
        self.rows = common.saved(placed.sortWithinPartitions("bucket"), "hard-candidates")

    def reach(self, norm: Column, floor: Column) -> Column:
        """Buckets, from the first, whose bound reaches ``floor``; doubles round, so a hair more."""
        bounds = F.array(*[F.lit(float(t)) for t in self.tops])
        return F.size(F.filter(bounds, lambda t: F.sqrt(t) * F.sqrt(norm) * (1 + 1e-9) >= floor.cast("double")))


def _searched(candidates: Candidates, anchors: DataFrame, k: int, same: bool, visited: list | None) -> DataFrame:
    """``(anchor, want, score, id, row, place)``: the k best candidates of each search of ``anchors(row, label, x, norm, wants)``."""
    spark, found, at, wave = anchors.sparkSession, None, 0, 1
    blocks = max(1, -(-anchors.count() // ANCHORS))
    pieces = F.array(*map(F.lit, candidates.pieces))
    key = ["block", "bucket", "piece"]
    while at < candidates.count:
        to = min(at + wave, candidates.count)
        reach = candidates.reach(F.col("norm"), F.array_min(F.col("wants")["floor"]))
        going = anchors.withColumn("reach", F.least(reach, F.lit(to))).where((F.col("reach") > at) & (F.size("wants") > 0))
        going = going.withColumn("bucket", F.explode(F.sequence(F.lit(at), F.col("reach") - 1))).withColumn("piece", F.explode(F.sequence(F.lit(0), F.element_at(pieces, F.col("bucket") + 1) - 1)))
        going = going.select(F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), "bucket", "piece", "row", "label", "x", "wants")
        met = candidates.rows.where(F.col("bucket").between(at, to - 1)).join(going.select(*key).distinct(), ["bucket", "piece"])
        left = going.select(*[F.col(c).alias(c) for c in (*key, "row", "label", "x", "wants")])
        right = met.select(*[F.col(c).alias(c) for c in (*key, "row", "id", "label", "x")])
        new = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(partial(_meet, k, same), FOUND)
        if visited is not None:
            visited.append((at, to, going.count()))
        found = common.saved(_top(new if found is None else new.unionByName(found.drop("place")), k), "hard-found")
        at, wave = to, wave * GROWTH
        if at < candidates.count:
            full = found.groupBy("anchor", "want").agg(F.count("*").alias("c"), F.min("score").alias("kth")).where(F.col("c") >= k)
            full = full.groupBy(F.col("anchor").alias("row")).agg(F.map_from_entries(F.collect_list(F.struct("want", "kth"))).alias("kth"))
            rise = F.transform("wants", lambda w: F.struct(w["want"].alias("want"), F.greatest(w["floor"], F.try_element_at("kth", w["want"])).alias("floor"), w["ceil"].alias("ceil")))
            risen = anchors.join(full, "row", "left").withColumn("wants", F.when(F.col("kth").isNull(), F.col("wants")).otherwise(rise)).drop("kth")
            anchors = common.saved(risen, "hard-anchors")
    return found if found is not None else spark.createDataFrame([], f"{FOUND}, place int")


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, unit: int = UNIT, visited: list | None = None) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` of ``rows(vec_id, label, x array<long>)``.

    A negative's score, times ``unit``, lies between ``low`` and ``high`` times the positive's. ``visited``, if given,
    receives (first bucket, end, visits of anchors) of each wave.
    """
    norm = F.aggregate("x", F.lit(0.0), lambda s, c: s + c.cast("double") * c)
    able = rows.where(F.col("label").isNotNull() & (F.coalesce(F.size("x"), F.lit(0)) > 0))
    able = able.select("vec_id", F.struct(F.col("label").cast("string").alias("l"), F.size("x").alias("d")).alias("kind"), "x", F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    able = common.saved(able.withColumn("row", F.monotonically_increasing_id()).withColumn("norm", norm), "hard-rows")
    parts = []
    # one length is the rule; others are searched among themselves
    for d in sorted(r["d"] for r in able.where("asks").select(F.col("kind.d").alias("d")).distinct().collect()):
        own = able.where(F.col("kind.d") == d).withColumn("label", F.col("kind.l"))
        candidates = Candidates(own.select("row", F.coalesce("vec_id", F.lit(MAX)).alias("id"), "label", "x", "norm"))
        wants = F.array(F.struct(F.lit(0).alias("want"), F.lit(MIN).alias("floor"), F.lit(MAX).alias("ceil")))
        anchors = common.saved(own.where("asks").select("row", "label", "x", "norm", wants.alias("wants")), "hard-anchors")
        near = _searched(candidates, anchors, positives, True, visited)
        near = near.select("anchor", F.col("place").alias("want"), F.col("score").alias("positive_score"), F.nullif("id", F.lit(MAX)).alias("positive_id"))
        scaled = lambda by, more: F.expr(f"cast((cast(positive_score as decimal(28,0)) * {by} + {more}) div {unit} as long)")  # noqa: E731  products may pass a long
        window = F.struct("want", scaled(low, unit - 1).alias("floor"), scaled(high, 0).alias("ceil"))
        windows = near.where("positive_score >= 0").groupBy(F.col("anchor").alias("row")).agg(F.collect_list(window).alias("wants"))
        anchors = common.saved(anchors.drop("wants").join(windows, "row"), "hard-windows")
        far = _searched(candidates, anchors, negatives, False, visited)
        far = far.select("anchor", "want", F.col("place").alias("rank"), F.nullif("id", F.lit(MAX)).alias("negative_id"), F.col("score").alias("negative_score"))
        names = own.where("asks").select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
        parts.append(far.join(near, ["anchor", "want"]).join(names, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    out = parts[0] if parts else rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    for p in parts[1:]:
        out = out.union(p)
    return out


def op11_norm_bucket_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = common.table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("v"))
    x = F.transform("v", lambda c: F.when(F.abs(c * 256) < 1 << 52, F.floor(c * 256)).otherwise(F.raise_error("a component is too large to be a whole number").cast("long")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = src.where(common.finite(F.col("v"))).select("vec_id", label.alias("label"), x.alias("x"))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


#: The same by comparing each anchor with all rows.
OP11_SQL = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS x FROM embeddings
 WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) <= 5"""
