"""Approximate nearest neighbours by multiprobe p-stable hashing.

1. Equal vectors fold into one node, which keeps the k + 1 smallest ids of its copies: hot copies cost nothing.
2. ``TABLES`` tables hash a node by ``M`` functions floor(a.v / w + b), with normal (2-stable) a. The width w follows
   the distance of the k-th neighbour, M the number of nodes and the entropy of one function; both are fitted on bounded
   samples (``SAMPLE_NODES`` nodes, ``SAMPLE_QUERIES`` queries with their true neighbours among all nodes).
3. A query visits its own bucket and perturbed ones, in the order of their estimated success: the distances of its
   projections to the sides of their cells are sorted, and sets of them are taken by rising expected squared distance.
   The number of probes is the smallest that reaches the sample's neighbours to ``TARGET``.
4. Buckets meet their visitors, large ones in pieces, and return each visitor's nearest nodes by exact distance in double
   precision; the tables' candidates are merged.
5. The sample's recall is measured on what came out. Below ``LEAST`` all queries are compared with all nodes, in blocks;
   so are queries that met too few nodes, and those whose length isn't the commonest.

Nearness is the Euclidean distance, ties go to the smaller id. Defined cases: vectors that are null, empty, zero or hold
null, NaN or infinite components take no part; vectors of different lengths have no distance; a row isn't its own
neighbour, but a repeated row is; a null id counts as the largest; an empty table, or one without queries, gives an empty
result. Only the id and the vector are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from evalloom.llm import common

K = 10
TABLES, WIDTH, CELL, MOST_FUNCTIONS, MOST_PROBES = 4, 2.4, 512, 24, 2048
SAMPLE_NODES, SAMPLE_QUERIES, TARGET, LEAST = 4096, 256, 0.97, 0.93
#: Nodes and visitors of a bucket that meet in one group.
PIECE, VISITORS = 4096, 1024
SEED = 1217
MAX = (1 << 63) - 1
FOUND = "query long, node long, low long, d2 double"


def perturbations(m: int, most: int) -> list[tuple[int, ...]]:
    """Sets of places among a query's 2m sorted side distances, by rising expected squared distance; never both sides of a function.

    The expected square of the j-th smallest of m uniform distances and their complements is that of Lv et al. (2007).
    """
    def square(j: int) -> float:
        if j <= m:
            return j * (j + 1) / (4 * (m + 1) * (m + 2))
        i = 2 * m + 1 - j
        return 1 - i / (m + 1) + i * (i + 1) / (4 * (m + 1) * (m + 2))

    cost = [square(j) for j in range(1, 2 * m + 1)]
    sets, heap = [()], [(cost[0], (0,))]
    while heap and len(sets) < most:
        total, places = heapq.heappop(heap)
        if len({min(p, 2 * m - 1 - p) for p in places}) == len(places):
            sets.append(places)
        last = places[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*places[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*places, last + 1)))
    return sets


class Tables:
    """Hash functions of all tables, for vectors of one length."""

    def __init__(self, length: int, functions: int, width: float):
        r = np.random.default_rng((SEED, length, functions))
        self.m, self.width = functions, width
        self.a, self.b = r.normal(size=(TABLES, functions, length)), r.uniform(size=(TABLES, functions, 1))
        self.weights = r.integers(1, 1 << 62, size=(TABLES, functions), dtype=np.int64) | 1
        self.sets, self.probes = perturbations(functions, MOST_PROBES), 1

    def places(self, x: np.ndarray) -> np.ndarray:
        """Places of vectors along each function, in cells: (tables, functions, vectors)."""
        return np.clip(self.a @ x.T / self.width + self.b, -(2.0**61), 2.0**61)

    def cells(self, places: np.ndarray) -> np.ndarray:
        """Bucket of each vector: (tables, vectors); sums wrap."""
        return (np.floor(places).astype(np.int64) * self.weights[:, :, None]).sum(1)

    def visits(self, x: np.ndarray, probes: int) -> np.ndarray:
        """Buckets that each vector visits, in order: (tables, vectors, probes)."""
        places = self.places(x)
        home = self.cells(places)
        inside = places - np.floor(places)
        order = np.argsort(np.concatenate([inside, 1 - inside], 1), 1, kind="stable")
        steps = np.where(order < self.m, -1, 1) * np.take_along_axis(self.weights[:, :, None], order % self.m, 1)
        out = np.repeat(home[:, :, None], min(probes, len(self.sets)), 2)
        for p, moved in enumerate(self.sets[:probes]):
            if moved:
                out[:, :, p] += steps[:, list(moved)].sum(1)
        return out


def _coded(tables: Tables):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = common.matrix(b.column(0))
            cells = tables.cells(tables.places(x)).T if len(x) else np.zeros((0, TABLES), np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(cells), pa.list_(pa.int64()))], [*b.schema.names, "cells"])

    return run


def _with_cells(df: DataFrame) -> StructType:
    return StructType([*df.schema.fields, StructField("cells", ArrayType(LongType()))])


def _visiting(tables: Tables):
    """Rows (v, query, t, cell) of the buckets that queries visit, a few queries a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 64):
                part = b.slice(at, 64)
                cells = tables.visits(common.matrix(part.column(0)), tables.probes).transpose(1, 0, 2).reshape(len(part), -1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(cells), pa.list_(pa.int64()))], [*part.schema.names, "cells"])

    return run


def nearest(q: np.ndarray, c: np.ndarray, low: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in q, place in c, squared distance) of the k nearest of c to each of q; ties go to the smaller ``low``."""
    at, to, dist = [], [], []
    qq, cc = (q * q).sum(1), (c * c).sum(1)
    slack = 1e-9 * (qq + cc.max(initial=0))  # products round; what is near the k-th by products is measured by differences
    step = max(1, (1 << 20) // max(1, len(c)))
    for s in range(0, len(q), step):
        own = slice(s, s + step)
        rough = qq[own, None] + cc[None, :] - 2 * (q[own] @ c.T)
        edge = np.partition(rough, k - 1, 1)[:, k - 1] + slack[own] if len(c) > k else np.full(len(rough), np.inf)
        for i, row in enumerate(rough <= edge[:, None]):
            j = np.flatnonzero(row)
            d = c[j] - q[s + i]
            d = (d * d).sum(1)
            best = np.lexsort((low[j], d))[:k]
            at.append(np.full(len(best), s + i))
            to.append(j[best])
            dist.append(d[best])
    return (np.concatenate(at), np.concatenate(to), np.concatenate(dist)) if at else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _found(query: np.ndarray, node: np.ndarray, low: np.ndarray, d2: np.ndarray) -> list[pa.Array]:
    return [pa.array(query, pa.int64()), pa.array(node, pa.int64()), pa.array(low, pa.int64()), pa.array(d2, pa.float64())]


def _meeting(k: int):
    """Nearest nodes of the visitors of one piece."""

    def run(q: pa.Table, b: pa.Table) -> pa.Table:
        if not q.num_rows or not b.num_rows:
            return pa.Table.from_arrays(_found(*[np.zeros(0)] * 4), ["query", "node", "low", "d2"])
        low, ids = b["low"].to_numpy(), b["node"].to_numpy()
        i, j, d = nearest(common.matrix(q["v"]), common.matrix(b["v"]), low, k)
        return pa.Table.from_arrays(_found(q["query"].to_numpy()[i], ids[j], low[j], d), ["query", "node", "low", "d2"])

    return run


def _met(visitors: DataFrame, nodes: DataFrame, key: list[str], k: int) -> DataFrame:
    """Nearest nodes of ``visitors(query, v, *key)`` among ``nodes(node, low, v, *key)`` of their key, in pieces."""
    sizes = nodes.groupBy(*key).agg(F.count("*").alias("n")).join(visitors.groupBy(*key).agg(F.count("*").alias("nq")), key)
    sizes = common.saved(sizes.select(*key, F.ceil(F.col("n") / PIECE).cast("int").alias("np"), F.ceil(F.col("nq") / VISITORS).cast("int").alias("nq")), "ann-sizes")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = visitors.join(sizes, key).withColumn("q", F.pmod(F.xxhash64("query"), F.col("nq")).cast("int")).withColumn("p", every("np"))
    right = nodes.join(sizes, key).withColumn("p", F.pmod(F.xxhash64("node"), F.col("np")).cast("int")).withColumn("q", every("nq"))
    group = [*key, "p", "q"]
    # aliases: both sides may come from one table
    left = left.select(*[F.col(c).alias(c) for c in (*group, "query", "v")])
    right = right.select(*[F.col(c).alias(c) for c in (*group, "node", "low", "v")])
    return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(_meeting(k), FOUND)


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The k nearest distinct nodes of each query."""
    once = found.groupBy("query", "node").agg(F.min("low").alias("low"), F.min("d2").alias("d2"))
    place = F.row_number().over(Window.partitionBy("query").orderBy("d2", "low", "node"))
    return once.withColumn("place", place).where(F.col("place") <= k).drop("place")


def _sampled(df: DataFrame, n: int, size: int) -> list:
    """About ``size`` of n rows, chosen by a hash of the node."""
    rate = int(min(1.0, size / max(1, n)) * (1 << 30))
    return df.where(F.pmod(F.xxhash64(F.lit(SEED), "node"), F.lit(1 << 30)) < rate).select("node", "v").limit(2 * size).collect()


def _truth(nodes: DataFrame, ids: np.ndarray, x: np.ndarray, k: int) -> dict[int, dict[int, list]]:
    """The k nearest other nodes of a bounded list of nodes, with their vectors, by comparing it with all nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                node = b.column(0).to_numpy()
                i, j, d = nearest(x, common.matrix(b.column(2)), b.column(1).to_numpy(), k + 1)
                own = ids[i] != node[j]
                i, j, d = i[own], j[own], d[own]
                yield pa.RecordBatch.from_arrays([*_found(ids[i], node[j], b.column(1).to_numpy()[j], d), b.column(2).take(pa.array(j))], ["query", "node", "low", "d2", "v"])

    kind = nodes.schema["v"].dataType.simpleString()
    near = nodes.select("node", "low", "v").mapInArrow(run, f"{FOUND}, v {kind}")
    place = F.row_number().over(Window.partitionBy("query").orderBy("d2", "low", "node"))
    true: dict[int, dict[int, list]] = {}
    for r in near.withColumn("place", place).where(F.col("place") <= k).select("query", "node", "d2", "v").collect():
        true.setdefault(r["query"], {})[r["node"]] = [r["d2"], r["v"]]
    return true


def fitted(sample: np.ndarray, n: int, queries: np.ndarray, true: list[list]) -> Tables:
    """Tables whose width, number of functions and probes suit a sample: ``true`` has (squared distance, vector) of each query's neighbours."""
    far = [np.sqrt(max(d for d, _ in t)) for t in true if t]
    spread = float(np.sqrt(sample.var(0).sum())) or float(np.abs(sample).max()) or 1.0
    width = WIDTH * (float(np.median(far)) if far else spread)
    width = width if width > 1e-6 * spread else WIDTH * spread
    probe = Tables(sample.shape[1], MOST_FUNCTIONS, width)
    places = np.floor(probe.places(sample)[0])
    entropy = np.mean([-(p * np.log(p)).sum() for p in (np.unique(row, return_counts=True)[1] / len(row) for row in places)])
    functions = int(np.clip(round(np.log(max(1.0, n / CELL)) / max(entropy, 1e-3)), 1, MOST_FUNCTIONS))
    tables = Tables(sample.shape[1], functions, width)
    need = []
    for q, t in zip(queries, true):
        if t:
            visits = tables.visits(q[None, :], MOST_PROBES)[:, 0]
            cells = tables.cells(tables.places(np.array([v for _, v in t], np.float64)))
            hit = visits[:, :, None] == cells[:, None, :]
            need += np.where(hit.any(1), hit.argmax(1), MOST_PROBES).min(0).tolist()
    if need:
        tables.probes = int(min(np.sort(need)[int(np.ceil(TARGET * len(need))) - 1] + 1, len(tables.sets)))
    return tables


def search(vectors: DataFrame, is_query: Column, k: int = K, measured: dict | None = None) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest other rows of each row of ``vectors(vec_id, embedding)`` that ``is_query`` chooses.

    ``measured``, if given, receives the recall over the sampled queries, the probes and the functions.
    """
    spark = vectors.sparkSession
    common.bounded_batches(spark)
    v = F.col("embedding")
    able = common.finite(v) & F.exists(v, lambda c: c != 0)
    rows = vectors.where(able).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = common.saved(rows.withColumn("row", F.monotonically_increasing_id()), "ann-rows")
    # a node is a distinct vector; its number is that of the first of its rows, of which it keeps k + 1
    place = F.row_number().over(Window.partitionBy("v").orderBy(F.col("vec_id").asc_nulls_last(), "row"))
    first = rows.select("v", "vec_id", "row").withColumn("place", place).where(F.col("place") <= k + 1)
    folded = first.groupBy("v").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "row"))).alias("members"))
    nodes = common.saved(folded.select(F.col("members")[0]["row"].alias("node"), F.coalesce(F.col("members")[0]["vec_id"], F.lit(MAX)).alias("low"), "v", F.size("v").alias("d"), "members"), "ann-nodes")
    asked = rows.where("asks").join(nodes.select("v", "node", "d"), "v").select(F.col("vec_id").alias("query_id"), "row", "node", "d", "v")
    asked = common.saved(asked, "ann-asked")
    visitors = common.saved(asked.groupBy("node", "d").agg(F.any_value("v").alias("v")), "ann-visitors")
    sizes = nodes.groupBy("d").agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("d")).limit(1).collect()
    length, n = (sizes[0]["d"], sizes[0]["c"]) if sizes else (0, 0)
    usual, asking = nodes.where(F.col("d") == length), visitors.where(F.col("d") == length)
    heard = _sampled(asking, asking.count(), SAMPLE_QUERIES) if n else []
    found, enough = None, k + 1
    if heard:
        ids, x = np.array([r["node"] for r in heard]), np.array([r["v"] for r in heard], np.float64)
        true = _truth(usual, ids, x, k)
        sample = np.array([r["v"] for r in _sampled(usual, n, SAMPLE_NODES)] or x, np.float64)
        tables = fitted(sample, n, x, [list(true.get(q, {}).values()) for q in ids.tolist()])
        usual_rows = usual.select("v", "node", "low")
        coded = usual_rows.mapInArrow(_coded(tables), _with_cells(usual_rows))
        hashed = coded.select("v", "node", "low", F.posexplode("cells").alias("t", "cell"))
        going = asking.select("v", F.col("node").alias("query"))
        going = going.mapInArrow(_visiting(tables), _with_cells(going))
        going = going.select("v", "query", F.posexplode("cells").alias("at", "cell")).select("v", "query", F.floor(F.col("at") / tables.probes).cast("int").alias("t"), "cell")
        found = common.saved(_merged(_met(going, hashed, ["t", "cell"], enough), enough), "ann-found")
        got: dict[int, set] = {}
        for r in found.where(F.col("query").isin(ids.tolist())).select("query", "node").collect():
            got.setdefault(r["query"], set()).add(r["node"])
        total = sum(map(len, true.values()))
        recall = sum(len(got.get(q, set()) & near.keys()) for q, near in true.items()) / total if total else 1.0
        if measured is not None:
            measured |= {"recall": recall, "probes": tables.probes, "functions": tables.m}
        if recall < LEAST:
            found = None
    done = found.groupBy("query").agg(F.count("*").alias("c")).where(F.col("c") >= enough).select(F.col("query").alias("node")) if found is not None else None
    left = visitors.join(done, "node", "left_anti") if done is not None else visitors
    exact = _merged(_met(left.select("v", F.col("node").alias("query"), "d"), nodes.select("v", "node", "low", "d"), ["d"], enough), enough)
    if found is not None:
        found = found.join(done.withColumnRenamed("node", "query"), "query", "left_semi").union(exact)
    else:
        found = exact
    # back to rows: a query row's neighbours are among the first k + 1 rows of its node's neighbours
    members = found.join(nodes.select("node", "members"), "node").select("query", "d2", F.explode("members").alias("m")).select("query", "d2", "m.vec_id", "m.row")
    order = ["d2", F.col("vec_id").asc_nulls_last(), "row"]
    members = members.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("place") <= enough).drop("place")
    pairs = asked.select("query_id", F.col("row").alias("own"), F.col("node").alias("query")).join(members, "query").where("own <> row")
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("own").orderBy(*order))).where(F.col("rank") <= k)
    return pairs.select("query_id", "rank", "vec_id", F.sqrt("d2").alias("score"))


def op12_multiprobe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
