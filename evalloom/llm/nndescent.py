"""Near-duplicate embeddings by NN-descent within labels.

1. Equal vectors of a label fold into one node (weight: the number of copies), so hot copies cost nothing.
2. Start lists: nodes fall into buckets by the signs of keyed random projections, in ``STARTS`` drawings; large buckets
   are cut, along one more projection, into chunks of ``CHUNK`` nodes, which are compared within.
3. Rounds: each node, as a pivot, gathers its list's and its reverse list's vectors (in chunks if many), compares them
   with each other and offers each the best it found; lists keep the ``K`` most similar. Rounds end when few change.
4. Audit: nodes of a hashed sample (about ``AUDIT`` of them, up to ``AUDIT_MOST`` where links are rare) are compared with
   all nodes of their label, in blocks; the share of their links that lists hold is the recall. Below ``RECALL`` more
   rounds follow, from fresh drawings; if it stays below ``LEAST_RECALL``, all nodes are compared as in 5.
5. Saturated lists (all entries reach the threshold) can't hold all links. They are first enlarged to ``ENLARGED``; nodes
   still saturated are compared with all nodes of their label in blocks, exactly. A block pair returns link counts and
   the components of its links, never the pairs, so a group of thousands of near copies stays linear in memory.

Links reach ``THRESHOLD`` by cosine in double precision. Defined cases: a null label, and a vector that is null, empty,
zero or holds null or non-finite components, links with nothing (its own component); vectors of different lengths don't
link; repeated rows are vectors of their own; a null id names no component unless nothing else is in it; an empty table
gives an empty result. Only vec_id, embedding and label are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm import common

THRESHOLD = 0.93
K, ENLARGED = 12, 48
STARTS, CHUNK = 6, 48
ROUNDS, SETTLED = 8, 0.005
#: Nodes of the first audit, most of a later one, links that an audit should meet; recall aimed at, and least one.
AUDIT, AUDIT_MOST, AUDIT_LINKS, RECALL, LEAST_RECALL = 400, 25_600, 200, 0.98, 0.9
#: Nodes of a block of the exact comparison.
BLOCK = 512
SEED = 4242


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors as bytes (float64); null where a vector can't link."""
    for b in batches:
        out = []
        for x in b.column(0):
            v = x.values
            a = None
            if v is not None and len(v) and not v.null_count:
                a = v.to_numpy(zero_copy_only=False).astype(np.float64)
                m = np.abs(a).max()
                a = (a / m) if np.isfinite(a).all() and m > 0 else None
                a = a / np.sqrt(a @ a) if a is not None else None
            out.append(None if a is None else a.tobytes())
        yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(out, pa.binary())], [*b.schema.names[1:], "unit"])


def _buckets(bits: int, drawing: int):
    """Sign codes of keyed projections, and a place along one more of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict = {}
        for b in batches:
            codes, places = [], []
            for u in b.column(1).to_pylist():
                a = np.frombuffer(u)
                if len(a) not in planes:
                    planes[len(a)] = np.random.default_rng((SEED, drawing, len(a))).normal(size=(bits + 1, len(a)))
                p = planes[len(a)] @ a
                codes.append(int((p[:-1] > 0) @ (1 << np.arange(bits))))
                places.append(float(p[-1]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codes, pa.int64()), pa.array(places)], ["node", "code", "place"])

    return run


def _offers(k: int):
    """Of each group of nodes with vectors: the best others of every member, as (node, list)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, lists = [], []
            for members in b.column(0).to_pylist():
                members = list({m["node"]: m["unit"] for m in members}.items())
                if len(members) < 2:
                    continue
                ids = np.array([m[0] for m in members])
                x = np.stack([np.frombuffer(m[1]) for m in members])
                s = x @ x.T
                np.fill_diagonal(s, -9)
                n = min(k, len(ids) - 1)
                best = np.argpartition(-s, n - 1, 1)[:, :n]
                for i, row in enumerate(best):
                    nodes.append(int(ids[i]))
                    lists.append([{"s": float(s[i, j]), "n": int(ids[j])} for j in row])
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(lists, pa.list_(pa.struct([("s", pa.float64()), ("n", pa.int64())])))], ["node", "list"])

    return run


LISTS = "node long, list array<struct<s:double,n:long>>"


def _best(lists: DataFrame, k: int) -> DataFrame:
    """Merges lists of a node and keeps its ``k`` most similar (ties: smaller node)."""
    rows = lists.select("node", F.explode("list").alias("e")).groupBy("node", F.col("e.n").alias("n")).agg(F.max("e.s").alias("s"))
    best = F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("s", (-F.col("n")).alias("m"))))), 1, k)
    return rows.groupBy("node").agg(F.transform(best, lambda x: F.struct(x["s"].alias("s"), (-x["m"]).alias("n"))).alias("list"))


def _started(nodes: DataFrame, n: int, k: int, first: int, drawings: int) -> DataFrame:
    bits = max(1, (n // CHUNK).bit_length())
    rows = None
    for d in range(first, first + drawings):
        placed = nodes.select("node", "unit").mapInArrow(_buckets(bits, d), "node long, code long, place double").withColumn("d", F.lit(d))
        rows = placed if rows is None else rows.union(placed)
    rows = rows.join(nodes.select("node", "group", "unit"), "node")
    # large buckets are cut along the place; cuts come from the bucket's extent, refined by the hash for equal places
    sizes = rows.groupBy("d", "group", "code").agg(F.count("*").alias("c"), F.min("place").alias("lo"), F.max("place").alias("hi"))
    pieces = F.ceil(F.col("c") / F.lit(CHUNK / 2))
    part = F.floor((F.col("place") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-300)) * F.least(pieces, F.lit(1 << 20)))
    cut = rows.join(sizes, ["d", "group", "code"]).withColumn("part", F.when(F.col("c") > CHUNK, part).otherwise(F.lit(0)))
    return _gathered(cut.select(F.struct("d", "group", "code", "part").alias("key"), "node", "unit"), k)


def _gathered(members: DataFrame, k: int, salt: int = 0) -> DataFrame:
    """Compares the members ``(key, node, unit)`` of each key, in chunks of about ``CHUNK``, other ones for each ``salt``, if there are more."""
    sizes = members.groupBy("key").agg(F.count("*").alias("c"))
    chunk = F.pmod(F.xxhash64(F.lit(salt), "node", "key"), F.ceil(F.col("c") / CHUNK))
    rows = members.join(sizes.where("c > 1"), "key").withColumn("chunk", chunk)
    groups = rows.groupBy("key", "chunk").agg(F.collect_list(F.struct("node", "unit")).alias("members"))
    return groups.select("members").mapInArrow(_offers(k), LISTS)


def _round(nodes: DataFrame, lists: DataFrame, k: int, salt: int) -> DataFrame:
    """One join of neighbours with neighbours' neighbours."""
    edges = lists.select("node", F.explode("list.n").alias("n"))
    both = edges.select(F.col("node").alias("pivot"), F.col("n").alias("node")).union(edges.select(F.col("n").alias("pivot"), "node")).union(lists.select(F.col("node").alias("pivot"), "node")).distinct()
    members = both.join(nodes.select("node", "unit"), "node").select(F.col("pivot").alias("key"), "node", "unit")
    return common.saved(_best(lists.unionByName(_gathered(members, k, salt)), k), "nnd-lists")


def _exact(query: pa.Table, base: pa.Table) -> pa.Table:
    """Links of a block of queries to a block of nodes: (node, other, weight) rows; other is null for counts."""
    q, b = (np.stack([np.frombuffer(u) for u in t["unit"].to_pylist()]) for t in (query, base))
    qi, bi = query["node"].to_numpy(), base["node"].to_numpy()
    qw, bw = query["weight"].to_numpy(), base["weight"].to_numpy()
    near = (q @ b.T >= THRESHOLD) & (qi[:, None] != bi[None, :])
    hard = base["hard"].to_numpy(zero_copy_only=False)
    mine, theirs = near @ bw, (qw @ near) * ~hard  # queries count all their links; other nodes those to queries
    rows = [(int(i), None, int(w)) for i, w in zip(qi, mine) if w] + [(int(i), None, int(w)) for i, w in zip(bi, theirs) if w]
    # components of the block's links: the smallest number spreads until nothing changes
    a, b = qi.copy(), bi.copy()
    most = np.iinfo(np.int64).max
    while True:
        low = np.minimum(a, np.where(near, b[None, :], most).min(1, initial=most))
        back = np.minimum(b, np.where(near, low[:, None], most).min(0, initial=most))
        if (low == a).all() and (back == b).all():
            break
        a, b = low, back
    rows += [(int(i), int(r), 0) for i, r in [*zip(qi, a), *zip(bi, b)] if i != r]
    cols = list(zip(*rows)) if rows else [[], [], []]
    return pa.table({"node": pa.array(cols[0], pa.int64()), "other": pa.array(cols[1], pa.int64()), "links": pa.array(cols[2], pa.int64())})


def _compared(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """Compares ``queries(node)`` with all nodes of their groups, block by block: rows of ``_exact``."""
    marked = nodes.join(queries.select("node", F.lit(True).alias("hard")), "node", "left").withColumn("hard", F.coalesce("hard", F.lit(False)))
    marked = common.saved(marked, "nnd-marked")
    sizes = marked.groupBy("group").agg(F.count("*").alias("n"), F.count_if("hard").alias("q")).where("q > 0")
    dealt = marked.join(sizes, "group")
    parts = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    base = dealt.withColumn("b", F.pmod(F.xxhash64("node"), parts("n")).cast("int")).withColumn("a", F.explode(F.sequence(F.lit(0), parts("q") - 1)))
    query = dealt.where("hard").withColumn("a", F.pmod(F.xxhash64(F.lit(1), "node"), parts("q")).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), parts("n") - 1)))
    # aliases: both sides come from one table
    cols = [F.col(c).alias(c) for c in ("group", "a", "b", "node", "unit", "weight", "hard")]

    def pair(q: pa.Table, b: pa.Table) -> pa.Table:
        if not q.num_rows or not b.num_rows:
            return pa.table({"node": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
        return _exact(q, b)

    return query.select(*cols).groupBy("group", "a", "b").cogroup(base.select(*cols).groupBy("group", "a", "b")).applyInArrow(pair, "node long, other long, links long")


def audit(nodes: DataFrame, lists: DataFrame, n: int, k: int) -> float | None:
    """Share of a sample's true links (at most as many as a list holds) that the lists hold; None if there is none.

    While a sample meets fewer than ``AUDIT_LINKS`` links, one of four times as many nodes follows.
    """
    size = AUDIT
    while True:
        sample = nodes.where(F.pmod(F.xxhash64(F.lit(8), "node"), F.lit(1 << 30)) < int(min(1.0, size / n) * (1 << 30)))
        ones = nodes.withColumn("weight", F.lit(1).cast("long"))
        true = _compared(ones, sample).where("other is null").groupBy("node").agg(F.sum("links").alias("t"))
        true = true.join(sample.select("node"), "node", "left_semi").select("node", F.least("t", F.lit(k)).alias("t"))
        held = lists.select("node", F.size(F.filter("list", lambda x: x["s"] >= THRESHOLD)).alias("h"))
        got = true.join(held, "node", "left").agg(F.sum("t").alias("t"), F.sum(F.least("t", F.coalesce("h", F.lit(0)))).alias("h")).first()
        if (got["t"] or 0) >= AUDIT_LINKS or size >= min(n, AUDIT_MOST):
            return got["h"] / got["t"] if got["t"] else None
        size *= 4


def near_duplicates(vectors: DataFrame, measured: dict | None = None) -> DataFrame:
    """``(vec_id, n_links, component_id)`` of every row of ``vectors(vec_id, embedding, label)``.

    ``measured``, if given, receives the audited recall.
    """
    src = vectors.select(F.col("embedding").cast("array<double>").alias("embedding"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("group"))
    rows = common.saved(src.mapInArrow(_unit, "vec_id long, group string, unit binary"), "nnd-rows")
    able = rows.where("group is not null and unit is not null")
    # a node's number is its content's; the group keeps lengths apart
    group = F.xxhash64("group", F.octet_length("unit"))
    nodes = able.withColumn("node", F.xxhash64(F.lit(SEED), "group", "unit")).groupBy("node").agg(F.any_value(group).alias("group"), F.any_value("unit").alias("unit"), F.count("*").alias("weight"), F.min("vec_id").alias("low"))
    nodes = common.saved(nodes, "nnd-nodes")
    n = nodes.count()
    out, counts, edges = rows.where("group is null or unit is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")), None, None
    if not n:
        return out
    lists = common.saved(_best(_started(nodes, n, K, 0, STARTS), K), "nnd-lists")
    drawn, recall = STARTS, 0.0
    sum_ = lambda x: x.select(F.explode("list").alias("e")).agg(F.count("*").alias("n"), F.sum("e.s").alias("s")).first()
    for attempt in range(4):
        before = sum_(lists)
        for r in range(ROUNDS):
            lists = _round(nodes, lists, K, 1 + attempt * ROUNDS + r)
            now = sum_(lists)
            if now["n"] == before["n"] and now["s"] - before["s"] < SETTLED * max(1.0, abs(before["s"])):
                break
            before = now
        recall = audit(nodes, lists, n, K)
        if recall is None or recall >= RECALL:
            break
        more = _started(nodes, n, K, drawn, 2 * STARTS)
        drawn += 2 * STARTS
        lists = common.saved(_best(lists.unionByName(more), K), "nnd-lists")
    if measured is not None:
        measured["recall"] = recall
    full = lambda k: (F.size("list") >= k) & F.forall("list", lambda x: x["s"] >= THRESHOLD)
    # enlarge saturated lists: their nodes and those on their lists compare again with longer lists
    hot = lists.where(full(K)).select("node", F.explode("list.n").alias("n"))
    hot = common.saved(hot.select("node").union(hot.select("n")).distinct(), "nnd-hot")
    if not hot.isEmpty():
        part = lists.join(hot, "node", "left_semi")
        for r in range(2):
            part = _round(nodes, part, ENLARGED, -1 - r)
        lists = common.saved(_best(lists.unionByName(part), ENLARGED), "nnd-lists")
    limit = F.when(F.size("list") > K, ENLARGED).otherwise(K)
    missed = recall is not None and recall < LEAST_RECALL
    hard = nodes.select("node") if missed else common.saved(lists.where((F.size("list") >= limit) & F.forall("list", lambda x: x["s"] >= THRESHOLD)).select("node"), "nnd-hard")
    # links of lists without hard nodes, both ways; hard nodes' links are exact
    links = lists.join(hard, "node", "left_anti").select("node", F.explode("list").alias("e")).where(F.col("e.s") >= THRESHOLD).select("node", F.col("e.n").alias("other"))
    links = links.join(hard.withColumnRenamed("node", "other"), "other", "left_anti").select("node", "other")
    links = common.saved(links.union(links.select("other", "node")).distinct(), "nnd-links")
    exact = common.saved(_compared(nodes, hard), "nnd-exact")
    weigh = links.join(nodes.select(F.col("node").alias("other"), "weight"), "other").select("node", F.col("weight").alias("links"))
    counts = weigh.union(exact.where("other is null").select("node", "links")).groupBy("node").agg(F.sum("links").alias("links"))
    edges = links.select(F.col("node").alias("u"), F.col("other").alias("v")).union(exact.where("other is not null").select("node", "other"))
    roots = common.components(edges, "nnd-cc").withColumnRenamed("u", "node")
    named = common.saved(nodes.select("node", "low", "weight").join(counts, "node", "left").join(roots, "node", "left").select("node", "low", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"), F.coalesce("root", "node").alias("root")), "nnd-named")
    low = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = named.join(low, "root").select("node", "n_links", "component_id")
    able = able.select("vec_id", F.xxhash64(F.lit(SEED), "group", "unit").alias("node")).join(named, "node").select("vec_id", "n_links", "component_id")
    return able.union(out)


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(common.table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


#: The same by comparing all pairs of a label.
OP4_SQL = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
 WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS id, vec_id AS root FROM embeddings UNION SELECT r.id, l.w FROM r JOIN l ON r.root = l.u),
c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.u = e.vec_id)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept FROM embeddings e JOIN c ON c.id = e.vec_id"""
