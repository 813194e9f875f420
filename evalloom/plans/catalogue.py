"""Registered queries: each binds an operator to the test tables and runs over whole tables; SQL says the same to DuckDB."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.functions import encoding, prompts, scalars, scanner, textops
from evalloom.operators import batches, constraints, labels, leaves, paired, permute, ranged, records, resample, sequence, stats, strata
from evalloom.plans import bundle, evaluate, prepared, study
from evalloom.sources import landing, publish

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

CLASSES = ["click", "error", "purchase", "signup", "view"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits, whole numbers as longs."""
    kinds = {"double": lambda c: r6(c), "float": lambda c: r6(F.col(c).cast("double")), "int": lambda c: F.col(c).cast("long")}
    return df.select(*[(kinds[t](c) if t in kinds else F.col(c)).alias(c) for c, t in df.dtypes])


# Label sets: event types of a user's day against those of the day before.


def label_sets(spark: SparkSession, d: str) -> DataFrame:
    day = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.collect_set("event_type").alias("gold"))
    before = day.select("user_id", F.date_add("day", 1).alias("day"), F.col("gold").alias("pred"))
    return day.join(before, ["user_id", "day"])


_SETS = """WITH s AS (SELECT DISTINCT user_id, ts::DATE AS d, event_type AS t FROM events),
days AS (SELECT DISTINCT user_id, d FROM s),
p AS (SELECT a.user_id, a.d FROM days a JOIN days b ON a.user_id = b.user_id AND b.d = (a.d - INTERVAL 1 DAY)::DATE),
g AS (SELECT s.user_id, s.d, s.t FROM s JOIN p ON s.user_id = p.user_id AND s.d = p.d),
q AS (SELECT p.user_id, p.d, s.t FROM p JOIN s ON s.user_id = p.user_id AND s.d = (p.d - INTERVAL 1 DAY)::DATE),
cls AS (SELECT unnest(['click','error','purchase','signup','view']) AS t),
hit AS (SELECT g.user_id, g.d, g.t FROM g JOIN q ON g.user_id = q.user_id AND g.d = q.d AND g.t = q.t),
prf AS (SELECT cls.t AS class, (SELECT count(*) FROM hit WHERE hit.t = cls.t) AS tp,
 (SELECT count(*) FROM q WHERE q.t = cls.t) AS np, (SELECT count(*) FROM g WHERE g.t = cls.t) AS ng FROM cls)
"""


@query(_SETS + """SELECT class, tp::BIGINT AS tp, (np - tp)::BIGINT AS fp, (ng - tp)::BIGINT AS fn,
round(CASE WHEN np > 0 THEN tp::DOUBLE / np ELSE 0 END, 6) AS "precision", round(CASE WHEN ng > 0 THEN tp::DOUBLE / ng ELSE 0 END, 6) AS recall,
round(CASE WHEN np + ng > 0 THEN 2.0::DOUBLE * tp / (np + ng) ELSE 0 END, 6) AS f1 FROM prf""")
def per_class_prf(spark, d):
    return rounded(labels.per_class_prf(label_sets(spark, d), "pred", "gold", CLASSES, []))


@query(_SETS + """, eq AS (SELECT p.user_id, p.d, (SELECT count(*) FROM hit h WHERE h.user_id = p.user_id AND h.d = p.d) AS nh,
 (SELECT count(*) FROM g WHERE g.user_id = p.user_id AND g.d = p.d) AS ng, (SELECT count(*) FROM q WHERE q.user_id = p.user_id AND q.d = p.d) AS nq FROM p)
SELECT round((SELECT avg((nh = ng AND nh = nq)::INT) FROM eq), 6) AS exact_match,
round((SELECT 2.0::DOUBLE * sum(tp) / (sum(np) + sum(ng)) FROM prf), 6) AS micro_f1,
round((SELECT avg(CASE WHEN np + ng > 0 THEN 2.0::DOUBLE * tp / (np + ng) ELSE 0 END) FROM prf), 6) AS macro_f1""")
def micro_macro_exact(spark, d):
    return rounded(labels.headline(label_sets(spark, d), "pred", "gold", CLASSES, []))


# Paired cells: part by return flag (condition) and line status (repeat); outcome: quantity above 40.


def cells(spark: SparkSession, d: str, outcome: str = "l_quantity > 40") -> DataFrame:
    li = table(spark, d, "lineitem").select("l_partkey", "l_returnflag", "l_linestatus", F.expr(outcome).cast("double").alias("outcome"))
    return paired.complete_units(li, "l_partkey", ["l_returnflag", "l_linestatus"], 6)


def grid(spark: SparkSession, d: str, outcome: str = "l_quantity > 40") -> DataFrame:
    return paired.paired_grid(cells(spark, d, outcome), "l_partkey", "l_linestatus", "l_returnflag", ["A", "N", "R"], "outcome")


def _cells_sql(outcome: str = "l_quantity > 40", name: str = "") -> str:
    return f"""c0{name} AS (SELECT l_partkey AS u, l_returnflag AS f, l_linestatus AS s, avg(({outcome})::INT::DOUBLE) AS v FROM lineitem GROUP BY 1, 2, 3),
c{name} AS (SELECT * FROM c0{name} WHERE u IN (SELECT u FROM c0{name} GROUP BY u HAVING count(*) = 6)),
w{name} AS (SELECT u, s, max(v) FILTER (f = 'A') AS a, max(v) FILTER (f = 'N') AS n, max(v) FILTER (f = 'R') AS r FROM c{name} GROUP BY u, s)"""


@query(f"WITH {_cells_sql()}, du AS (SELECT u, avg(a - n) AS x FROM w GROUP BY u) SELECT round(avg(x), 6) AS point, count(*)::BIGINT AS n_units FROM du")
def paired_contrast(spark, d):
    return rounded(paired.contrast(paired.unit_differences(grid(spark, d), "l_partkey", "A", "N")))


@query("""WITH k AS (SELECT DISTINCT l_partkey, l_returnflag, l_linestatus FROM lineitem)
SELECT count(*)::BIGINT AS "rows", count(*)::BIGINT AS cells,
(count(DISTINCT l_partkey) * count(DISTINCT l_returnflag) * count(DISTINCT l_linestatus))::BIGINT AS expected,
count(*) = count(DISTINCT l_partkey) * count(DISTINCT l_returnflag) * count(DISTINCT l_linestatus) AS complete FROM k""")
def grid_completeness(spark, d):
    keys = ["l_partkey", "l_returnflag", "l_linestatus"]
    return constraints.grid_is_complete(table(spark, d, "lineitem").select(*keys).distinct(), keys)


@query("""WITH s AS (SELECT c.c_mktsegment AS seg, o.o_orderstatus AS st, o.o_orderpriority AS pr FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
g AS (SELECT * FROM (SELECT DISTINCT seg FROM s) CROSS JOIN (SELECT DISTINCT st FROM s) CROSS JOIN (SELECT DISTINCT pr FROM s))
SELECT g.seg AS c_mktsegment, g.st AS o_orderstatus, g.pr AS o_orderpriority, count(s.seg)::BIGINT AS n
FROM g LEFT JOIN s ON g.seg = s.seg AND g.st = s.st AND g.pr = s.pr GROUP BY 1, 2, 3 HAVING count(s.seg) <> 1""")
def grid_gaps(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rounded(constraints.grid_gaps(rows, [["c_mktsegment"], ["o_orderstatus"], ["o_orderpriority"]]))


@query("""WITH r AS (SELECT l_returnflag, l_linestatus, avg((l_quantity > 40)::INT::DOUBLE) AS v FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, count(*)::BIGINT AS n FROM r GROUP BY 1""")
def repeat_mean_sd(spark, d):
    one = stats.rate(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], F.col("l_quantity") > 40)
    return rounded(stats.repeat_mean_sd(one, ["l_returnflag"], "rate"))


@query("""SELECT c_mktsegment, quantile_disc(c_acctbal, 0.5) AS p50, quantile_disc(c_acctbal, 0.9) AS p90, quantile_disc(c_acctbal, 0.95) AS p95,
quantile_disc(c_acctbal, 0.99) AS p99, max(c_acctbal) AS max, count(*)::BIGINT AS n FROM customer GROUP BY 1""")
def nearest_rank(spark, d):
    return stats.nearest_rank(table(spark, d, "customer"), ["c_mktsegment"], "c_acctbal")


@query("""WITH r AS (SELECT c_mktsegment AS g, c_acctbal AS v, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) AS k, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)
SELECT g AS c_mktsegment, max(v) FILTER (k = round_even(0.5::DOUBLE * (n - 1), 0) + 1) AS p50, max(v) FILTER (k = round_even(0.9::DOUBLE * (n - 1), 0) + 1) AS p90,
max(v) FILTER (k = round_even(0.95::DOUBLE * (n - 1), 0) + 1) AS p95, max(v) FILTER (k = round_even(0.99::DOUBLE * (n - 1), 0) + 1) AS p99, max(v) AS max, max(n)::BIGINT AS n FROM r GROUP BY 1""")
def nearest_index(spark, d):
    return stats.nearest_index(table(spark, d, "customer"), ["c_mktsegment"], "c_acctbal")


@query("""WITH k AS (SELECT floor(l_extendedprice) AS v, sum(l_quantity)::BIGINT AS k FROM lineitem GROUP BY 1),
r AS (SELECT v, sum(k) OVER (ORDER BY v) AS c, (SELECT sum(k) FROM k) AS n FROM k)
SELECT min(v) FILTER (c >= ceil(0.5::DOUBLE * n))::BIGINT AS p50, min(v) FILTER (c >= ceil(n * 90 / 100.0::DOUBLE))::BIGINT AS p90, min(v) FILTER (c >= ceil(n * 95 / 100.0::DOUBLE))::BIGINT AS p95,
min(v) FILTER (c >= ceil(n * 99 / 100.0::DOUBLE))::BIGINT AS p99, max(v)::BIGINT AS max, max(n)::BIGINT AS n FROM r""")
def weighted_nearest_rank(spark, d):
    rows = table(spark, d, "lineitem").select(F.floor("l_extendedprice").alias("v"), F.col("l_quantity").cast("long").alias("k"))
    return rounded(stats.nearest_rank(rows, [], "v", weight=F.col("k")))


@query("SELECT o_orderstatus, o_orderpriority, count(*)::BIGINT AS n, grouping(o_orderstatus, o_orderpriority)::BIGINT AS level FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def margin_counts(spark, d):
    return rounded(stats.margins(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority"))


@query("""SELECT o_orderpriority, (count(*) FILTER (o_orderstatus = 'F'))::BIGINT AS "F", (count(*) FILTER (o_orderstatus = 'O'))::BIGINT AS "O", (count(*) FILTER (o_orderstatus = 'P'))::BIGINT AS "P" FROM orders GROUP BY 1""")
def category_crosstab(spark, d):
    return stats.crosstab(table(spark, d, "orders"), ["o_orderpriority"], "o_orderstatus", ["F", "O", "P"])


@query("""WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p,
row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events)
SELECT user_id, event_type, min(p)::BIGINT AS first_pos, count(*)::BIGINT AS run_length FROM r GROUP BY user_id, event_type, p - k""")
def run_length(spark, d):
    return rounded(sequence.run_lengths(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], ["event_type"]))


_BATCH = """WITH r AS (SELECT l_quantity::BIGINT AS len, (l_linenumber % 5)::BIGINT AS prompt, floor((row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1) / 2) AS b FROM lineitem),
w AS (SELECT b, least(max(len), 30) AS width FROM r GROUP BY b)
"""


@query(_BATCH + "SELECT sum(least(len, width - 1))::BIGINT AS forwarded, sum(greatest(0, least(len, width) - prompt))::BIGINT AS supervised FROM r JOIN w USING (b)")
def micro_batch_tokens(spark, d):
    li = table(spark, d, "lineitem").withColumn("len", F.col("l_quantity").cast("long")).withColumn("prompt", (F.col("l_linenumber") % 5).cast("long"))
    b = sequence.micro_batches(li, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"], 2)
    one = sequence.forwarded_tokens(b, "len", 30).withColumnRenamed("tokens", "forwarded")
    return one.crossJoin(sequence.supervised_tokens(b, "len", "prompt", 30).withColumnRenamed("tokens", "supervised"))


@query("""SELECT i::BIGINT AS position, CASE WHEN floor((i + 1) * 0.2::DOUBLE) > floor(i * 0.2::DOUBLE) THEN 'aux' ELSE 'main' END AS pool,
(CASE WHEN floor((i + 1) * 0.2::DOUBLE) > floor(i * 0.2::DOUBLE) THEN floor(i * 0.2::DOUBLE) ELSE i - floor(i * 0.2::DOUBLE) END)::BIGINT AS ordinal
FROM range((SELECT count(*) FROM orders)) t(i)""")
def interleave(spark, d):
    return rounded(sequence.interleave(spark, table(spark, d, "orders").count(), 0.2))


def _stream_sql(total: str, ratio: str, seed: int) -> str:
    """Rows (position, pool, ordinal, n, y): parts are the main pool, suppliers the auxiliary one."""
    rows = f"""SELECT position, pool, ordinal, n, ordinal % n AS x, '{seed}:' || pool || ':' || (ordinal // n) AS key FROM
 (SELECT i::BIGINT AS position, CASE WHEN floor((i + 1) * {ratio}::DOUBLE) > floor(i * {ratio}::DOUBLE) THEN 'aux' ELSE 'main' END AS pool, floor(i * {ratio}::DOUBLE)::BIGINT AS aux,
 (CASE WHEN pool = 'aux' THEN aux ELSE i - aux END)::BIGINT AS ordinal FROM range(({total})::BIGINT) t(i)) JOIN (SELECT 'main' AS pool, count(*) AS n FROM part UNION ALL SELECT 'aux', count(*) FROM supplier) USING (pool)"""
    return permute.sql_permuted(rows)


@query(f"SELECT position, pool, y AS index FROM ({_stream_sql('SELECT 3 * count(*) FROM part', '0.2', 42)})")
def mixture_stream(spark, d):
    n, m = table(spark, d, "part").count(), table(spark, d, "supplier").count()
    return sequence.mixture_stream(spark, n, m, 0.2, 3 * n, 42)


_ITEMS = """m AS (SELECT 'main' AS pool, row_number() OVER (ORDER BY p_partkey) - 1 AS y, p_name AS item, NULL AS other FROM part),
a AS (SELECT 'aux' AS pool, row_number() OVER (ORDER BY s_suppkey) - 1 AS y, s_name AS item, CASE WHEN s_acctbal < 5000 THEN 'control of ' || s_name END AS other FROM supplier)"""


@query(f"""WITH st AS ({_stream_sql("SELECT count(*) FROM lineitem", "0.125", 11)}), {_ITEMS}
SELECT position, pool, y AS index, CASE WHEN other IS NOT NULL AND ordinal >= 100 + y THEN other ELSE item END AS item FROM st JOIN (FROM m UNION ALL FROM a) USING (pool, y)""")
def condition_stream(spark, d):
    """A stream as long as lineitem over parts and suppliers; poor suppliers' items give way to a control from an ordinal on."""
    part = ranged.numbered(ranged.ranged(table(spark, d, "part").select("p_partkey", "p_name"), [], ["p_partkey"]), [], "index").select("index", F.col("p_name").alias("item"))
    sup = ranged.numbered(ranged.ranged(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"), [], ["s_suppkey"]), [], "index")
    other = sup.where("s_acctbal < 5000").select((F.lit(100) + F.col("index")).alias("from_ordinal"), "index", F.concat(F.lit("control of "), "s_name").alias("item"))
    mixed = permute.mixture(spark.range(table(spark, d, "lineitem").count()).select(F.col("id").alias("position")), part.count(), sup.count(), 0.125, 11)
    return permute.condition_stream(mixed, part, sup.select("index", F.col("s_name").alias("item")), other).select("position", "pool", "index", "item")


@query(f"""WITH {_cells_sql()}, z AS (SELECT a > 0 AS x, n > 0 AS y FROM w WHERE s = 'F'),
t AS (SELECT count(*) FILTER (x AND y) AS b, count(*) FILTER (NOT x AND NOT y) AS ne, count(*) FILTER (NOT x AND y) AS g, count(*) FILTER (x AND NOT y) AS l, count(*) AS n FROM z)
SELECT b::BIGINT AS both, ne::BIGINT AS neither, g::BIGINT AS gained, l::BIGINT AS lost, n::BIGINT AS n, (g - l)::BIGINT AS net, round((g - l) * 100.0::DOUBLE / n, 6) AS net_percent FROM t""")
def transition_2x2(spark, d):
    return rounded(paired.transition(grid(spark, d).where("l_linestatus = 'F'"), "A", "N"))


@query(f"WITH {_cells_sql()}, z AS (SELECT s, avg((a <> n)::INT::DOUBLE) AS d FROM w GROUP BY s) SELECT round(min(d), 6) AS low, round(max(d), 6) AS high, count(*)::BIGINT AS repeats FROM z")
def discordance(spark, d):
    return rounded(paired.discordance(grid(spark, d), "l_linestatus", "A", "N"))


_BINS = {"size_small": "p_size < 10", "size_mid": "p_size between 10 and 29", "size_large": "p_size >= 30", "price_low": "p_retailprice < 950", "price_high": "p_retailprice >= 950"}
_BIN_SQL = " UNION ALL ".join(f"SELECT '{k}' AS stratum, p_partkey FROM part WHERE {v}" for k, v in _BINS.items())


@query(f"WITH {_cells_sql()}, b AS ({_BIN_SQL}), m AS (SELECT stratum, u, avg(v) AS m FROM c JOIN b ON c.u = b.p_partkey WHERE f = 'A' GROUP BY 1, 2) SELECT stratum, round(avg(m), 6) AS mean FROM m GROUP BY 1")
def strata_baseline(spark, d):
    rows = cells(spark, d).where("l_returnflag = 'A'").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rounded(stats.mean_of_means(strata.stratify(rows, {k: F.expr(v) for k, v in _BINS.items()}), ["stratum"], ["l_partkey"], F.col("outcome")))


@query(f"""WITH {_cells_sql()} SELECT u AS l_partkey, f AS l_returnflag, bool_and(v > 0) AS "all", bool_or(v > 0) AS "any", count(*) FILTER (v > 0) >= 2 AS at_least FROM c GROUP BY 1, 2""")
def all_any_atleast(spark, d):
    return stats.over_repeats(cells(spark, d), ["l_partkey", "l_returnflag"], F.col("outcome") > 0)


@query("""WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1997), b AS (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1998)
SELECT (SELECT count(*) FROM a)::BIGINT AS first_groups, (SELECT count(*) FROM b)::BIGINT AS second_groups, (SELECT count(*) FROM a JOIN b USING (o_custkey))::BIGINT AS shared,
(SELECT count(*) FROM orders WHERE year(o_orderdate) = 1998 AND o_custkey IN (SELECT o_custkey FROM a))::BIGINT AS second_rows_shared""")
def group_overlap(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("y")).where("y in (1997, 1998)")
    per = o.groupBy("o_custkey").agg(F.count_if(F.col("y") == 1997).alias("a"), F.count_if(F.col("y") == 1998).alias("b"))
    return per.agg(F.count_if(F.col("a") > 0).alias("first_groups"), F.count_if(F.col("b") > 0).alias("second_groups"), F.count_if((F.col("a") > 0) & (F.col("b") > 0)).alias("shared"), F.coalesce(F.sum(F.when(F.col("a") > 0, F.col("b"))), F.lit(0)).alias("second_rows_shared"))


@query("WITH k AS (SELECT o_custkey, count(*) AS size FROM orders GROUP BY 1) SELECT size::BIGINT AS size, count(*)::BIGINT AS keys FROM k GROUP BY 1")
def count_of_counts(spark, d):
    return stats.count_of_counts(table(spark, d, "orders"), "o_custkey")


@query(f"""WITH {_cells_sql()}, {_cells_sql("l_discount > 0.05", "2")}, x AS (SELECT u, avg(a - n) AS x FROM w GROUP BY u), y AS (SELECT u, avg(a - n) AS y FROM w2 GROUP BY u)
SELECT round(avg(x - y), 6) AS point, count(*)::BIGINT AS n_units FROM x JOIN y USING (u)""")
def diff_in_diff(spark, d):
    one, two = (paired.unit_differences(grid(spark, d, o), "l_partkey", "A", "N") for o in ("l_quantity > 40", "l_discount > 0.05D"))
    return rounded(paired.contrast(paired.difference_in_differences(one, two, "l_partkey")))


@query(f"WITH {_cells_sql()}, du AS (SELECT u, avg(a - n) AS x FROM w GROUP BY u) SELECT round(avg(x), 6) AS point, count(*)::BIGINT AS n_units FROM du")
def bootstrap_point(spark, d):
    return bootstrap_ci(spark, d).select("point", "n_units")


_INTERVAL = """quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high, round(least(1.0::DOUBLE, 2 * least(avg((v <= 0)::INT), avg((v >= 0)::INT))), 6) AS p_value"""


@query(f"""WITH {_cells_sql()}, u AS (SELECT row_number() OVER (ORDER BY u::VARCHAR) - 1 AS spot, x FROM (SELECT u, avg(a - n) AS x FROM w GROUP BY u)),
draws AS ({resample.sql_drawn(42, 10_000, "SELECT count(*) FROM u")}), m AS (SELECT r, avg(x) AS v FROM draws JOIN u USING (spot) GROUP BY r),
i AS (SELECT round({_INTERVAL} FROM m) SELECT (SELECT round(avg(x), 6) FROM u) AS point, low, high, p_value, (SELECT count(*) FROM u)::BIGINT AS n_units, low > 0 OR high < 0 AS excludes_zero FROM i""")
def bootstrap_ci(spark, d):
    diff = paired.unit_differences(grid(spark, d), "l_partkey", "A", "N")
    return rounded(resample.mean_intervals(diff, [], "l_partkey", "difference", draws=10_000))


@query(f"""WITH o AS (SELECT o_custkey, o_orderpriority AS g, avg(o_totalprice) - 150000 AS x FROM orders GROUP BY 1, 2),
u AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY o_custkey::VARCHAR) - 1 AS spot, count(*) OVER (PARTITION BY g) AS size, x FROM o),
draws AS (SELECT g, r, ((v * size::UBIGINT) >> 32)::BIGINT AS spot FROM ({resample.sql_mixed(f"(SELECT g, size, r, w, k FROM ({resample.sql_mixed('range(300) t(r)', f'{int(resample.root(7, 0)[0])} + r', 'w')}), (SELECT DISTINCT g, size FROM u), LATERAL range(size) s(k))", "w + k::UBIGINT", "v")})),
m AS (SELECT g, r, avg(x) AS v FROM draws JOIN u USING (g, spot) GROUP BY g, r),
i AS (SELECT g, round({_INTERVAL} FROM m GROUP BY g), q AS (SELECT g, round(avg(x), 6) AS point, count(*)::BIGINT AS n_units FROM u GROUP BY g)
SELECT g AS o_orderpriority, point, low, high, p_value, n_units, low > 0 OR high < 0 AS excludes_zero FROM i JOIN q USING (g)""")
def bootstrap_groups(spark, d):
    """Customers' mean order price against 150,000 within each priority: contrasts of thousands of units."""
    units = table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg((F.avg("o_totalprice") - 150_000).alias("x"))
    return rounded(resample.mean_intervals(units, ["o_orderpriority"], "o_custkey", "x", draws=300, seed=7))


@query(_SETS + f""", side AS (SELECT user_id, d, CASE WHEN day(d) <= 15 THEN 'b' ELSE 'a' END AS c FROM p),
u AS (SELECT user_id, row_number() OVER (ORDER BY user_id::VARCHAR) - 1 AS spot FROM (SELECT DISTINCT user_id FROM p)),
f AS (SELECT user_id, d, t, 2 AS tp2, 0 AS one FROM hit UNION ALL SELECT user_id, d, t, 0, 1 FROM g UNION ALL SELECT user_id, d, t, 0, 1 FROM q),
cell AS (SELECT spot, c, t, sum(tp2) AS tp2, sum(one) AS n FROM f JOIN side USING (user_id, d) JOIN u USING (user_id) GROUP BY 1, 2, 3),
draws AS ({resample.sql_drawn(45, 2_000, "SELECT count(*) FROM u")}), k AS (SELECT r, spot, count(*) AS k FROM draws GROUP BY 1, 2),
fs AS (SELECT r, c, t, sum(k * tp2) / sum(k * n) AS f1 FROM k JOIN cell USING (spot) GROUP BY 1, 2, 3),
m AS (SELECT r, coalesce(sum(f1) FILTER (c = 'a'), 0) / 5.0::DOUBLE - coalesce(sum(f1) FILTER (c = 'b'), 0) / 5.0::DOUBLE AS v FROM fs GROUP BY r),
point AS (SELECT round(sum(CASE WHEN c = 'a' THEN f1 ELSE -f1 END) / 5.0::DOUBLE, 6) AS point FROM (SELECT c, t, sum(tp2) / sum(n) AS f1 FROM cell GROUP BY 1, 2)),
i AS (SELECT round({_INTERVAL} FROM m) SELECT (SELECT point FROM point) AS point, low, high, p_value, (SELECT count(*) FROM u)::BIGINT AS n_units, low > 0 OR high < 0 AS excludes_zero FROM i""")
def macro_f1_bootstrap(spark, d):
    sets = label_sets(spark, d).withColumn("half", F.when(F.dayofmonth("day") <= 15, "first").otherwise("second")).withColumn("one", F.lit(1))
    got = rounded(resample.macro_f1_interval(sets, "user_id", "one", "half", "second", "first", "pred", "gold", CLASSES, draws=2_000))
    # the interval that is shown decides, as in the SQL: a bound that rounds to zero doesn't exclude it
    return got.withColumn("excludes_zero", (F.col("low") > 0) | (F.col("high") < 0))


@query("""SELECT lang, (count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)))::BIGINT AS labelled, (count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)))::BIGINT AS unlabelled FROM documents GROUP BY 1""")
def semi_anti_population(spark, d):
    docs, lab = table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels").select("doc_id")
    both = docs.join(lab, "doc_id", "left_semi").withColumn("k", F.lit(1)).unionAll(docs.join(lab, "doc_id", "left_anti").withColumn("k", F.lit(0)))
    return both.groupBy("lang").agg(F.count_if(F.col("k") == 1).alias("labelled"), F.count_if(F.col("k") == 0).alias("unlabelled"))


@query("""WITH a AS (SELECT l_partkey, l_suppkey FROM lineitem), b AS (SELECT l_partkey, CASE WHEN l_linenumber = 1 AND l_quantity = 50 THEN -1 ELSE l_suppkey END AS l_suppkey FROM lineitem)
SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'right' AS side FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def bag_equality(spark, d):
    li = table(spark, d, "lineitem")
    changed = F.when((F.col("l_linenumber") == 1) & (F.col("l_quantity") == 50), F.lit(-1).cast("long")).otherwise(F.col("l_suppkey"))
    return constraints.bag_difference(li.select("l_partkey", "l_suppkey"), li.select("l_partkey", changed.alias("l_suppkey")))


@query("""WITH e AS (SELECT p_partkey AS k, p_brand AS t FROM part WHERE p_size < 45), a AS (SELECT p_partkey AS k, CASE WHEN p_size = 7 THEN 'other' ELSE p_brand END AS t FROM part WHERE p_size > 2)
SELECT coalesce(e.k, a.k) AS p_partkey, CASE WHEN a.k IS NULL THEN 'missing' WHEN e.k IS NULL THEN 'unexpected' ELSE 'mismatched' END AS problem FROM e FULL JOIN a ON e.k = a.k WHERE a.k IS NULL OR e.k IS NULL OR e.t <> a.t""")
def coverage_diff(spark, d):
    p = table(spark, d, "part")
    other = F.when(F.col("p_size") == 7, "other").otherwise(F.col("p_brand"))
    return constraints.coverage(p.where("p_size < 45").select("p_partkey", F.col("p_brand").alias("t")), p.where("p_size > 2").select("p_partkey", other.alias("t")), "p_partkey", "t")


_NAMES = {"1 urgent": "urgent", "2 high": "high", "3 Medium": "medium", "not specified 4": "none", "4 not specified": "none"}


@query("""WITH k AS (SELECT o_orderkey, regexp_replace(lower(o_orderpriority), '[^a-z0-9]', '', 'g') AS key FROM orders)
SELECT o_orderkey, key, CASE key WHEN '1urgent' THEN 'urgent' WHEN '2high' THEN 'high' WHEN '3medium' THEN 'medium' WHEN '4notspecified' THEN 'none' END AS label FROM k""")
def label_normalise(spark, d):
    p = F.col("o_orderpriority")
    return table(spark, d, "orders").select("o_orderkey", scalars.label_key(p).alias("key"), scalars.normalise_label(p, _NAMES).alias("label"))


@query("""SELECT o_orderkey, 'recognized_array' AS status, list_filter(['F', 'O', 'P'], lambda x: x = o_orderstatus) AS pred, 2::BIGINT AS n_emitted, 1::BIGINT AS rejected FROM orders""")
def last_json_list(spark, d):
    o = table(spark, d, "orders")
    text = F.concat(F.lit('notes [1, 2] and ["O"] then: ["'), F.col("o_orderstatus"), F.lit('", "'), F.col("o_orderpriority"), F.lit('"] end ['))
    got = o.select("o_orderkey", textops.parsed_labels(text, ["F", "O", "P"], {}).alias("g"))
    return got.select("o_orderkey", "g.status", "g.pred", "g.n_emitted", "g.rejected")


@query("""SELECT doc_id, md5(rtrim_nl) AS code_md5, status FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'go_block' ELSE 'fenced_block' END AS status, 'x := ' || doc_id AS rtrim_nl FROM documents)""")
def fence_extract(spark, d):
    docs = table(spark, d, "documents")
    tag = F.when(F.col("doc_id") % 2 == 0, "go").otherwise("")
    text = F.concat(F.col("text"), F.lit("\n```"), tag, F.lit("\nx := "), F.col("doc_id").cast("string"), F.lit("\n```\nend"))
    got = docs.select("doc_id", textops.fenced_code(text).alias("g"))
    return got.select("doc_id", F.md5("g.code").alias("code_md5"), F.col("g.status").alias("status"))


@query("""WITH s AS (SELECT user_id, ts::DATE AS d, list_sort(list(DISTINCT event_type)) AS l FROM events GROUP BY 1, 2),
t AS (SELECT a.user_id, a.d, a.l AS target, b.l AS before, c.l AS after FROM s a JOIN s b ON a.user_id = b.user_id AND b.d = (a.d - INTERVAL 1 DAY)::DATE JOIN s c ON a.user_id = c.user_id AND c.d = (a.d - INTERVAL 2 DAY)::DATE),
f AS (SELECT *, NOT list_has_any(target, after) AS fixed, len(list_filter(after, lambda x: NOT list_contains(before, x))) > 0 AS worse FROM t)
SELECT CASE WHEN fixed AND NOT worse THEN 'A' WHEN fixed THEN 'B' WHEN NOT worse THEN 'C' ELSE 'D' END AS category, count(*)::BIGINT AS n FROM f GROUP BY 1""")
def decision_table(spark, d):
    s = label_sets(spark, d)
    two = s.select("user_id", F.date_add("day", 1).alias("day"), F.col("pred").alias("after"))
    got = s.join(two, ["user_id", "day"]).select(textops.outcome(F.lit(True), F.col("gold"), F.col("pred"), F.col("after")).alias("o"))
    return got.groupBy("o.category").agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT year(o_orderdate)::BIGINT AS y, avg(o_totalprice) AS mean FROM orders GROUP BY 1)
SELECT y, round(mean, 6) AS mean, round((mean / (SELECT mean FROM m WHERE y = 1997) - 1) * 100, 6) AS over_percent FROM m""")
def baseline_ratio(spark, d):
    o = table(spark, d, "orders").select(F.year("o_orderdate").cast("long").alias("y"), "o_totalprice")
    return rounded(stats.ratio_to_baseline(o, "y", "o_totalprice", 1997))


@query("""WITH m AS (SELECT o_orderpriority AS p, year(o_orderdate) AS y, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2), b AS (SELECT p, v AS base FROM m WHERE y = 1997)
SELECT p AS o_orderpriority, round(ceil(max(abs(v - base) / base * 100) * 10) / 10, 6) AS variation_percent FROM m JOIN b USING (p) GROUP BY 1""")
def seed_variation(spark, d):
    m = table(spark, d, "orders").groupBy("o_orderpriority", F.year("o_orderdate").alias("y")).agg(F.avg("o_totalprice").alias("v"))
    return rounded(stats.seed_variation(m, ["o_orderpriority"], "y", "v", 1997))


@query("""WITH m AS (SELECT o_orderstatus AS s, o_orderpriority AS p, avg(o_totalprice) AS mean FROM orders GROUP BY 1, 2)
SELECT s AS o_orderstatus, p AS o_orderpriority, round(mean, 6) AS mean, round(mean / sum(mean) OVER (PARTITION BY s), 6) AS share FROM m""")
def decomposition_shares(spark, d):
    return rounded(stats.shares(table(spark, d, "orders"), ["o_orderstatus"], "o_orderpriority", "o_totalprice"))


@query("""WITH t AS (SELECT l_returnflag AS c, sum(l_quantity)::BIGINT AS tokens FROM lineitem GROUP BY 1), r AS (SELECT tokens AS ref FROM t WHERE c = 'A')
SELECT c AS l_returnflag, tokens, round((tokens - ref)::DOUBLE / ref, 6) AS delta, abs((tokens - ref)::DOUBLE / ref) > 0.05 AS exceeds FROM t, r""")
def budget_guard(spark, d):
    t = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.sum("l_quantity").cast("long").alias("tokens"))
    return rounded(stats.budget_guard(t, "l_returnflag", "tokens", "A"))


@query("""WITH u AS (SELECT d.doc_id, d.n_chars FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)), l AS (SELECT n_chars AS v, min(doc_id) AS k FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY 1),
lo AS (SELECT u.doc_id, l.v, l.k FROM u ASOF LEFT JOIN l ON u.n_chars >= l.v), hi AS (SELECT u.doc_id, l.v, l.k FROM u ASOF LEFT JOIN l ON u.n_chars <= l.v),
b AS (SELECT u.doc_id, abs(lo.v - u.n_chars) AS a, lo.k AS ka, abs(hi.v - u.n_chars) AS b, hi.k AS kb FROM u JOIN lo USING (doc_id) JOIN hi USING (doc_id))
SELECT doc_id, (CASE WHEN b IS NULL OR a < b OR (a = b AND ka < kb) THEN ka ELSE kb END)::BIGINT AS nearest, (CASE WHEN b IS NULL OR a <= b THEN a ELSE b END)::BIGINT AS distance FROM b""")
def nearest_neighbour(spark, d):
    docs, lab = table(spark, d, "documents").select("doc_id", "n_chars"), table(spark, d, "labels").select("doc_id")
    right = docs.join(lab, "doc_id", "left_semi").select(F.col("doc_id").alias("key"), F.col("n_chars").alias("v"))
    return sequence.nearest(docs.join(lab, "doc_id", "left_anti"), "n_chars", right, "v", "key").select("doc_id", "nearest", "distance")


@query()
def budget_truncate(spark, d):
    docs = table(spark, d, "documents")
    lines = F.transform(F.split("text", "\n"), lambda t, i: F.struct((i % 3).alias("tier"), (i % 4).alias("depth"), t.alias("text")))
    count = lambda t: F.size(F.split(F.trim(t), r"\s+"))
    rows = docs.select("doc_id", lines.alias("lines"), F.lit(True).alias("ok"), (F.col("n_chars") / 20).cast("int").alias("budget"))
    got = sequence.delivered(rows, "ok", "lines", "budget", count)
    return got.select("doc_id", "status", F.length("summary").cast("long").alias("length"))


@query("SELECT k, count(*)::BIGINT AS n, round(sum(value), 6) AS total FROM (SELECT (props->>'$.k')::BIGINT AS k, value FROM events) GROUP BY 1")
def json_props(spark, d):
    e = table(spark, d, "events").select(F.get_json_object("props", "$.k").cast("long").alias("k"), "value")
    return e.groupBy("k").agg(F.count("*").alias("n"), r6(F.sum("value")).alias("total"))


@query("""WITH r AS (SELECT c_nationkey, c_custkey, floor(c_acctbal / 1000) AS s, row_number() OVER (PARTITION BY c_nationkey ORDER BY floor(c_acctbal / 1000) DESC, c_custkey) AS k FROM customer)
SELECT c_nationkey, c_custkey AS best_step, s::BIGINT AS best_score FROM r WHERE k = 1""")
def first_best(spark, d):
    c = table(spark, d, "customer").withColumn("s", F.floor(F.col("c_acctbal") / 1000))
    return stats.first_best(c, ["c_nationkey"], "c_custkey", "s")


@query("SELECT c_mktsegment, sha256(string_agg(k, chr(10) ORDER BY k)) AS checksum, count(*)::BIGINT AS n FROM (SELECT DISTINCT c_mktsegment, c_custkey::VARCHAR AS k FROM customer) GROUP BY 1")
def id_checksum(spark, d):
    return constraints.id_checksum(table(spark, d, "customer"), ["c_mktsegment"], "c_custkey")


_PREDICATES = {"quantity": "l_quantity > 40", "discount": "l_discount > 0.05D", "tax": "l_tax > 0.04D", "price": "l_extendedprice > 50000", "first": "l_linenumber = 1", "returned": "l_returnflag = 'R'", "open": "l_linestatus = 'O'"}


@query(" UNION ALL ".join(f"SELECT l_returnflag, '{k}' AS component, (count(*) FILTER ({v.replace('D', '::DOUBLE') if v.endswith('D') else v}))::BIGINT AS value FROM lineitem GROUP BY 1" for k, v in _PREDICATES.items()))
def wide_conditional(spark, d):
    return stats.wide_conditional(table(spark, d, "lineitem"), ["l_returnflag"], {k: F.expr(v) for k, v in _PREDICATES.items()})


@query("WITH m AS (SELECT l_linestatus, l_returnflag, avg(l_discount) AS m FROM lineitem GROUP BY 1, 2) SELECT l_linestatus, round(min(m), 6) AS low, round(max(m), 6) AS high, round(max(m) - min(m), 6) AS span FROM m GROUP BY 1")
def group_range(spark, d):
    return rounded(stats.group_range(table(spark, d, "lineitem"), ["l_linestatus"], ["l_returnflag"], F.col("l_discount")))


@query("SELECT o_custkey, count(*)::BIGINT AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return constraints.duplicate_keys(table(spark, d, "orders"), ["o_custkey"])


@query("SELECT o_custkey, count(DISTINCT o_orderstatus)::BIGINT AS splits FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def split_overlap(spark, d):
    return constraints.overlapping_splits(table(spark, d, "orders"), "o_custkey", "o_orderstatus")


@query("SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def subset_constraint(spark, d):
    return constraints.outside(table(spark, d, "customer"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("""SELECT l_orderkey, l_linenumber, unnest(list_filter([CASE WHEN NOT l_quantity < 50 THEN 'quantity' END, CASE WHEN NOT l_tax <= 0.07::DOUBLE THEN 'tax' END], lambda x: x IS NOT NULL)) AS rule FROM lineitem""")
def failing_checks(spark, d):
    return constraints.failing(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], {"quantity": F.col("l_quantity") < 50, "tax": F.col("l_tax") <= 0.07})


def _greedy_sql(by: str, key: str) -> str:
    """Starts of buckets by recursion: the next one is the first row, at most 16 on, that would pass the count or the cap."""
    return f"""WITH RECURSIVE l AS (SELECT {by} AS g, l_quantity::BIGINT AS len, row_number() OVER (PARTITION BY {by} ORDER BY l_quantity, {key}) - 1 AS i, count(*) OVER (PARTITION BY {by}) AS n FROM lineitem),
lead16 AS (SELECT g, i, n, list(len) OVER (PARTITION BY g ORDER BY i ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS ahead FROM l),
nx AS (SELECT g, i, n, i + coalesce(list_min(list_filter(range(1, len(ahead)::BIGINT), lambda k: (k + 1) * ahead[k + 1] > 400)), len(ahead)) AS nxt FROM lead16),
b AS (SELECT g, i, nxt, n, 0 AS bucket FROM nx WHERE i = 0 UNION ALL SELECT nx.g, nx.i, nx.nxt, nx.n, b.bucket + 1 FROM b JOIN nx ON nx.g = b.g AND nx.i = b.nxt)
SELECT b.g, b.bucket::BIGINT AS bucket, (b.nxt - b.i)::BIGINT AS n, l.len AS longest FROM b JOIN l ON l.g = b.g AND l.i = b.nxt - 1"""


def _bucketed_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_suppkey", F.col("l_quantity").cast("long").alias("len"), F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("key"))


@query("SELECT g AS l_suppkey, bucket, n, longest FROM (" + _greedy_sql("l_suppkey", "l_orderkey, l_linenumber, l_partkey") + ")")
def greedy_buckets(spark, d):
    return sequence.greedy_buckets(_bucketed_lines(spark, d), ["l_suppkey"], "len", "key", 16, 400).groupBy("l_suppkey", "bucket").agg(F.count("*").alias("n"), F.max("len").alias("longest"))


@query("SELECT bucket, n, longest FROM (" + _greedy_sql("0", "l_orderkey, l_linenumber, l_partkey") + ")")
def greedy_buckets_whole(spark, d):
    """One group: all of lineitem."""
    return sequence.greedy_buckets(_bucketed_lines(spark, d), [], "len", "key", 16, 400).groupBy("bucket").agg(F.count("*").alias("n"), F.max("len").alias("longest"))


@query("""SELECT i::BIGINT AS step, round(CASE WHEN i < 60 THEN i / 60.0::DOUBLE ELSE 0.1::DOUBLE + 0.9::DOUBLE * 0.5::DOUBLE * (1 + cos(pi() * least(1.0::DOUBLE, (i - 60) / 540.0::DOUBLE))) END, 6) AS multiplier FROM range(600) t(i)""")
def learning_rate_schedule(spark, d):
    return spark.range(600).select(F.col("id").alias("step"), r6(sequence.warmup_cosine(F.col("id"), 600, 60, 0.1)).alias("multiplier"))


# Sources made from parts: what the scanner must see follows from the part's numbers.

_PIECES = [
    # (selector, its modulus, pieces by remainder: text, text without comments, flag)
    ("p_size", 5, {0: ("//go:build linux", "", "build_tags"), 1: ("// +build linux", "", "build_tags"), 2: ("/* //go:build no */", "", None), 3: ("//go:builder x", "", None)}),
    ("0", 1, {0: ("package p", "package p", None)}),
    ("p_size", 7, {0: ('import "C"', 'import "C"', "cgo"), 1: ('import (\n\t"fmt"\n\tx "C"\n)', 'import (\n\t"fmt"\n\tx "C"\n)', "cgo"), 2: ('// import "C"', "", None), 3: ('var s = "import \\"C\\""', 'var s = "import \\"C\\""', None), 4: ('import "fmt"\nvar c = "C"', 'import "fmt"\nvar c = "C"', None)}),
    ("p_partkey", 7, {0: ("type T[P any] struct{}", "type T[P any] struct{}", "generics"), 1: ("type T [4]int", "type T [4]int", None), 2: ("func F[K comparable](k K) {}", "func F[K comparable](k K) {}", "generics"), 3: ("type (\n\tA int\n\tB[X, Y any] []X\n)", "type (\n\tA int\n\tB[X, Y any] []X\n)", "generics"), 4: ("func G() { a[i] = b [j] }", "func G() { a[i] = b [j] }", None), 5: ("`type R[P any] /* kept */`", "`type R[P any] /* kept */`", None)}),
    ("p_size", 4, {0: ("var u = unsafe . Pointer(nil)", "var u = unsafe . Pointer(nil)", "unsafe_ptr"), 1: ('var t = "unsafe.Pointer"', 'var t = "unsafe.Pointer"', None), 2: ("var v uintptr // x", "var v uintptr", "unsafe_ptr"), 3: ('var w = "http://a/*b" /* "c" */ + \'"\'', 'var w = "http://a/*b" + \'"\'', None)}),
    ("p_partkey", 5, {0: ("//go:embed a.txt", "", "go:embed"), 1: ("//go:embedded a", "", None), 2: ('var e = "//go:embed b"', 'var e = "//go:embed b"', None)}),
]


def _piece(which: int, sql: bool) -> list:
    quoted = lambda t: "'" + t.replace("'", "''") + "'" if t is not None else "NULL"
    if sql:
        return [f"CASE {c} % {m} " + " ".join(f"WHEN {r} THEN {quoted(x[which])}" for r, x in by.items()) + f" ELSE {'NULL' if which == 2 else quoted('')} END" for c, m, by in _PIECES]
    out = []
    for c, m, by in _PIECES:
        e = F.lit("")
        for r, x in by.items():
            e = F.when(F.expr(c) % m == r, F.lit(x[which])).otherwise(e)
        out.append(e)
    return out


@query(f"""SELECT p_partkey, list_sort(list_filter([{", ".join(_piece(2, True))}], lambda x: x IS NOT NULL)) AS flags,
trim(regexp_replace(concat_ws(chr(10), {", ".join(_piece(1, True))}, 'var n = "' || p_name || '"'), '\\s+', ' ', 'g')) AS verbatim FROM part""")
def source_scanner(spark, d):
    """Flags and text without comments of sources with strings, runes, raw strings and directives in all the wrong places."""
    code = F.concat_ws("\n", *_piece(0, False), F.concat(F.lit('var n = "'), "p_name", F.lit('" // "unsafe.Pointer"')))
    src = table(spark, d, "part").select("p_partkey", code.alias("code"))
    return src.select("p_partkey", scanner.construct_flags(F.col("code")).alias("flags"), scanner.verbatim(F.col("code")).alias("verbatim"))


@query(f"""SELECT p_partkey, len(regexp_extract_all(c, '{scanner.SQL_TOKEN.replace("'", "''")}'))::BIGINT AS n FROM (SELECT p_partkey, concat_ws(chr(10), {", ".join(_piece(0, True))}) AS c FROM part)""")
def source_tokens(spark, d):
    return table(spark, d, "part").select("p_partkey", F.size(scanner.tokens(F.concat_ws("\n", *_piece(0, False)))).cast("long").alias("n"))


# Batches that go out packed and come back in order; component scores; a registry of leaves.


def _widths(t: pa.Table) -> pa.Table:
    """A batch's width and each row's padding."""
    n = t["len"].to_numpy()
    return pa.table({"pos": t["pos"], "width": np.full(len(n), n.max()), "padding": n.max() - n, "rows": np.full(len(n), len(n))})


@query("""WITH r AS (SELECT o_orderkey AS pos, o_orderpriority AS f, floor(o_totalprice / 1000)::BIGINT AS len FROM orders), b AS (SELECT *, (row_number() OVER (PARTITION BY f ORDER BY len, pos) - 1) // 16 AS b FROM r)
SELECT pos AS o_orderkey, f AS o_orderpriority, max(len) OVER w AS width, max(len) OVER w - len AS padding, count(*) OVER w AS rows FROM b WINDOW w AS (PARTITION BY f, b)""")
def scatter_restore(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), "o_orderpriority", F.floor(F.col("o_totalprice") / 1000).cast("long").alias("len"))
    got = batches.restored(o, "pos", "o_orderpriority", "len", _widths, "width long, padding long, rows long", 16)
    return got.select(F.col("pos").alias("o_orderkey"), "o_orderpriority", "width", "padding", "rows")


@query("""WITH r AS (SELECT o_orderstatus AS s, o_orderpriority AS t, o_totalprice > 200000 AS hit FROM orders)
SELECT s AS o_orderstatus, round(coalesce(avg(hit::INT) FILTER (t = '1-URGENT'), 0), 6) AS urgent, round(coalesce(avg(hit::INT) FILTER (t = '5-LOW'), 0), 6) AS low, round(coalesce(avg(hit::INT) FILTER (t = 'none'), 0), 6) AS "none",
round((coalesce(avg(hit::INT) FILTER (t = '1-URGENT'), 0) + coalesce(avg(hit::INT) FILTER (t = '5-LOW'), 0)) / 3.0::DOUBLE, 6) AS composite FROM r GROUP BY s""")
def component_scores(spark, d):
    """Three components of a composite by order status, in one pass; one of them has no rows."""
    rows = table(spark, d, "orders").select("o_orderstatus", F.col("o_orderpriority").alias("task_type"), (F.col("o_totalprice") > 200_000).alias("hit"))
    scorers = [evaluate.Scorer(n, t, 64, evaluate.rate_of(F.col("hit"))) for n, t in (("urgent", "1-URGENT"), ("low", "5-LOW"), ("none", "none"))]
    return rounded(evaluate.composite(rows, scorers, ["o_orderstatus"]))


_FLAGS, _STATES = ["A", "N", "R"], ["F", "O"]


def _line_leaves() -> leaves.Leaves:
    """Counts, sums, shares, extremes and texts of lineitem by flag and status, declared by rule."""
    out = leaves.Leaves()
    f, s, q = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_quantity").cast("double")
    for x in _FLAGS:
        out.add("lineitem", {f"lines.{x}.count": F.count_if(f == x), f"lines.{x}.percent": leaves.share(F.count_if(f == x), F.count("*")), f"lines.{x}.greatest_price": F.max(F.when(f == x, F.col("l_extendedprice"))), f"lines.{x}.statuses": F.count_distinct(F.when(f == x, s))})
        out.add("lineitem", {f"lines.{x}.{y}.quantity": F.coalesce(F.sum(F.when((f == x) & (s == y), q)), F.lit(0.0)) for y in _STATES})
    out.add("lineitem", {"lines.first_flag": F.min(f), "lines.all_positive": F.bool_and(q > 0)})
    out.add("lineitem", {f"lines.{x}.count": F.when(F.count_if(f == x) > 0, F.count_if(f == x)) for x in ("X", "Y")}, optional=True)
    out.add("orders", {f"orders.{y}.count": F.count_if(F.col("o_orderstatus") == y) for y in ("F", "O", "P")} | {"orders.customers": F.count_distinct("o_custkey")})
    return out


def _line_leaves_sql() -> str:
    one = lambda i, v, t, k="number": f"SELECT '{i}' AS id, {v if k in ('number', 'whole') else 'NULL'}::DOUBLE AS number, {v if k == 'text' else 'NULL'}::VARCHAR AS text, {v if k == 'flag' else 'NULL'}::BOOLEAN AS flag, '{k}' AS kind FROM {t}"
    out = []
    for x in _FLAGS:
        of = f"FILTER (l_returnflag = '{x}')"
        out += [one(f"lines.{x}.count", f"count(*) {of}", "lineitem", "whole"), one(f"lines.{x}.percent", f"round(count(*) {of} * 100.0::DOUBLE / count(*), 6)", "lineitem"), one(f"lines.{x}.greatest_price", f"max(l_extendedprice) {of}", "lineitem"), one(f"lines.{x}.statuses", f"count(DISTINCT l_linestatus) {of}", "lineitem", "whole")]
        out += [one(f"lines.{x}.{y}.quantity", f"coalesce(sum(l_quantity) FILTER (l_returnflag = '{x}' AND l_linestatus = '{y}'), 0)", "lineitem") for y in _STATES]
    out += [one("lines.first_flag", "min(l_returnflag)", "lineitem", "text"), one("lines.all_positive", "bool_and(l_quantity > 0)", "lineitem", "flag")]
    out += [one(f"orders.{y}.count", f"count(*) FILTER (o_orderstatus = '{y}')", "orders", "whole") for y in ("F", "O", "P")] + [one("orders.customers", "count(DISTINCT o_custkey)", "orders", "whole")]
    return " UNION ALL ".join(out)


@query(_line_leaves_sql())
def leaf_registry(spark, d):
    return rounded(_line_leaves().table({"lineitem": table(spark, d, "lineitem"), "orders": table(spark, d, "orders")}))


# Training examples of documents: word lengths stand for token ids, the first eight words for the prompt.


def _word_ids(t: Column) -> Column:
    return F.transform(F.filter(F.split(t, " "), lambda w: w != ""), lambda w: F.length(w).cast("long"))


_EXAMPLES_SQL = """WITH d AS (SELECT doc_id, list_transform(list_filter(string_split(coalesce(text, ''), ' '), lambda w: w <> ''), lambda w: length(w)) AS ids FROM documents),
e AS (SELECT doc_id, least(len(ids), 8) + 2 AS p, list_concat(list_concat([1000, 1001], ids[1:8]), list_concat(ids[9:], [1002])) AS ids, floor((row_number() OVER (ORDER BY doc_id) - 1) / 4)::BIGINT AS b FROM d),
w AS (SELECT *, least(max(len(ids)) OVER (PARTITION BY b), 64) AS w FROM e),
p AS (SELECT *, list_concat(ids[1:w], list_transform(range(greatest(w - len(ids), 0)), lambda x: 0)) AS padded FROM w)
"""


@query(_EXAMPLES_SQL + """SELECT doc_id, b AS batch, p::BIGINT AS prompt_len, w - 1 AS width, list_sum(padded[1:w - 1])::BIGINT AS input_sum,
len(list_filter(list_transform(range(2, w + 1), lambda i: CASE WHEN i - 2 < p - 1 OR padded[i] = 0 THEN NULL ELSE padded[i] END), lambda t: t IS NOT NULL))::BIGINT AS supervised,
coalesce(list_sum(list_transform(range(2, w + 1), lambda i: CASE WHEN i - 2 < p - 1 OR padded[i] = 0 THEN NULL ELSE padded[i] END)), 0)::BIGINT AS target_sum FROM p""")
def collated_examples(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    words = _word_ids(F.col("text"))
    ids = F.concat(F.array(*[F.lit(i).cast("long") for i in (1000, 1001)]), F.slice(words, 1, 8))
    rest = F.slice(words, F.lit(9), F.greatest(F.size(words), F.lit(1)))
    one = docs.select("doc_id", encoding.example(ids, rest, lambda x: x, 1002).alias("e")).select("doc_id", "e.*")
    got = encoding.collated_stream(one, "doc_id", [], "input_ids", "prompt_len", 4, 0, 64)
    learned = F.filter("targets", lambda t: t != encoding.IGNORED)
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    return got.select("doc_id", "batch", "prompt_len", F.size("inputs").cast("long").alias("width"), total(F.col("inputs")).alias("input_sum"), F.size(learned).cast("long").alias("supervised"), total(learned).alias("target_sum"))


@query("""WITH l AS (SELECT n_chars, doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)), m AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS spot, doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)),
r AS (SELECT i AS draw, ('0x' || substr(md5('5:' || i), 1, 12))::BIGINT % (SELECT count(*) FROM m) AS spot FROM range((SELECT count(*) FROM documents)) t(i)), u AS (SELECT draw, doc_id AS main_key, n_chars FROM r JOIN m USING (spot)),
x AS (SELECT n_chars AS v, min(doc_id) AS k FROM l GROUP BY 1), lo AS (SELECT u.draw, x.v, x.k FROM u ASOF LEFT JOIN x ON u.n_chars >= x.v), hi AS (SELECT u.draw, x.v, x.k FROM u ASOF LEFT JOIN x ON u.n_chars <= x.v),
b AS (SELECT u.draw, main_key, abs(lo.v - u.n_chars) AS a, lo.k AS ka, abs(hi.v - u.n_chars) AS b, hi.k AS kb FROM u JOIN lo USING (draw) JOIN hi USING (draw))
SELECT draw::BIGINT AS draw, main_key, (CASE WHEN b IS NULL OR a < b OR (a = b AND ka < kb) THEN ka ELSE kb END)::BIGINT AS nearest, (CASE WHEN b IS NULL OR a <= b THEN a ELSE b END)::BIGINT AS distance FROM b""")
def stratified_sample(spark, d):
    """As many draws as documents among the unlabelled ones, each matched with the labelled one of nearest length."""
    docs, lab = table(spark, d, "documents").select("doc_id", "n_chars"), table(spark, d, "labels").select("doc_id")
    return prepared.stratified_sample(docs.join(lab, "doc_id", "left_anti"), docs.join(lab, "doc_id", "left_semi"), "n_chars", "doc_id", docs.count(), 5)


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def subset_violations(spark, d):
    """Customers with orders that the set of customers in credit lacks."""
    allowed = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return constraints.outside(table(spark, d, "orders"), allowed, ["o_custkey"])


@query("""WITH h AS (SELECT source, sha256(CASE WHEN text IS NULL THEN 'null' ELSE '=' || text END) AS h FROM documents)
SELECT source, count(*)::BIGINT AS n, """ + " || ".join(f"format('{{:016x}}', (sum(('0x' || substr(h, {8 * i + 1}, 8))::BIGINT)::HUGEINT % 9223372036854775808)::BIGINT)" for i in range(8)) + " AS digest FROM h GROUP BY 1")
def text_digests(spark, d):
    """An order-free digest of each source's texts, copies included."""
    return constraints.multiset_digest(table(spark, d, "documents"), ["source"], "text")


# A run bundle made from parts: published by executors, read once, checked, then queried.

_BUNDLE_CONDITIONS = {c: {"kind": "fine_tuned", "path": c.lower(), "seeds": [42, 43], "configuration_id": f"parts-{c.lower()}"} for c in ("C0", "C1")}
_BUNDLE = bundle.Study(_BUNDLE_CONDITIONS, "parts", "none", {"fine_tuned": "0" * 40}, {"main": {}}, tasks=["rule_identification", "explanation"])


def published_parts(spark: SparkSession, d: str) -> str:
    """Publishes four runs over all parts and returns their root: a part's label is its size's, an answer's depends on condition and seed."""
    part, names = table(spark, d, "part"), F.array(*map(F.lit, study.CHECKS))
    dims = spark.createDataFrame([(c, p, s) for c, p, s, _, _ in _BUNDLE.runs()], "condition string, path string, seed long")
    rows = part.crossJoin(F.broadcast(dims)).withColumn("task_type", F.explode(F.array(*map(F.lit, _BUNDLE.tasks))))  # four runs
    rule = F.col("task_type") == "rule_identification"
    shift = F.when((F.col("p_partkey") + F.col("seed")) % F.when(F.col("condition") == "C0", 3).otherwise(5) == 0, 1).otherwise(0)
    gold, pred = (F.when(rule, F.array(F.get(names, ((F.col("p_size") + x) % 8).cast("int")))) for x in (F.lit(0), shift))
    records_ = rows.select(
        "path", F.col("seed").alias("run_seed"), F.concat(F.lit("sha256:"), F.sha2(F.col("p_partkey").cast("string"), 256)).alias("base_snippet_id"), "condition", "seed", "task_type", gold.alias("gold"), pred.alias("pred"),
        gold.alias("target_checks"), F.lit("present").alias("summary_status"), F.col("p_size").cast("long").alias("prompt_tokens"), F.lit(1).cast("long").alias("retokenized_response_token_proxy"), (F.col("p_retailprice") / 100 + F.col("seed")).alias("latency_ms"),
        F.when(rule, F.lit(0).cast("long")).alias("rejected_label_count"), F.when(rule, gold == pred).alias("exact_match"), F.when(rule, F.lit(1).cast("long")).alias("n_emitted"), F.when(rule, F.lit("recognized_array")).alias("normalization_status"),
    ).withColumn("target_checks", F.coalesce("target_checks", F.array(F.lit("elseif"))))
    tokens = int(part.agg(F.sum("p_size")).first()[0] or 0)
    metrics = {"rule_id_macro_f1": 0.5, "correction_fix_rate": 0.25, "joint_fix_rate": 0.125}

    def documents(c: str, p: str, s: int) -> dict:
        who = {"historical_run_id": f"parts-{p}-{s}", "condition": c, "seed": s, "profile": "main"}
        compute = {"optimizer_steps": 600, "examples_seen": 1, "total_tokens": tokens + s, "supervised_tokens": 1, "peak_allocated_gpu_memory_gib": 1.0, "wall_clock_train_s": 1.0, "wall_clock_total_s": 2.0}
        origin = {"dataset_revision": "parts", "model_identifier": "none", "data_fraction": 1.0, "historical_source_commit": "0" * 40, "run_kind": "fine_tuned"}
        return {
            "results.yaml": who | {"metrics": {"checkpoint_selection": {"selected_step": 480, "best_composite": s / 64, **metrics}, "compute": compute, "length": {"allowed_max_length": 1, "realized_truncation": 0}, "provenance": origin}},
            "manifest.yaml": who | {"dataset_revision": "parts", "historical_source_commit": "0" * 40, "configuration_id": f"parts-{p}"},
            "selection_trace.json": [{"step": k, "validation_loss": 1.0, "composite_score": s / 64 if k == 480 else 0.1, **metrics} for k in _BUNDLE.steps],
        }

    root = landing.fresh(spark, "runs")
    publish.publish_runs(records_, {(p, s): documents(c, p, s) for c, p, s, _, _ in _BUNDLE.runs()}, {(p, s): c for c, p, s, _, _ in _BUNDLE.runs()}, root, ["historical_run_id", "profile"])
    return root


@query("""WITH r AS (SELECT c, s, p_size, p_retailprice, (p_partkey + s) % (CASE WHEN c = 'C0' THEN 3 ELSE 5 END) <> 0 AS exact FROM part, (VALUES ('C0'), ('C1')) t(c), (VALUES (42), (43)) u(s))
SELECT c AS condition, s::BIGINT AS seed, 2 * count(*)::BIGINT AS records, round(avg(exact::INT), 6) AS exact_match, round(avg(p_retailprice / 100 + s), 6) AS latency, (sum(p_size) + s)::BIGINT AS total_tokens, s / 64.0::DOUBLE AS best, 480::BIGINT AS step FROM r GROUP BY c, s""")
def run_bundle(spark, d):
    ids = table(spark, d, "part").select(F.concat(F.lit("sha256:"), F.sha2(F.col("p_partkey").cast("string"), 256)).alias("base_snippet_id"))
    _, recs, results, _, traces = bundle.load_runs(spark, published_parts(spark, d), _BUNDLE, ids)
    by = ["condition", "seed"]
    got = recs.groupBy(*by).agg(F.count("*").alias("records"), r6(F.avg(F.col("exact_match").cast("double"))).alias("exact_match"), r6(F.avg("latency_ms")).alias("latency"))
    tokens = results.select(*by, F.col("metrics.compute.total_tokens").alias("total_tokens"), F.col("metrics.checkpoint_selection.best_composite").alias("best"))
    return got.join(tokens, by).join(study.selected_steps(traces).select(*by, F.col("best_step").alias("step")), by)


# Text and tool operators on texts put together from the tables.


@query("""SELECT p_partkey, (p_partkey % 3) * 1000000 + p_size * 1000 + p_partkey % 7 >= 1010000 AND (p_partkey % 3) * 1000000 + p_size * 1000 + p_partkey % 7 < 2005003 AS supported FROM part""")
def version_ranges(spark, d):
    text = F.concat(F.lit("tool v"), F.concat_ws(".", (F.col("p_partkey") % 3).cast("string"), F.col("p_size").cast("string"), (F.col("p_partkey") % 7).cast("string")), F.lit(" linux"))
    return table(spark, d, "part").select("p_partkey", scalars.version_between(text, (1, 10, 0), (2, 5, 3)).alias("supported"))


@query("""SELECT l_orderkey, 'check' || l_returnflag AS "check", l_partkey::BIGINT AS line, l_linenumber::BIGINT AS "column" FROM lineitem WHERE l_returnflag IN ('A', 'R')""")
def tool_findings(spark, d):
    li = table(spark, d, "lineitem")
    text = F.format_string("# pkg\na/b.go:%d:%d: check%s: found\na/b.go:1:1: other: not asked\n", F.col("l_partkey").cast("long"), F.col("l_linenumber").cast("long"), F.col("l_returnflag"))
    rows = li.select("l_orderkey", F.explode(scalars.findings(text, ["checkA", "checkR"])).alias("f"))
    return rounded(rows.select("l_orderkey", "f.*"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'OK' WHEN contains(lower(text), 'http') OR contains(lower(text), 'copyright') THEN 'NA' ELSE 'FAIL' END AS status FROM documents""")
def build_statuses(spark, d):
    return table(spark, d, "documents").select("doc_id", scalars.build_status(F.col("doc_id") % 3 == 0, F.col("text"), ["http", "copyright"]).alias("status"))


@query("""SELECT p_partkey, repeat('`', greatest(3, p_size % 6 + 1)) || 'go' || chr(10) || repeat('`', p_size % 6) || ' x ``' || chr(10) || repeat('`', greatest(3, p_size % 6 + 1)) AS fenced FROM part""")
def fence_lengths(spark, d):
    text = F.concat(F.repeat(F.lit("`"), (F.col("p_size") % 6).cast("int")), F.lit(" x ``"))
    return table(spark, d, "part").select("p_partkey", scalars.fenced(text, "go").alias("fenced"))


@query("""SELECT p_partkey, p_size % 3 <> 2 AS directive, CASE WHEN p_size % 2 = 0 THEN 'body ' || p_partkey ELSE 'no header ' || p_partkey END AS body FROM part""")
def directives_headers(spark, d):
    line = F.concat(F.lit("lint:ignore"), F.when(F.col("p_size") % 3 == 0, "").when(F.col("p_size") % 3 == 1, "\tall").otherwise("d"))
    text = F.concat(F.when(F.col("p_size") % 2 == 0, "x <|assistant|> body ").otherwise(" no header "), F.col("p_partkey").cast("string"))
    return table(spark, d, "part").select("p_partkey", scalars.is_directive(line, "lint:ignore").alias("directive"), scalars.after_header(text, "<|assistant|>").alias("body"))


@query("""SELECT doc_id, md5(trim(regexp_replace(text, '[\\s\\x{0B}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g'))) AS text_md5 FROM documents""")
def one_space(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(scalars.one_space(F.col("text"))).alias("text_md5"))


@query("""SELECT o_orderkey, count(*)::BIGINT AS n, sum(l_quantity)::BIGINT AS total FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'A' GROUP BY 1""")
def map_prefix(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.concat_ws(":", "l_returnflag", F.uuid()).alias("k"), F.col("l_quantity").cast("long").alias("v"))
    m = li.groupBy("o_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))
    mine = m.join(table(spark, d, "orders"), "o_orderkey", "left_semi").select("o_orderkey", scalars.entries_of(F.col("m"), "A").alias("m")).where(F.size("m") > 0)
    return rounded(mine.select("o_orderkey", F.size("m").alias("n"), F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda a, x: a + x).alias("total")))


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'file' WHEN 1 THEN 'decl' ELSE 'stmt' END AS strategy, md5(CASE p_size % 3 WHEN 0 THEN 'package q' || chr(10) || 'var x = ' || p_partkey
WHEN 1 THEN 'package p' || chr(10) || chr(10) || 'var x = ' || p_partkey || chr(10)
ELSE 'package p' || chr(10) || chr(10) || 'func _gocheck_body() {' || chr(10) || chr(9) || 'x := 1' || chr(10) || chr(9) || 'y := ' || p_partkey || chr(10) || '}' || chr(10) END) AS source_md5 FROM part""")
def fixture_sources(spark, d):
    k = F.col("p_partkey").cast("string")
    code = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("package q\nvar x = "), k)).when(F.col("p_size") % 3 == 1, F.concat(F.lit("var x = "), k)).otherwise(F.concat(F.lit("x := 1 y := "), k))
    got = table(spark, d, "part").select("p_partkey", textops.fixture(code).alias("f"))
    return got.select("p_partkey", F.col("f.strategy").alias("strategy"), F.md5("f.source").alias("source_md5"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'fix part ' || p_partkey || ': ' || p_brand ELSE 'name ' || p_brand END AS prompt,
length(CASE WHEN p_size % 2 = 0 THEN 'fix part ' || p_partkey || ': ' || p_brand ELSE 'name ' || p_brand END)::BIGINT AS prompt_len,
(length(CASE WHEN p_size % 2 = 0 THEN 'fix part ' || p_partkey || ': ' || p_brand ELSE 'name ' || p_brand END) + length(p_brand))::BIGINT AS total_len FROM part""")
def prompt_registry(spark, d):
    p = table(spark, d, "part").withColumn("task", F.when(F.col("p_size") % 2 == 0, "fix").otherwise("name"))
    text = prompts.by_task(F.col("task"), {"fix": "fix part {id}: {brand}", "name": "name {brand}"}, {"id": F.col("p_partkey"), "brand": F.col("p_brand")})
    p = p.withColumn("prompt", text)
    return p.select("p_partkey", "prompt", prompts.lengths(F.col("prompt"), F.col("p_brand"), F.length).alias("n")).select("p_partkey", "prompt", "n.*")


# Integrity rules.


@query("SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def uniform_values(spark, d):
    return constraints.uniform(table(spark, d, "orders"), ["o_custkey"], "o_orderstatus").select("o_custkey")


@query("SELECT p_partkey FROM part WHERE (p_size = 7) <> (p_size % 10 = 7)")
def both_or_neither(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.expr("nullif(p_size, 7)").alias("a"), F.expr("nullif(p_size % 10, 7)").alias("b"))
    return constraints.both_or_neither(p, "a", "b").select("p_partkey")


@query("""SELECT * FROM (SELECT 'finished' AS rule, (count(*) FILTER (o_orderstatus = 'F'))::BIGINT AS found, 10::BIGINT AS expected FROM orders UNION ALL SELECT 'odd', (count(*) FILTER (o_orderstatus = 'X'))::BIGINT, 0 FROM orders) WHERE found <> expected""")
def cardinalities(spark, d):
    return constraints.cardinalities(table(spark, d, "orders"), {"finished": (F.col("o_orderstatus") == "F", 10), "odd": (F.col("o_orderstatus") == "X", 0)})


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber <= 3")
def finite_guard(spark, d):
    odd = F.when(F.col("l_linenumber") == 1, float("nan")).when(F.col("l_linenumber") == 2, float("inf")).when(F.col("l_linenumber") > 3, F.col("l_tax"))
    return table(spark, d, "lineitem").where(~constraints.finite(odd)).select("l_orderkey", "l_linenumber")


@query("""SELECT coalesce(a.k, b.k) AS o_orderkey, CASE WHEN b.k IS NULL THEN 'missing right' WHEN a.k IS NULL THEN 'missing left' ELSE 'different' END AS problem
FROM (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_totalprice < 200000) a FULL JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderpriority LIKE '1%' THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_totalprice > 50000) b ON a.k = b.k
WHERE a.k IS NULL OR b.k IS NULL OR a.s <> b.s""")
def join_agreement(spark, d):
    o = table(spark, d, "orders")
    right = o.where("o_totalprice > 50000").select("o_orderkey", F.when(F.col("o_orderpriority").startswith("1"), "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))
    return constraints.mismatches(o.where("o_totalprice < 200000").select("o_orderkey", "o_orderstatus"), right, ["o_orderkey"], ["o_orderstatus"])


@query("SELECT l_orderkey, l_linenumber, l_linenumber / 2.0::DOUBLE AS value FROM lineitem WHERE l_linenumber <> 2")
def binary_guard(spark, d):
    li = table(spark, d, "lineitem").withColumn("value", F.col("l_linenumber") / 2.0)
    return rounded(records.not_binary(li, ["l_orderkey", "l_linenumber"], "value"))


@query("SELECT p_partkey AS k, 'small' AS side FROM part WHERE p_size < 20 UNION ALL SELECT p_partkey, 'large' FROM part WHERE p_size >= 20")
def disjoint_union(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_size")
    return records.disjoint_union([p.where("p_size < 20").select("k", F.lit("small").alias("side")), p.where("p_size >= 20").select("k", F.lit("large").alias("side"))], ["k"])


# Records: partners, positions, steps, totals.


@query(f"""WITH {_cells_sql()} SELECT a.u AS l_partkey, a.s AS l_linestatus, round(a.v, 6) AS outcome, round(b.v, 6) AS partner_outcome FROM c a LEFT JOIN c b ON a.u = b.u AND a.s = b.s AND b.f = 'N' WHERE a.f = 'A'""")
def partner_lookup(spark, d):
    c = cells(spark, d)
    mine, other = (c.where(F.col("l_returnflag") == f).drop("l_returnflag") for f in "AN")
    return rounded(records.partner(mine, other, ["l_partkey", "l_linestatus"], ["outcome"]))


@query(_SETS + """, k AS (SELECT user_id, d, row_number() OVER (PARTITION BY user_id, d ORDER BY t) AS i, t FROM s)
SELECT user_id, d::VARCHAR AS day, t AS first, upper(t) AS second FROM k""")
def positional_zip(spark, d):
    s = table(spark, d, "events").groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(F.sort_array(F.collect_set("event_type")).alias("a"))
    pairs = records.zipped(F.col("a"), F.transform("a", F.upper))
    return s.select("user_id", "day", F.explode(pairs).alias("z")).select("user_id", "day", "z.*")


@query(_SETS + """, gs AS (SELECT user_id, d, list(t) AS l FROM g GROUP BY 1, 2), qs AS (SELECT user_id, d, list(t) AS l FROM q GROUP BY 1, 2)
SELECT user_id, d::VARCHAR AS day, array_to_string(list_sort(qs.l), ',') AS found FROM gs JOIN qs USING (user_id, d)""")
def detected_sets(spark, d):
    s = label_sets(spark, d)
    got = records.detected(F.col("gold"), F.array_except("gold", "pred"), F.array_except("pred", "gold"))
    return s.select("user_id", F.col("day").cast("string").alias("day"), F.array_join(got, ",").alias("found"))


@query("""WITH c AS (SELECT l_returnflag, l_linestatus, l_linenumber, count(*) FILTER (l_quantity > 40) AS h, count(*) AS n FROM lineitem GROUP BY 1, 2, 3),
r AS (SELECT *, h * 100.0::DOUBLE / n AS p, row_number() OVER (PARTITION BY l_returnflag ORDER BY h DESC, h * 100.0::DOUBLE / n DESC) AS k FROM c) SELECT l_returnflag, h::BIGINT AS count, round(p, 6) AS percent FROM r WHERE k = 1""")
def greatest_cell(spark, d):
    return rounded(records.greatest_cell(table(spark, d, "lineitem"), ["l_returnflag"], ["l_linestatus", "l_linenumber"], F.col("l_quantity") > 40))


@query("""WITH m AS (SELECT l_returnflag AS f, l_linenumber AS s, sum(l_quantity)::DOUBLE AS v FROM lineitem GROUP BY 1, 2), z AS (SELECT a.f, (a.v - b.v) * 100 / b.v AS x FROM m a JOIN m b ON a.s = b.s AND b.f = 'A' WHERE a.f <> 'A')
SELECT f AS l_returnflag, round(min(x), 6) AS low, round(max(x), 6) AS high, round(max(abs(x)), 6) AS most FROM z GROUP BY 1""")
def repeat_deviation(spark, d):
    m = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.sum("l_quantity").cast("double").alias("v"))
    return rounded(records.repeat_deviation(m, "l_returnflag", "l_linenumber", "v", "A"))


@query("""WITH n AS (SELECT l_orderkey, l_suppkey % 3 AS step, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, step::BIGINT AS step, n::BIGINT AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, step) = 1 AS usual, count(*) OVER (PARTITION BY l_orderkey) = 2 AS one_alternate FROM n""")
def step_histogram(spark, d):
    return rounded(records.step_histogram(table(spark, d, "lineitem").withColumn("step", F.col("l_suppkey") % 3), ["l_orderkey"], "step"))


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS total, count(*) OVER w AS steps FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)")
def running_totals(spark, d):
    o = table(spark, d, "orders").withColumn("step", F.lit(1).cast("long"))
    got = records.running_totals(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_totalprice", "step"])
    return got.select("o_orderkey", F.round("total_o_totalprice", 2).alias("total"), F.col("total_step").alias("steps"))


@query("""WITH e AS (SELECT l_orderkey, l_linenumber AS place, 1 AS late, 'node ' || l_partkey AS t FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 0, 'comment ' || l_suppkey FROM lineitem WHERE l_returnflag = 'R')
SELECT l_orderkey, string_agg(t, ';' ORDER BY place, late, t) AS merged FROM e GROUP BY 1""")
def merged_by_place(spark, d):
    one = lambda text: F.struct(F.col("l_linenumber").alias("at"), text.alias("text"))
    node, comment = one(F.concat(F.lit("node "), F.col("l_partkey").cast("string"))), one(F.concat(F.lit("comment "), F.col("l_suppkey").cast("string")))
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(node)).alias("n"), F.sort_array(F.collect_list(F.when(F.col("l_returnflag") == "R", comment))).alias("c"))
    return g.select("l_orderkey", F.array_join(records.merged_by_place(F.col("n"), F.col("c")), ";").alias("merged"))


@query("""SELECT l_returnflag, CASE l_returnflag WHEN 'R' THEN 'returned' WHEN 'A' THEN 'accepted' ELSE 'none' END AS name, (CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END)::BIGINT AS ordinal, count(*)::BIGINT AS n FROM lineitem GROUP BY 1""")
def declared_order(spark, d):
    n = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"))
    return records.named(n, "l_returnflag", {"R": "returned", "A": "accepted", "N": "none"})


@query("""SELECT i::BIGINT AS draw, ('0x' || substr(md5('42:' || i), 1, 12))::BIGINT % (SELECT count(*) FROM part) AS place FROM range(1000) t(i)""")
def seeded_draw(spark, d):
    n = table(spark, d, "part").count()
    return spark.range(1000).select(F.col("id").alias("draw"), records.drawn(n, 42, F.col("id")).alias("place"))


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, l_quantity * l_extendedprice AS v FROM lineitem) SELECT l_orderkey, l_linenumber, round(round_even(v / pow(10.0::DOUBLE, floor(log10(v)) - 1), 0) * pow(10.0::DOUBLE, floor(log10(v)) - 1), 6) AS rounded FROM v""")
def two_digits(spark, d):
    v = (F.col("l_quantity") * F.col("l_extendedprice")).cast("double")
    return rounded(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", stats.two_significant(v).alias("rounded")))


@query("""SELECT doc_id FROM labels WHERE quality = 0 UNION SELECT doc_id FROM labels WHERE toxic = 1""")
def exclusion_ids(spark, d):
    lab = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.lit("test").alias("split"), "quality", "toxic")
    adjudged = lab.select("id", "split", F.when(F.col("toxic") == 1, "exclude").otherwise("keep").alias("resolution"))
    return evaluate.exclusions(lab.where("quality = 0"), adjudged, "test").withColumnRenamed("id", "doc_id")


@query("""SELECT doc_id, quality FROM labels WHERE quality = 1 AND toxic = 0""")
def selected_population(spark, d):
    lab = table(spark, d, "labels")
    bad = lab.where("quality = 0 or toxic = 1").select(F.col("doc_id").alias("id"))
    ids = evaluate.without(lab.select("doc_id"), bad, "doc_id").select(F.col("doc_id").alias("id"))
    return rounded(evaluate.selected(lab.select("doc_id", "quality"), ids, "doc_id"))
