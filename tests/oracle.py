"""Runs registered queries against their SQL on a folder of tables: python tests/oracle.py FOLDER [NAME...]."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: [show(x) for x in v] if isinstance(v, list | tuple) else float(v) if isinstance(v, int | float) and not isinstance(v, bool) else v
    return [columns[i] for i in order], sorted((str([show(r[i]) for i in order]) for r in rows))


def compare(spark, query, sql, folder):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{folder}/{t}.parquet'")
    cur = con.execute(sql)
    want = canonical([c[0] for c in cur.description], cur.fetchall())
    df = query(spark, folder)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    return got, want


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[2:] or list(e.oracle_sql())
    for n in names:
        t = time.time()
        try:
            got, want = compare(spark, e.queries()[n], e.oracle_sql()[n], sys.argv[1])
            diff = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
            print(n, "ok" if got == want else f"DIFFERS {got[0]} {want[0]} {len(got[1])} {len(want[1])} {diff[:1]}", round(time.time() - t, 1), flush=True)
        except Exception as x:
            print(n, "ERROR", str(x)[:300].replace("\n", " "), flush=True)
