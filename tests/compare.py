"""Runs registered queries and their SQL side by side and reports where they differ."""

import math
import os
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = lambda v: round(v, 6) if isinstance(v, float) and not math.isnan(v) else v
    return sorted(columns), sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


def compare(spark, sf_dir, name, query, sql):
    got = query(spark, sf_dir)
    a = rows(got.columns, [tuple(r) for r in got.collect()])
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    cur = con.execute(sql)
    b = rows([c[0] for c in cur.description], [tuple(float(v) if type(v).__name__ == "Decimal" else v for v in r) for r in cur.fetchall()])
    if a == b:
        return len(a[1]), None
    if a[0] != b[0]:
        return len(a[1]), f"columns {a[0]} and {b[0]}"
    ours, theirs = set(map(repr, a[1])), set(map(repr, b[1]))
    return len(a[1]), f"{len(a[1])} and {len(b[1])} rows; only here {sorted(ours - theirs)[:2]}, only there {sorted(theirs - ours)[:2]}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    queries, oracle = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or [n for n in queries if n in oracle]:
        began = time.time()
        try:
            n, fault = compare(spark, sys.argv[1], name, queries[name], oracle[name])
        except Exception as e:
            n, fault = 0, f"{type(e).__name__}: {str(e)[:600]}"
        print(name, n, "ok" if not fault else "DIFFERS " + fault, round(time.time() - began, 1), flush=True)
