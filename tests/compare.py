"""Compare registered queries with their DuckDB SQL, as rows sorted by all columns."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    norm = lambda v: round(v, 6) if isinstance(v, float) else str(v)
    return [columns[i] for i in order], sorted([tuple(norm(r[i]) for i in order) for r in rows], key=str)


def difference(spark, con, query, oracle, sf_dir):
    """None if both agree, else a short account."""
    df = query(spark, sf_dir)
    a = canonical(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(oracle)
    b = canonical([d[0] for d in rel.description], rel.fetchall())
    if a == b:
        return None
    if a[0] != b[0]:
        return f"columns {a[0]} against {b[0]}"
    x, y = set(a[1]), set(b[1])
    return f"{len(a[1])} rows against {len(b[1])}; only ours {sorted(x - y, key=str)[:2]}; only SQL {sorted(y - x, key=str)[:2]}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = f"/root/testdata/{os.environ.get('SF', 'sf0.01')}"
    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    queries, oracles, con = entry.queries(), entry.oracle_sql(), connect(sf_dir)
    for name in sys.argv[1:] or [x for x in queries if not x.startswith("op") and x != "pipeline"]:
        began = time.time()
        try:
            found = difference(spark, con, queries[name], oracles[name], sf_dir) if name in oracles else f"rows only: {queries[name](spark, sf_dir).count()}"
        except Exception as e:
            found = "error: " + str(e)[:600]
        print(name, found or "same", f"{time.time() - began:.1f} s", flush=True)
