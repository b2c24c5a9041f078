"""Run registered queries on Spark and their SQL on DuckDB and compare the rows.

    python tests/oracle_check.py [sf_dir] [query ...]
"""

from __future__ import annotations

import datetime
import decimal
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str, pattern: str = "{t}.parquet"):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{pattern.format(t=t)}')")
    return con


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return f"b{int(v)}"
    if isinstance(v, int):
        return f"i{v}"
    if isinstance(v, decimal.Decimal):
        return f"d{v}"
    if isinstance(v, float):
        return f"f{v!r}"
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    return str(v)


def normalize(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark_df, con, sql):
    """Empty string when equal, else a description of the first difference."""
    sc, sr = normalize(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    dc, dr = normalize([d[0] for d in cur.description], cur.fetchall())
    if sc != dc:
        return f"columns differ: only spark {sorted(set(sc) - set(dc))}, only sql {sorted(set(dc) - set(sc))}"
    if len(sr) != len(dr):
        return f"{len(sr)} rows on spark, {len(dr)} in sql"
    for a, b in zip(sr, dr, strict=True):
        if a != b:
            return "; ".join(f"{c}: {x} vs {y}" for c, x, y in zip(sc, a, b, strict=True) if x != y)[:600]
    return ""


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false").config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv):
    from __spark_entry__ import oracle_sql, queries

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    spark, con = session(), connect(sf_dir)
    bad = 0
    for name, fn in queries().items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        t = time.time()
        try:
            df = fn(spark, sf_dir)
            sql = oracle_sql().get(name)
            if sql is None:
                n = df.count()
                msg = f"rows only ({n})"
            else:
                diff = compare(df, con, sql)
                msg = "DIFF " + diff if diff else "OK"
                bad += bool(diff)
        except Exception as e:  # noqa: BLE001 - report and go on with the other queries
            msg, bad = f"ERROR {type(e).__name__} {str(e)[:700]}", bad + 1
        print(f"{name:38s} {time.time() - t:6.1f}s  {msg}", flush=True)
    print(f"{bad} problem(s)")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
