"""Run a registered query in Spark and its SQL in DuckDB and compare rows."""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from pagelattice.derived import BASE


def make_spark(cpus: int = 8) -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("pagelattice")
             .config("spark.sql.shuffle.partitions", "8").config("spark.sql.adaptive.enabled", "true")
             .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "\0null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        f = float(v)
        return repr(int(f)) if f == int(f) else repr(f)
    return str(v)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, con, name, sf_dir, queries, oracles):
    t0 = time.time()
    df = queries[name](spark, sf_dir)
    got = _rows(df.columns, df.collect())
    t1 = time.time()
    if name not in oracles:
        return f"ROWS   {name}: {len(got)} rows, spark {t1 - t0:.1f}s", len(got) > 0
    cur = con.execute(oracles[name])
    names = [d[0] for d in cur.description]
    want = _rows(names, cur.fetchall())
    t2 = time.time()
    if sorted(names) != sorted(df.columns):
        return f"FAIL   {name}: columns {sorted(df.columns)} vs {sorted(names)}", False
    if got == want:
        return f"ok     {name}: {len(got)} rows, spark {t1 - t0:.1f}s duck {t2 - t1:.1f}s", True
    a, b = set(got) - set(want), set(want) - set(got)
    return (f"FAIL   {name}: {sorted(df.columns)} {len(got)} vs {len(want)} rows; "
            f"only spark {len(a)} {sorted(a)[:3]}; only sql {len(b)} {sorted(b)[:3]}"), False


def main(argv):
    import __spark_entry__ as entry
    sf = argv[0]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = make_spark(), duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not argv[1:] or any(n == p or (p.endswith("*") and n.startswith(p[:-1])) for p in argv[1:])]
    bad = 0
    for n in names:
        try:
            msg, fine = compare(spark, con, n, sf_dir, queries, oracles)
        except Exception as e:
            msg, fine = f"ERROR  {n}: {type(e).__name__} {str(e)[:700]}", False
        bad += not fine
        print(msg[:1600], flush=True)
    print(f"{len(names)} queries, {bad} not fine")


if __name__ == "__main__":
    main(sys.argv[1:])
