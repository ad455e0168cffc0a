"""Runs a registered query in Spark and its SQL in DuckDB over the same tables and compares the rows."""

import glob
import math
import os
import sys
import time

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def _cell(x):
    if x is None or x != x:
        return ""
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, float):
        return repr(int(x)) if x == int(x) and math.isfinite(x) and abs(x) < 1e15 else f"{x:.9g}"
    if isinstance(x, (list, tuple)) or hasattr(x, "tolist"):
        return str([_cell(y) for y in x])
    return str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in data)


def compare(spark, con, sf_dir, query, sql):
    """None if equal, else what differs."""
    df = query(spark, sf_dir)
    names, mine = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    other, theirs = rows([c[0] for c in cur.description], cur.fetchall())
    if names != other:
        return f"columns {names} and {other}"
    if mine != theirs:
        a, b = set(mine) - set(theirs), set(theirs) - set(mine)
        return f"{len(mine)} and {len(theirs)} rows; {len(a)} and {len(b)} differ: {sorted(a)[:3]} / {sorted(b)[:3]}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = duck(sf), e.oracle_sql()
    for name, query in e.queries().items():
        if sys.argv[1:] and not any(name.startswith(x) for x in sys.argv[1:]):
            continue
        start = time.time()
        try:
            if name in sqls:
                said = compare(spark, con, sf, query, sqls[name]) or "equal"
            else:
                said = f"{query(spark, sf).count()} rows, no SQL"
        except Exception as x:
            said = f"ERROR {type(x).__name__}: {str(x)[:700]}"
        print(f"{name}: {said} ({time.time() - start:.1f} s)", flush=True)
