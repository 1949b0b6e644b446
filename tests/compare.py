"""Run queries and their SQL twins side by side and report differences.

    python tests/compare.py SF_DIR [query ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def tidy(df: pd.DataFrame) -> list[tuple]:
    """Rows as plain tuples over sorted columns, sorted."""
    def plain(v):
        if v is None or (isinstance(v, float) and v != v) or v is pd.NA or v is pd.NaT:
            return None
        if hasattr(v, "item"):
            v = v.item()
        if isinstance(v, float) and v.is_integer():
            return int(v)
        return v

    columns = sorted(df.columns)
    rows = [tuple(plain(v) for v in row) for row in df[columns].itertuples(index=False, name=None)]
    return sorted(rows, key=repr)


def database(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def difference(spark, con, sf: str, name: str, fn, sql: str | None) -> tuple[str, int, list]:
    df = fn(spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "CartesianProduct" in plan or "NestedLoopJoin" in plan:
        return "pairs of all rows in the plan", 0, []
    got = df.toPandas()
    if sql is None:
        return "rows-only", len(got), []
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} / {sorted(want.columns)}", len(got), []
    a, b = tidy(got), tidy(want)
    if a == b:
        return "ok", len(a), []
    only_a, only_b = [r for r in a if r not in set(b)][:3], [r for r in b if r not in set(a)][:3]
    return f"DIFF {len(a)} / {len(b)}", len(a), [("spark", only_a), ("sql", only_b)]


if __name__ == "__main__":
    from hedgemark.session import build_session
    import __spark_entry__ as entry

    sf = sys.argv[1]
    spark = build_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    con, sql = database(sf), entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            state, rows, diff = difference(spark, con, sf, name, fn, sql.get(name))
        except Exception as error:  # report and go on with the next query
            state, rows, diff = f"ERROR {str(error)[:600]}", 0, []
        bad += state not in ("ok", "rows-only")
        print(f"{name:28s} {state} rows={rows} {time.time() - start:.1f}s", flush=True)
        for side, examples in diff:
            for row in examples:
                print(f"    {side}: {str(row)[:400]}")
    print("bad:", bad)
