"""Run registered queries beside their SQL in DuckDB: ``python tests/oracle.py [name ...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    def value(x):
        if x is None or (isinstance(x, float) and x != x) or x is pd.NaT or x is pd.NA:
            return None
        if hasattr(x, "item"):
            x = x.item()
        return x

    df = df[sorted(df.columns)]
    rows = [tuple(value(x) for x in r) for r in df.itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(mine: pd.DataFrame, theirs: pd.DataFrame) -> str | None:
    if sorted(mine.columns) != sorted(theirs.columns):
        return f"columns {sorted(mine.columns)} / {sorted(theirs.columns)}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} / {len(theirs)}"
    a, b = canonical(mine), canonical(theirs)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} rows differ, e.g.\n   {bad[0][0]}\n   {bad[0][1]}" if bad else None


def main(names: list[str]) -> int:
    import __spark_entry__ as entry

    from sharetide.session import local_session

    sf_dir = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
    spark = local_session(8, app="oracle")
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, failed = connect(sf_dir), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if names and name not in names:
            continue
        started = time.time()
        try:
            mine = fn(spark, sf_dir).toPandas()
            took = time.time() - started
            problem = compare(mine, con.execute(oracles[name]).fetchdf()) if name in oracles else None
        except Exception as e:
            took, problem, mine = time.time() - started, f"{type(e).__name__}: {str(e)[:700]}", []
        failed += problem is not None
        kind = "sql " if name in oracles else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind} {name:30s} {len(mine):7d} rows {took:6.2f}s {problem or ''}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
