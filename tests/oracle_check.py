"""Compare a registered query with its SQL, value by value.

`python -m tests.oracle_check [sf] [name ...]` runs it for all or the named queries.
"""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _key(row: tuple) -> tuple:
    return tuple("" if v is None else repr(round(v, 6)) if isinstance(v, float) else repr(v) for v in row)


def _rows(rows: list[tuple], order: list[int]) -> list[tuple]:
    picked = (tuple(None if isinstance(v, float) and math.isnan(v) else v for v in (r[i] for i in order)) for r in rows)
    return sorted((_key(r) for r in picked))


def compare(spark: SparkSession, con: duckdb.DuckDBPyConnection, sf_dir: str, query, sql: str | None) -> tuple[bool, str]:
    started = time.time()
    df = query(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    spent = f"spark {time.time() - started:.1f}s"
    if sql is None:
        return True, f"{len(rows)} rows, no SQL, {spent}"
    started = time.time()
    result = con.execute(sql)
    names, kinds = [d[0] for d in result.description], [str(d[1]) for d in result.description]
    expected = result.fetchall()
    spent += f", sql {time.time() - started:.1f}s"
    if sorted(names) != sorted(df.columns):
        return False, f"columns differ: {sorted(df.columns)} / {sorted(names)}"
    want = {n: TYPES.get(t, t) for n, t in df.dtypes}
    off = [(n, want[n], k) for n, k in zip(names, kinds) if want[n] != k]
    order = sorted(names)
    left = _rows(rows, [df.columns.index(n) for n in order])
    right = _rows(expected, [names.index(n) for n in order])
    if left != right:
        a, b = set(left), set(right)
        return False, (
            f"{len(left)} / {len(right)} rows differ, types {off}, {spent}\n   columns {order}"
            f"\n   only spark {sorted(a - b)[:2]}\n   only sql   {sorted(b - a)[:2]}"
        )
    return not off, f"{len(left)} rows{', types ' + str(off) if off else ''}, {spent}"


def main() -> int:
    import __spark_entry__ as registered
    from ledgerflow.session import build_session

    sf, names = (sys.argv[1] if len(sys.argv) > 1 else "sf0.01"), sys.argv[2:]
    sf_dir = f"/root/testdata/{sf}"
    spark = build_session("oracle-check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(sf_dir), 0
    queries, sqls = registered.queries(), registered.oracle_sql()
    for name in names or queries:
        try:
            ok, detail = compare(spark, con, sf_dir, queries[name], sqls.get(name))
        except Exception as error:  # noqa: BLE001
            ok, detail = False, f"{type(error).__name__}: {str(error)[:1500]}"
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name}: {detail}", flush=True)
    print(f"{failed} failed")
    spark.stop()
    return failed


if __name__ == "__main__":
    sys.exit(min(main(), 1))
