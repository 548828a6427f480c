"""Compare registered queries with their SQL twins: `python tests/check_results.py [sf_dir] [names...]`."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as contract  # noqa: E402
from regrove.session import get_spark  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    return str(v)


def canonical(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def spark_rows(df):
    return canonical(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql: str):
    cur = con.execute(sql)
    return canonical([d[0] for d in cur.description], cur.fetchall())


def main(sf_dir: str, names: list[str]) -> int:
    spark = get_spark("check", os.environ.get("CHECK_MASTER", "local[8]"), **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    queries, sql = contract.queries(), contract.oracle_sql()
    bad = 0
    for name in names or list(queries):
        start = time.time()
        try:
            columns, rows = spark_rows(queries[name](spark, sf_dir))
        except Exception as e:
            print(f"{name:24s} ERROR {str(e)[:400]}", flush=True)
            bad += 1
            continue
        took = time.time() - start
        if name not in sql:
            print(f"{name:24s} rows {len(rows)} ({took:.1f}s)", flush=True)
            continue
        try:
            expected_columns, expected = duck_rows(con, sql[name])
        except Exception as e:
            print(f"{name:24s} SQL ERROR {str(e)[:400]}", flush=True)
            bad += 1
            continue
        same = columns == expected_columns and rows == expected
        print(f"{name:24s} {'ok' if same else 'DIFFERENT'} {len(rows)} rows ({took:.1f}s)", flush=True)
        if not same:
            bad += 1
            print("   columns", columns, expected_columns if columns != expected_columns else "")
            different = [(a, b) for a, b in zip(rows, expected) if a != b]
            print("   rows", len(rows), len(expected), "different", len(different))
            for a, b in different[:3]:
                print("   ", a, "\n   ", b)
    print("bad", bad)
    return bad


if __name__ == "__main__":
    args = sys.argv[1:]
    sys.exit(1 if main(args[0] if args else "/root/testdata/sf0.01", args[1:]) else 0)
