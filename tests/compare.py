"""Run registered queries in Spark and their twins in DuckDB and compare all rows."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def oracle(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    """Value as a comparable text, strict about kind: 1, 1.0 and True differ."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    if isinstance(value, bool):
        return f"b{value}"
    if isinstance(value, decimal.Decimal):
        return f"d{value}"
    if isinstance(value, float):
        return f"f{value + 0.0!r}"
    if isinstance(value, (datetime.datetime, datetime.date)):
        return f"t{value.isoformat()}"
    return f"{type(value).__name__[0]}{value}"


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def differences(df, con, sql) -> str | None:
    """None when both give the same columns and rows."""
    made = con.execute(sql)
    names = [d[0] for d in made.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    right = rows_of(names, made.fetchall())
    if left == right:
        return None
    here, there = set(left) - set(right), set(right) - set(left)
    return f"{len(left)} vs {len(right)} rows; spark only {sorted(here)[:3]}; sql only {sorted(there)[:3]}"


def main(folder: str, only: list[str]) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as contract

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "10g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, twins, bad = oracle(folder), contract.oracle_sql(), 0
    for name, run in contract.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            df = run(spark, folder)
            if name in twins:
                problem = differences(df, con, twins[name])
            else:
                rows = df.collect()
                problem = None if rows else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        kind = "sql " if name in twins else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind} {time.time() - start:6.2f}s {name} {problem or ''}", flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
