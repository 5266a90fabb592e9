"""Runs registered queries against their SQL in DuckDB. Usage: python -m tests.parity <sf> [name ...]"""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

import __spark_entry__ as entry

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def session() -> SparkSession:
    return (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g").getOrCreate()
    )


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if hasattr(value, "isoformat"):
        return value.isoformat(" ")
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark: SparkSession, con, sf_dir: str, name: str) -> str | None:
    """None when equal, else a short account of the difference."""
    got = entry.queries()[name](spark, sf_dir)
    got_rows = rows_of(got.columns, got.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return None if got_rows else "no rows"
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want_rows = rows_of(names, cursor.fetchall())
    if sorted(names) != sorted(got.columns):
        return f"columns {sorted(got.columns)} != {sorted(names)}"
    if len(got_rows) != len(want_rows):
        return f"{len(got_rows)} rows != {len(want_rows)}"
    if got_rows != want_rows:
        bad = [(g, w) for g, w in zip(got_rows, want_rows) if g != w]
        return f"{len(bad)} of {len(got_rows)} rows differ, e.g. {bad[0][0]} != {bad[0][1]}"
    return "empty on both sides" if not got_rows else None


def main() -> None:
    sf_dir, names = f"/root/testdata/sf{sys.argv[1]}", sys.argv[2:]
    spark, con = session(), database(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    failed = 0
    for name in names or entry.queries():
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, name)
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        kind = "sql" if name in entry.oracle_sql() else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} [{kind}] {time.time() - start:.1f}s {problem or ''}", flush=True)
        failed += problem is not None
    print("failed:", failed)


if __name__ == "__main__":
    main()
