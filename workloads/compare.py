"""Run the registered queries next to their SQL and compare the results.

    python -m workloads.compare /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from workloads.oracles import ORACLES
from workloads.queries import QUERIES


def session() -> SparkSession:
    return (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return value


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(row[i]) for i in order) for row in rows), key=repr)


def compare(spark: SparkSession, con: duckdb.DuckDBPyConnection, sf_dir: str, name: str) -> str | None:
    """None if both agree, else what differs first."""
    df = QUERIES[name](spark, sf_dir)
    mine = _rows(df.columns, df.collect())
    result = con.sql(ORACLES[name])
    if sorted(df.columns) != sorted(result.columns):
        return f"columns {sorted(df.columns)} and {sorted(result.columns)}"
    theirs = _rows(result.columns, result.fetchall())
    if len(mine) != len(theirs):
        return f"{len(mine)} rows and {len(theirs)}"
    for a, b in zip(mine, theirs):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{a!r} and {b!r}"
    return None


def main(sf_dir: str, names: list[str]) -> int:
    spark, con, failed = session(), connect(sf_dir), 0
    spark.sparkContext.setLogLevel("OFF")
    for name in names or list(QUERIES):
        started = time.monotonic()
        try:
            problem = compare(spark, con, sf_dir, name) if name in ORACLES else "no SQL"
        except Exception as e:  # noqa: BLE001 - report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'DIFF'} {name} {time.monotonic() - started:.1f}s {problem or ''}"[:900], flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
