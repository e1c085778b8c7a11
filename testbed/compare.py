"""Runs registered queries next to their SQL and compares the results.

    python -m testbed.compare [folder with the tables] [query ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

from footfall.config import SESSION
from testbed import oracle
from testbed.queries import queries


def session(cpus: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("footfall")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "8g")
        .config(map=SESSION)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _sorted(rows, names) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    picked = [tuple(row[i] for i in order) for row in rows]
    return sorted(picked, key=lambda row: tuple((v is None, str(v)) for v in row))


def difference(spark: SparkSession, con: duckdb.DuckDBPyConnection, sf_dir: str, name: str) -> str | None:
    """What is different, or None; values have to be equal, floating-point ones too."""
    frame = queries()[name](spark, sf_dir)
    got = _sorted([tuple(r) for r in frame.collect()], frame.columns)
    result = con.execute(oracle.oracle_sql()[name])
    names = [c[0] for c in result.description]
    want = _sorted(result.fetchall(), names)
    if sorted(frame.columns) != sorted(names):
        return f"columns {sorted(frame.columns)} instead of {sorted(names)}"
    if got == want:
        return None
    extra, missing = set(got) - set(want), set(want) - set(got)
    return (
        f"{len(got)} rows instead of {len(want)}; "
        f"extra {sorted(extra, key=str)[:2]}, missing {sorted(missing, key=str)[:2]}"
    )


def main(sf_dir: str, names: list[str]) -> int:
    spark, con = session(), database(sf_dir)
    failed = 0
    for name in names or queries():
        start = time.time()
        wrong = difference(spark, con, sf_dir, name)
        failed += wrong is not None
        rows = con.execute(f"SELECT count(*) FROM ({oracle.oracle_sql()[name]})").fetchall()[0][0]
        print(f"{name:24} {time.time() - start:6.2f} s {rows:7} rows  {wrong or 'ok'}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:]))
