"""What runs have done: files taken in, parts folded, runs completed.

Each run writes its own part and counts once it is recorded as completed, which it does last of all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from footfall.schemas import RUNS, TAKEN
from footfall.sources.files import ORIGIN, stored
from footfall.sources.intake import is_usable


def usable(parsed: DataFrame) -> DataFrame:
    """The lines that fit a shape and have a date."""
    return parsed.where(is_usable())


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The completed runs; none before the first one."""
    return stored(spark, f"{path}/runs", RUNS)


def next_run(spark: SparkSession, path: str) -> int:
    return read_runs(spark, path).agg(F.coalesce(F.max("run") + 1, F.lit(0))).first()[0]


def save_run(spark: SparkSession, path: str, run: int, kind: str) -> None:
    """Completes a run: what it wrote counts from now on."""
    spark.createDataFrame([(kind,)], "kind string").coalesce(1).write.mode("overwrite").parquet(f"{path}/runs/run={run}")


def read_taken(spark: SparkSession, path: str) -> DataFrame:
    """The files of all completed runs; no rows before the first one."""
    done = next_run(spark, path)
    return stored(spark, f"{path}/taken", TAKEN).where(F.col("run") < done)


def save_taken(lines: DataFrame, path: str, log: str, run: int) -> None:
    """Records the files that lines are from."""
    lines.select(*ORIGIN).distinct().write.mode("overwrite").parquet(f"{path}/taken/log={log}/run={run}")
