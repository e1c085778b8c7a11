"""The two server logs and what is stored of them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from footfall.schemas import LINE_COUNTS, QUARANTINED, STORED
from footfall.sources.files import present, stored


def read_lines(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """Text lines as column ``value``, of all paths and globs that lead to files.

    If none does, this gives an error, as Spark does.
    """
    return spark.read.text(present(spark, paths))


def read_enriched(spark: SparkSession, path: str) -> DataFrame:
    """The enriched log so far; no rows before the first batch."""
    return stored(spark, path, STORED)


def read_line_counts(spark: SparkSession, path: str) -> DataFrame:
    """What became of the lines of each batch."""
    counts = stored(spark, path, LINE_COUNTS)
    sums = [F.sum(c).alias(c) for c in ("lines", "bad_dates", "bad_objects")]
    return counts.groupBy("log", "shape", "batch").agg(*sums).select("log", "shape", "lines", "bad_dates", "bad_objects", "batch")


def read_quarantined(spark: SparkSession, path: str, again: int) -> DataFrame:
    """The lines that could not be used: ``value``, ``shape``, ``file``, ``batch`` and ``log``.

    ``again`` is the last run that has tried all of them again; what earlier ones stored does not count any more.
    """
    return stored(spark, path, QUARANTINED).where(F.col("run") >= again).drop("run")
