"""What is kept by day: the enriched log, and what reports need of it."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BooleanType, DateType, StructField, StructType

from footfall.functions.text import day_of
from footfall.sources.files import stored

# False in the row that stands for a day without rows, which is how a day's rows are taken away.
PRESENT = "present"


def write_days(rows: DataFrame, path: str, *order: str, days: Iterable[date] | None = None) -> None:
    """Replaces the days that the rows are on; other days stay.

    Rows have an ``event_date``. Files are balanced over days, and sorted within by ``order``. With
    ``days``, all of these are replaced, also those without rows, and the table is read by ``read_days``.
    """
    if days is not None:
        marks = rows.sparkSession.createDataFrame([(d, False) for d in days], f"event_date date, {PRESENT} boolean")
        rows = rows.withColumn(PRESENT, F.lit(True)).unionByName(marks, allowMissingColumns=True)
    (
        rows.hint("rebalance", "event_date")
        .sortWithinPartitions("event_date", *order)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("event_date")
        .parquet(path)
    )


def read_days(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows that ``write_days`` has stored; ``schema`` is without the day, which comes last."""
    fields = [*schema.fields, StructField(PRESENT, BooleanType()), StructField("event_date", DateType())]
    return stored(spark, path, StructType(fields)).where(PRESENT).drop(PRESENT)


def write_enriched(enriched: DataFrame, path: str) -> None:
    write_days(enriched.withColumn("event_date", day_of("time")), path, "session_id", "time")


def on_days(rows: DataFrame, days: list[date]) -> DataFrame:
    """The rows of stored days; only their folders are read."""
    return rows.where(F.col("event_date").isin(days))
