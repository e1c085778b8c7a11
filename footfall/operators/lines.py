"""What became of log lines: which shape they fit, and what of them could not be used."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def count_lines(parsed: DataFrame, log: str, by: Sequence[str] = ()) -> DataFrame:
    """Per shape the lines, those without a possible date, and the objects that are no number.

    Shape 0 holds the lines no shape fits. Lines of a shape with a date are used, all others are not.
    ``by`` names further columns to count by.
    """
    if log == "access":
        bad = F.when(F.col("shape").isin(1, 2) & F.col("clicked_oid").isNull(), 1).otherwise(0)
    else:
        bad = F.when(F.col("oids").isNotNull(), F.size(F.filter("oids", F.isnull))).otherwise(0)
    return parsed.groupBy(F.coalesce("shape", F.lit(0)).alias("shape"), *by).agg(
        F.count(F.lit(1)).alias("lines"),
        F.count(F.when(F.col("shape").isNotNull() & F.col("time").isNull(), 1)).alias("bad_dates"),
        F.sum(bad).alias("bad_objects"),
    ).select(F.lit(log).alias("log"), "shape", *by, "lines", "bad_dates", "bad_objects")


def count_shapes(parsed: DataFrame) -> DataFrame:
    """Lines per shape; shape 0 holds the lines no shape fits."""
    return parsed.groupBy(F.coalesce("shape", F.lit(0)).alias("shape")).agg(F.count(F.lit(1)).alias("lines"))
