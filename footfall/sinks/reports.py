"""Writing reports as Parquet, CSV and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType


def write_parquet(report: DataFrame, path: str) -> DataFrame:
    """Stores the report and returns it as read back, so that it is computed once."""
    report.write.mode("overwrite").parquet(path)
    return report.sparkSession.read.schema(report.schema).parquet(path)


def write_csv(report: DataFrame, path: str, single_file: bool = False) -> None:
    """Semicolon-separated with a header; lists as JSON text, as CSV has none.

    ``single_file`` has one task write the whole report, which should be a stored one.
    """
    columns = [
        F.to_json(f.name).alias(f.name) if isinstance(f.dataType, ArrayType) else F.col(f.name)
        for f in report.schema.fields
    ]
    rows = report.select(*columns)
    (rows.coalesce(1) if single_file else rows).write.mode("overwrite").csv(path, sep=";", header=True)


def write_json(report: DataFrame, path: str, single_file: bool = False) -> None:
    (report.coalesce(1) if single_file else report).write.mode("overwrite").json(path)
