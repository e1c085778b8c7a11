"""What files there are below paths or globs."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

# Where a line or a file is from, as the file sources tell it.
ORIGIN = {"file": "file_path", "length": "file_size", "modified": "file_modification_time"}


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def present(spark: SparkSession, paths: Iterable[str]) -> list[str]:
    """The paths that lead to files; all of them if none does, for Spark to say so."""
    paths = list(paths)
    return [p for p in paths if exists(spark, p)] or paths


def one_glob(paths: Iterable[str]) -> str:
    """One glob for all that the paths and globs lead to; finding nothing is no error for a glob."""
    paths = list(dict.fromkeys(paths))
    if len(paths) == 1 and re.search(r"[\[{*?]", paths[0]):
        return paths[0]
    if any(mark in p for p in paths for mark in ",{}"):
        raise ValueError(f"paths with commas or braces cannot be read together: {paths}")
    common = 0
    while all(len(p) > common and p[common] == paths[0][common] for p in paths):
        common += 1
    folder = paths[0][: paths[0].rfind("/", 0, common) + 1]
    return folder + "{" + ",".join(p.removeprefix(folder) for p in paths) + "}"


def origin() -> list:
    """The hidden columns that say where a row was read."""
    return [F.col(f"_metadata.{field}").alias(name) for name, field in ORIGIN.items()]


def listed(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """``path``, ``file``, ``length`` and ``modified`` of the files that are not empty; their content is not read."""
    schema = "path string, file string, length long, modified timestamp"
    paths = list(paths)
    if not paths:
        return spark.createDataFrame([], schema)
    try:
        return spark.read.format("binaryFile").load(one_glob(paths)).select("path", *origin())
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def listed_bytes(spark: SparkSession, paths: Iterable[str]) -> int:
    """The bytes of the files that the paths and globs lead to."""
    return listed(spark, paths).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def literal(path: str) -> str:
    """A path as a glob that finds it alone."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def stored(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A Parquet table; no rows if there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def made(spark: SparkSession, path: str) -> None:
    """Makes a folder if there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)


def removed(spark: SparkSession, path: str) -> None:
    """Takes away a folder that holds nothing any more that is read."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
