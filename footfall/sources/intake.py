"""Log files on their way in.

New files are found by Spark's file source, whose log in the checkpoint folder knows every file it has
read, and parsed into a staged table whose sink records what was committed: each file's lines are
staged exactly once, in steps of a bounded number of files, whatever fails in between. A step that
fails is done again with the same files by the next run. Files that have changed since, for instance
grown, are read again as they are now; equal events count once later.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from datetime import datetime
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from footfall.config import Settings
from footfall.schemas import LINE, STAGED
from footfall.sources.files import ORIGIN, listed, literal, one_glob, origin, removed, stored

Parser = Callable[..., DataFrame]
# The file source forgets files of an older age than this and would take no notice of late ones.
NEVER = "36500d"


def is_usable() -> Column:
    return F.col("shape").isNotNull() & F.col("time").isNotNull()


def _parsed(lines: DataFrame, parse: Parser, run: int) -> DataFrame:
    """The fields of lines, the text of those that cannot be used, and where they are from."""
    parsed = parse(lines, keep=("value", *ORIGIN))
    value = F.when(~is_usable(), F.col("value"))
    return parsed.withColumn("value", value).withColumn("run", F.lit(run).cast("bigint"))


def stage_new(spark: SparkSession, settings: Settings, log: str, parse: Parser, run: int) -> None:
    """Stages the lines of files that were not there before."""
    lines = (
        spark.readStream.format("text")
        .schema(LINE)
        .option("maxFilesPerTrigger", settings.files_per_batch)
        .option("maxFileAge", NEVER)
        .load(one_glob(settings.logs[log]))
        .select("value", *origin())
    )
    query = (
        _parsed(lines, parse, run)
        .writeStream.format("parquet")
        .option("path", f"{settings.staged}/new/{log}")
        .option("checkpointLocation", f"{settings.state}/intake/{log}")
        .partitionBy("run")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _chunks(rows: Iterator, size: int) -> Iterator[list]:
    while chunk := list(islice(rows, size)):
        yield chunk


def changed_files(spark: SparkSession, settings: Settings, log: str, known: DataFrame, before: datetime) -> DataFrame:
    """The files that differ from what is ``known`` of them, as they were before that moment.

    Later ones may be new, and are left to the file source.
    """
    found = listed(spark, settings.logs[log]).where(F.col("modified") <= F.lit(before))
    return found.join(known.select(*ORIGIN), list(ORIGIN), "left_anti")


def stage_changed(spark: SparkSession, settings: Settings, log: str, parse: Parser, run: int, files: DataFrame) -> None:
    """Stages the lines of files as they are now, some files at a time; replaces what a failed run has staged of such."""
    folder = f"{settings.staged}/changed/{log}/run={run}"
    removed(spark, folder)
    paths = (r["path"] for r in files.sort("path").toLocalIterator())
    for number, chunk in enumerate(_chunks(paths, settings.files_per_batch)):
        lines = spark.read.text([literal(p) for p in chunk]).select("value", *origin())
        _parsed(lines, parse, run).drop("run").write.mode("overwrite").parquet(f"{folder}/part={number}")


def staged(spark: SparkSession, settings: Settings, log: str, run: int) -> DataFrame:
    """The lines that a run has staged."""
    both: Iterable[DataFrame] = (
        stored(spark, f"{settings.staged}/{kind}/{log}", STAGED[log]) for kind in ("new", "changed")
    )
    new, changed = (rows.where(F.col("run") == run).select(*STAGED[log].names) for rows in both)
    return new.unionByName(changed)


def remove_staged(spark: SparkSession, settings: Settings, log: str, run: int) -> None:
    """Takes away what a completed run has staged."""
    for kind in ("new", "changed"):
        removed(spark, f"{settings.staged}/{kind}/{log}/run={run}")
