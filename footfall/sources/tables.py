"""Tables that are divided by the keys they are joined on.

They are external tables of the session's catalog, declared anew where the catalog does not know
them; Spark divides their rows into buckets by a hash of the keys, and joins on these keys read
matching buckets side by side, without a shuffle. A bucket is written, and joined, by one task, so a new
table has the more buckets the larger its first input is. Lines are kept by part and day: part ``n`` holds
what run ``n`` took in, part ``-1 - n`` what all runs up to ``n`` took in of a day. Which of a day's parts count
is told by the recorded folds: the latest fold and the runs after it. Parts that a fold has replaced
are taken away one fold or run later, so that a reader sees either.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable
from datetime import date
from hashlib import md5

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from footfall.config import Settings
from footfall.schemas import FOLDS, PARSED
from footfall.sources.files import listed_bytes, made, removed, stored

# How many bytes of its first input a bucket of a new table holds.
BUCKET_BYTES = 32 * 1024 * 1024

KEYS = {"access": ("session_id", "time", "requested_page_id"), "runtime": ("session_id", "time", "page_id")}
LAYOUT = StructType([StructField("buckets", LongType())])


class Divided:
    """A table in buckets, with partitions of which the first is given by whoever writes.

    It has ``buckets`` of them, or more if there are more than ``BUCKET_BYTES`` of input for each when it is new.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, partitions: tuple[str, str], keys: tuple[str, ...],
                 buckets: int, input_bytes: Callable[[], int]):
        self.spark = spark
        self.path = path
        self.schema = schema
        self.partitions = partitions
        self.keys = keys
        self.name = f"footfall_{md5(path.encode()).hexdigest()}"
        self.buckets = self._layout(buckets, input_bytes)
        self._declare()

    def _layout(self, buckets: int, input_bytes: Callable[[], int]) -> int:
        """How many buckets the table has; as many as its input asks for when it is new."""
        path = f"{self.path}_layout"
        found = stored(self.spark, path, LAYOUT).first()
        if found is not None:
            return found["buckets"]
        buckets = max(buckets, -(-input_bytes() // BUCKET_BYTES))
        self.spark.createDataFrame([(buckets,)], LAYOUT).coalesce(1).write.mode("overwrite").parquet(path)
        return buckets

    def _declare(self) -> None:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema)
        partitions, keys = (", ".join(f"`{c}`" for c in names) for names in (self.partitions, self.keys))
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}) USING parquet PARTITIONED BY ({partitions}) "
            f"CLUSTERED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )
        made(self.spark, self.path)
        self.spark.sql(f"MSCK REPAIR TABLE {self.name} SYNC PARTITIONS")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def replace(self, rows: DataFrame, first: str, mode: str = "static") -> None:
        """Puts the rows in place of all partitions whose first column has that value, a literal.

        With ``mode`` dynamic only partitions that the rows are in are replaced, and the rows may be the table's own.
        """
        columns = [c for c in self.schema.names if c != self.partitions[0]]
        view = f"{self.name}_rows"
        rows.select(*columns).repartition(self.buckets, *self.keys).createOrReplaceTempView(view)
        names = ", ".join(f"`{c}`" for c in columns)
        spec = f"`{self.partitions[0]}` = {first}, `{self.partitions[1]}`"
        before = self.spark.conf.get("spark.sql.sources.partitionOverwriteMode")
        self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)
        try:
            self.spark.sql(f"INSERT OVERWRITE TABLE {self.name} PARTITION ({spec}) SELECT {names} FROM {view}")
        finally:
            self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
            self.spark.catalog.dropTempView(view)

    def listed(self) -> list[tuple[str, str]]:
        """The values of the partitions there are, as text."""
        found = (r[0].split("/") for r in self.spark.sql(f"SHOW PARTITIONS {self.name}").collect())
        return [(a.split("=", 1)[1], b.split("=", 1)[1]) for a, b in found]

    def remove(self, first: str, second: str) -> None:
        a, b = self.partitions
        self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION (`{a}` = '{first}', `{b}` = '{second}')")
        removed(self.spark, f"{self.path}/{a}={first}/{b}={second}")


class Lines:
    """The parsed lines of a log that can be used, by part and day."""

    def __init__(self, spark: SparkSession, settings: Settings, log: str):
        self.spark = spark
        self.settings = settings
        self.log = log
        fields = [f for f in PARSED[log].fields if f.name != "event_date"]
        schema = StructType([*fields, StructField("part", LongType()), PARSED[log]["event_date"]])
        # Both logs have as many, as they are joined.
        paths = (*settings.access_logs, *settings.runtime_logs)
        self.table = Divided(
            spark, f"{settings.parsed}/{log}", schema, ("part", "event_date"), KEYS[log], settings.buckets,
            lambda: listed_bytes(spark, paths),
        )

    def add(self, lines: DataFrame, run: int) -> None:
        """Stores the lines that a run took in; replaces what it has stored before."""
        self.table.replace(lines, str(run))

    def folds(self, days: Iterable[date] | None = None) -> DataFrame:
        """By day, up to which run its lines are folded."""
        found = stored(self.spark, f"{self.settings.state}/folds", FOLDS).where(F.col("log") == self.log)
        if days is not None:
            found = found.where(F.col("event_date").isin(list(days)))
        return found.groupBy("event_date").agg(F.max("high").alias("high"))

    def _live(self, days: Iterable[date] | None) -> DataFrame:
        rows = self.table.rows()
        part, high = F.col("part"), F.coalesce("high", F.lit(-1))
        if days is None:
            # There is one fold a day.
            rows = rows.join(F.broadcast(self.folds()), "event_date", "left")
            return rows.where((part >= 0) & (part > high) | (high >= 0) & (part == -1 - high))
        folded = dict(tuple(r) for r in self.folds(days).collect())
        by_high = defaultdict(list)
        for day in days:
            by_high[folded.get(day)].append(day)
        live = F.lit(False)
        for high, own in by_high.items():
            counts = part >= 0 if high is None else (part > high) | (part == -1 - high)
            live |= F.col("event_date").isin(own) & counts
        return rows.where(live)

    def read(self, days: Iterable[date] | None = None) -> DataFrame:
        """All lines, or those of some days, of which only these days' parts are read."""
        return self._live(days).select(*PARSED[self.log].names)

    def parts(self) -> dict[date, list[int]]:
        """By day, the parts there are, those that no longer count among them."""
        found = defaultdict(list)
        for part, day in self.table.listed():
            found[date.fromisoformat(day)].append(int(part))
        return found

    def fold(self, days: list[date], run: int) -> list[date]:
        """Puts the lines that earlier runs took in of those days into one part, where they lie in too many; returns these days."""
        folded = dict(tuple(r) for r in self.folds(days).collect())
        parts = self.parts()

        def closed(day: date) -> int:
            high = folded.get(day, -1)
            return sum(high < p < run for p in parts.get(day, ())) + (high >= 0)

        many = sorted(d for d in days if closed(d) > self.settings.parts_per_day)
        if many:
            self.table.replace(self._live(many).where(F.col("part") < run), str(-run), "dynamic")
            record = self.spark.createDataFrame([(d, run - 1) for d in many], "event_date date, high long")
            record.coalesce(1).write.mode("overwrite").parquet(f"{self.settings.state}/folds/log={self.log}/run={run}")
        return many

    def remove_folded(self, run: int) -> None:
        """Takes away the parts that folds of runs before this one have replaced."""
        before = stored(self.spark, f"{self.settings.state}/folds", FOLDS).where((F.col("log") == self.log) & (F.col("run") < run))
        folded = dict(tuple(r) for r in before.groupBy("event_date").agg(F.max("high")).collect())
        if not folded:
            return
        for part, day in self.table.listed():
            high = folded.get(date.fromisoformat(day))
            if high is not None and (0 <= int(part) <= high or -1 - high < int(part) < 0):
                self.table.remove(part, day)
