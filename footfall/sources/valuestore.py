"""The dumped values as a table in buckets of (object, table, column), kept from run to run.

A dump is parsed again only when its files have changed; its values then take the place of the
earlier ones. The smallest of an object's several values is kept, as in the dumps themselves.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from footfall.config import Settings
from footfall.schemas import STORED_DUMPS, VALUE
from footfall.sources.dumps import dump_columns, dump_values, one_row_per_object, read_dump
from footfall.sources.files import listed, listed_bytes, removed, stored
from footfall.sources.tables import Divided

KEYS = ("oid", "value_table", "value_column")
TABLE = StructType([*VALUE.fields, StructField("dump", StringType()), StructField("name", StringType())])


class ValueStore:
    def __init__(self, spark: SparkSession, settings: Settings):
        self.spark = spark
        self.settings = settings
        dumps = lambda: listed_bytes(spark, self._paths().values())
        self.table = Divided(spark, settings.values, TABLE, ("dump", "name"), KEYS, settings.buckets, dumps)
        self.state = f"{settings.state}/dumps"

    def _paths(self) -> dict[str, str]:
        return {table: f"{self.settings.dumps}/{table}.csv" for table in self.settings.dump_tables}

    def files(self) -> dict[str, int]:
        """By dumped table that is there, a hash of the names, sizes and times of its files, listed once."""
        found = listed(self.spark, self._paths().values())
        table = F.regexp_extract("path", r"/([^/]+)\.csv(?:/[^/]*)?$", 1)
        hashes = found.groupBy(table.alias("table")).agg(F.bit_xor(F.xxhash64("file", "length", "modified")).alias("files"))
        return {r["table"]: r["files"] for r in hashes.collect()}

    def refresh(self) -> list[str]:
        """Takes in the dumps that are new or have changed; returns their tables."""
        there = self.files()
        known = {r["dump"]: r["files"] for r in stored(self.spark, self.state, STORED_DUMPS).collect()}
        changed = sorted(t for t, files in there.items() if known.get(t) != files)
        for table in changed:
            self._replace(table, there[table])
        for table in sorted(set(known) - set(there)):
            removed(self.spark, f"{self.state}/dump={table}")
        self.__dict__.pop("dumps", None)
        return changed

    def _replace(self, table: str, files: int) -> None:
        dump = read_dump(self.spark, self._paths()[table], table)
        columns = dump_columns(dump)
        rows = dump_values(self.spark, {table: one_row_per_object(dump, columns)}, {table: columns})
        # The dump does not count while its values are replaced.
        removed(self.spark, f"{self.state}/dump={table}")
        self.table.replace(rows.withColumn("name", F.col("value_column")), f"'{table}'")
        own = self.table.rows().where(F.col("dump") == table)
        sizes = own.agg(F.count(F.lit(1)).alias("values"), F.coalesce(F.sum(self._bytes()), F.lit(0)).alias("bytes"))
        names = F.array(*[F.lit(c) for c in columns])
        record = sizes.select(F.lit(table.upper()).alias("value_table"), names.alias("columns"), "values", "bytes", F.lit(files).alias("files"))
        record.write.mode("overwrite").parquet(f"{self.state}/dump={table}")

    @staticmethod
    def _bytes() -> Column:
        return F.octet_length("value") + F.lit(16)

    @cached_property
    def dumps(self) -> dict[str, dict]:
        """By table, its columns and the number and bytes of its values."""
        return {r["dump"]: r.asDict() for r in stored(self.spark, self.state, STORED_DUMPS).collect()}

    @property
    def headers(self) -> dict[str, dict[str, str]]:
        """By table, its columns by their names in upper case."""
        return {table: {c.upper(): c for c in d["columns"]} for table, d in self.dumps.items()}

    def size(self, tables: Iterable[str]) -> tuple[int, int]:
        """Values and bytes of the tables."""
        own = [self.dumps[t] for t in tables]
        return sum(d["values"] for d in own), sum(d["bytes"] for d in own)

    def values(self, columns: dict[str, list[str]] | None = None) -> DataFrame:
        """The values of those columns by table, or all; others are not read."""
        if columns is None:
            columns = {t: d["columns"] for t, d in self.dumps.items()}
        wanted = F.lit(False)
        for table, names in columns.items():
            wanted |= (F.col("dump") == table) & F.col("name").isin([n.upper() for n in names])
        return self.table.rows().where(wanted).select(*VALUE.names)
