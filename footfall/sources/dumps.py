"""Database dumps: one CSV file per table, all values as text, key column OID."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from footfall.schemas import VALUE
from footfall.sources.files import exists

KEY = "OID"
TABLE = "table_name"


def read_dump(spark: SparkSession, path: str, table: str) -> DataFrame:
    """The rows of ``table`` with its name as an extra column."""
    return spark.read.csv(path, sep=";", header=True).withColumn(TABLE, F.lit(table))


def read_dumps(spark: SparkSession, folder: str, tables: Iterable[str]) -> dict[str, DataFrame]:
    """All tables that are there; a table without a file is left out."""
    paths = {table: f"{folder}/{table}.csv" for table in tables}
    return {table: read_dump(spark, path, table) for table, path in paths.items() if exists(spark, path)}


def dump_columns(dump: DataFrame) -> list[str]:
    return [c for c in dump.columns if c != TABLE]


def _key(dump: DataFrame) -> Column:
    """The object id; null where the dump has none or no number."""
    name = next(c for c in dump.columns if c.upper() == KEY)
    return F.col(f"`{name}`").try_cast("bigint")


def one_row_per_object(dump: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` by object id; of an object's several values, the smallest."""
    smallest = [F.min(f"`{c}`").alias(c) for c in columns if c.upper() != KEY]
    return dump.groupBy(_key(dump).alias(KEY)).agg(F.count(F.lit(1)).alias("_rows"), *smallest)


def dump_values(
    spark: SparkSession, dumps: Mapping[str, DataFrame], columns: Mapping[str, list[str]]
) -> DataFrame:
    """The values of ``columns`` as rows (``oid``, ``value_table``, ``value_column``, ``value``).

    Table and column names are in upper case, the way the joins compare them.
    """
    parts = [_values(table, dump, columns[table]) for table, dump in dumps.items()]
    return reduce(DataFrame.unionByName, parts, spark.createDataFrame([], VALUE))


def object_values(
    spark: SparkSession, rows_by_object: Mapping[str, DataFrame], columns: Mapping[str, list[str]], keys: DataFrame
) -> DataFrame:
    """The values of ``keys`` (``oid``, ``value_table``, ``value_column``), as far as the dumps have them.

    A dump of one row per object is joined with the keys that name it; no dump row is unpivoted.
    """
    parts = [spark.createDataFrame([], VALUE)]
    for table, dump in rows_by_object.items():
        names = {c: KEY if c.upper() == KEY else c for c in columns[table]}
        # Under names of their own, as a dump may have columns of any name.
        cells = [F.col(f"`{name}`").cast("string").alias(f"_cell{i}") for i, name in enumerate(names.values())]
        objects = dump.select(F.col(KEY).alias("_object"), *cells)
        own = keys.where(F.col("value_table") == table.upper())
        value = F.coalesce(*[F.when(F.col("value_column") == c.upper(), F.col(f"_cell{i}")) for i, c in enumerate(names)])
        found = own.join(objects, F.col("oid") == F.col("_object")).withColumn("value", value)
        parts.append(found.where(F.col("value").isNotNull()).select(*VALUE.names))
    return reduce(DataFrame.unionByName, parts)


CELLS = "_object long, _dump string, _cells array<string>"


def cell_place(columns: Mapping[str, list[str]]) -> Column:
    """Where a dump's list of cells has the column that ``value_table`` and ``value_column`` name; null if none does."""
    places = [
        F.when((F.col("value_table") == table.upper()) & (F.col("value_column") == c.upper()), i)
        for table, names in columns.items()
        for i, c in enumerate(names)
    ]
    return F.coalesce(*places, F.lit(None).cast("int"))


def object_cells(
    spark: SparkSession, rows_by_object: Mapping[str, DataFrame], columns: Mapping[str, list[str]]
) -> DataFrame:
    """One row per object and dump with the list of its ``columns``, in their order; no dump row is unpivoted."""
    parts = [spark.createDataFrame([], CELLS)]
    for table, dump in rows_by_object.items():
        names = [KEY if c.upper() == KEY else c for c in columns[table]]
        row = F.array(*[F.col(f"`{name}`").cast("string") for name in names])
        rows = dump.select(F.col(KEY).alias("_object"), F.lit(table.upper()).alias("_dump"), row.alias("_cells"))
        parts.append(rows.where(F.col("_object").isNotNull()))
    return reduce(DataFrame.unionByName, parts)


def _values(table: str, dump: DataFrame, columns: list[str]) -> DataFrame:
    cells = [
        F.struct(
            F.lit(c.upper()).alias("value_column"),
            (_key(dump) if c.upper() == KEY else F.col(f"`{c}`")).cast("string").alias("value"),
        )
        for c in columns
    ]
    return (
        dump.select(_key(dump).alias("oid"), F.inline(F.array(*cells)))
        .where(F.col("oid").isNotNull() & F.col("value").isNotNull())
        .select("oid", F.lit(table.upper()).alias("value_table"), "value_column", "value")
    )
