"""From an object id to the value the database holds for it."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import cached_property, reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession, functions as F

from footfall.config import Limits
from footfall.operators.lookup import Lookup, Sizes, row_bytes, shuffled_join
from footfall.sources.dumps import cell_place, dump_columns, dump_values, object_cells, object_values, one_row_per_object
from footfall.sources.valuestore import ValueStore

KEYS = ["oid", "value_table", "value_column"]


Name = tuple[str, str]


def headers(dumps: Mapping[str, DataFrame]) -> dict[str, dict[str, str]]:
    """By dump, its columns by their names in upper case."""
    return {table: {c.upper(): c for c in dump_columns(dump)} for table, dump in dumps.items()}


Headers = Mapping[str, Mapping[str, str]]


def displayed_columns(dumps: Mapping[str, DataFrame], shown: DataFrame) -> dict[Name | None, tuple[int, int]]:
    """Rows and bytes of ``shown``, the model's displayed attributes, by the (table, column) they name.

    Names that the dumps do not have count together as None, so there are no more than the dumps
    have columns, and one.
    """
    return displayed_names(headers(dumps), shown)


def displayed_names(headers: Headers, shown: DataFrame) -> dict[Name | None, tuple[int, int]]:
    table, column = F.upper("table_db"), F.upper("attribute_database_column")
    known = [table.isin(t.upper()) & column.isin(*names) for t, names in headers.items()]
    name = F.when(reduce(or_, known, F.lit(False)), F.struct(table.alias("t"), column.alias("c")))
    rows = shown.groupBy(name.alias("name")).agg(F.count(F.lit(1)), F.sum(row_bytes(shown))).collect()
    return {None if name is None else tuple(name): (count, total) for name, count, total in rows}


def needed_columns(dumps: Mapping[str, DataFrame], names: Iterable[Name | None]) -> dict[str, list[str]]:
    """Per dump, those of its columns that are named. The CSV scans read them and no others."""
    return named_columns(headers(dumps), names)


def named_columns(headers: Headers, names: Iterable[Name | None]) -> dict[str, list[str]]:
    found = set(names)
    return {t: [name for upper, name in columns.items() if (t.upper(), upper) in found] for t, columns in headers.items()}


class StoredValues:
    """One value per object and displayed column of the dumps; of several, the smallest.

    ``names`` gives the displayed (table, column). ``listed`` gives the bytes of the dumps' files, if
    they are files: dumps that are small by that need not be counted.
    """

    def __init__(
        self,
        spark: SparkSession,
        dumps: Mapping[str, DataFrame],
        names: Callable[[], Iterable[Name | None]],
        limits: Limits,
        listed: Callable[[], int | None] = lambda: None,
    ):
        self.spark = spark
        self.dumps = dumps
        self.names = names
        self.limits = limits
        self.listed = listed

    @cached_property
    def columns(self) -> dict[str, list[str]]:
        """By dump, the columns to read; only dumps with any."""
        return {t: names for t, names in needed_columns(self.dumps, self.names()).items() if names}

    @cached_property
    def objects(self) -> dict[str, DataFrame]:
        return {t: one_row_per_object(self.dumps[t], names) for t, names in self.columns.items()}

    @cached_property
    def is_small(self) -> bool:
        """Whether all values of the needed columns may be broadcast."""
        listed = self.listed()
        # A value takes a byte and a separator at least.
        if listed is not None and listed <= min(self.limits.broadcast_bytes, 2 * self.limits.broadcast_rows):
            return True
        read = Sizes(lambda: {t: self.dumps[t].select(*[f"`{c}`" for c in names]) for t, names in self.columns.items()})
        values = sum(rows * len(self.columns[t]) for t, (rows, _) in read.measured.items())
        return values <= self.limits.broadcast_rows and read.within(self.limits)

    def lookup(self, keys: Callable[[], DataFrame]) -> Lookup:
        """What to join facts with whose (object, table, column) are among ``keys``.

        Small dumps are broadcast as they are. Larger ones are joined with the facts object by object,
        so that finding the keys does not describe the facts once more.
        """
        if self.is_small:
            return Lookup(dump_values(self.spark, self.objects, self.columns), KEYS, self.limits, small=lambda: True)
        return ObjectLookup(self, keys)


class ObjectLookup(Lookup):
    """Values of dumps that are too large to be broadcast; ``frame`` has those of the ``keys`` alone."""

    def __init__(self, stored: StoredValues, keys: Callable[[], DataFrame]):
        self.stored = stored
        self.named = keys
        self.keys = KEYS
        self.limits = stored.limits

    @cached_property
    def frame(self) -> DataFrame:
        return object_values(self.stored.spark, self.stored.objects, self.stored.columns, self.named())

    @property
    def is_small(self) -> bool:
        return False

    def join(self, facts: DataFrame, how: str) -> DataFrame:
        """``facts`` with the values of their keys, null if there is none; ``how`` is ``left``.

        An object's cells come as a list, of which each fact takes its own. Facts that name no cell are spread.
        """
        if how != "left":
            raise ValueError(f"values are joined left, not {how}")
        place = cell_place(self.stored.columns)
        known = F.col("_cell").isNotNull()
        placed = facts.withColumn("_cell", place)
        placed = placed.withColumn("_object", F.when(known, F.col("oid"))).withColumn("_dump", F.when(known, F.col("value_table")))
        objects = object_cells(self.stored.spark, self.stored.objects, self.stored.columns)
        joined = shuffled_join(placed, objects, ["_object", "_dump"], how)
        return joined.withColumn("value", F.get("_cells", F.col("_cell"))).drop("_cell", "_cells", "_object", "_dump")


class KeptValues:
    """The same from a store that is kept by table and column, in buckets of the keys."""

    def __init__(self, store: ValueStore, names: Callable[[], Iterable[Name | None]], limits: Limits):
        self.store = store
        self.names = names
        self.limits = limits

    @cached_property
    def columns(self) -> dict[str, list[str]]:
        return {t: names for t, names in named_columns(self.store.headers, self.names()).items() if names}

    @cached_property
    def is_small(self) -> bool:
        """Whether the tables with needed columns may be broadcast; their sizes were stored with them."""
        values, total = self.store.size(self.columns)
        return values <= self.limits.broadcast_rows and total <= self.limits.broadcast_bytes

    def lookup(self, keys: Callable[[], DataFrame]) -> Lookup:
        """What to join facts with: small values as they are, else those of the different ``keys``, found bucket by bucket."""
        values = self.store.values(self.columns)
        if self.is_small:
            return Lookup(values, KEYS, self.limits, small=lambda: True)
        return Lookup(keys().join(values, KEYS).select(*values.columns), KEYS, self.limits, small=lambda: False)


def clicked_keys(hits: DataFrame) -> DataFrame:
    """The different (object, table, column) that clicks refer to."""
    return (
        hits.where(F.col("clicked_oid") != 0)
        .select(
            F.col("clicked_oid").alias("oid"),
            F.upper("clicked_table").alias("value_table"),
            F.upper("clicked_column").alias("value_column"),
        )
        .distinct()
    )


def displayed_keys(shown: DataFrame) -> DataFrame:
    """The different (object, table, column) that shown objects refer to."""
    return shown.select(
        "oid",
        F.upper("table_db").alias("value_table"),
        F.upper("attribute_database_column").alias("value_column"),
    ).distinct()


def lookup_keys(hits: DataFrame, shown: DataFrame) -> DataFrame:
    return clicked_keys(hits).union(displayed_keys(shown)).distinct()


def oid_values(keys: DataFrame, stored: StoredValues | KeptValues) -> DataFrame:
    """Each key with its value; null if the dumps have none."""
    return stored.lookup(lambda: keys).join(keys, "left")


def clicked_values(hits: DataFrame, lookup: Lookup, one_table: bool = True) -> DataFrame:
    """Hits with the column and the value of the clicked object.

    The table does not stay. Where an entity has one column in several tables, hits that only
    differed in it are made one again; ``one_table`` says that the model has no such entity.
    """
    keyed = (
        hits.withColumn("oid", F.when(F.col("clicked_oid") != 0, F.col("clicked_oid")))
        .withColumn("value_table", F.upper("clicked_table"))
        .withColumn("value_column", F.upper("clicked_column"))
    )
    known = F.col("oid").isNotNull() & F.col("clicked_table").isNotNull()
    valued = (
        lookup.join(keyed, "left")
        .withColumn("clicked_type_oid", F.when(known, F.col("clicked_column")))
        .withColumnRenamed("value", "clicked_oid_value")
        .drop("oid", "value_table", "value_column", "clicked_table", "clicked_column")
    )
    return valued if one_table else valued.distinct()


def displayed_values(shown: DataFrame, lookup: Lookup) -> DataFrame:
    """Shown objects with the value of each displayed attribute."""
    keyed = shown.withColumn("value_table", F.upper("table_db")).withColumn(
        "value_column", F.upper("attribute_database_column")
    )
    known = F.col("table_db").isNotNull()
    return (
        lookup.join(keyed, "left")
        .withColumn("displayed_oid", F.when(known, F.col("oid")))
        .withColumn("displayed_type_oid", F.when(known, F.col("attribute_database_column")))
        .withColumnRenamed("value", "displayed_oid_value")
        .drop("value_column")
        .withColumn("value_table", F.col("table_db"))
    )
