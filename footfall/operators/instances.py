"""The values most often shown by a component or clicked through a link."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from footfall.functions.text import counted, unit_label

# What names an object, as attribute of the model and as database column; the text
# that stands for a missing value in a dump.
NAMING_ATTRIBUTES = ("name", "title", "category")
NAMING_COLUMNS = ("NAME", "TITLE", "CATEGORY")
NO_VALUE = "NULL"
TOP = 10


def _known(value: str) -> Column:
    return F.col(value).isNotNull() & (F.col(value) != NO_VALUE)


# The narrow extract of the log that the counts below need, for either kind of value.
EXTRACT = ("kind", "time", "session_id", "unit_id", "unit_name", "type", "value")
SHOWN = {
    "unit_id": "unit_id",
    "unit_name": "displayed_unit_name",
    "type": "displayed_attribute_name",
    "value": "displayed_oid_value",
}
CLICKED = {
    "unit_id": "clicked_link_id",
    "unit_name": "clicked_link_name",
    "type": "clicked_type_oid",
    "value": "clicked_oid_value",
}


def _is_shown() -> Column:
    return _known("displayed_oid_value") & F.col("displayed_attribute_name").isin(*NAMING_ATTRIBUTES)


def _is_clicked() -> Column:
    return (
        _known("clicked_oid_value")
        & F.col("clicked_link_name").isNotNull()
        & F.col("clicked_type_oid").isin(*NAMING_COLUMNS)
    )


def extract(log: DataFrame, *keep: str) -> DataFrame:
    """The different shown and clicked naming values of a second, in one pass over the log."""

    def part(kind: str, wanted: Column, names: dict[str, str]) -> Column:
        fields = F.struct(F.lit(kind).alias("kind"), *[F.col(c).alias(name) for name, c in names.items()])
        return F.when(wanted, fields)

    both = F.array(part("shown", _is_shown(), SHOWN), part("clicked", _is_clicked(), CLICKED))
    rows = log.select(*keep, "time", "session_id", F.inline(F.array_compact(both)))
    return rows.select(*keep, *EXTRACT).distinct()


def shown_values(extracted: DataFrame, *keep: str) -> DataFrame:
    return _named(extracted, "shown", SHOWN, keep)


def clicked_values(extracted: DataFrame, *keep: str) -> DataFrame:
    return _named(extracted, "clicked", CLICKED, keep)


def _named(extracted: DataFrame, kind: str, names: dict[str, str], keep: Sequence[str]) -> DataFrame:
    rows = extracted.where(F.col("kind") == kind)
    return rows.select("time", "session_id", *[F.col(name).alias(c) for name, c in names.items()], *keep)


def _count(
    events: DataFrame, once: list[str], unit: tuple[str, str], value: str, merge_sessions: bool, by: Sequence[str]
) -> DataFrame:
    session = [] if merge_sessions else ["session_id"]
    return (
        events.select("time", *session, *unit, value, *once, *by)
        .distinct()
        .groupBy(*unit, F.col(value).alias("value"), *by)
        .agg(F.count(F.lit(1)).alias("n"))
    )


SHOWN_UNIT = ("unit_id", "displayed_unit_name")
CLICKED_UNIT = ("clicked_link_id", "clicked_link_name")


def displayed_counts(log: DataFrame, merge_sessions: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """How often each component showed each naming value; once per session, second and attribute.

    ``by`` names further columns to count by. Counts by day add up, as a second is on one day.
    """
    shown = log.where(_is_shown())
    return _count(shown, ["displayed_attribute_name"], SHOWN_UNIT, "displayed_oid_value", merge_sessions, by)


def clicked_counts(log: DataFrame, merge_sessions: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """How often each named link was clicked on each naming value; once per session, second and column."""
    clicked = log.where(_is_clicked())
    return _count(clicked, ["clicked_type_oid"], CLICKED_UNIT, "clicked_oid_value", merge_sessions, by)


def top_displayed(counts: DataFrame) -> DataFrame:
    return _top(counts, SHOWN_UNIT, "top10_displayed_instances")


def top_clicked(counts: DataFrame) -> DataFrame:
    return _top(counts, CLICKED_UNIT, "top10_clicked_instances")


def _top(counts: DataFrame, unit: tuple[str, str], name: str) -> DataFrame:
    """The ``TOP`` values of each unit as ``value: count``, most frequent first, then by value.

    The rank limit is applied before the shuffle as well, so a unit with very many values sends
    ten per task.
    """
    order = Window.partitionBy(*unit).orderBy(F.col("n").desc(), F.col("value"))
    best = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    entries = F.sort_array(F.collect_list(F.struct("rank", counted("value", "n").alias("entry"))))
    return best.groupBy(*unit).agg(entries.alias("entries")).select(
        unit_label(*unit).alias("unit_id"), F.col("entries.entry").alias(name)
    )


def top10_displayed(log: DataFrame, merge_sessions: bool = False) -> DataFrame:
    return top_displayed(displayed_counts(log, merge_sessions))


def top10_clicked(log: DataFrame, merge_sessions: bool = False) -> DataFrame:
    return top_clicked(clicked_counts(log, merge_sessions))
