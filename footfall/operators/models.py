"""Lookup tables from the design model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from footfall.config import Limits
from footfall.operators.lookup import Lookup


def combined_rows(units: DataFrame, attributes: DataFrame) -> DataFrame:
    shown = units.select("unit_id", "unit_name", "entity_id", F.col("displayed_attribute").alias("attribute_id"))
    return shown.join(attributes, ["entity_id", "attribute_id"])


def combined_model(units: DataFrame, attributes: DataFrame) -> DataFrame:
    """View components with the attributes they display, where these are stored ones."""
    return combined_rows(units, attributes).distinct()


def page_names(pages: DataFrame) -> DataFrame:
    """One name per page; of several, the smallest."""
    return pages.groupBy("page_id").agg(F.min("page_name").alias("page_name"))


def columns_of_several_tables(attributes: DataFrame) -> DataFrame:
    """The columns of an entity that several tables have."""
    tables = attributes.groupBy("entity_id", "attribute_database_column").agg(
        F.min(F.coalesce("table_db", F.lit(""))).alias("first"), F.max("table_db").alias("last")
    )
    return tables.where("first <> last").select("entity_id", "attribute_database_column")


Small = Callable[[], bool] | None


def page_lookup(pages: DataFrame, limits: Limits, small: Small = None) -> Lookup:
    return Lookup(pages, ["page_id"], limits, page_names, small)


def link_lookup(links: DataFrame, limits: Limits, small: Small = None) -> Lookup:
    rows = links.select(
        F.col("link_id").alias("clicked_link_id"), F.col("link_name").alias("clicked_link_name"), "target_unit"
    )
    return Lookup(rows, ["clicked_link_id"], limits, DataFrame.distinct, small)


def clicked_entity_lookup(attributes: DataFrame, limits: Limits, small: Small = None) -> Lookup:
    rows = attributes.select(
        F.col("attribute_id").alias("clicked_attribute_id"),
        F.col("entity_id").alias("clicked_entity_id"),
        F.col("entity_name").alias("clicked_entity_name"),
    )
    return Lookup(rows, ["clicked_attribute_id"], limits, DataFrame.distinct, small)


def unit_lookup(combined: DataFrame, limits: Limits, small: Small = None) -> Lookup:
    """What each component displays."""
    rows = combined.select(
        "unit_id",
        F.col("unit_name").alias("displayed_unit_name"),
        F.col("entity_id").alias("displayed_entity_id"),
        F.col("entity_name").alias("displayed_entity_name"),
        "table_db",
        F.col("attribute_id").alias("displayed_attribute_id"),
        F.col("attribute_name").alias("displayed_attribute_name"),
        "attribute_database_column",
    )
    return Lookup(rows, ["unit_id"], limits, DataFrame.distinct, small)


def clicked_column_lookup(combined: DataFrame, limits: Limits, small: Small = None) -> Lookup:
    """The database columns of an entity that some component displays."""
    rows = combined.select(
        F.col("entity_id").alias("_entity"),
        F.col("table_db").alias("clicked_table"),
        F.col("attribute_database_column").alias("clicked_column"),
    )
    return Lookup(rows, ["_entity"], limits, DataFrame.distinct, small)
