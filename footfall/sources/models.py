"""The site's design model: pages, links, view components and entities from XML.

``read_elements`` reads all elements with an explicit schema; ``pages``, ``links``, ``units`` and
``attributes`` turn such rows into relations, so they also work on rows that come from elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from footfall.functions.text import bare_id, pinned
from footfall.schemas import ELEMENT_ROW, ENTITY_ROW, LINK_ROW, PAGE_ROW, UNIT_ROW
from footfall.sources.files import present

# Element names of the design model.
PAGE_TAGS = ("Page", "MasterPage")
LINK_TAGS = ("Link", "OKLink", "KOLink")
DISPLAY_TAGS = (
    "PowerIndexUnit",
    "IndexUnit",
    "HierarchicalIndexUnit",
    "DataUnit",
    "MultiDataUnit",
    "EventCalendarUnit",
    "MultiChoiceIndexUnit",
)
ENTITY_TAGS = ("SelectorUnit", "EntryUnit", "MultiEntryUnit")
PLAIN_TAGS = ("ModuleInstanceUnit", "MultiMessageUnit", "NoOpContentUnit", "TimeUnit", "GetUnit")
UNIT_TAGS = DISPLAY_TAGS + ENTITY_TAGS + PLAIN_TAGS
ENTITY_TAG = "Entity"
ALL_TAGS = (*PAGE_TAGS, *LINK_TAGS, *UNIT_TAGS, ENTITY_TAG)

# What is no element, and an element's start: its attributes hold no bare quote, and what is in (?:...)*+
# is not tried again.
NO_ELEMENT = r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>"
START = r"""(?=[\s/>])(?:[^<>"'/]++|/(?!>)|"[^"]*+"|'[^']*+')*+"""
# Starts count alone, as elements may lie in each other; entities count with the attributes in them.
ELEMENT = rf"(?s)<(?:{'|'.join(t for t in ALL_TAGS if t != ENTITY_TAG)}){START}/?>|<{ENTITY_TAG}{START}(?:/>|>.*?</{ENTITY_TAG}\s*>)"


def read_elements(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """Every element of the design model at any depth, its name as ``kind``, in one pass over the files.

    A missing element gives no rows, a missing attribute null. Each file is one text.
    """
    files = spark.read.text(present(spark, paths), wholetext=True)
    plain = F.regexp_replace("value", NO_ELEMENT, "")
    elements = files.select(F.explode(F.regexp_extract_all(plain, F.lit(ELEMENT), F.lit(0))).alias("element"))
    text = F.col("element")
    closed = F.when(text.endswith("/>") | text.startswith(f"<{ENTITY_TAG}"), text).otherwise(
        F.concat(F.expr("left(element, length(element) - 1)"), F.lit("/>"))
    )
    kind = F.regexp_extract("element", r"^<(\w+)", 1)
    return pinned(elements.select(kind.alias("kind"), F.from_xml(closed, ELEMENT_ROW).alias("e"))).select("kind", "e.*")


def of_kind(rows: DataFrame, tags: Iterable[str]) -> DataFrame:
    return rows.where(F.col("kind").isin(*tags))


def read_rows(spark: SparkSession, paths: Iterable[str], tags: Iterable[str], schema: StructType) -> DataFrame:
    """The elements named in ``tags``, with the columns of ``schema``."""
    return of_kind(read_elements(spark, paths), tags).select("kind", *schema.names)


def pages(rows: DataFrame) -> DataFrame:
    return rows.select(bare_id("_id").alias("page_id"), F.col("_name").alias("page_name"), "kind")


def links(rows: DataFrame) -> DataFrame:
    return rows.select(
        bare_id("_id").alias("link_id"),
        F.col("_name").alias("link_name"),
        bare_id("_to").alias("target_unit"),
        "kind",
    )


def units(rows: DataFrame) -> DataFrame:
    """View components, one row per displayed attribute; one row with null if there is none.

    Only display components show attributes, and only the first two groups have an entity.
    """
    attribute_ids = F.when(
        F.col("kind").isin(*DISPLAY_TAGS), F.split(F.trim("_displayAttributes"), r"\s+")
    )
    entity = F.when(F.col("kind").isin(*DISPLAY_TAGS, *ENTITY_TAGS), F.col("_entity"))
    return rows.select(
        bare_id("_id").alias("unit_id"),
        F.col("_name").alias("unit_name"),
        entity.alias("entity_id"),
        F.explode_outer(F.transform(attribute_ids, bare_id)).alias("displayed_attribute"),
        "kind",
    )


def attributes(rows: DataFrame) -> DataFrame:
    """Entity attributes stored in a database column; derived ones drop out."""
    return (
        rows.select(
            F.col("_id").alias("entity_id"),
            F.col("_table").alias("table_db"),
            F.col("_name").alias("entity_name"),
            F.explode("Attribute").alias("a"),
        )
        .select(
            "entity_id",
            "table_db",
            "entity_name",
            bare_id("a._id").alias("attribute_id"),
            F.col("a._name").alias("attribute_name"),
            F.col("a._column").alias("attribute_database_column"),
        )
        .where(F.col("attribute_database_column").isNotNull())
    )


def read_pages(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    return pages(read_rows(spark, paths, PAGE_TAGS, PAGE_ROW))


def read_links(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    return links(read_rows(spark, paths, LINK_TAGS, LINK_ROW))


def read_units(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    return units(read_rows(spark, paths, UNIT_TAGS, UNIT_ROW))


def read_attributes(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    return attributes(read_rows(spark, paths, [ENTITY_TAG], ENTITY_ROW))
