"""Joining the two logs with the design model, the stored values and each other."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from footfall.config import Limits
from footfall.operators import models, values
from footfall.operators.lookup import Lookup, Sizes
from footfall.schemas import ENRICHED

HIT_COLUMNS = (
    "time",
    "ip",
    "session_id",
    "requested_page_id",
    "source_page_id",
    "clicked_link_id",
    "clicked_attribute_id",
    "clicked_oid",
)
# What stored lines have besides.
STAMPS = ("ingested_at", "batch", "event_date")
EVENT_KEYS = ("time", "session_id", "requested_page_id")


class Site:
    """The design model and the dumped values of one site, and the lookups made from them.

    A subclass says where the relations come from. They are measured in one pass, what components
    display in another, when a query needs them.
    """

    pages: DataFrame
    links: DataFrame
    units: DataFrame
    attributes: DataFrame
    dumps: Mapping[str, DataFrame]

    def __init__(self, spark: SparkSession, limits: Limits = Limits()):
        self.spark = spark
        self.limits = limits

    @cached_property
    def combined(self) -> DataFrame:
        """The components with what they display; the lookups remove repetitions."""
        return models.combined_rows(self.units, self.attributes)

    @cached_property
    def sizes(self) -> Sizes:
        return Sizes(
            lambda: {
                "pages": self.pages,
                "links": self.links,
                "attributes": self.attributes,
                "several": models.columns_of_several_tables(self.attributes),
            }
        )

    @cached_property
    def displayed(self) -> dict[values.Name | None, tuple[int, int]]:
        """Rows and bytes of the combined model by what they display."""
        return values.displayed_names(self.headers, self.combined)

    @property
    def headers(self) -> values.Headers:
        """The dumps' columns."""
        return values.headers(self.dumps)

    def _small(self, name: str) -> Callable[[], bool]:
        return lambda: self.sizes.within(self.limits, name)

    def _small_model(self) -> bool:
        rows, total = (sum(size[i] for size in self.displayed.values()) for i in (0, 1))
        return rows <= self.limits.broadcast_rows and total <= self.limits.broadcast_bytes

    @cached_property
    def known_pages(self) -> Lookup:
        return models.page_lookup(self.pages, self.limits, self._small("pages"))

    @cached_property
    def requested_pages(self) -> Lookup:
        return self.known_pages.renamed("requested_page_id", "requested_page_name")

    @cached_property
    def source_pages(self) -> Lookup:
        return self.known_pages.renamed("source_page_id", "source_page_name")

    @cached_property
    def displayed_pages(self) -> Lookup:
        return self.known_pages.renamed("displayed_page_id", "displayed_page_name")

    @cached_property
    def clicked_links(self) -> Lookup:
        return models.link_lookup(self.links, self.limits, self._small("links"))

    @cached_property
    def clicked_entities(self) -> Lookup:
        return models.clicked_entity_lookup(self.attributes, self.limits, self._small("attributes"))

    @cached_property
    def clicked_columns(self) -> Lookup:
        return models.clicked_column_lookup(self.combined, self.limits, self._small_model)

    @cached_property
    def shown_units(self) -> Lookup:
        return models.unit_lookup(self.combined, self.limits, self._small_model)

    @property
    def one_table(self) -> bool:
        """Whether each column of an entity is in one table only."""
        return self.sizes.measured["several"][0] == 0

    def dump_bytes(self) -> int | None:
        """The bytes of the dumps' files; none if they are not files."""
        return None

    @cached_property
    def stored_values(self) -> values.StoredValues | values.KeptValues:
        return values.StoredValues(self.spark, self.dumps, lambda: self.displayed, self.limits, self.dump_bytes)


def distinct_hits(parsed: DataFrame, stamps: Sequence[str] = ()) -> DataFrame:
    """Equal hits of one second count once. Repeats are removed before anything is joined.

    Of the ``stamps``, columns that say when a line came in, a hit keeps the earliest.
    """
    if not stamps:
        return parsed.select(*HIT_COLUMNS).distinct()
    return parsed.groupBy(*HIT_COLUMNS).agg(*[F.min(s).alias(s) for s in stamps])


def with_requested_page(hits: DataFrame, site: Site) -> DataFrame:
    """Adds the page's name; hits on pages the model does not know drop out."""
    return site.requested_pages.join(hits, "inner")


def with_source_page(hits: DataFrame, site: Site) -> DataFrame:
    return site.source_pages.join(hits, "left")


def with_clicked_entity(hits: DataFrame, site: Site) -> DataFrame:
    """Adds the entity that owns the clicked attribute."""
    return site.clicked_entities.join(hits, "left")


def with_displayed_columns(hits: DataFrame, site: Site) -> DataFrame:
    """One row per displayed column of the clicked entity; one row without if there is none.

    A hit that names no object stays one row, as there is nothing to look up for it.
    """
    entity = F.when(F.col("clicked_oid") != 0, F.col("clicked_entity_id"))
    return site.clicked_columns.join(hits.withColumn("_entity", entity), "left").drop("_entity")


def with_clicked_link(hits: DataFrame, site: Site) -> DataFrame:
    return site.clicked_links.join(hits, "left")


def described_hits(hits: DataFrame, site: Site) -> DataFrame:
    """All that the design model says about a hit."""
    hits = with_requested_page(hits, site)
    hits = with_source_page(with_clicked_entity(hits, site), site)
    return with_clicked_link(with_displayed_columns(hits, site), site)


def valued_hits(hits: DataFrame, site: Site) -> DataFrame:
    described = described_hits(hits, site)
    stored = site.stored_values.lookup(lambda: values.clicked_keys(described))
    return values.clicked_values(described, stored, site.one_table)


def shown_objects(parsed: DataFrame) -> DataFrame:
    """One row per object a runtime line shows; lines without objects drop out."""
    return (
        parsed.drop("shape", *STAMPS)
        .withColumnRenamed("page_id", "displayed_page_id")
        .withColumn("oid", F.explode("oids"))
        .drop("oids")
        .where(F.col("oid").isNotNull())
    )


def distinct_shown(parsed: DataFrame) -> DataFrame:
    """Equal shown objects of one second count once."""
    return shown_objects(parsed).distinct()


def with_displayed_page(shown: DataFrame, site: Site) -> DataFrame:
    return site.displayed_pages.join(shown, "inner")


def with_unit(shown: DataFrame, site: Site) -> DataFrame:
    """One row per attribute that the component displays; unknown components drop out."""
    return site.shown_units.join(shown, "inner")


def described_shown(shown: DataFrame, site: Site) -> DataFrame:
    return with_unit(with_displayed_page(shown, site), site)


def valued_shown(shown: DataFrame, site: Site) -> DataFrame:
    described = described_shown(shown, site)
    return values.displayed_values(described, site.stored_values.lookup(lambda: values.displayed_keys(described)))


def enriched_log(access: DataFrame, runtime: DataFrame, site: Site, stamps: Sequence[str] = ()) -> DataFrame:
    """Every hit with what the same session was shown on that page in that second, and its ``stamps``.

    Both sides hold no row twice, so neither does the result, and the wide rows need no further
    shuffle to remove duplicates.
    """
    hits = described_hits(distinct_hits(access, stamps), site)
    shown = described_shown(distinct_shown(runtime), site)
    stored = site.stored_values.lookup(lambda: values.lookup_keys(hits, shown))
    hits = values.clicked_values(hits, stored, site.one_table)
    shown = values.displayed_values(shown, stored)
    return hits.join(_on_hit(shown), list(EVENT_KEYS), "left").select(*ENRICHED.names, *stamps)


def shown_on_hits(access: DataFrame, runtime: DataFrame, site: Site) -> DataFrame:
    """The shown objects that the enriched log holds, without the hits they belong to.

    Enough for the reports on shown values, which collapse repeated events themselves, and free
    of the pairs with every hit of the second.
    """
    hits = access.select(*EVENT_KEYS).distinct()
    shown = valued_shown(shown_objects(runtime), site)
    return _on_hit(shown).join(hits, list(EVENT_KEYS), "left_semi")


def _on_hit(shown: DataFrame) -> DataFrame:
    return shown.withColumn("requested_page_id", F.col("displayed_page_id"))
