"""Which links lead from page to page."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from footfall.functions.text import unit_label
from footfall.operators.lookup import shuffled_join

STEP = ("source_page_id", "requested_page_id", "clicked_link_id", "clicked_link_name")


def link_counts(log: DataFrame, merge_sessions: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Clicks per (source, target, link); one per session and second, none within a page.

    ``by`` names further columns to count by. Counts by day add up, as a second is on one day.
    """
    session = [] if merge_sessions else ["session_id"]
    return (
        log.where(
            F.col("clicked_link_id").isNotNull() & (F.col("source_page_id") != F.col("requested_page_id"))
        )
        .select("time", *session, *STEP, *by)
        .distinct()
        .groupBy(*STEP, *by)
        .agg(F.count(F.lit(1)).alias("clicks"))
    )


def link_share(counts: DataFrame, page: str, name: str) -> DataFrame:
    """Of counted clicks, each link's share of those of its ``page``."""
    totals = counts.groupBy(page).agg(F.sum("clicks").alias("page_clicks"))
    return shuffled_join(counts, totals, [page], "inner").select(
        "source_page_id",
        "requested_page_id",
        unit_label("clicked_link_id", "clicked_link_name").alias("unit_id"),
        (F.col("clicks") / F.col("page_clicks")).alias(name),
    )


def output_link(log: DataFrame, merge_sessions: bool = False) -> DataFrame:
    """Per (source, target, link), its share of the clicks that leave the source page."""
    return link_share(link_counts(log, merge_sessions), "source_page_id", "link_out")


def input_link(log: DataFrame, merge_sessions: bool = False) -> DataFrame:
    """Per (source, target, link), its share of the clicks that lead to the target page."""
    return link_share(link_counts(log, merge_sessions), "requested_page_id", "link_in")
