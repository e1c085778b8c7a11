"""Where sessions begin and end, and how often they visit a page.

Each function takes any frame with the columns it names: parsed hits with page names, the
enriched log, or page visits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from footfall.functions.text import unit_label

PAGE = ("requested_page_id", "requested_page_name")


def page_label() -> Column:
    return unit_label(*PAGE)


def _share(n: Column, total: DataFrame) -> Column:
    """``n`` as a part of the one number in ``total``, a subquery of the same plan."""
    return n / total.scalar()


def _visit() -> Column:
    return F.struct("time", *PAGE)


def _session_ends(log: DataFrame, pick) -> DataFrame:
    """Sessions per page they begin or end on; of pages in the same second the id decides."""
    ends = log.groupBy("session_id").agg(pick(_visit()).alias("visit")).select("visit.*")
    return ends.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("sessions"))


def end_share(pages: DataFrame, name: str) -> DataFrame:
    """Of counted ``sessions`` by page, each page's share."""
    total = pages.agg(F.sum("sessions"))
    return pages.select(page_label().alias("unit_id"), _share(F.col("sessions"), total).alias(name))


def bounce_rate(log: DataFrame) -> DataFrame:
    """Per page, the share of sessions that end on it."""
    return end_share(_session_ends(log, F.max), "bounce_rate")


def entrance_rate(log: DataFrame) -> DataFrame:
    """Per page, the share of sessions that begin on it."""
    return end_share(_session_ends(log, F.min), "entrance_rate")


def visit_share(pages: DataFrame, total: DataFrame) -> DataFrame:
    """Counted ``visits`` by page, divided by the one number in ``total``."""
    return pages.select(
        page_label().alias("unit_id"), _share(F.col("visits"), total).alias("average_visits_per_session")
    )


def page_visits(log: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Visits per session and page, one per second; ``by`` names further columns to count by."""
    visits = log.select("session_id", "time", *PAGE, *by).distinct()
    return visits.groupBy("session_id", *PAGE, *by).agg(F.count(F.lit(1)).alias("visits"))


def average_visits(log: DataFrame) -> DataFrame:
    """Per page, visits (one per session and second) divided by all sessions; no session counts as one."""
    per_session = page_visits(log)
    pages = per_session.groupBy(*PAGE).agg(F.sum("visits").alias("visits"))
    # Counting by way of the visits lets both counts share one pass over the log.
    sessions = per_session.groupBy("session_id").agg(F.sum("visits").alias("visits")).where("visits > 0")
    return visit_share(pages, sessions.agg(F.count(F.lit(1))))


def session_days(visits: DataFrame) -> DataFrame:
    """Per session and day, its first and last visit on it."""
    return visits.groupBy("session_id", "event_date").agg(F.min(_visit()).alias("first"), F.max(_visit()).alias("last"))


def session_states(days: DataFrame) -> DataFrame:
    """From the first and last visits of days those of whole sessions, and the days they are on.

    ``event_date`` is the day of the last visit.
    """
    return days.groupBy("session_id").agg(
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.min("event_date").alias("first_date"),
        F.max("event_date").alias("event_date"),
    )


def session_ends(states: DataFrame) -> DataFrame:
    """How many sessions begin and end on each page, by the day on which they were last seen."""
    ends = F.array(F.struct(F.lit("first").alias("end"), "first.*"), F.struct(F.lit("last").alias("end"), "last.*"))
    pages = states.select("event_date", F.inline(ends))
    return pages.groupBy("event_date", "end", *PAGE).agg(F.count(F.lit(1)).alias("sessions"))
