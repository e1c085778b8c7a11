"""From page to page within a session."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame, Window, functions as F

from footfall.functions.text import DAY, day_of
from footfall.operators.sessions import PAGE, page_label

# Fixed value: a page counts as the next one only if it follows within this many seconds.
HORIZON = 3600


def page_flow(log: DataFrame) -> DataFrame:
    """The different (second, page, session, source)."""
    return log.groupBy("time", "requested_page_id", "session_id", "source_page_id").agg(
        F.min("requested_page_name").alias("requested_page_name")
    )


def next_navigation(log: DataFrame) -> DataFrame:
    """Per visit (page, session, second), the first later second with another page, and the smallest such page id.

    The answer is less than an hour away, so it lies in the visit's own hour or in the one after.
    Each second of a session is therefore put into its own hour and the hour before, and the
    search runs within (session, hour): at most 7200 rows, however long the session is.

    A run is a series of seconds that all hold one and the same page. The answer for page ``p``
    is the next second if it holds another page, else the start of the run after the next
    second's run.
    """
    visit = F.struct(*PAGE)
    seconds = (
        log.where(F.col("session_id").isNotNull())
        .groupBy("session_id", F.unix_timestamp("time").alias("at"))
        .agg(F.sort_array(F.collect_set(visit)).alias("visits"))
    )
    hour = F.floor(F.col("at") / HORIZON)
    places = F.array(
        F.struct(hour.alias("hour"), F.col("visits").alias("visits")),
        F.struct((hour - 1).alias("hour"), F.lit(None).alias("visits")),
    )
    # Two pages are enough to tell whether a second holds one page and to find another than p.
    pages = F.transform(F.slice("visits", 1, 2), lambda v: v["requested_page_id"])
    placed = seconds.select("session_id", "at", pages.alias("pages"), F.inline(places))

    back = Window.partitionBy("session_id", "hour").orderBy(F.col("at").desc())
    second = F.struct("at", "pages")
    same_run = (F.size("pages") == 1) & (F.lead("pages").over(back) == F.col("pages"))
    marked = placed.withColumn("starts_run", ~F.coalesce(same_run, F.lit(False)))
    later = back.rowsBetween(Window.unboundedPreceding, -1)
    run = F.last(F.when(F.col("starts_run"), second), ignorenulls=True).over(later)
    linked = marked.withColumn("next_run", run).select(
        "session_id",
        "at",
        "visits",
        F.lag(second).over(back).alias("next"),
        F.lag("next_run").over(back).alias("run_after_next"),
    )

    page = F.col("requested_page_id")
    answer = F.when(F.col("next.pages") != F.array(page), F.col("next")).otherwise(F.col("run_after_next"))
    found = linked.select("session_id", "at", "next", "run_after_next", F.inline("visits")).select(
        "session_id", "at", *PAGE, answer.alias("answer")
    )
    others = F.filter("answer.pages", lambda p: p != page)
    return found.where(F.col("answer.at") - F.col("at") < HORIZON).select(
        F.timestamp_seconds("at").alias("time"),
        *PAGE,
        "session_id",
        F.timestamp_seconds("answer.at").alias("next_time"),
        F.get(others, 0).alias("next_page_id"),
    )


def _stays(log: DataFrame, session: Sequence[str]) -> DataFrame:
    """Each way from a page to the next, from its first view on."""
    return (
        next_navigation(log)
        .groupBy(*PAGE, "next_time", "next_page_id", *session)
        .agg(F.min("time").alias("time"))
        .withColumn("seconds", F.unix_timestamp("next_time") - F.unix_timestamp("time"))
    )


def mean_stay(sums: DataFrame) -> DataFrame:
    """From ``seconds`` and ``stays`` by page the mean of a stay."""
    return sums.groupBy(page_label().alias("unit_id")).agg((F.sum("seconds") / F.sum("stays")).alias("residence_time"))


def residence_time(log: DataFrame, merge_sessions: bool = False) -> DataFrame:
    """Per page, the mean seconds to the next page; repeated views count from the first."""
    session = [] if merge_sessions else ["session_id"]
    return mean_stay(_stays(log, session).withColumn("stays", F.lit(1)))


def stays_of_days(visits: DataFrame, days: Sequence[date], merge_sessions: bool = False) -> DataFrame:
    """Per page and day, the ``seconds`` and number of the ``stays`` that end on that day; they add up over days.

    ``visits`` have an ``event_date``. All views that a stay of a day begins with are on that day or in the
    hour before it, so these are all that is read, and lines that come in for a day change the stays of
    that day and of the next one only.
    """
    before = [d - timedelta(days=1) for d in days]
    last_hour = F.unix_timestamp("time") % DAY >= DAY - HORIZON
    needed = F.col("event_date").isin(list(days)) | (F.col("event_date").isin(before) & last_hour)
    session = [] if merge_sessions else ["session_id"]
    stays = _stays(visits.where(F.col("event_date").isin([*days, *before]) & needed), session)
    ending = stays.withColumn("event_date", day_of("next_time")).where(F.col("event_date").isin(list(days)))
    return ending.groupBy("event_date", *PAGE).agg(F.sum("seconds").alias("seconds"), F.count(F.lit(1)).alias("stays"))
