"""All reports, and the one that puts them side by side."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from footfall.operators.instances import (
    CLICKED_UNIT,
    SHOWN_UNIT,
    top10_clicked,
    top10_displayed,
    top_clicked,
    top_displayed,
)
from footfall.operators.links import STEP, input_link, link_share, output_link
from footfall.operators.navigation import mean_stay, residence_time
from footfall.operators.sessions import (
    PAGE,
    average_visits,
    bounce_rate,
    end_share,
    entrance_rate,
    visit_share,
)

# Report name -> its measure in the combined report, in the order of the columns there.
MEASURES = {
    "residence_time": "residence_time",
    "average_visits": "average_visits_per_session",
    "bounce_rate": "bounce_rate",
    "entrance_rate": "entrance_rate",
    "output_link": "link_out",
    "input_link": "link_in",
    "top10_clicked": "top10_clicked_instances",
    "top10_displayed": "top10_displayed_instances",
}
SUMMED = ("output_link", "input_link")


def all_reports(
    visits: DataFrame,
    clicked: DataFrame,
    shown: DataFrame,
    merge_sessions: bool = False,
) -> dict[str, DataFrame]:
    """The reports on pages and links, on clicked values and on shown values.

    Each argument may be the enriched log itself or an extract with the columns the reports name.
    """
    return {
        "residence_time": residence_time(visits, merge_sessions),
        "average_visits": average_visits(visits),
        "bounce_rate": bounce_rate(visits),
        "entrance_rate": entrance_rate(visits),
        "output_link": output_link(visits, merge_sessions),
        "input_link": input_link(visits, merge_sessions),
        "top10_clicked": top10_clicked(clicked, merge_sessions),
        "top10_displayed": top10_displayed(shown, merge_sessions),
    }


def counted_reports(sums: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The same reports from counts by day: ``visits``, ``clicks``, ``clicked``, ``shown``, ``stays`` and ``ends``.

    A day's counts are of seconds, stays and sessions that no other day counts, so they add up.
    """

    def added(name: str, keys: Sequence[str], *counts: str) -> DataFrame:
        return sums[name].groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts])

    ends = added("ends", ("end", *PAGE), "sessions")
    last = ends.where("end = 'last'")
    clicks = added("clicks", STEP, "clicks")
    return {
        "residence_time": mean_stay(sums["stays"]),
        "average_visits": visit_share(added("visits", PAGE, "visits"), last.agg(F.sum("sessions"))),
        "bounce_rate": end_share(last, "bounce_rate"),
        "entrance_rate": end_share(ends.where("end = 'first'"), "entrance_rate"),
        "output_link": link_share(clicks, "source_page_id", "link_out"),
        "input_link": link_share(clicks, "requested_page_id", "link_in"),
        "top10_clicked": top_clicked(added("clicked", (*CLICKED_UNIT, "value"), "n")),
        "top10_displayed": top_displayed(added("shown", (*SHOWN_UNIT, "value"), "n")),
    }


def combined_analysis(reports: Mapping[str, DataFrame]) -> DataFrame:
    """Per page, link or component, every measure any report has for it.

    This is the full outer join of all reports on ``unit_id``. As each has at most one row per
    unit, stacking them and grouping once gives the same rows with one shuffle instead of one per
    join. A link's shares are summed over its pages first, to nine places; rows without a label are left out.
    """
    parts = []
    for report, measure in MEASURES.items():
        part = reports[report].where(F.col("unit_id").isNotNull()).select("unit_id", measure)
        if report in SUMMED:
            # Added as decimals, so that the sum does not depend on the order of the rows.
            total = F.sum(F.col(measure).cast("decimal(28,12)"))
            part = part.groupBy("unit_id").agg(F.round(total, 9).cast("double").alias(measure))
        parts.append(part)
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.groupBy("unit_id").agg(
        *[F.first(m, ignorenulls=True).alias(m) for m in MEASURES.values()]
    )
