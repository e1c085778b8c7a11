import random
import re
from datetime import datetime, timezone

import pytest
from footfall.operators.navigation import HORIZON, next_navigation, page_flow, residence_time

SCHEMA = "session_id string, at long, requested_page_id string, requested_page_name string, source_page_id string"


def make_log(spark, visits):
    from pyspark.sql import functions as F

    rows = [(s, t, p, f"name of {p}", None) for s, t, p in visits]
    return spark.createDataFrame(rows, SCHEMA).withColumn("time", F.timestamp_seconds("at")).drop("at")


def brute_force(visits):
    """(session, time, page) -> the first later (time, page) with another page within the hour."""
    found = {}
    for s, t, p in set(visits):
        if s is None:
            continue
        later = [(t2, p2) for s2, t2, p2 in visits if s2 == s and p2 != p and t < t2 < t + HORIZON]
        if later:
            found[s, t, p] = min(later)
    return found


def seconds(moment):
    return int(moment.replace(tzinfo=timezone.utc).timestamp()) if isinstance(moment, datetime) else moment


def computed(log):
    got = {}
    for r in next_navigation(log).collect():
        key = (r.session_id, seconds(r.time), r.requested_page_id)
        assert key not in got
        got[key] = (seconds(r.next_time), r.next_page_id)
    return got


def random_visits(seed, sessions, length, span, pages):
    rng = random.Random(seed)
    base = 1_700_000_000 + rng.randrange(HORIZON)
    visits = []
    for s in range(sessions):
        for _ in range(rng.randint(1, length)):
            visits.append((f"s{s}", base + rng.randrange(span), f"p{rng.randrange(pages)}"))
    return visits


@pytest.mark.parametrize(
    "seed, sessions, length, span, pages",
    [
        (1, 60, 30, 20, 3),  # many ties
        (2, 40, 25, 3 * HORIZON, 2),  # long runs of one page, across hours
        (3, 30, 60, 2 * HORIZON, 4),
        (4, 1, 900, 6 * HORIZON, 3),  # one long session
        (5, 20, 40, HORIZON + 10, 1),  # nothing to go on to
    ],
)
def test_same_as_comparing_all_pairs(spark, seed, sessions, length, span, pages):
    visits = random_visits(seed, sessions, length, span, pages) + [(None, 5, "p0"), (None, 6, "p1")]
    assert computed(make_log(spark, visits)) == brute_force(visits)


def test_limit_is_strict(spark):
    visits = [("a", 0, "p"), ("a", 3600, "q"), ("b", 0, "p"), ("b", 3599, "q")]
    assert computed(make_log(spark, visits)) == {("b", 0, "p"): (3599, "q")}


def test_an_early_view_can_be_out_of_range_while_a_later_one_is_not(spark):
    visits = [("a", 0, "p"), ("a", 3000, "p"), ("a", 4000, "q")]
    assert computed(make_log(spark, visits)) == {("a", 3000, "p"): (4000, "q")}


def test_residence_counts_repeated_views_from_the_first(spark):
    visits = [("a", 0, "p"), ("a", 10, "p"), ("a", 30, "q"), ("b", 0, "p"), ("b", 10, "q")]
    got = {r.unit_id: r.residence_time for r in residence_time(make_log(spark, visits)).collect()}
    assert got == {"p: name of p": 20.0}


def test_merged_sessions_share_a_stay_that_ends_in_the_same_second(spark):
    visits = [("a", 0, "p"), ("a", 30, "q"), ("b", 10, "p"), ("b", 30, "q")]
    log = make_log(spark, visits)
    assert residence_time(log).first().residence_time == 25.0
    assert residence_time(log, merge_sessions=True).first().residence_time == 30.0


def test_page_flow_is_distinct(spark):
    visits = [("a", 0, "p"), ("a", 0, "p"), ("a", 0, "q")]
    assert page_flow(make_log(spark, visits)).count() == 2


def test_windows_stay_short_in_a_long_session(spark):
    """The rows that share a window are those of one session and two hours."""
    from pyspark.sql import functions as F

    log = spark.range(0, 40 * HORIZON, 60).select(
        F.concat(F.lit("robot"), F.col("id") % 1).alias("session_id"),
        F.timestamp_seconds("id").alias("time"),
        F.concat(F.lit("p"), F.col("id") % 7).alias("requested_page_id"),
        F.lit("n").alias("requested_page_name"),
    )
    plan = next_navigation(log)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(session_id#\d+, hour#\d+L,", plan)
    assert next_navigation(log).count() == 40 * 60 - 1
