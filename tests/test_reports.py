import pytest
from footfall.operators import instances, links, sessions
from footfall.operators.combined import MEASURES, combined_analysis
from pyspark.sql import functions as F

PAGES = "session_id string, at long, requested_page_id string, requested_page_name string"


def page_log(spark, *visits):
    rows = [(s, t, p, p.upper()) for s, t, p in visits]
    return spark.createDataFrame(rows, PAGES).withColumn("time", F.timestamp_seconds("at"))


def by_unit(report, measure):
    return {r.unit_id: r[measure] for r in report.collect()}


def test_first_and_last_page_of_a_session(spark):
    log = page_log(spark, ("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", 1, "y"), ("b", 1, "x"), (None, 3, "x"))
    assert by_unit(sessions.bounce_rate(log), "bounce_rate") == {"z: Z": 1 / 3, "y: Y": 1 / 3, "x: X": 1 / 3}
    assert by_unit(sessions.entrance_rate(log), "entrance_rate") == {"x: X": 1.0}


def test_visits_count_once_per_session_and_second(spark):
    log = page_log(spark, ("a", 1, "x"), ("a", 1, "x"), ("a", 2, "x"), ("b", 1, "y"), (None, 1, "y"))
    got = by_unit(sessions.average_visits(log), "average_visits_per_session")
    assert got == {"x: X": 2 / 3, "y: Y": 2 / 3}


def test_reports_on_no_rows_are_empty(spark):
    log = page_log(spark, ("a", 1, "x")).where("false")
    assert sessions.bounce_rate(log).count() == 0
    assert sessions.average_visits(log).count() == 0


def link_log(spark, *clicks):
    schema = "session_id string, at long, source_page_id string, requested_page_id string, clicked_link_id string, clicked_link_name string"
    return spark.createDataFrame(list(clicks), schema).withColumn("time", F.timestamp_seconds("at"))


CLICKS = (
    ("a", 1, "p", "q", "l1", "one"),
    ("a", 1, "p", "q", "l1", "one"),
    ("b", 1, "p", "q", "l1", "one"),
    ("a", 2, "p", "r", "l2", None),
    ("a", 3, "p", "p", "l1", "one"),
    ("a", 4, None, "q", "l1", "one"),
    ("a", 5, "r", "q", "l1", "one"),
    ("a", 6, "r", "q", None, None),
)


def test_link_counts(spark):
    got = {tuple(r)[:3]: r.clicks for r in links.link_counts(link_log(spark, *CLICKS)).collect()}
    assert got == {("p", "q", "l1"): 2, ("p", "r", "l2"): 1, ("r", "q", "l1"): 1}
    merged = links.link_counts(link_log(spark, *CLICKS), merge_sessions=True).collect()
    assert {tuple(r)[:3]: r.clicks for r in merged} == {("p", "q", "l1"): 1, ("p", "r", "l2"): 1, ("r", "q", "l1"): 1}


def test_link_shares(spark):
    log = link_log(spark, *CLICKS)
    out = {(r.source_page_id, r.requested_page_id, r.unit_id): r.link_out for r in links.output_link(log).collect()}
    assert out == {("p", "q", "l1: one"): 2 / 3, ("p", "r", None): 1 / 3, ("r", "q", "l1: one"): 1.0}
    into = {(r.source_page_id, r.requested_page_id, r.unit_id): r.link_in for r in links.input_link(log).collect()}
    assert into == {("p", "q", "l1: one"): 2 / 3, ("p", "r", None): 1.0, ("r", "q", "l1: one"): 1 / 3}


def test_top_ten_by_count_then_value(spark):
    rows = [("s", t, "u", "Unit", "name", f"v{v:02}") for v in range(15) for t in range(30 - v if v < 5 else 3)]
    rows += [("s", 1, "u", "Unit", "brand", "other"), ("s", 1, "u", "Unit", "name", "NULL"), ("s", 1, "u", "Unit", "name", None)]
    rows += [("s", 1, "u", "Unit", "title", "v00"), ("t", 1, "u", "Unit", "name", "v00")]
    schema = "session_id string, at long, unit_id string, displayed_unit_name string, displayed_attribute_name string, displayed_oid_value string"
    log = spark.createDataFrame(rows, schema).withColumn("time", F.timestamp_seconds("at"))
    report = instances.top10_displayed(log).collect()
    assert len(report) == 1 and report[0].unit_id == "u: Unit"
    assert report[0].top10_displayed_instances == [
        "v00: 32", "v01: 29", "v02: 28", "v03: 27", "v04: 26", "v05: 3", "v06: 3", "v07: 3", "v08: 3", "v09: 3",
    ]
    assert "WindowGroupLimit" in instances.top10_displayed(log)._jdf.queryExecution().executedPlan().toString()
    merged = instances.displayed_counts(log, merge_sessions=True).where("value = 'v00'").first()
    assert merged.n == 31


def test_clicked_values_need_a_link_name_and_a_naming_column(spark):
    rows = [
        ("s", 1, "l1", "one", "NAME", "a"),
        ("s", 1, "l1", "one", "TITLE", "a"),
        ("s", 1, "l1", "one", "BRAND", "a"),
        ("s", 2, "l2", None, "NAME", "a"),
        ("s", 2, "l1", "one", "NAME", None),
    ]
    schema = "session_id string, at long, clicked_link_id string, clicked_link_name string, clicked_type_oid string, clicked_oid_value string"
    log = spark.createDataFrame(rows, schema).withColumn("time", F.timestamp_seconds("at"))
    assert by_unit(instances.top10_clicked(log), "top10_clicked_instances") == {"l1: one": ["a: 2"]}


@pytest.fixture
def reports(spark):
    lists = ("top10_clicked", "top10_displayed")
    made = {}
    for report, measure in MEASURES.items():
        kind = "array<string>" if report in lists else "double"
        one = ["v: 1"] if report in lists else 0.5
        rows = [(f"only {report}", one), ("everywhere", one), (None, one)]
        if report in ("output_link", "input_link"):
            rows.append(("everywhere", 0.25))
        made[report] = spark.createDataFrame(rows, f"unit_id string, {measure} {kind}")
    return made


def test_combined_report_is_the_full_join(reports):
    got = {r.unit_id: r.asDict() for r in combined_analysis(reports).collect()}
    assert set(got) == {"everywhere", *[f"only {name}" for name in MEASURES]}
    for name, measure in MEASURES.items():
        own = got[f"only {name}"]
        assert own[measure] is not None
        assert all(own[m] is None for m in MEASURES.values() if m != measure)
    assert got["everywhere"]["link_out"] == 0.75 and got["everywhere"]["bounce_rate"] == 0.5
    assert got["everywhere"]["top10_clicked_instances"] == ["v: 1"]
