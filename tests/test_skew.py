"""One key with a third of all rows."""

from contextlib import contextmanager

import pytest
from footfall.functions.accesslog import parse_access_log
from footfall.functions.runtimelog import parse_runtime_log
from footfall.operators import enrich, instances, navigation, sessions
from pyspark.sql import functions as F

ROWS = 60_000


@contextmanager
def settings(spark, **values):
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Site(enrich.Site):
    """Two pages, one component, one entity."""

    def __init__(self, spark):
        super().__init__(spark)
        frame = spark.createDataFrame
        self.pages = frame([("page1", "One", "Page"), ("page2", "Two", "Page")], "page_id string, page_name string, kind string")
        self.links = frame([("ln1", "open", "dau1")], "link_id string, link_name string, target_unit string")
        self.units = frame([("dau1", "Box", "e1", "att1")], "unit_id string, unit_name string, entity_id string, displayed_attribute string")
        self.attributes = frame(
            [("e1", "THING", "Thing", "att1", "name", "NAME")],
            "entity_id string, table_db string, entity_name string, attribute_id string, attribute_name string, attribute_database_column string",
        )
        self.dumps = {"THING": frame([(str(i), f"v{i % 100}", "THING") for i in range(ROWS // 10)], "OID string, NAME string, table_name string")}


@pytest.fixture(scope="module")
def access(spark):
    """A third of the hits share session, page and second; each names another object."""
    n = F.col("id")
    hot = n % 3 == 0
    second = F.date_format(F.timestamp_seconds(F.when(hot, 1704067200).otherwise(1704067200 + n)), "dd/MMM/yyyy:HH:mm:ss")
    session = F.when(hot, "robot").otherwise(F.concat(F.lit("s"), n % 500))
    return spark.range(ROWS).repartition(8).select(
        F.concat(
            F.lit("10.0.0.1 - - ["), second, F.lit(' +0000] "GET /app/page2.do?sp=page1&link=ln1&att1='), n + 1,
            F.lit(' HTTP/1.1" 200 1 '), session,
        ).alias("value")
    )


@pytest.fixture(scope="module")
def runtime(spark):
    line = "01 Jan 2024 00:00:00,1  INFO [h]  (c.U) - [robot][page2][dau1][step][t-1] shown {oid=[5]}"
    return spark.createDataFrame([(line,)] * 100, "value string")


def test_the_join_of_both_logs_splits_a_hot_event(spark, access, runtime):
    small = "8KB"
    with settings(
        spark,
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes=small,
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="1.5",
        spark__sql__adaptive__advisoryPartitionSizeInBytes=small,
        spark__sql__adaptive__coalescePartitions__enabled="false",
        spark__sql__shuffle__partitions="16",
    ):
        log = enrich.enriched_log(parse_access_log(access), parse_runtime_log(runtime), Site(spark))
        rows = log.groupBy("session_id").agg(F.count("oid").alias("shown"), F.count(F.lit(1)).alias("n"), F.sum("clicked_oid"))
        got = {r.session_id: (r.n, r.shown) for r in rows.collect()}
        plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "skew=true" in plan
    assert got["robot"] == (ROWS // 3, ROWS // 3)
    assert sum(n for n, _ in got.values()) == ROWS
    assert sum(shown for _, shown in got.values()) == ROWS // 3


def test_reports_on_a_hot_session(spark, access, runtime):
    site = Site(spark)
    log = enrich.with_requested_page(parse_access_log(access), site)
    assert sessions.bounce_rate(log).first().bounce_rate == 1.0
    assert navigation.next_navigation(log).count() == 0
    clicked = enrich.valued_hits(enrich.distinct_hits(parse_access_log(access)), site)
    counts = instances.clicked_counts(clicked)
    # 5999 hits name a stored object; the 2000 of the hot second share its 100 values.
    assert counts.agg(F.sum("n")).first()[0] == 3999 + 100
    assert len(instances.top10_clicked(clicked).first().top10_clicked_instances) == 10


def test_groups_are_combined_before_the_shuffle(spark, access):
    """A hot group leaves a task as one row."""
    log = enrich.with_requested_page(parse_access_log(access), Site(spark))
    for report in (sessions.bounce_rate(log), sessions.average_visits(log), navigation.page_flow(log)):
        plan = report._jdf.queryExecution().executedPlan().toString()
        assert "functions=[partial_" in plan or "HashAggregate(keys=[session_id" in plan
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
