"""A whole run on files, and runs that follow it."""

import dataclasses
import datetime
import json
import math
import re
from pathlib import Path
from urllib.parse import unquote

import pytest
from conftest import SMALL
from footfall.config import Limits, Settings
from footfall.functions.accesslog import parse_access_log
from footfall.functions.runtimelog import parse_runtime_log
from footfall.operators import instances, sessions
from footfall.operators.combined import all_reports
from footfall.operators.enrich import enriched_log
from footfall.plans import pipeline
from footfall.schemas import ENRICHED, PARSED
from footfall.sinks.reports import write_csv
from footfall.sources import intake, state, valuestore
from footfall.sources.dumps import read_dump
from footfall.sources.logs import read_enriched
from footfall.sources.state import read_taken
from footfall.sources.tables import Lines
from footfall.sources.valuestore import ValueStore
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from testbed import inputs
from testbed.queries import Data


def content(frame):
    return sorted((tuple(r) for r in frame.select(*ENRICHED.names).collect()), key=str)


@pytest.fixture(scope="module")
def settings(spark, tmp_path_factory):
    return inputs.write_files(spark, SMALL, str(tmp_path_factory.mktemp("site")))


@pytest.fixture(scope="module")
def days(spark, settings):
    return pipeline.run(spark, settings)


def test_files_give_the_same_log_as_tables(spark, settings, days):
    assert content(read_enriched(spark, settings.enriched)) == content(Data(spark, SMALL).enriched)


def test_log_is_partitioned_by_day(spark, settings, days):
    log = read_enriched(spark, settings.enriched)
    assert log.where("event_date <> to_date(time)").count() == 0
    day = log.agg(F.min("event_date")).first()[0]
    plan = log.where(F.col("event_date") == day)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan


def test_run_returns_the_days_it_made(spark, settings, days):
    log = read_enriched(spark, settings.enriched)
    assert {r.event_date for r in log.select("event_date").distinct().collect()} <= set(days)


def test_one_moment_per_batch(spark, settings, days):
    moments = read_enriched(spark, settings.enriched).select("batch", "ingested_at").distinct().collect()
    assert [r.batch for r in moments] == [0] and moments[0].ingested_at is not None


def test_reports_are_there_in_all_formats(spark, settings, days):
    reports = Path(settings.reports)
    names = {p.name for p in reports.iterdir() if not p.name.startswith("_")}
    kinds = ("residence_time", "average_visits", "bounce_rate", "entrance_rate", "output_link", "input_link",
             "top10_clicked", "top10_displayed", "combined_analysis", "lines")
    assert names == {f"{k}.{f}" for k in kinds for f in ("parquet", "csv")} | {"combined_analysis.json"}
    for kind in kinds:
        stored = spark.read.parquet(f"{settings.reports}/{kind}.parquet")
        csv = spark.read.csv(f"{settings.reports}/{kind}.csv", sep=";", header=True)
        assert csv.columns == stored.columns
        assert csv.count() == stored.count() > 0
    assert spark.read.json(f"{settings.reports}/combined_analysis.json").count() == spark.read.parquet(
        f"{settings.reports}/combined_analysis.parquet"
    ).count()


def test_shares_add_up(spark, settings, days):
    def stored(name):
        return spark.read.parquet(f"{settings.reports}/{name}.parquet")

    for name in ("bounce_rate", "entrance_rate"):
        assert math.isclose(stored(name).agg(F.sum(name)).first()[0], 1.0)
    for name, page, share in (("output_link", "source_page_id", "link_out"), ("input_link", "requested_page_id", "link_in")):
        totals = [r[1] for r in stored(name).groupBy(page).agg(F.sum(share)).collect()]
        assert totals and all(math.isclose(t, 1.0) for t in totals)
    for name in ("top10_clicked", "top10_displayed"):
        assert stored(name).where(F.size(f"{name}_instances") > 10).count() == 0


def test_lists_are_json_text_in_csv(spark, settings, days):
    row = spark.read.csv(f"{settings.reports}/top10_clicked.csv", sep=";", header=True).first()
    stored = spark.read.parquet(f"{settings.reports}/top10_clicked.parquet").where(F.col("unit_id") == row.unit_id).first()
    assert json.loads(row.top10_clicked_instances) == stored.top10_clicked_instances


def test_every_line_is_counted(spark, settings, days):
    counted = spark.read.parquet(f"{settings.reports}/lines.parquet")
    for log, lines in (("access", inputs.access_lines), ("runtime", inputs.runtime_lines)):
        assert counted.where(F.col("log") == log).agg(F.sum("lines")).first()[0] == lines(spark, SMALL).count()
    bad = counted.agg(F.sum("bad_dates"), F.sum("bad_objects")).first()
    assert bad[0] > 0 and bad[1] > 0


def test_a_second_run_adds_nothing(spark, settings, days):
    before = content(read_enriched(spark, settings.enriched))
    assert pipeline.run(spark, settings) == []
    assert content(read_enriched(spark, settings.enriched)) == before


@pytest.fixture
def small_site(spark, folder):
    """A site with a page, and a function that puts log files there."""
    def put(path, text):
        target = Path(folder) / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text)

    put("web/p.wr", '<A><Page id="a#page1" name="Home"/><Link id="a#ln1" name="open" to="a#d1"/>'
        '<IndexUnit id="a#d1" name="Box" entity="e1" displayAttributes="e1#att1"/></A>')
    put("data/d.wr", '<D><Entity id="e1" name="T" table="X"><Attribute id="e1#att1" name="name" column="NAME"/></Entity></D>')
    put("dumps/X.csv", "OID;NAME\n5;Tea\n")
    return put, Settings(
        (f"{folder}/web",), (f"{folder}/data",), f"{folder}/dumps", (f"{folder}/access/*",), (f"{folder}/runtime/*",),
        f"{folder}/out", ("X",), buckets=2,
    )


def hit(second, session="s1", day="01"):
    return f'10.0.0.1 - - [{day}/Jan/2024:00:00:{second:02} +0000] "GET /app/page1.do HTTP/1.1" 200 5 {session}\n'


SHOWN = "01 Jan 2024 00:00:20,1  INFO [h]  (c.U) - [s1][page1][d1][step][t-1] shown {oid=[5]}\n"


def test_no_line_is_lost_whatever_the_order(spark, small_site):
    put, settings = small_site
    put("access/a", hit(20) + hit(30))
    put("runtime/r0", "")
    assert len(pipeline.run(spark, settings)) == 1
    # Older, in the last second taken in, and newer; what was shown comes a run after its hit.
    put("access/b", hit(10) + hit(30, "s2") + hit(40) + hit(20) + hit(20, day="02") + hit(1, day="31").replace("Jan", "Feb"))
    put("runtime/r1", SHOWN)
    assert len(pipeline.run(spark, settings)) == 2
    log = read_enriched(spark, settings.enriched)
    got = sorted((r.event_date.day, r.time.second, r.session_id, r.displayed_oid_value, r.batch) for r in log.collect())
    assert got == [
        (1, 10, "s1", None, 1), (1, 20, "s1", "Tea", 0), (1, 30, "s1", None, 0), (1, 30, "s2", None, 1),
        (1, 40, "s1", None, 1), (2, 20, "s1", None, 1),
    ]
    visits = spark.read.parquet(f"{settings.reports}/average_visits.parquet").first()
    assert visits.average_visits_per_session == 3.0
    lines = spark.read.parquet(f"{settings.reports}/lines.parquet")
    assert lines.agg(F.sum("lines"), F.sum("bad_dates")).first()[:] == (9, 1)


def seconds(spark, settings):
    return sorted((r.time.second, r.batch) for r in read_enriched(spark, settings.enriched).collect())


def staged_files(monkeypatch):
    """Notes the names of the files whose lines a run stages."""
    names = []
    save = state.save_taken

    def noted(lines, path, log, run):
        names.extend((log, unquote(r.file.rsplit("/", 1)[1])) for r in lines.select("file").distinct().collect())
        save(lines, path, log, run)

    monkeypatch.setattr(pipeline.state, "save_taken", noted)
    return names


def test_only_new_files_are_read_as_text(spark, small_site, monkeypatch):
    put, settings = small_site
    put("access/a", hit(1))
    put("runtime/r0", "")
    names = staged_files(monkeypatch)
    site = pipeline.FileSite(spark, settings)
    assert len(pipeline.take_in(spark, site, settings)) == 1
    assert names == [("access", "a")]
    put("access/b", hit(2))
    put("access/a", hit(1) + hit(3))  # has grown
    put("runtime/r0", SHOWN)  # was empty
    pipeline.take_in(spark, site, settings)
    assert sorted(names[1:]) == [("access", "a"), ("access", "b"), ("runtime", "r0")]
    assert pipeline.take_in(spark, site, settings) == []
    put("access/c", hit(4))
    pipeline.take_in(spark, site, settings)
    assert names[4:] == [("access", "c")]
    assert seconds(spark, settings) == [(1, 0), (2, 1), (3, 1), (4, 2)]
    taken = read_taken(spark, settings.state)
    assert sorted((r.log, r.file.rsplit("/", 1)[1], r.run) for r in taken.collect()) == [
        ("access", "a", 0), ("access", "a", 1), ("access", "b", 1), ("access", "c", 2), ("runtime", "r0", 1)
    ]


def test_a_failed_run_is_repeated(spark, small_site, monkeypatch):
    put, settings = small_site
    put("access/a[1]", hit(1))
    put("runtime/r0", SHOWN)
    site = pipeline.FileSite(spark, settings)
    for step in ("save_taken", "save_run"):
        with monkeypatch.context() as m:
            m.setattr(pipeline.state, step, lambda *_: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                pipeline.take_in(spark, site, settings)
        assert read_taken(spark, settings.state).count() == 0
    put("access/b", hit(20))
    assert len(pipeline.take_in(spark, site, settings)) == 1
    log = read_enriched(spark, settings.enriched).collect()
    assert sorted((r.time.second, r.batch, r.displayed_oid_value) for r in log) == [(1, 0, None), (20, 0, "Tea")]
    assert read_taken(spark, settings.state).count() == 3


def test_many_files_in_steps_of_which_one_fails(spark, small_site):
    """5,000 files in steps of 1,000. A step that fails is done again with its files, the others are not."""
    put, settings = small_site
    settings = dataclasses.replace(settings, files_per_batch=1000)
    for i in range(5000):
        put(f"access/f{i:04}", hit(i % 60, f"s{i}") if i != 3456 else "boom\n" + hit(i % 60, f"s{i}"))

    def failing(lines, keep=()):
        parsed = parse_access_log(lines, keep)
        return parsed.withColumn("ip", F.when(F.col("value") == "boom", F.raise_error(F.lit("no"))).otherwise(F.col("ip")))

    with pytest.raises(StreamingQueryException):
        intake.stage_new(spark, settings, "access", failing, 0)
    first = intake.staged(spark, settings, "access", 0).count()
    assert first % 1000 == 0 and first < 5000
    intake.stage_new(spark, settings, "access", parse_access_log, 0)
    staged = intake.staged(spark, settings, "access", 0)
    assert staged.where("value is null").count() == staged.select("session_id").distinct().count() - 1 == 5000
    offsets = [p.name for p in Path(settings.state.removeprefix("file:"), "intake/access/offsets").iterdir()]
    assert len([n for n in offsets if n.isdigit()]) == 5
    intake.stage_new(spark, settings, "access", parse_access_log, 1)
    assert intake.staged(spark, settings, "access", 1).count() == 0


def test_lines_of_a_day_stay_in_few_parts(spark, folder):
    """Over 20 runs, each with lines of one day; what readers see does not change by folding."""
    settings = Settings((), (), "", (), (), f"{folder}/out", buckets=2, parts_per_day=3)
    lines = Lines(spark, settings, "access")
    most, folded = 0, 0
    for run in range(20):
        new = spark.createDataFrame([(f"s{run}", f"2024-01-01 00:00:{run:02}")], "session_id string, t string").select(
            *[
                {"session_id": F.col("session_id"), "time": F.col("t").cast("timestamp"), "batch": F.lit(run).cast("long"),
                 "event_date": F.lit("2024-01-01").cast("date")}.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name)
                for f in PARSED["access"].fields
            ]
        )
        lines.add(new, run)
        day = [datetime.date(2024, 1, 1)]
        folded += bool(lines.fold(day, run))
        for read in (lines.read(day), lines.read()):
            assert sorted(r.batch for r in read.collect()) == list(range(run + 1))
        lines.remove_folded(run)
        most = max(most, len(lines.parts()[day[0]]))
    assert most <= 2 * settings.parts_per_day + 3 and folded >= 4
    # Another session finds the same, whatever number of buckets it asks for.
    spark.sql(f"DROP TABLE {lines.table.name}")
    again = Lines(spark, dataclasses.replace(settings, buckets=7), "access")
    assert again.read().count() == 20 and again.table.buckets == 2


def test_a_fold_of_a_failed_run_loses_nothing(spark, small_site, monkeypatch):
    put, settings = small_site
    settings = dataclasses.replace(settings, parts_per_day=0, buckets=1)
    site = pipeline.FileSite(spark, settings)
    put("access/a", hit(1))
    pipeline.take_in(spark, site, settings)
    put("access/b", hit(2))
    with monkeypatch.context() as m:
        m.setattr(pipeline.state, "save_run", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            pipeline.take_in(spark, site, settings)
    put("access/c", hit(3))
    pipeline.take_in(spark, site, settings)
    put("access/d", hit(4))
    pipeline.take_in(spark, site, settings)
    assert seconds(spark, settings) == [(1, 0), (2, 1), (3, 1), (4, 2)]
    assert len(Lines(spark, settings, "access").parts()[datetime.date(2024, 1, 1)]) <= 4


def test_days_are_joined_without_a_shuffle(spark, settings, days):
    site = pipeline.FileSite(spark, settings)
    access, runtime = (Lines(spark, settings, log).read(days) for log in ("access", "runtime"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = enriched_log(access, runtime, site, ("ingested_at", "batch"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    # Lookups have shuffles of their own below their broadcasts; nothing of the logs is shuffled.
    shuffled = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)
    assert shuffled and not any("session_id" in keys or "time" in keys for keys in shuffled)
    assert "Exchange RoundRobin" not in plan and "SinglePartition" not in plan


def test_dumps_are_parsed_once(spark, small_site, monkeypatch):
    put, settings = small_site
    put("dumps/Y.csv", "OID;NAME\n1;a\n1;b\n")
    settings = dataclasses.replace(settings, dump_tables=("X", "Y", "Z"), buckets=2)

    def values():
        return sorted(tuple(r) for r in ValueStore(spark, settings).values().collect())

    read = []
    with monkeypatch.context() as m:
        m.setattr(valuestore, "read_dump", lambda spark, path, table: read.append(table) or read_dump(spark, path, table))
        assert ValueStore(spark, settings).refresh() == ["X", "Y"] == read
        assert ValueStore(spark, settings).refresh() == []
        assert values() == [(1, "Y", "NAME", "a"), (1, "Y", "OID", "1"), (5, "X", "NAME", "Tea"), (5, "X", "OID", "5")]
        put("dumps/Y.csv", "OID;TITLE\n2;t\n")
        put("dumps/Z.csv", "OID;NAME\n")
        assert ValueStore(spark, settings).refresh() == ["Y", "Z"] == read[2:]
    assert values() == [(2, "Y", "OID", "2"), (2, "Y", "TITLE", "t"), (5, "X", "NAME", "Tea"), (5, "X", "OID", "5")]
    store = ValueStore(spark, settings)
    assert store.headers["Z"] == {"OID": "OID", "NAME": "NAME"} and store.size(["Y"])[0] == 2
    Path(settings.dumps, "X.csv").unlink()
    assert store.refresh() == [] and set(store.dumps) == {"Y", "Z"} and len(values()) == 2


def test_large_stored_values_are_found_by_key(spark, small_site):
    _, settings = small_site
    settings = dataclasses.replace(settings, limits=Limits(broadcast_rows=0), buckets=2)
    site = pipeline.FileSite(spark, settings)
    keys = spark.createDataFrame([(5, "X", "NAME"), (6, "X", "NAME")], "oid long, value_table string, value_column string")
    found = site.stored_values.lookup(lambda: keys.distinct())
    assert not found.is_small and [tuple(r) for r in found.frame.collect()] == [(5, "X", "NAME", "Tea")]


def test_unused_lines_can_be_taken_in_again(spark, small_site):
    put, settings = small_site
    settings = dataclasses.replace(settings, buckets=1)
    odd = hit(7).replace("GET", "FETCH ~ GET").replace("10.0.0.1 - - [01/Jan/2024:00:00:07", "10.0.0.1 - - [01.01.2024 00:00:07")
    put("access/a", hit(1) + odd + "never\n")
    put("runtime/r", "nothing\n")
    site = pipeline.FileSite(spark, settings)
    pipeline.take_in(spark, site, settings)
    got = pipeline.quarantined(spark, settings).collect()
    assert sorted((r.log, r.value, r.batch) for r in got) == [("access", odd.strip(), 0), ("access", "never", 0), ("runtime", "nothing", 0)]
    assert {r.file.rsplit("/", 1)[1] for r in got} == {"a", "r"}

    def better(lines, keep=()):
        fixed = F.replace("value", F.lit("[01.01.2024 "), F.lit("[01/Jan/2024:"))
        return parse_access_log(lines.withColumn("value", fixed), keep)

    parsers = {"access": better, "runtime": parse_runtime_log}
    assert pipeline.take_in_again(spark, site, settings, parsers) == [datetime.date(2024, 1, 1)]
    assert seconds(spark, settings) == [(1, 0), (7, 1)]
    left = pipeline.quarantined(spark, settings).collect()
    assert sorted((r.log, r.value, r.batch) for r in left) == [("access", "never", 0), ("runtime", "nothing", 0)]
    put("access/b", hit(8) + "neither\n")
    pipeline.take_in(spark, site, settings)
    assert pipeline.quarantined(spark, settings).count() == 3
    assert seconds(spark, settings) == [(1, 0), (7, 1), (8, 2)]


def test_reports_add_up_over_runs(spark, small_site):
    """Three runs with late lines, over midnight: counts by day give what the whole log gives."""
    put, settings = small_site
    settings = dataclasses.replace(settings, buckets=1)
    put("web/q.wr", "".join(f'<Page id="page{i}" name="P{i}"/>' for i in range(2, 5)))

    def views(*places):
        line = '10.0.0.1 - - [{} +0000] "GET /app/page{}.do?sp=page1&link=ln1&att1=5 HTTP/1.1" 200 5 {}\n'
        return "".join(line.format(time, page, session) for time, page, session in places)

    parts = (
        [("02/Jan/2024:00:10:00", 2, "a"), ("03/Jan/2024:12:00:00", 3, "b"), ("05/Jan/2024:00:00:10", 4, "c")],
        [("01/Jan/2024:23:40:00", 1, "a"), ("01/Jan/2024:23:50:00", 1, "a"), ("02/Jan/2024:00:05:00", 1, "a"), ("03/Jan/2024:12:10:00", 1, "b")],
        [("04/Jan/2024:23:59:50", 1, "c"), ("06/Jan/2024:08:00:00", 2, "b"), ("01/Jan/2024:00:00:01", 4, "b"), ("03/Jan/2024:12:05:00", 4, "b")],
    )
    for number, part in enumerate(parts):
        put(f"access/{number}", views(*part))
        put(f"runtime/{number}", SHOWN if number == 1 else "x\n")
        assert pipeline.run(spark, settings)
        visits = pipeline._visits(spark, settings)
        values = pipeline.read_days(spark, f"{settings.extracts}/values", pipeline.EXTRACTED)
        whole = all_reports(visits, instances.clicked_values(values), instances.shown_values(values))
        for name, report in whole.items():
            stored = spark.read.parquet(f"{settings.reports}/{name}.parquet")
            assert sorted(map(str, stored.collect())) == sorted(map(str, report.collect())), (number, name)
        states = pipeline.read_counts(spark, settings, "sessions")
        want = sessions.session_states(sessions.session_days(visits))
        assert sorted(map(str, states.select(sorted(states.columns)).collect())) == sorted(map(str, want.select(sorted(states.columns)).collect()))
    stays = pipeline.read_counts(spark, settings, "stays").where("requested_page_id = 'page1'").collect()
    assert {(str(r.event_date), r.seconds, r.stays) for r in stays} == {("2024-01-02", 1800, 1), ("2024-01-05", 20, 1)}


def test_reports_of_another_kind_are_counted_anew(spark, small_site):
    put, settings = small_site
    settings = dataclasses.replace(settings, buckets=1)
    put("access/a", hit(1) + hit(1, "s2"))
    put("runtime/r", SHOWN)
    pipeline.run(spark, settings)
    merged = dataclasses.replace(settings, merge_sessions=True)
    pipeline.write_reports(spark, merged)
    assert spark.read.parquet(f"{settings.reports}/average_visits.parquet").first().average_visits_per_session == 1.0


def test_times_do_not_depend_on_the_session_zone(spark, small_site):
    put, settings = small_site
    put("access/a", hit(1))
    put("runtime/r0", "")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        [day] = pipeline.take_in(spark, pipeline.FileSite(spark, settings), settings)
        seconds = read_enriched(spark, settings.enriched).select(F.unix_timestamp("time")).first()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert (day.year, day.month, day.day) == (2024, 1, 1) and seconds == 1704067201


def test_views(spark, settings, days):
    names = pipeline.register_views(spark, settings)
    assert {"enriched_log", "combined_analysis", "ORDER", "PART", "model_pages", "model_combined"} <= set(names)
    assert spark.sql("SELECT count(*) FROM model_units JOIN model_attributes USING (entity_id)").first()[0] > 0
    by_name = spark.sql("SELECT count(*) FROM enriched_log JOIN `ORDER` o ON displayed_oid = o.OID AND value_table = 'ORDER'")
    assert by_name.first()[0] > 0


def test_one_file_only_if_asked_for(spark, folder):
    report = spark.range(100).repartition(4)
    write_csv(report, f"{folder}/many")
    write_csv(report, f"{folder}/one", single_file=True)
    assert len(list(Path(f"{folder}/many").glob("part-*"))) == 4
    assert len(list(Path(f"{folder}/one").glob("part-*"))) == 1


def test_nothing_before_the_first_batch(spark, folder):
    assert read_enriched(spark, f"{folder}/none").count() == 0
    assert read_taken(spark, f"{folder}/none").count() == 0


def test_scratch_is_in_the_shared_folder(spark):
    assert inputs.scratch(spark).startswith(spark.conf.get("spark.checkpoint.dir"))


def test_shuffled_lookups_give_the_same_log(spark):
    d = Data(spark, SMALL)
    site = inputs.TableSite(spark, SMALL, Limits(broadcast_rows=0))
    assert content(enriched_log(d.access, d.runtime, site)) == content(d.enriched)


def test_enriched_log_holds_no_row_twice(spark):
    rows = content(Data(spark, SMALL).enriched)
    assert len(rows) == len(set(rows))


def test_usual_layout():
    settings = Settings.under("file:/base", "web", "data", "dumps", "logs", "logs", "out", merge_sessions=True)
    assert settings.web_model[0] == "file:/base/web/*/*/*/page*.wr"
    assert settings.reports == "file:/base/out/reports"
    assert settings.merge_sessions and "ORDER" in settings.dump_tables


def test_large_dumps_are_joined_key_by_key(spark):
    """No dump row is unpivoted or copied: the plan has no generator above a scan of a dump."""
    d = Data(spark, SMALL)
    site = inputs.TableSite(spark, SMALL, Limits(broadcast_rows=0))
    keys = spark.createDataFrame([(1, "PART", "NAME")], "oid long, value_table string, value_column string")
    found = site.stored_values.lookup(lambda: keys).frame
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r)[:3] for r in found.collect()] == [(1, "PART", "NAME")]
    assert found.first().value == d.site.stored_values.lookup(lambda: keys).frame.where(
        "oid = 1 and value_table = 'PART' and value_column = 'NAME'"
    ).first().value


def test_the_log_is_made_once_for_both_writes(spark, monkeypatch):
    from testbed import queries as registered

    plans, write = [], registered.write_enriched

    def recorded(rows, path):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        write(rows, path)

    monkeypatch.setattr(registered, "write_enriched", recorded)
    registered.QUERIES["enriched_roundtrip"](Data(spark, SMALL))
    assert len(plans) == 2 and all("Join" not in plan for plan in plans)


def test_counts_are_wide(spark):
    from footfall.operators.instances import displayed_counts

    assert dict(displayed_counts(Data(spark, SMALL).shown_log).dtypes)["n"] == "bigint"


def test_large_first_inputs_lie_in_more_buckets(spark, small_site, monkeypatch):
    """A bucket is one task's, so their number follows the first input; later runs keep it."""
    put, settings = small_site
    put("access/a", "".join(hit(i) for i in range(10)))
    put("runtime/r", SHOWN)
    logs, dumps = (sum(p.stat().st_size for f in names for p in Path(settings.dumps).parent.glob(f)) for names in (("access/*", "runtime/*"), ("dumps/*",)))
    monkeypatch.setattr("footfall.sources.tables.BUCKET_BYTES", 4)
    assert ValueStore(spark, settings).table.buckets == -(-dumps // 4) > settings.buckets
    monkeypatch.setattr("footfall.sources.tables.BUCKET_BYTES", 100)
    pipeline.take_in(spark, pipeline.FileSite(spark, settings), settings)
    assert len(seconds(spark, settings)) == 10
    put("access/b", "".join(hit(i) for i in range(10, 20)))
    pipeline.take_in(spark, pipeline.FileSite(spark, settings), settings)
    assert len(seconds(spark, settings)) == 20
    assert {Lines(spark, settings, log).table.buckets for log in ("access", "runtime")} == {-(-logs // 100)}
