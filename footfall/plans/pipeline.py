"""From raw inputs to stored reports."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from datetime import date, datetime, timedelta, timezone
from functools import cached_property, partial

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DateType, LongType, StringType, StructField, StructType, TimestampType

from footfall.config import Settings
from footfall.functions.accesslog import parse_access_log
from footfall.functions.runtimelog import parse_runtime_log
from footfall.functions.text import day_of
from footfall.operators import instances, links, navigation, sessions
from footfall.operators.combined import MEASURES, combined_analysis, counted_reports
from footfall.operators.enrich import Site, enriched_log
from footfall.operators.lines import count_lines
from footfall.operators.models import combined_model
from footfall.operators.values import Headers, KeptValues
from footfall.schemas import LINE_COUNTS, STORED
from footfall.sinks.enriched import on_days, read_days, write_days, write_enriched
from footfall.sinks.reports import write_csv, write_json, write_parquet
from footfall.sources import dumps, files, intake, logs, models, state
from footfall.sources.files import ORIGIN, removed
from footfall.sources.tables import Lines
from footfall.sources.valuestore import ValueStore

# What reports on pages and links need of the enriched log.
VISIT = (
    "time",
    "session_id",
    "source_page_id",
    "requested_page_id",
    "requested_page_name",
    "clicked_link_id",
    "clicked_link_name",
)
EXTRACTED = StructType([StructField(c, TimestampType() if c == "time" else StringType()) for c in instances.EXTRACT])
LOGS = {"access": parse_access_log, "runtime": parse_runtime_log}
# A run that has tried unused lines again.
AGAIN = "again"
# How many small writes run side by side.
WRITERS = 6

_TEXT, _NUMBER = StringType(), LongType()
_PAGE = [StructField(c, _TEXT) for c in sessions.PAGE]
_END = StructType([STORED["time"], *_PAGE])


def _counts(*fields: StructField, of: tuple[str, ...]) -> StructType:
    return StructType([*fields, *[StructField(c, _NUMBER) for c in of]])


# What is stored by day, without the day.
COUNTS = {
    "visits": _counts(*_PAGE, of=("visits",)),
    "clicks": _counts(*[StructField(c, _TEXT) for c in links.STEP], of=("clicks",)),
    "clicked": _counts(*[StructField(c, _TEXT) for c in (*instances.CLICKED_UNIT, "value")], of=("n",)),
    "shown": _counts(*[StructField(c, _TEXT) for c in (*instances.SHOWN_UNIT, "value")], of=("n",)),
    "stays": _counts(*_PAGE, of=("seconds", "stays")),
    "ends": _counts(StructField("end", _TEXT), *_PAGE, of=("sessions",)),
    "session_days": StructType([StructField("session_id", _TEXT), StructField("first", _END), StructField("last", _END)]),
    "sessions": StructType(
        [
            StructField("session_id", _TEXT),
            StructField("first", _END),
            StructField("last", _END),
            StructField("first_date", DateType()),
        ]
    ),
}
COUNTED = ("visits", "clicks", "clicked", "shown", "stays", "ends")


class FileSite(Site):
    """A site whose model and dumps are in files.

    The model's files are read once and its relations stored, as several joins of a run read them. Of
    the dumps, the values are kept from run to run.
    """

    def __init__(self, spark: SparkSession, settings: Settings):
        super().__init__(spark, settings.limits)
        self.settings = settings

    def _stored(self, name: str, relation: DataFrame) -> DataFrame:
        return write_parquet(relation, f"{self.settings.model}/{name}")

    @cached_property
    def web(self) -> DataFrame:
        return self._stored("web", models.read_elements(self.spark, self.settings.web_model))

    @cached_property
    def pages(self) -> DataFrame:
        return self._stored("pages", models.pages(models.of_kind(self.web, models.PAGE_TAGS)))

    @cached_property
    def links(self) -> DataFrame:
        return self._stored("links", models.links(models.of_kind(self.web, models.LINK_TAGS)))

    @cached_property
    def units(self) -> DataFrame:
        return self._stored("units", models.units(models.of_kind(self.web, models.UNIT_TAGS)))

    @cached_property
    def attributes(self) -> DataFrame:
        return self._stored("attributes", models.read_attributes(self.spark, self.settings.data_model))

    @cached_property
    def combined(self) -> DataFrame:
        return self._stored("combined", combined_model(self.units, self.attributes))

    @cached_property
    def values(self) -> ValueStore:
        store = ValueStore(self.spark, self.settings)
        store.refresh()
        return store

    @property
    def headers(self) -> Headers:
        return self.values.headers

    @cached_property
    def stored_values(self) -> KeptValues:
        return KeptValues(self.values, lambda: self.displayed, self.limits)


def at_once(writes: Iterable[Callable]) -> list:
    """The results of writes that do not depend on each other; Spark runs their jobs side by side."""
    with ThreadPoolExecutor(WRITERS) as pool:
        return [done.result() for done in [pool.submit(write) for write in writes]]


def enrich(access_lines: DataFrame, runtime_lines: DataFrame, site: Site) -> DataFrame:
    """Log lines as the enriched log."""
    return enriched_log(
        state.usable(parse_access_log(access_lines)), state.usable(parse_runtime_log(runtime_lines)), site
    )


def take_in(spark: SparkSession, site: Site, settings: Settings) -> list[date]:
    """Adds the log files that are new, or have changed, to the enriched log; returns the days they touch.

    Lines may come in any order and more than once: the days that a run touches are made anew from
    all parsed lines of theirs, in which equal events count once. Only the new files are read as text.
    A run counts when it is recorded as completed, which is done last; if one fails before that, the
    next one has its number, goes on with the files that it has not staged yet, and replaces what it wrote.
    """
    started = datetime.now(timezone.utc)
    run = state.next_run(spark, settings.state)
    for log, parse in LOGS.items():
        intake.stage_new(spark, settings, log, parse, run)
        known = state.read_taken(spark, settings.state).where(F.col("log") == log).select(*ORIGIN)
        known = known.union(intake.staged(spark, settings, log, run).select(*ORIGIN))
        changed = intake.changed_files(spark, settings, log, known, started)
        intake.stage_changed(spark, settings, log, parse, run, changed)
    days = {log: store_lines(intake.staged(spark, settings, log, run), settings, log, run, started) for log in LOGS}
    if all(own is None for own in days.values()):
        return []
    return _complete(spark, site, settings, sorted({d for own in days.values() for d in own or ()}), run, "files")


def store_lines(staged: DataFrame, settings: Settings, log: str, run: int, now: datetime) -> set[date] | None:
    """Stores what a run has staged of a log: its files, line counts, lines by day, and those that cannot be used.

    Returns the days of its lines, or None if there are no lines.
    """
    spark = staged.sparkSession
    dated = staged.withColumn("event_date", day_of("time"))
    counts = f"{settings.line_counts}/log={log}/batch={run}"
    count_lines(dated, log, ("event_date",)).drop("log").write.mode("overwrite").parquet(counts)
    found = spark.read.schema(StructType(LINE_COUNTS.fields[:-2])).parquet(counts)
    days = found.where((F.col("shape") > 0) & F.col("event_date").isNotNull()).select("event_date").distinct()
    days = {r[0] for r in days.collect()}
    if not days and found.isEmpty():
        return None
    state.save_taken(staged, settings.state, log, run)
    stamped = dated.withColumn("ingested_at", F.lit(now)).withColumn("batch", F.lit(run).cast("bigint"))
    Lines(spark, settings, log).add(state.usable(stamped), run)
    unused = stamped.where(F.col("value").isNotNull()).select("value", "shape", "file", "batch")
    unused.write.mode("overwrite").parquet(f"{settings.quarantine}/log={log}/run={run}")
    return days


def _complete(spark: SparkSession, site: Site, settings: Settings, days: list[date], run: int, kind: str) -> list[date]:
    """Makes the days anew that a run touches, records it as completed, and takes away what has been replaced."""
    lines = {log: Lines(spark, settings, log) for log in LOGS}
    for own in lines.values():
        own.fold(days, run)
    make_days(spark, site, settings, days)
    state.save_run(spark, settings.state, run, kind)
    for log, own in lines.items():
        own.remove_folded(run)
        intake.remove_staged(spark, settings, log, run)
    return days


def quarantined(spark: SparkSession, settings: Settings) -> DataFrame:
    """The lines of all completed runs that could not be used, with the run that read them as ``batch``."""
    runs = state.read_runs(spark, settings.state).agg(
        F.coalesce(F.max("run"), F.lit(-1)), F.coalesce(F.max(F.when(F.col("kind") == AGAIN, F.col("run"))), F.lit(0))
    )
    done, again = runs.first()
    return logs.read_quarantined(spark, settings.quarantine, again).where(F.col("batch") <= done)


def take_in_again(spark: SparkSession, site: Site, settings: Settings, parsers: Mapping[str, intake.Parser] = LOGS) -> list[date]:
    """Tries all lines again that could not be used, for instance with better parsers; returns the days they touch.

    Those that can be used now join the enriched log, the others stay as they are.
    """
    now = datetime.now(timezone.utc)
    run = state.next_run(spark, settings.state)
    lines = quarantined(spark, settings)
    days: set[date] = set()
    for log, parse in parsers.items():
        parsed = parse(lines.where(F.col("log") == log), keep=("value", "file", "batch"))
        tried = write_parquet(parsed.withColumn("event_date", day_of("time")), f"{settings.staged}/again/{log}/run={run}")
        usable = state.usable(tried).withColumn("ingested_at", F.lit(now)).withColumn("batch", F.lit(run).cast("bigint"))
        Lines(spark, settings, log).add(usable, run)
        days.update(r[0] for r in usable.select("event_date").distinct().collect())
        still = tried.where(~intake.is_usable()).select("value", "shape", "file", "batch")
        still.write.mode("overwrite").parquet(f"{settings.quarantine}/log={log}/run={run}")
        used = count_lines(usable, log, ("event_date",)).drop("log")
        used.write.mode("overwrite").parquet(f"{settings.line_counts}/log={log}/batch={run}")
    made = _complete(spark, site, settings, sorted(days), run, AGAIN)
    for log in parsers:
        removed(spark, f"{settings.staged}/again/{log}/run={run}")
    return made


def make_days(spark: SparkSession, site: Site, settings: Settings, days: list[date]) -> None:
    """The enriched log of some days from their stored lines, and all that reports need of it.

    They take the place of what there was of these days; a day keeps it if the design model no longer
    knows any of its pages.
    """
    if not days:
        return
    access, runtime = (Lines(spark, settings, log).read(days) for log in LOGS)
    write_enriched(enriched_log(access, runtime, site, ("ingested_at", "batch")), settings.enriched)
    log = on_days(logs.read_enriched(spark, settings.enriched), days)
    visits, values = log.select("event_date", *VISIT).distinct(), instances.extract(log, "event_date")
    at_once(
        [
            partial(write_days, visits, f"{settings.extracts}/visits", "session_id", "time", days=days),
            partial(write_days, values, f"{settings.extracts}/values", "kind", "unit_id", days=days),
        ]
    )
    count_days(spark, settings, days)


def _visits(spark: SparkSession, settings: Settings) -> DataFrame:
    return read_days(spark, f"{settings.extracts}/visits", StructType([STORED[c] for c in VISIT]))


def count_days(spark: SparkSession, settings: Settings, days: list[date]) -> None:
    """What those days contribute to the reports. A day's stays begin in the hour before it, so the next day's change as well."""
    by = ("event_date",)
    visits = _visits(spark, settings)
    values = on_days(read_days(spark, f"{settings.extracts}/values", EXTRACTED), days)
    own = on_days(visits, days)
    once = settings.merge_sessions
    clicked, shown = (part(values, *by) for part in (instances.clicked_values, instances.shown_values))
    following = sorted({*days, *(d + timedelta(days=1) for d in days)})
    pages = sessions.page_visits(own, by).groupBy(*sessions.PAGE, *by).agg(F.sum("visits").alias("visits"))
    at_once(
        partial(write_days, counts, f"{settings.aggregates}/{name}", days=touched)
        for name, counts, touched in (
            ("visits", pages, days),
            ("clicks", links.link_counts(own, once, by), days),
            ("clicked", instances.clicked_counts(clicked, once, by), days),
            ("shown", instances.displayed_counts(shown, once, by), days),
            ("stays", navigation.stays_of_days(visits, following, once), following),
            ("session_days", sessions.session_days(own), days),
        )
    )
    _renew_sessions(spark, settings, days)


def read_counts(spark: SparkSession, settings: Settings, name: str) -> DataFrame:
    """Stored counts by day."""
    return read_days(spark, f"{settings.aggregates}/{name}", COUNTS[name])


def _renew_sessions(spark: SparkSession, settings: Settings, days: list[date]) -> None:
    """Makes the states of sessions anew that were or are on those days.

    States lie by the day on which a session was last seen. Only those days are rewritten on which one of
    the sessions was or is last seen; of a session's days, all are read.
    """
    states = read_counts(spark, settings, "sessions")
    by_day = read_counts(spark, settings, "session_days")
    # The days that a session's state spans are all that it can have been on.
    touched = F.exists(F.lit(days), lambda d: (d >= F.col("first_date")) & (d <= F.col("event_date")))
    before = states.where((F.col("event_date") >= F.lit(min(days))) & touched)
    renewed = before.select("session_id").union(on_days(by_day, days).select("session_id")).distinct()
    renewed = write_parquet(renewed, f"{settings.aggregates}/renewed").withColumnRenamed("session_id", "renewed_id")
    same = F.col("session_id").eqNullSafe(F.col("renewed_id"))
    first, last = before.agg(F.min("first_date"), F.max("event_date")).first()
    first, last = min(min(days), first or min(days)), max(max(days), last or max(days))
    spanned = by_day.where(F.col("event_date").between(F.lit(first), F.lit(last)))
    new = write_parquet(
        sessions.session_states(spanned.join(renewed, same, "left_semi")), f"{settings.aggregates}/renewed_sessions"
    )
    rewritten = sorted({r[0] for r in before.union(new.select(before.columns)).select("event_date").distinct().collect()})
    others = on_days(states, rewritten).join(renewed, same, "left_anti")
    content = write_parquet(others.unionByName(new), f"{settings.aggregates}/rewritten_sessions")
    at_once(
        partial(write_days, rows, f"{settings.aggregates}/{name}", days=rewritten)
        for name, rows in (("sessions", content), ("ends", sessions.session_ends(content)))
    )


def write_reports(spark: SparkSession, settings: Settings) -> None:
    """All reports, each as Parquet and CSV, the combined one also as JSON.

    They add up the stored counts of days; the log itself is not read. The combined report reads the
    stored reports. One more report counts the lines of each batch.
    """
    if files.stored(spark, f"{settings.aggregates}/session_days", StructType([])).isEmpty():
        # Counts of this kind have not been kept so far.
        days = sorted(r[0] for r in _visits(spark, settings).select("event_date").distinct().collect())
        if days:
            count_days(spark, settings, days)
    reports = counted_reports({name: read_counts(spark, settings, name) for name in COUNTED})
    reports["lines"] = logs.read_line_counts(spark, settings.line_counts)
    stored = dict(zip(reports, at_once(partial(_store, report, name, settings) for name, report in reports.items())))
    combined = _store(combined_analysis(stored), "combined_analysis", settings)
    write_json(combined, f"{settings.reports}/combined_analysis.json", settings.single_file)


def _store(report: DataFrame, name: str, settings: Settings) -> DataFrame:
    stored = write_parquet(report, f"{settings.reports}/{name}.parquet")
    write_csv(stored, f"{settings.reports}/{name}.csv", settings.single_file)
    return stored


def register_views(spark: SparkSession, settings: Settings) -> list[str]:
    """Makes the stored log, the reports, the dumps and the design model known to SQL; returns the names.

    A dump has the name of its table, which may have to be quoted. The model's relations are
    ``model_pages``, ``model_links``, ``model_units``, ``model_attributes`` and ``model_combined``.
    """
    views = {"enriched_log": logs.read_enriched(spark, settings.enriched)}
    for name in (*MEASURES, "combined_analysis", "lines"):
        views[name] = spark.read.parquet(f"{settings.reports}/{name}.parquet")
    views.update(dumps.read_dumps(spark, settings.dumps, settings.dump_tables))
    for name in ("pages", "links", "units", "attributes", "combined"):
        views[f"model_{name}"] = spark.read.parquet(f"{settings.output}/model/{name}")
    for name, view in views.items():
        view.createOrReplaceTempView(f"`{name}`")
    return list(views)


def run(spark: SparkSession, settings: Settings) -> list[date]:
    """Takes in what is new in the logs and renews the reports; returns the days that were made anew."""
    days = take_in(spark, FileSite(spark, settings), settings)
    write_reports(spark, settings)
    return days
