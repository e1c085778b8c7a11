"""One registered query per operator, each over the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, TimestampType

from footfall.config import Settings
from footfall.functions.accesslog import parse_access_log
from footfall.functions.runtimelog import parse_runtime_log
from footfall.functions.text import last_segment
from footfall.operators import enrich, instances, links, navigation, sessions, values
from footfall.operators.combined import all_reports, combined_analysis
from footfall.operators.lines import count_lines, count_shapes
from footfall.operators.models import combined_model
from footfall.plans import pipeline
from footfall.sinks import reports as sinks
from footfall.sinks.enriched import write_enriched
from footfall.sources import dumps, logs, models
from footfall.sources.state import usable
from footfall.sources.valuestore import ValueStore
from testbed import inputs

ARRIVAL = "2024-01-16"


class Data:
    """The inputs of one session and folder, parsed but not computed."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        inputs.prepare(spark)
        self.spark = spark
        self.sf_dir = sf_dir

    @cached_property
    def site(self) -> enrich.Site:
        return inputs.TableSite(self.spark, self.sf_dir)

    @cached_property
    def access(self) -> DataFrame:
        return usable(parse_access_log(inputs.access_lines(self.spark, self.sf_dir)))

    @cached_property
    def runtime(self) -> DataFrame:
        return usable(parse_runtime_log(inputs.runtime_lines(self.spark, self.sf_dir)))

    @cached_property
    def hits(self) -> DataFrame:
        return enrich.with_requested_page(enrich.distinct_hits(self.access), self.site)

    @cached_property
    def entity_hits(self) -> DataFrame:
        return enrich.with_clicked_entity(self.hits, self.site)

    @cached_property
    def source_hits(self) -> DataFrame:
        return enrich.with_source_page(self.entity_hits, self.site)

    @cached_property
    def model_hits(self) -> DataFrame:
        return enrich.with_displayed_columns(self.source_hits, self.site)

    @cached_property
    def page_log(self) -> DataFrame:
        """What reports on pages need: they collapse repeated hits themselves."""
        return enrich.with_requested_page(self.access, self.site)

    @cached_property
    def link_log(self) -> DataFrame:
        return enrich.with_clicked_link(self.page_log, self.site)

    @cached_property
    def clicked_log(self) -> DataFrame:
        return enrich.valued_hits(self.access, self.site)

    @cached_property
    def distinct_shown(self) -> DataFrame:
        return enrich.distinct_shown(self.runtime)

    @cached_property
    def shown_log(self) -> DataFrame:
        return enrich.shown_on_hits(self.access, self.runtime, self.site)

    @cached_property
    def enriched(self) -> DataFrame:
        return enrich.enriched_log(self.access, self.runtime, self.site)

    @cached_property
    def scratch(self) -> str:
        return inputs.scratch(self.spark)


def plain(frame: DataFrame) -> DataFrame:
    """Times and lists as text, so that both engines show them alike."""
    columns = []
    for f in frame.schema.fields:
        column = F.col(f"`{f.name}`")
        if isinstance(f.dataType, TimestampType):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, ArrayType):
            separator = "|" if f.dataType.elementType.typeName() == "string" else ","
            column = F.array_join(column.cast("array<string>"), separator)
        columns.append(column.alias(f.name))
    return frame.select(*columns)


def model(reader: Callable, part: str) -> Callable[[Data], DataFrame]:
    """Reads one relation of the design model from XML files."""

    def query(d: Data) -> DataFrame:
        inputs.write_model(d.spark, d.sf_dir, d.scratch)
        return reader(d.spark, [f"{d.scratch}/{part}"])

    return query


def db_dump_scan(d: Data) -> DataFrame:
    inputs.write_dumps(d.spark, d.sf_dir, d.scratch)
    tables = dumps.read_dumps(d.spark, d.scratch, inputs.DUMPS)
    lower = [t.toDF(*[c.lower() for c in t.columns]) for t in tables.values()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), lower)


def segments(d: Data) -> DataFrame:
    return inputs.table(d.spark, d.sf_dir, "pages").select(
        "page_id", last_segment("url", "/").alias("after_slash"), last_segment("url", ".").alias("after_dot")
    )


def oid_values(d: Data) -> DataFrame:
    hits = enrich.with_clicked_link(d.model_hits, d.site)
    keys = values.lookup_keys(hits, enrich.described_shown(d.distinct_shown, d.site))
    return values.oid_values(keys, d.site.stored_values)


def oid_values_joined(d: Data) -> DataFrame:
    clicked = enrich.valued_hits(enrich.distinct_hits(d.access), d.site).select(
        F.lit("access").alias("log"),
        "time",
        "session_id",
        F.col("clicked_oid").alias("oid"),
        F.col("clicked_type_oid").alias("type_oid"),
        F.col("clicked_oid_value").alias("oid_value"),
    )
    shown = enrich.valued_shown(d.distinct_shown, d.site).select(
        F.lit("runtime"), "time", "session_id", "displayed_oid", "displayed_type_oid", "displayed_oid_value"
    )
    return clicked.union(shown)


def combined(d: Data) -> DataFrame:
    """The reports on pages and links share one stored extract of the log, those on values another."""
    hits = sinks.write_parquet(enrich.distinct_hits(d.access), f"{d.scratch}/hits")
    shown = sinks.write_parquet(d.runtime, f"{d.scratch}/shown")
    linked = enrich.with_clicked_link(enrich.with_requested_page(hits, d.site), d.site)
    visits = sinks.write_parquet(linked.select(*pipeline.VISIT).distinct(), f"{d.scratch}/visits")
    clicked, displayed = enrich.valued_hits(hits, d.site), enrich.shown_on_hits(hits, shown, d.site)
    return combined_analysis(all_reports(visits, clicked, displayed))


def enriched_roundtrip(d: Data) -> DataFrame:
    """Writes the days twice, as after a failed run; the second time replaces the first. The log itself is made once."""
    made = sinks.write_parquet(d.enriched, f"{d.scratch}/made")
    for _ in range(2):
        write_enriched(made, f"{d.scratch}/enriched")
    return logs.read_enriched(d.spark, f"{d.scratch}/enriched").drop(*enrich.STAMPS)


def log_files_scan(d: Data) -> DataFrame:
    """Both logs read from files of two servers."""
    inputs.deliver(d.spark, d.sf_dir, d.scratch, "front", "event_id % 2 = 0", "event_id % 2 = 1")
    inputs.deliver(d.spark, d.sf_dir, d.scratch, "back", "event_id % 2 = 1", "event_id % 2 = 0")

    def lines(log):
        return logs.read_lines(d.spark, [f"{d.scratch}/{log}/{server}*" for server in ("front", "back", "none")])

    access, runtime = usable(parse_access_log(lines("access"))), usable(parse_runtime_log(lines("runtime")))
    return access.select(
        F.lit("access").alias("log"), "shape", "time", "session_id", F.col("requested_page_id").alias("page_id")
    ).union(runtime.select(F.lit("runtime"), "shape", "time", "session_id", "page_id"))


def deliveries(d: Data, *parts: tuple[str, str, str], **more) -> Settings:
    """A run for each delivery (server's name, condition on either log's events); ``more`` are settings."""
    settings = replace(inputs.write_site(d.spark, d.sf_dir, d.scratch), **more)
    site = pipeline.FileSite(d.spark, settings)
    for name, access, runtime in parts:
        inputs.deliver(d.spark, d.sf_dir, d.scratch, name, access, runtime)
        pipeline.take_in(d.spark, site, settings)
    return settings


def arrivals(d: Data, *parts: tuple[str, str, str]) -> DataFrame:
    """The enriched log after all deliveries."""
    return logs.read_enriched(d.spark, deliveries(d, *parts).enriched)


# Everything but every third event, then these: late first and last pages of sessions, on all days.
LATE = (("front", "event_id % 3 <> 0", "event_id % 3 <> 1"), ("back", "event_id % 3 = 0", "event_id % 3 = 1"))


def incremental_cutoff(d: Data) -> DataFrame:
    """The logs arrive in two parts and once more as they were; each event is stored once."""
    before, after = f"ts < '{ARRIVAL}'", f"ts >= '{ARRIVAL}'"
    log = arrivals(d, ("front1", before, before), ("front2", after, after), ("back", before, before))
    return log.groupBy("batch").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("time").alias("first_time"),
        F.max("time").alias("last_time"),
        F.count_distinct("ingested_at").alias("moments"),
    )


def late_arrival(d: Data) -> DataFrame:
    """The later half of the hits comes first, less the odd ones, and what was shown comes a run after all hits."""
    late = f"ts >= '{ARRIVAL}' and event_id % 2 = 0"
    log = arrivals(d, ("back", late, "false"), ("front1", f"not ({late})", "false"), ("front2", "false", "true"))
    return log.drop(*enrich.STAMPS)


def compacted_log(d: Data) -> DataFrame:
    """Three runs on the same days, whose lines are folded into one part from the second run on."""
    parts = tuple((f"front{i}", f"event_id % 3 = {i}", f"event_id % 3 = {2 - i}") for i in range(3))
    settings = deliveries(d, *parts, parts_per_day=0)
    return logs.read_enriched(d.spark, settings.enriched).drop(*enrich.STAMPS)


def reports_by_day(d: Data) -> DataFrame:
    """The combined report from counts that two runs have stored by day."""
    settings = deliveries(d, *LATE)
    pipeline.write_reports(d.spark, settings)
    return d.spark.read.parquet(f"{settings.reports}/combined_analysis.parquet")


def session_state(d: Data) -> DataFrame:
    """First and last page of each session, kept over two runs."""
    settings = deliveries(d, *LATE)
    ends = [F.col(f"{end}.{c}").alias(f"{end}_{c}") for end in ("first", "last") for c in ("time", *sessions.PAGE)]
    return pipeline.read_counts(d.spark, settings, "sessions").select("session_id", *ends)


def residence_by_day(d: Data) -> DataFrame:
    """Stays by page and the day they end on, kept over two runs."""
    stays = pipeline.read_counts(d.spark, deliveries(d, *LATE), "stays")
    return stays.withColumn("event_date", F.col("event_date").cast("string"))


def value_store(d: Data) -> DataFrame:
    """All dumped values from the store; the second time it is asked nothing has changed."""
    settings = inputs.write_site(d.spark, d.sf_dir, d.scratch)
    store = ValueStore(d.spark, settings)
    store.refresh()
    store.refresh()
    return store.values()


def quarantined_lines(d: Data) -> DataFrame:
    settings = deliveries(d, ("front", "true", "true"))
    lines = pipeline.quarantined(d.spark, settings)
    return lines.select("log", F.coalesce("shape", F.lit(0)).alias("shape"), "value", "batch")


def rejected_lines(d: Data) -> DataFrame:
    access, runtime = inputs.access_lines(d.spark, d.sf_dir), inputs.runtime_lines(d.spark, d.sf_dir)
    return count_lines(parse_access_log(access), "access").union(count_lines(parse_runtime_log(runtime), "runtime"))


def sink_parquet(d: Data) -> DataFrame:
    return sinks.write_parquet(sessions.average_visits(d.page_log), f"{d.scratch}/report")


def sink_csv(d: Data) -> DataFrame:
    report = sinks.write_parquet(instances.top10_displayed(d.shown_log), f"{d.scratch}/stored")
    sinks.write_csv(report, f"{d.scratch}/report")
    return d.spark.read.csv(f"{d.scratch}/report", sep=";", header=True)


def sink_json(d: Data) -> DataFrame:
    report = sinks.write_parquet(combined(d), f"{d.scratch}/stored")
    sinks.write_json(report, f"{d.scratch}/report")
    return d.spark.read.schema(report.schema).json(f"{d.scratch}/report")


QUERIES: dict[str, Callable[[Data], DataFrame]] = {
    "model_pages": model(models.read_pages, "web/pages"),
    "model_links": model(models.read_links, "web/links"),
    "model_units": model(models.read_units, "web/units"),
    "data_model_attributes": model(models.read_attributes, "data"),
    "db_dump_scan": db_dump_scan,
    "combined_model": lambda d: combined_model(d.site.units, d.site.attributes),
    "last_segment": segments,
    "access_log_parse": lambda d: d.access,
    "access_log_shapes": lambda d: count_shapes(parse_access_log(inputs.access_lines(d.spark, d.sf_dir))),
    "runtime_log_shapes": lambda d: count_shapes(parse_runtime_log(inputs.runtime_lines(d.spark, d.sf_dir))),
    "rejected_lines": rejected_lines,
    "log_files_scan": log_files_scan,
    "runtime_log_parse": lambda d: d.runtime,
    "runtime_oids": lambda d: enrich.shown_objects(d.runtime),
    "hits_requested_page": lambda d: d.hits,
    "hits_clicked_entity": lambda d: d.entity_hits,
    "hits_source_page": lambda d: d.source_hits,
    "hits_models": lambda d: d.model_hits,
    "hits_links": lambda d: enrich.with_clicked_link(d.model_hits, d.site),
    "runtime_pages": lambda d: enrich.with_displayed_page(d.distinct_shown, d.site),
    "runtime_enriched": lambda d: enrich.described_shown(d.distinct_shown, d.site),
    "oid_values": oid_values,
    "oid_values_joined": oid_values_joined,
    "enriched_log": lambda d: d.enriched,
    "enriched_roundtrip": enriched_roundtrip,
    "incremental_cutoff": incremental_cutoff,
    "late_arrival": late_arrival,
    "compacted_log": compacted_log,
    "reports_by_day": reports_by_day,
    "session_state": session_state,
    "residence_by_day": residence_by_day,
    "value_store": value_store,
    "quarantined_lines": quarantined_lines,
    "bounce_rate": lambda d: sessions.bounce_rate(d.page_log),
    "entrance_rate": lambda d: sessions.entrance_rate(d.page_log),
    "average_visits": lambda d: sessions.average_visits(d.page_log),
    "page_flow": lambda d: navigation.page_flow(d.page_log),
    "next_navigation": lambda d: navigation.next_navigation(d.page_log),
    "residence_time": lambda d: navigation.residence_time(d.page_log),
    "link_counts": lambda d: links.link_counts(d.link_log),
    "link_counts_merged": lambda d: links.link_counts(d.link_log, merge_sessions=True),
    "residence_time_merged": lambda d: navigation.residence_time(d.page_log, merge_sessions=True),
    "displayed_counts_merged": lambda d: instances.displayed_counts(d.shown_log, merge_sessions=True),
    "clicked_counts_merged": lambda d: instances.clicked_counts(d.clicked_log, merge_sessions=True),
    "output_link": lambda d: links.output_link(d.link_log),
    "input_link": lambda d: links.input_link(d.link_log),
    "displayed_counts": lambda d: instances.displayed_counts(d.shown_log),
    "clicked_counts": lambda d: instances.clicked_counts(d.clicked_log),
    "top10_displayed": lambda d: instances.top10_displayed(d.shown_log),
    "top10_clicked": lambda d: instances.top10_clicked(d.clicked_log),
    "combined_analysis": combined,
    "sink_parquet": sink_parquet,
    "sink_csv": sink_csv,
    "sink_json": sink_json,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(query):
        return lambda spark, sf_dir: plain(query(Data(spark, sf_dir)))

    return {name: bind(query) for name, query in QUERIES.items()}
