"""The given test tables as logs, design model and dumps of a site (see FIXTURES.md).

``events`` become log lines; ``supplier``, ``nation`` and ``part`` become the design model;
``part``, ``customer`` and ``orders`` become the dumps. Everything grows with the tables. Log
lines are computed as text and parsed by the library like any line of a file; the model and the
dumps are also written as XML and CSV files where a query is about reading them.
"""

from __future__ import annotations

import os
import uuid
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from footfall.config import SESSION, Limits, Settings
from footfall.operators.enrich import Site
from footfall.sources import dumps, models

DUMPS = ("PART", "CUSTOMER", "ORDER")
# How many elements a file of the design model has at most: each is read as one text, by one task.
MODEL_ROWS = 50_000


def prepare(spark: SparkSession) -> None:
    for name, value in SESSION.items():
        spark.conf.set(name, value)


def scratch(spark: SparkSession) -> str:
    """A new folder in the place the session names for shared files; on one machine its warehouse will do."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    base = base or spark.conf.get("spark.sql.warehouse.dir")
    return os.path.join(base, f"footfall-{uuid.uuid4().hex}")


# What is read of the given tables. Naming it spares a look into the files for each read.
TABLES = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, props string",
    "supplier": "s_suppkey bigint, s_name string",
    "nation": "n_nationkey int, n_name string",
    "part": "p_partkey bigint, p_name string, p_type string, p_brand string",
    "customer": "c_custkey bigint, c_name string, c_mktsegment string",
    "orders": "o_orderkey bigint, o_orderpriority string, o_orderstatus string",
    "pages": "page_id bigint, url string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def text(*parts: Column | str) -> Column:
    """Columns and literal strings in a row."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def clicks(spark: SparkSession, sf_dir: str, part: str = "true") -> DataFrame:
    """The fields that the lines of both logs are built from, of the events for which ``part`` holds."""
    u, k, m = F.col("user_id"), F.col("k"), F.col("k") % 10
    # As one file the table would be parsed by one task or a few.
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return (
        table(spark, sf_dir, "events")
        .where(part)
        .repartition(tasks, "event_id")
        .select("ts", "user_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
        .select(
            "ts",
            "user_id",
            "event_type",
            "k",
            m.alias("m"),
            F.when(u % 10 == 9, "-").otherwise(text("s", u, "d", F.dayofmonth("ts"))).alias("session"),
            F.when(
                (F.col("event_type") == "view") & (m == 3), text("mpage", u % 28)
            ).otherwise(text("page", F.floor((3 * u + m % 4) / 4))).alias("page"),
            text("page", F.floor((3 * u + m % 3) / 4)).alias("sp"),
            text("ln", 14 * u + 2 * m).alias("link"),
            F.floor(2 * u / 3).alias("e"),
            (13 * u + k).alias("oid"),
            # Every tenth of the k values logs the same line twice.
            F.explode(F.array_repeat(F.lit(0), F.when(m == 5, 2).otherwise(1))).alias("copy"),
        )
    )


def access_lines(spark: SparkSession, sf_dir: str, part: str = "true") -> DataFrame:
    c = F.col
    att = text("att", 10 * c("e") + c("m") % 4)
    # A number too large for an object.
    oid = F.when(c("k") == 97, "99999999999999999999").otherwise(c("oid").cast("string"))
    request = (
        F.when(c("event_type") == "click", text(c("page"), ".do?sp=", c("sp"), "&link=", c("link"), "&", att, "=", oid))
        .when(c("event_type") == "purchase", text(c("page"), ".do?link=", c("link"), "&", att, "=", oid))
        .when(c("event_type") == "view", text(c("page"), ".do"))
        .when((c("event_type") == "error") & (c("m") == 7), F.lit("login.do"))
        .when(c("event_type") == "error", text(c("page"), ".do?sp=", c("sp")))
        .otherwise(text(c("page"), ".do;jsessionid=", c("session")))
    )
    tail = F.when(c("event_type") == "signup", F.lit("302 -")).otherwise(text("200 512 ", c("session")))
    stamp = F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss")
    line = text("10.0.0.", c("user_id"), " - - [", stamp, ' +0000] "GET /app/', request, ' HTTP/1.1" ', tail)
    no_date = text('10.0.0.1 - - [31/Feb/2024:10:00:00 +0000] "GET /app/', c("page"), '.do HTTP/1.1" 200 512 ', c("session"))
    more = F.when((c("event_type") == "error") & (c("m") == 8), no_date)
    return clicks(spark, sf_dir, part).select(F.explode(F.array_compact(F.array(line, more))).alias("value"))


def runtime_lines(spark: SparkSession, sf_dir: str, part: str = "true") -> DataFrame:
    c = F.col
    after_date = text(",123  INFO [h1]  (com.x.Unit) - [", c("session"), "]")
    head = F.concat(F.date_format("ts", "dd MMM yyyy HH:mm:ss"), after_date)
    miu = F.when(c("k") % 3 == 0, "[m1]").otherwise("")
    unit = text(miu, "[", c("page"), "][dau", c("e"), "]")
    shape = c("k") % 8
    rest = (
        F.when(shape == 0, text(unit, "[step][t-1] done {}"))
        .when(shape == 4, text(unit, "started"))
        .when(shape == 6, text("[", c("page"), "]no unit"))
        .otherwise(text(unit, "[step][t-1] shown {oid=[", c("oid") + 1, ", ", c("oid") + 2, "]}"))
    )
    def error(m: int) -> Column:
        return (c("event_type") == "error") & (c("m") == m)

    plain_unit = text("[", c("page"), "][dau", c("e"), "][step][t-1] shown {oid=[")
    line = (
        F.when(error(7), text("java.lang.IllegalStateException: ", c("k")))
        .when(error(8), text("31 Feb 2024 10:00:00", after_date, plain_unit, "1, 2]}"))
        .when(error(6), text(head, plain_unit, "x, ", c("oid") + 1, "]}"))
        .when(c("event_type").isin("view", "click"), F.concat(head, rest))
    )
    # Behind a generator, as for the other log: a filter on lines would make them before the events are shuffled, and again after.
    return clicks(spark, sf_dir, part).select(F.explode(F.array_compact(F.array(line))).alias("value"))


def in_turn(number: Column, tags: tuple[str, ...]) -> Column:
    return F.element_at(F.lit(list(tags)), (number % len(tags) + 1).cast("int"))


def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as the XML source gives them, with the element's name as ``kind``; so do the next ones."""
    plain, master = (F.lit(tag).alias("kind") for tag in models.PAGE_TAGS)
    s, n = F.col("s_suppkey"), F.col("n_nationkey")
    # Some pages have two names.
    names = F.array_compact(F.array("s_name", F.when(s % 10 == 3, text("A ", F.col("s_name")))))
    return (
        table(spark, sf_dir, "supplier")
        .select(plain, text("sv1#area", s % 7, "#page", s).alias("_id"), F.explode(names).alias("_name"))
        .union(table(spark, sf_dir, "nation").select(master, text("sv1#mpage", n), "n_name"))
    )


def link_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        in_turn(p, models.LINK_TAGS).alias("kind"),
        text("sv1#page1#ln", p).alias("_id"),
        F.col("p_name").alias("_name"),
        text("sv1#page1#dau", F.floor(p / 20)).alias("_to"),
    )


def unit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, kind = F.col("s_suppkey"), F.col("kind")
    entity = text("dm#ent", s)
    displayed = F.concat_ws(" ", *[text(entity, "#att", 10 * s + j) for j in range(3)])
    return (
        table(spark, sf_dir, "supplier")
        .withColumn("kind", in_turn(s, models.UNIT_TAGS))
        .select(
            "kind",
            text("sv1#page1#dau", s).alias("_id"),
            text("Box of ", F.col("s_name")).alias("_name"),
            F.when(kind.isin(*models.DISPLAY_TAGS, *models.ENTITY_TAGS), entity).alias("_entity"),
            F.when(kind.isin(*models.DISPLAY_TAGS), displayed).alias("_displayAttributes"),
        )
    )


def entity_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    kinds = {
        "PART": [("name", "NAME"), ("category", "CATEGORY"), ("brand", "BRAND"), ("derived", None)],
        "CUSTOMER": [("name", "NAME"), ("category", "CATEGORY"), ("derived", None)],
        "ORDER": [("title", "TITLE"), ("status", "STATUS"), ("derived", None)],
    }

    def attributes(columns):
        return F.array(
            *[
                F.struct(
                    text("dm#ent", s, "#att", 10 * s + j).alias("_id"),
                    F.lit(name).alias("_name"),
                    F.lit(column).cast("string").alias("_column"),
                )
                for j, (name, column) in enumerate(columns)
            ]
        )

    part, customer, order = (attributes(columns) for columns in kinds.values())
    kind, entity = F.lit(models.ENTITY_TAG).alias("kind"), text("dm#ent", s).alias("_id")
    suppliers = table(spark, sf_dir, "supplier")
    each = suppliers.select(
        kind,
        entity,
        text("Kind ", s).alias("_name"),
        in_turn(s, tuple(kinds)).alias("_table"),
        F.when(s % 3 == 0, part).when(s % 3 == 1, customer).otherwise(order).alias("Attribute"),
    )
    # Some entities have a column in two tables, some have two names.
    name_only = attributes(kinds["CUSTOMER"][:1])
    two_tables = suppliers.where(s % 6 == 0).select(kind, entity, text("Kind ", s), F.lit("CUSTOMER"), name_only)
    two_names = suppliers.where(s % 6 == 1).select(kind, entity, text("Other ", s), F.lit("CUSTOMER"), customer)
    return each.union(two_tables).union(two_names)


def dump_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The dumped tables as the CSV source gives them."""
    sources = {
        "PART": ("part", {"OID": "p_partkey", "NAME": "p_name", "CATEGORY": "p_type", "BRAND": "p_brand"}),
        "CUSTOMER": ("customer", {"OID": "c_custkey", "NAME": "c_name", "CATEGORY": "c_mktsegment"}),
        "ORDER": ("orders", {"OID": "o_orderkey", "TITLE": "o_orderpriority", "STATUS": "o_orderstatus"}),
    }
    tables = {
        name: table(spark, sf_dir, source).select(
            *[F.col(field).cast("string").alias(column) for column, field in columns.items()],
            F.lit(name).alias(dumps.TABLE),
        )
        for name, (source, columns) in sources.items()
    }
    # Some objects are there twice, with two names.
    again = tables["PART"].where("OID % 10 = 1").withColumn("NAME", text("A ", F.col("NAME")))
    return tables | {"PART": tables["PART"].union(again)}


class TableSite(Site):
    """A site whose model and dumps are taken from the tables."""

    def __init__(self, spark: SparkSession, sf_dir: str, limits: Limits = Limits()):
        super().__init__(spark, limits)
        self.sf_dir = sf_dir

    @cached_property
    def pages(self) -> DataFrame:
        return models.pages(page_rows(self.spark, self.sf_dir))

    @cached_property
    def links(self) -> DataFrame:
        return models.links(link_rows(self.spark, self.sf_dir))

    @cached_property
    def units(self) -> DataFrame:
        return models.units(unit_rows(self.spark, self.sf_dir))

    @cached_property
    def attributes(self) -> DataFrame:
        return models.attributes(entity_rows(self.spark, self.sf_dir))

    @cached_property
    def dumps(self) -> dict[str, DataFrame]:
        return dump_tables(self.spark, self.sf_dir)


def write_model(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """The design model as XML files, each row an element below an ``Area``."""
    for name, rows, tags in (
        ("web/pages", page_rows(spark, sf_dir), models.PAGE_TAGS),
        ("web/links", link_rows(spark, sf_dir), models.LINK_TAGS),
        ("web/units", unit_rows(spark, sf_dir), models.UNIT_TAGS),
        ("data", entity_rows(spark, sf_dir), (models.ENTITY_TAG,)),
    ):
        fields = F.struct(*[c for c in rows.columns if c != "kind"])
        (
            rows.select(*[F.when(F.col("kind") == tag, fields).alias(tag) for tag in tags])
            .write.format("xml")
            .option("maxRecordsPerFile", MODEL_ROWS)
            .option("rootTag", "Model")
            .option("rowTag", "Area")
            .save(f"{folder}/{name}")
        )


def write_dumps(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """The dumps as CSV files with a header."""
    for name, dump in dump_tables(spark, sf_dir).items():
        dump.drop(dumps.TABLE).write.csv(f"{folder}/{name}.csv", sep=";", header=True)


def write_files(spark: SparkSession, sf_dir: str, folder: str) -> Settings:
    """All inputs as files below ``folder``, the way a site delivers them."""
    settings = write_site(spark, sf_dir, folder)
    for name, part in (("front", "event_id % 2 = 0"), ("back", "event_id % 2 = 1")):
        deliver(spark, sf_dir, folder, name, part, part)
    return settings


def write_site(spark: SparkSession, sf_dir: str, folder: str) -> Settings:
    """Design model and dumps as files, and where to look for logs: those of two servers."""
    write_model(spark, sf_dir, folder)
    write_dumps(spark, sf_dir, f"{folder}/dumps")
    return Settings(
        web_model=(f"{folder}/web/*",),
        data_model=(f"{folder}/data",),
        dumps=f"{folder}/dumps",
        access_logs=(f"{folder}/access/front*", f"{folder}/access/back*", f"{folder}/access/none*"),
        runtime_logs=(f"{folder}/runtime/front*", f"{folder}/runtime/back*"),
        output=f"{folder}/output",
        dump_tables=DUMPS,
        buckets=4,
    )


def deliver(spark: SparkSession, sf_dir: str, folder: str, name: str, access: str, runtime: str) -> None:
    """Log files of a server, with the lines of the events for which the conditions hold."""
    access_lines(spark, sf_dir, access).write.text(f"{folder}/access/{name}")
    runtime_lines(spark, sf_dir, runtime).write.text(f"{folder}/runtime/{name}")
