"""Schemas of the inputs and of the enriched log."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    DateType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def strings(*names: str) -> StructType:
    return StructType([StructField(name, StringType()) for name in names])


PAGE_ROW = strings("_id", "_name")
LINK_ROW = strings("_id", "_name", "_to")
UNIT_ROW = strings("_id", "_name", "_entity", "_displayAttributes")
ENTITY_ROW = strings("_id", "_name", "_table").add("Attribute", ArrayType(strings("_id", "_name", "_column")))
# Any element; each kind has some of these.
ELEMENT_ROW = StructType([*UNIT_ROW.fields, *strings("_to").fields, *ENTITY_ROW.fields[2:]])

VALUE = StructType(
    [
        StructField("oid", LongType()),
        StructField("value_table", StringType()),
        StructField("value_column", StringType()),
        StructField("value", StringType()),
    ]
)

# What is not text.
_TYPES = {"time": TimestampType(), "clicked_oid": LongType(), "oid": LongType(), "displayed_oid": LongType()}
_ENRICHED = (
    # the hit
    "ip",
    "time",
    "session_id",
    "source_page_id",
    "source_page_name",
    "requested_page_id",
    "requested_page_name",
    "clicked_link_id",
    "clicked_link_name",
    "target_unit",
    "clicked_attribute_id",
    "clicked_entity_id",
    "clicked_entity_name",
    "clicked_oid",
    "clicked_type_oid",
    "clicked_oid_value",
    # what was shown in the same second, null if nothing was
    "log_level",
    "host",
    "java_class",
    "miu_id",
    "trace",
    "message",
    "oid",
    "displayed_page_id",
    "displayed_page_name",
    "unit_id",
    "displayed_unit_name",
    "displayed_entity_id",
    "displayed_entity_name",
    "displayed_attribute_id",
    "displayed_attribute_name",
    "table_db",
    "attribute_database_column",
    "value_table",
    "displayed_oid",
    "displayed_type_oid",
    "displayed_oid_value",
)
ENRICHED = StructType([StructField(name, _TYPES.get(name, StringType())) for name in _ENRICHED])


LINE = strings("value")

# Parsed lines. ``shape`` and ``time`` are null where a line has none.
FIELDS = {
    "access": [
        StructField("shape", IntegerType()),
        StructField("ip", StringType()),
        StructField("time", TimestampType()),
        *strings("session_id", "requested_page_id", "source_page_id", "clicked_link_id", "clicked_attribute_id"),
        StructField("clicked_oid", LongType()),
    ],
    "runtime": [
        StructField("shape", IntegerType()),
        StructField("time", TimestampType()),
        *strings("log_level", "host", "java_class", "session_id", "miu_id", "page_id", "unit_id", "trace", "message"),
        StructField("oids", ArrayType(LongType())),
    ],
}
_STAMPS = [
    StructField("ingested_at", TimestampType()),
    StructField("batch", LongType()),
    StructField("event_date", DateType()),
]
# As stored by day.
PARSED = {log: StructType([*fields, *_STAMPS]) for log, fields in FIELDS.items()}

# Where a line was read.
_ORIGIN = [StructField("file", StringType()), StructField("length", LongType()), StructField("modified", TimestampType())]
# Lines on their way in, by run; ``value`` is the text of those that cannot be used.
STAGED = {
    log: StructType([*fields, StructField("value", StringType()), *_ORIGIN, StructField("run", LongType())])
    for log, fields in FIELDS.items()
}
STORED = StructType([*ENRICHED, *_STAMPS])

# What became of lines: shape 0 is none; bad objects are those that are no number.
LINE_COUNTS = StructType(
    [
        StructField("shape", IntegerType()),
        StructField("event_date", DateType()),
        StructField("lines", LongType()),
        StructField("bad_dates", LongType()),
        StructField("bad_objects", LongType()),
        StructField("log", StringType()),
        StructField("batch", LongType()),
    ]
)

# Lines that could not be used, with the run that read them.
QUARANTINED = StructType(
    [
        StructField("value", StringType()),
        StructField("shape", IntegerType()),
        StructField("file", StringType()),
        StructField("batch", LongType()),
        StructField("log", StringType()),
        StructField("run", LongType()),
    ]
)

# Files taken in, by run, and the runs that were completed.
TAKEN = StructType([*_ORIGIN, StructField("log", StringType()), StructField("run", LongType())])
RUNS = StructType([StructField("kind", StringType()), StructField("run", LongType())])
# Up to which run a day's lines are folded into one part.
FOLDS = StructType(
    [StructField("event_date", DateType()), StructField("high", LongType()), StructField("log", StringType()), StructField("run", LongType())]
)
# The dumped tables whose values are stored.
STORED_DUMPS = StructType(
    [
        StructField("value_table", StringType()),
        StructField("columns", ArrayType(StringType())),
        StructField("values", LongType()),
        StructField("bytes", LongType()),
        StructField("files", LongType()),
        StructField("dump", StringType()),
    ]
)
