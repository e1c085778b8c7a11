"""Application runtime log lines as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from footfall.functions.text import blank_to_null, groups, pinned, utc_time

# Form of a line.
#   day Mon year h:m:s[,fraction]  LEVEL [host]  (class) - <one of four rests>
# What is in (?>...) or followed by ++ is not tried again, so that a long line that fits nothing
# takes linear time.
HEAD = (
    r"(?s)^(?>.*?(?<!\w)(\w++ \w++ \d++ \d++:\d++:\d++)\S*+  (\w++) \[([^\]]++)\]  \()"
    r"(?>(.*?)\) - (?=\[))"
)
UNIT = r"\[(\w+)\](?:\[(\w+)\])?\[(\w+)\]\[(\w+)\]"
TRACE = r"\[\w+\]\[([^\]]+)\]"
OBJECTS = UNIT + TRACE + r"(.*\[([^\[]+)\]\}).*"
NO_OBJECTS = UNIT + TRACE + r"(.*\{\}).*"
NO_TRACE = UNIT + r"(.*)"
NO_UNIT = r"\[(\w+)\]\[(\w+)\](.*)"
LINE = f"{HEAD}(?:{OBJECTS}|{NO_OBJECTS}|{NO_TRACE}|{NO_UNIT})$"
TIME = "d MMM yyyy H:m:s Z"

# Group numbers in LINE of (session, miu, page, unit, trace, message, objects) per shape.
GROUPS = {
    1: (5, 6, 7, 8, 9, 10, 11),
    2: (12, 13, 14, 15, 16, 17, None),
    3: (18, 19, 20, 21, None, 22, None),
    4: (23, None, 24, None, None, 25, None),
}
GROUP_COUNT = 25


def split_oids(text: Column) -> Column:
    """``'1, 2'`` as an array of numbers; an element that is no number is null."""
    return F.transform(F.split(text, ", "), lambda x: x.try_cast("bigint"))


def parse_runtime_log(lines: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per line of column ``value``; ``shape`` is null where no shape fits. Columns in ``keep`` stay.

    Shapes: 1 with the objects shown, 2 with an empty object list, 3 without a trace, 4 without a
    unit. The pattern tries them in this order and all fields come from the one that fits.
    """
    framed = lines.select(groups("value", LINE, GROUP_COUNT).alias("f"), *keep)

    def group(number: int) -> Column:
        return blank_to_null(F.get("f", number))

    # The session is the only field that is never empty in the shape that fits.
    shape = F.coalesce(
        *(F.when(F.get("f", numbers[0]) != "", F.lit(s)) for s, numbers in GROUPS.items())
    )

    def field(position: int) -> Column:
        numbers = [numbers[position] for numbers in GROUPS.values()]
        return F.coalesce(*(group(n) for n in numbers if n is not None))

    fields = framed.select(
        shape.alias("shape"),
        utc_time(group(1), TIME).alias("time"),
        group(2).alias("log_level"),
        group(3).alias("host"),
        group(4).alias("java_class"),
        field(0).alias("session_id"),
        field(1).alias("miu_id"),
        field(2).alias("page_id"),
        field(3).alias("unit_id"),
        field(4).alias("trace"),
        F.when(shape.isNotNull(), F.coalesce(field(5), F.lit(""))).alias("message"),
        split_oids(field(6)).alias("oids"),
        *keep,
    )
    return pinned(fields)
