"""Small column expressions on text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SEPARATOR = "\u0001"
DAY = 24 * 60 * 60


def last_segment(text: Column | str, mark: str) -> Column:
    """The text after the last ``mark``; the whole text without one; null for null.

    Marks at the end are not counted.
    """
    return F.substring_index(F.rtrim(text, F.lit(mark)), mark, -1)


def bare_id(model_id: Column | str) -> Column:
    """A model id without the ids of the elements around it."""
    return last_segment(model_id, "#")


def unit_label(unit_id: Column | str, name: Column | str) -> Column:
    """``id: name``, the key of every report; null if either part is."""
    return F.concat(unit_id, F.lit(": "), name)


def counted(value: Column | str, n: Column | str) -> Column:
    """``value: count``, an entry of the top-ten lists."""
    return F.concat(value, F.lit(": "), F.col(n) if isinstance(n, str) else n)


def utc_time(text: Column, form: str) -> Column:
    """A moment written without a zone, read as UTC whatever the session's zone; null if there is no such date.

    ``form`` ends with the zone's letter.
    """
    return F.try_to_timestamp(F.concat(text, F.lit(" +0000")), F.lit(form))


def day_of(time: str) -> Column:
    """The day in UTC, whatever the session's time zone."""
    return F.date_from_unix_date(F.floor(F.unix_timestamp(time) / DAY).cast("int"))


def blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def groups(text: str, pattern: str, count: int) -> Column:
    """All groups of an anchored ``pattern`` in one pass, as an array from index 1.

    ``regexp_extract`` would run the pattern once per group. A text that does not match gives an
    array without index 1, so read it with ``F.get``. A group that took no part is ``''``.
    """
    packed = "".join(f"{SEPARATOR}${i}" for i in range(1, count + 1))
    clean = F.replace(F.col(text), F.lit(SEPARATOR), F.lit(" "))
    return F.split(F.regexp_replace(clean, pattern, packed), SEPARATOR)


def pinned(frame: DataFrame) -> DataFrame:
    """The same rows behind a generator, which no filter is pushed through.

    Spark moves a filter on a parsed field below the projection that parses it and then parses
    twice: once for the filter, once for the value.
    """
    return frame.select(F.inline(F.array(F.struct(*frame.columns))))
