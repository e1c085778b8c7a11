"""HTTP access log lines as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from footfall.functions.text import blank_to_null, groups, pinned, utc_time

# Form of a line and of the request parameters.
#   ip ... [day/Mon/year:h:m:s zone] "GET /dir/<page>.do<rest>" <status> <bytes> <session>
# What is in (?>...) is not tried again, so that a long line that fits nothing takes linear time.
LINE = (
    r"(?s)^\s*(\S+)\s(?>.*?\[(\d+/\w+/\d+:\d+:\d+:\d+)[^\]]*\])"
    r"(?>.*?/([^/ ]*)\.do(?=[?; ]))(.*?)(?:\" \d+ \d+ (\S+).*)?$"
)
TIME = "d/MMM/yyyy:H:m:s Z"
SOURCE = r"(?s)^.*[?&]sp=(\w+)"
LINK = r"(?s)^.*[?&]link=(\w+)"
OBJECT = r"[?&](att\d+=\d+)"
URL_SESSION = r"^;jsessionid=(\S+) "
PLAIN_PAGE = r"^m?page"


def _parameter(url: Column, mark: str, pattern: str) -> Column:
    """What ``pattern`` finds; a plain search for ``mark`` spares most requests the pattern."""
    return F.when(url.contains(mark), F.regexp_extract(url, pattern, 1)).otherwise("")


def parse_access_log(lines: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per line of column ``value``; ``shape`` is null where no shape fits. Columns in ``keep`` stay.

    The first shape that fits decides how every field is read:

    1. source, link and object are given;
    2. link and object are given, the source is the requested page itself;
    3. a plain page without parameters;
    4. only the source counts;
    5. a request with the session in its URL, which needs no status, bytes or session field.
    """
    framed = lines.select(groups("value", LINE, 5).alias("f"), *keep)
    rest = F.get("f", 4)
    url = F.substring_index(rest, " ", 1)
    fields = pinned(
        framed.select(
            F.get("f", 1).alias("ip"),
            utc_time(F.get("f", 2), TIME).alias("time"),
            F.get("f", 3).alias("page"),
            blank_to_null(F.get("f", 5)).alias("tail"),
            rest.startswith("?").alias("has_query"),
            (rest.startswith(" HTTP") & F.get("f", 3).rlike(PLAIN_PAGE)).alias("plain"),
            _parameter(url, "sp=", SOURCE).alias("sp"),
            _parameter(url, "link=", LINK).alias("link"),
            _parameter(url, "att", OBJECT).alias("object"),
            F.when(rest.startswith(";"), F.regexp_extract(rest, URL_SESSION, 1)).alias("url_session"),
            *keep,
        )
    )
    full = F.col("tail").isNotNull()
    clicked = F.col("has_query") & (F.col("link") != "") & (F.col("object") != "") & full
    shaped = fields.withColumn(
        "shape",
        F.when(clicked & (F.col("sp") != ""), 1)
        .when(clicked, 2)
        .when(F.col("plain") & full, 3)
        .when((F.col("sp") != "") & full, 4)
        .when(F.col("url_session") != "", 5),
    )
    shape = F.col("shape")
    is_click = shape.isin(1, 2)
    return shaped.select(
        "shape",
        F.when(shape.isNotNull(), F.col("ip")).alias("ip"),
        F.when(shape.isNotNull(), F.col("time")).alias("time"),
        F.when(shape == 5, F.col("url_session")).when(shape < 5, F.col("tail")).alias("session_id"),
        F.when(shape.isNotNull(), F.col("page")).alias("requested_page_id"),
        F.when(shape.isin(1, 4), F.col("sp")).when(shape == 2, F.col("page")).alias("source_page_id"),
        F.when(is_click, F.col("link")).alias("clicked_link_id"),
        F.when(is_click, F.substring_index("object", "=", 1)).alias("clicked_attribute_id"),
        F.when(is_click, F.substring_index("object", "=", -1).try_cast("bigint"))
        .when(shape.isNotNull(), F.lit(0).cast("bigint"))
        .alias("clicked_oid"),
        *keep,
    )


