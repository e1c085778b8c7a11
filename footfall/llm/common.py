"""What the operators share: words of a text as bytes, and cutting lineage."""

from __future__ import annotations

import os
import uuid
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UPPER = bytes(range(ord("A"), ord("Z") + 1))
LOWER = bytes.maketrans(UPPER, UPPER.lower())
# A-Z in lower case; every other byte of ASCII that is neither letter nor digit is a blank.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)
# Bytes inside a code point, and the six blanks that separate words.
INNER = bytes(range(0x80, 0xC0))
BLANKS = bytes([0x20, *range(0x09, 0x0E)])


def folded_words(text: bytes) -> list[bytes]:
    """The runs of letters, digits and characters beyond ASCII, with A-Z in lower case."""
    return text.translate(FOLD).split()


def raw_texts(column: pa.Array) -> list[bytes]:
    """The texts of a column as UTF-8, null as empty."""
    return [b if b is not None else b"" for b in column.cast(pa.large_binary()).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], column: str, size: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about that many bytes of text, so that memory does not follow the batch."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(column)).to_pylist()
        start = held = 0
        for i, n in enumerate(lengths):
            held += n or 0
            if held >= size:
                yield batch.slice(start, i + 1 - start)
                start, held = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


def show_package(rows: DataFrame) -> None:
    """Lets Python workers import this package from the folder in which the driver found it.

    An installed package, or one sent with ``--py-files``, is found without.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = rows.sparkSession.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])


def map_texts(
    rows: DataFrame,
    function: Callable[[pa.RecordBatch], pa.RecordBatch | None],
    schema: str,
    column: str = "text",
    size: int = 8_000_000,
) -> DataFrame:
    """Runs a function over slices of the rows; it sees Arrow batches and returns them."""

    show_package(rows)

    def run(batches):
        for part in slices(batches, column, size):
            result = function(part)
            if result is not None:
                yield result

    return rows.mapInArrow(run, schema)


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
SPANS_SQL = "array<struct<kind:string,start:int,end:int>>"


def span_array(spans: list[list[tuple[str, int, int]]]) -> pa.Array:
    """Spans (kind, start, end) of several texts as a column."""
    return pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in each] for each in spans], SPANS)


class Taken:
    """The places of a text that given spans cover, for asking whether a further span meets any of them."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end in sorted(spans):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def meets(self, start: int, end: int) -> bool:
        # Of the covered places, which do not meet each other, only the last to start before the end can reach in.
        before = bisect_right(self.starts, end - 1) - 1
        return before >= 0 and self.ends[before] > start


def joined_spans(spans: str) -> Column:
    """A column of spans as text: ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def spans_of(spans: str, kind: str) -> Column:
    """How many spans of a kind there are."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Where that is unset and all runs in one process, as in tests, it lies in the warehouse folder; on
    a cluster it has to be set.
    """
    own = spark.conf.get("spark.checkpoint.dir", None)
    if own is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return own or os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "checkpoints")


def cut(rows: DataFrame) -> DataFrame:
    """The rows as stored in the cluster's checkpoint folder, without their history."""
    spark = rows.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return rows.checkpoint()


def stored(rows: DataFrame) -> DataFrame:
    """The rows as a new Parquet table in the shared folder, for results that are read by column or more than once."""
    path = os.path.join(shared_folder(rows.sparkSession), f"table-{uuid.uuid4().hex}")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


# Whether Spark takes a query's shuffle files off the disks when the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _clean(keep: Callable[[DataFrame], DataFrame], rows: DataFrame) -> DataFrame:
    conf = rows.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        # A frame of its own, so that the one given may still be used.
        return keep(rows.select("*"))
    finally:
        conf.set(CLEANUP, before)


def cut_clean(rows: DataFrame) -> DataFrame:
    """``cut``, after which the shuffles that made the rows are taken off the disks."""
    return _clean(cut, rows)


def stored_clean(rows: DataFrame) -> DataFrame:
    """``stored``, after which the shuffles that made the rows are taken off the disks."""
    return _clean(stored, rows)


def new_key(key: Column) -> Column:
    """A bigint key equal to the given one that is not known to be partitioned.

    A join after a grouping by its key would reuse the grouping's shuffle, and then adaptive
    execution cannot split a hot key. With this, both sides get a shuffle that it can split.
    """
    return key.bitwiseXOR(F.lit(0).cast("bigint"))
