"""Joins of a fact table with a lookup table."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import cached_property, reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from footfall.config import Limits

# Rows whose key is null can match nothing, so they may go anywhere.
LOOSE_PLACES = 1 << 20


def row_bytes(frame: DataFrame) -> Column:
    """The bytes of a row's values as text."""
    return sum(F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in frame.columns)


class Sizes:
    """Rows and bytes of several relations, counted on the executors in one pass when first asked for."""

    def __init__(self, relations: Callable[[], Mapping[str, DataFrame]]):
        self._relations = relations

    @cached_property
    def measured(self) -> dict[str, tuple[int, int]]:
        relations = self._relations()
        parts = [r.select(F.lit(name).alias("name"), row_bytes(r).alias("bytes")) for name, r in relations.items()]
        if not parts:
            return {}
        sums = reduce(DataFrame.union, parts).groupBy("name").agg(F.count(F.lit(1)), F.sum("bytes")).collect()
        return {name: (0, 0) for name in relations} | {name: (rows, total) for name, rows, total in sums}

    def within(self, limits: Limits, *names: str) -> bool:
        """Whether the relations so named, or all, are small together."""
        sizes = [self.measured[name] for name in names or self.measured]
        return (
            sum(rows for rows, _ in sizes) <= limits.broadcast_rows
            and sum(total for _, total in sizes) <= limits.broadcast_bytes
        )


class Lookup:
    """A lookup table whose ``keys`` carry the names of the fact columns they are joined with.

    A lookup that proves small when measured is broadcast. Otherwise both sides are shuffled, and
    adaptive execution splits a key with a large share of the facts.

    ``shape`` makes the lookup from ``rows``, for instance by removing repetitions. ``small`` says
    whether the rows are few enough, if something else has measured them; else they are counted.
    """

    def __init__(
        self,
        rows: DataFrame,
        keys: list[str],
        limits: Limits = Limits(),
        shape: Callable[[DataFrame], DataFrame] | None = None,
        small: Callable[[], bool] | None = None,
    ):
        self.rows = rows
        self.keys = keys
        self.limits = limits
        self.shape = shape
        self._small = small or (lambda: Sizes(lambda: {"rows": rows}).within(limits))

    @cached_property
    def frame(self) -> DataFrame:
        return self.rows if self.shape is None else self.shape(self.rows)

    @cached_property
    def is_small(self) -> bool:
        return self._small()

    def renamed(self, *names: str) -> Lookup:
        """The same table under other column names, the keys first; it is not measured again."""
        return Lookup(self.frame.toDF(*names), list(names[: len(self.keys)]), self.limits, small=lambda: self.is_small)

    def join(self, facts: DataFrame, how: str) -> DataFrame:
        """``facts`` with the columns of this lookup; ``how`` is ``inner``, ``left`` or ``left_semi``."""
        if self.is_small:
            return facts.join(F.broadcast(self.frame), self.keys, how)
        return shuffled_join(facts, self.frame, self.keys, how)


def shuffled_join(facts: DataFrame, lookup: DataFrame, keys: list[str], how: str) -> DataFrame:
    """An equi-join in which a hot key can be split and no row is copied before it is.

    The hash of the keys is joined on as well. That gives both sides a shuffle of this join's own,
    even where a grouping by the keys came before, and only such shuffles are split by adaptive
    execution. Facts with a null key match nothing and are spread widely by their other columns.
    """
    complete = reduce(and_, (F.col(k).isNotNull() for k in keys))
    loose = F.pmod(F.xxhash64(*[c for c in facts.columns if c not in keys] or keys), F.lit(LOOSE_PLACES))
    placed = facts.withColumn("_place", F.when(complete, F.xxhash64(*keys)).otherwise(loose))
    return placed.join(lookup.withColumn("_place", F.xxhash64(*keys)), [*keys, "_place"], how).drop("_place")
