"""Near-duplicate documents by SimHash and meet-in-the-middle ball hashing.

A text's fingerprint has a bit set where over half the hashes of its word shingles have it. Two
fingerprints at most ``bits`` apart have a common variant: one at most half of that away from both.
So every different fingerprint emits all variants within half the radius (for an odd radius the
half rounded up, and a mark on the variants within the half rounded down), and variants are grouped.
A group has at most as many fingerprints as a ball of that radius, 65 for two bits, however many
documents there are. In it each fingerprint is linked to the smallest marked one, which keeps the
components that all its pairs would give; links are made unique and verified.

Links join classes of equal fingerprints, so copies are never expanded. A document's component is the
smallest id reachable. Null texts, like empty ones, have fingerprint zero, linked like any other. A
null id never names a component: one whose ids are all null has a null component. Repeated rows are
returned each. Other columns do not matter.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from footfall.llm.common import LOWER, cut, map_texts, new_key, raw_texts
from footfall.llm.components import components

SEED = 42


def shingle_hashes(text: bytes, length: int) -> list[int]:
    words = text.translate(LOWER).split()
    if not words:
        return []
    shingles = zip(*[words[i:] for i in range(min(length, len(words)))])
    digest = xxhash.xxh64_intdigest
    return [digest(s, SEED) for s in map(b" ".join, shingles)]


def fingerprint(hashes: list[int]) -> int:
    """As a signed number of 64 bits."""
    if not hashes:
        return 0
    each = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    ones = np.unpackbits(each, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, length: int = 3, id_col: str = "doc_id") -> DataFrame:
    """``id`` and ``fp`` (bigint) of each row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [fingerprint(shingle_hashes(t, length)) for t in raw_texts(batch.column("text"))]
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(made, pa.int64())], ["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col("text").alias("text"))
    return map_texts(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, fp bigint")


def masks(bits: int) -> list[int]:
    """All signed 64-bit numbers with at most that many bits set."""
    values = [sum(1 << b for b in chosen) for n in range(bits + 1) for chosen in combinations(range(64), n)]
    return [v - (1 << 64) if v >> 63 else v for v in values]


def links(fps: DataFrame, bits: int) -> DataFrame:
    """Links (a, b) between different values of ``fp`` whose components are those of all links within ``bits``."""
    if not 0 <= bits <= 4:
        raise ValueError("balls of more than four bits have too many variants")
    inner, outer = bits // 2, (bits + 1) // 2
    variant = F.explode(F.transform(F.lit(masks(outer)), lambda m: F.col("fp").bitwiseXOR(m)))
    emitted = fps.select("fp", variant.alias("variant"))
    near = F.bit_count(F.col("variant").bitwiseXOR(F.col("fp"))) <= inner
    center = F.min(F.when(near, F.col("fp"))).over(Window.partitionBy("variant"))
    return (
        emitted.select("fp", center.alias("center"))
        .where("fp <> center")
        .select(F.greatest("fp", "center").alias("a"), F.least("fp", "center").alias("b"))
        .distinct()
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)
    )


def duplicates(docs: DataFrame, length: int = 3, bits: int = 2, id_col: str = "doc_id") -> DataFrame:
    """``id``, ``fp``, ``root`` and ``component`` of each row: its component's first fingerprint and smallest id."""
    rows = cut(fingerprints(docs, length, id_col))
    classes = cut(rows.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links(classes.select("fp"), bits))
    # Classes in no link are their own roots; only those in one need the smallest id of several classes.
    linked = roots.union(roots.select("root", "root").distinct())
    rooted = cut(
        classes.join(linked, F.col("fp") == F.col("node"), "left").select(
            "fp", "least", F.coalesce("root", "fp").alias("root"), F.col("root").isNotNull().alias("linked")
        )
    )
    names = rooted.where("linked").groupBy("root").agg(F.min("least").alias("component"))
    named = (
        rooted.where("linked")
        .select("fp", "root", new_key(F.col("root")).alias("k"))
        .join(names.select(new_key(F.col("root")).alias("k"), "component"), "k")
        .select("fp", "root", "component")
    )
    labels = rooted.where("not linked").select("fp", "root", F.col("least").alias("component")).union(named)
    labels = labels.select(new_key(F.col("fp")).alias("k"), "root", "component")
    return rows.withColumn("k", new_key(F.col("fp"))).join(labels, "k").select("id", "fp", "root", "component")


def report(docs: DataFrame) -> DataFrame:
    """One row per document with its fingerprint and the smallest id of its component."""
    return duplicates(docs).select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def clean(docs: DataFrame, length: int = 3, bits: int = 2) -> DataFrame:
    """One document of each component, the one with the smallest id, with all its columns.

    Where several rows have that id, or none of the component's rows has one, one of them stays.
    """
    found = cut(duplicates(docs, length, bits))
    first = cut(found.where("id <=> component").select("id", "fp", "root"))
    ids = found.groupBy("id").agg(F.count("*").alias("n"))
    once = ids.where("n = 1 and id is not null").select(F.col("id").alias("own"))
    single = first.join(once, F.col("id") == F.col("own"), "left_semi").select(F.col("id").alias("own"))
    named = docs.alias("d")
    kept = named.join(single.alias("s"), F.expr("d.doc_id = s.own"), "left_semi")
    # Where rows share an id, or have none, the fingerprint tells them apart.
    unclear = ids.where("n > 1 or id is null").select(F.col("id").alias("own"))
    again = named.join(unclear.alias("s"), F.expr("d.doc_id <=> s.own"), "left_semi")
    several = first.join(unclear, F.expr("id <=> own"), "left_semi")
    return kept.union(_one_of_each(again, several, length))


def _one_of_each(docs: DataFrame, first: DataFrame, length: int) -> DataFrame:
    """One row of ``docs`` for each root of ``first`` (id, fp, root), the first by its hashes."""
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("own_id"), F.col("text").alias("text")
    )

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [fingerprint(shingle_hashes(t, length)) for t in raw_texts(batch.column("text"))]
        return pa.RecordBatch.from_pydict(
            {"row": batch.column("row"), "own_id": batch.column("own_id"), "own_fp": pa.array(made, pa.int64())}
        )

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("row", "own_id")}
    hashed = map_texts(rows, run, f"row {kinds['row']}, own_id {kinds['own_id']}, own_fp bigint")
    rooted = hashed.join(first.distinct(), F.expr("own_id <=> id and own_fp = fp"))
    chosen = rooted.groupBy("root").agg(F.min_by("row", F.struct("fp", F.xxhash64("row"))).alias("row"))
    return chosen.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
