"""Placement of rows on shards by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a prime-sized table: it starts at an
offset and goes on by a skip, both hashes of its name. The shards take turns, and at each turn claim
the first free slot of their order, until the table is full. Shards so get slots as evenly as the
weights ask, and adding or losing one moves few other slots.

A row's slot is a hash of its key modulo the table's size. The table has as many rows as slots, a
parameter of at most ``MOST_SLOTS``, so it is broadcast whatever the input's size; a row is placed by
one lookup, without a shuffle. A key with a third of the rows would go to one shard, so rows are
placed by their id. All of the row path is DataFrame code.

A null key has slot 0's shard, as no hash is defined for it; empty keys are keys like others, equal
keys go to equal shards. Repeated rows are placed each. Other columns pass unread.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SLOTS = 65_537
MOST_SLOTS = 655_373
SHARDS = tuple(f"shard-{i:04d}" for i in range(256))


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def preference(name: str, slots: int) -> tuple[int, int]:
    """The offset and skip of a shard."""
    digest = hashlib.md5(name.encode()).hexdigest()
    return int(digest[:15], 16) % slots, int(digest[15:30], 16) % (slots - 1) + 1


def fill(names: Sequence[str], slots: int = SLOTS, weights: Sequence[int] | None = None) -> list[int]:
    """The place of each slot's shard in ``names``; a shard of weight w claims w slots a turn."""
    if not is_prime(slots) or slots > MOST_SLOTS:
        raise ValueError(f"the number of slots has to be a prime of at most {MOST_SLOTS}")
    if not names or len(set(names)) < len(names) or len(names) > slots:
        raise ValueError("shards need different names, at most one a slot")
    turns = [i for i, w in enumerate(weights or [1] * len(names)) for _ in range(w)]
    nexts, skips = map(list, zip(*(preference(n, slots) for n in names)))
    table, free = [-1] * slots, slots
    while free:
        for shard in turns:
            at = nexts[shard]
            while table[at] >= 0:
                at = (at + skips[shard]) % slots
            table[at] = shard
            nexts[shard] = (at + skips[shard]) % slots
            free -= 1
            if not free:
                break
    return table


def table_rows(spark: SparkSession, names: Sequence[str], table: Sequence[int]) -> DataFrame:
    """``slot`` and ``shard``, a row for each slot."""
    places = F.split(F.lit(",".join(map(str, table))), ",")
    return spark.range(1).select(F.posexplode(places).alias("slot", "place")).select(
        "slot", F.element_at(F.array(*map(F.lit, names)), F.col("place").cast("int") + 1).alias("shard")
    )


def slot_of(key: Column, slots: int) -> Column:
    """A slot from the first 60 bits of the key's MD5; 0 for null."""
    number = F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 15), 16, 10).cast("bigint")
    return F.coalesce(F.pmod(number, F.lit(slots).cast("bigint")).cast("int"), F.lit(0))


def place(
    rows: DataFrame, key: Column, names: Sequence[str] = SHARDS, slots: int = SLOTS, weights: Sequence[int] | None = None
) -> DataFrame:
    """``row`` (all columns as a struct), ``slot`` and ``shard``."""
    placed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), slot_of(key, slots).alias("slot"))
    lookup = table_rows(rows.sparkSession, names, fill(names, slots, weights))
    return placed.join(F.broadcast(lookup), "slot").select("row", "slot", "shard")


def write_shards(rows: DataFrame, key: Column, path: str, names: Sequence[str] = SHARDS, slots: int = SLOTS) -> None:
    """Writes the rows below a folder ``shard=<name>`` each. Large shards get several files.

    If the rows have a column ``shard`` of their own, the folders are named ``shard_``, and so on.
    """
    folder = "shard"
    while folder in map(str.lower, rows.columns):
        folder += "_"
    flat = place(rows, key, names, slots).select(F.col("shard").alias(folder), "row.*")
    flat.hint("rebalance", folder).write.partitionBy(folder).mode("overwrite").parquet(path)


def report(docs: DataFrame) -> DataFrame:
    """One row per document with its slot and shard."""
    return place(docs.select("doc_id"), F.col("doc_id")).select(F.col("row.doc_id").alias("doc_id"), "slot", "shard")


def oracle_sql(names: Sequence[str] = SHARDS, slots: int = SLOTS) -> str:
    """The same placement in DuckDB's SQL, by the filled table as a list."""
    table = ",".join(map(str, fill(names, slots)))
    shards = ",".join(f"'{n}'" for n in names)
    return f"""
WITH lookup AS (SELECT [{table}] AS places, [{shards}] AS names),
placed AS (
    SELECT doc_id, coalesce((('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT % {slots})::INTEGER, 0) AS slot
    FROM documents)
SELECT doc_id, slot, names[places[slot + 1] + 1] AS shard FROM placed, lookup"""
