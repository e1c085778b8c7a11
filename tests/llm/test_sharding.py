"""The table against a slow filling; placement against the hash in Python."""

import hashlib
from collections import Counter

import pytest
from footfall.llm import sharding
from pyspark.sql import functions as F


def slow_fill(names, slots, weights):
    """Shards list all their preferences and strike out what is taken."""
    lists = []
    for name in names:
        offset, skip = sharding.preference(name, slots)
        lists.append([(offset + j * skip) % slots for j in range(slots)])
    owner = {}
    while len(owner) < slots:
        for shard, weight in enumerate(weights):
            for _ in range(weight):
                if len(owner) < slots:
                    owner[next(s for s in lists[shard] if s not in owner)] = shard
    return [owner[s] for s in range(slots)]


@pytest.mark.parametrize(("n", "slots", "weights"), [(1, 2, [1]), (5, 101, [1] * 5), (7, 211, [1, 2, 1, 3, 1, 1, 1])])
def test_fill(n, slots, weights):
    names = [f"s{i}" for i in range(n)]
    assert sharding.fill(names, slots, weights) == slow_fill(names, slots, weights)


def test_evenness_and_little_movement():
    table = sharding.fill(sharding.SHARDS)
    counts = Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.fill(sharding.SHARDS[:-1])
    moved = sum(a != b for a, b in zip(table, fewer) if a != len(sharding.SHARDS) - 1)
    assert moved / len(table) < 0.05


@pytest.mark.parametrize(("names", "slots"), [([], 101), (["a", "a"], 101), (["a"], 100), (["a"], 1_000_003)])
def test_refused(names, slots):
    with pytest.raises(ValueError):
        sharding.fill(names, slots)


def test_tables(documents, clashing):
    docs = clashing(documents("a", "a", None, (None, "b"), (0, "again"), (10**15, "c")))
    rows = [(r.doc_id, r.slot, r.shard) for r in sharding.report(docs).collect()]
    table = sharding.fill(sharding.SHARDS)
    want = []
    for own in (0, 1, 2, None, 0, 10**15):
        slot = 0 if own is None else int(hashlib.md5(str(own).encode()).hexdigest()[:15], 16) % sharding.SLOTS
        want.append((own, slot, sharding.SHARDS[table[slot]]))
    assert sorted(rows, key=str) == sorted(want, key=str)
    assert sharding.report(docs.limit(0)).collect() == []


def test_plan_is_native_and_without_shuffle(documents, capsys):
    sharding.report(documents("a")).explain()
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" in plan and "Python" not in plan and "Arrow" not in plan and "hashpartitioning" not in plan


def test_written_shards(spark, documents, clashing, folder):
    docs = documents(*["text"] * 40)
    sharding.write_shards(docs, F.col("doc_id"), f"{folder}/out", ["a", "b"], 101)
    back = spark.read.parquet(f"{folder}/out")
    assert back.count() == 40 and {r["shard"] for r in back.collect()} == {"a", "b"}
    sharding.write_shards(clashing(docs), F.col("doc_id"), f"{folder}/clash", ["a", "b"], 101)
    back = spark.read.parquet(f"{folder}/clash")
    assert {r["shard"] for r in back.collect()} == {"x"} and {r["shard_"] for r in back.collect()} == {"a", "b"}
