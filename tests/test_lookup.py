import pytest
from footfall.config import Limits
from footfall.operators.lookup import Lookup, Sizes, shuffled_join
from pyspark.sql import functions as F

NONE_SMALL = Limits(broadcast_rows=0)


@pytest.fixture(scope="module")
def facts(spark):
    """A third of the rows have one key, a third none, the rest many."""
    n = F.col("id")
    key = F.when(n % 3 == 0, F.lit("hot")).when(n % 3 == 1, F.concat(F.lit("k"), n % 50))
    return spark.range(3000).select(n.alias("n"), key.alias("key"))


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame([("hot", "H"), ("hot", "I"), *[(f"k{i}", f"K{i}") for i in range(0, 50, 2)]], "key string, name string")


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_both_ways_give_the_rows_of_a_plain_join(facts, names, how):
    want = rows(facts.join(names, ["key"], how))
    small, large = Lookup(names, ["key"]), Lookup(names, ["key"], NONE_SMALL)
    assert small.is_small and not large.is_small
    assert rows(small.join(facts, how)) == want
    assert rows(large.join(facts, how)) == want


def test_size_counts_as_well_as_rows(names):
    assert not Lookup(names, ["key"], Limits(broadcast_bytes=10)).is_small


def test_renamed_lookup_keeps_its_measure(names):
    lookup = Lookup(names, ["key"], NONE_SMALL)
    other = lookup.renamed("k", "n")
    assert other.keys == ["k"] and other.frame.columns == ["k", "n"]
    assert not other.is_small and "is_small" in vars(lookup)


def test_relations_are_measured_in_one_pass(spark, names):
    sizes = Sizes(lambda: {"names": names, "none": names.limit(0)})
    assert sizes.measured == {"names": (27, 2 * len("hotH") + sum(2 * len(f"k{i}") for i in range(0, 50, 2))), "none": (0, 0)}
    assert sizes.within(Limits(), "names") and sizes.within(NONE_SMALL, "none") and not sizes.within(NONE_SMALL)


def test_a_hot_key_is_split_also_after_a_grouping_by_it(spark, facts, names):
    """Both sides have a shuffle of the join's own, and null keys are spread."""
    grouped = names.groupBy("key").agg(F.min("name").alias("name"))
    values = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        wide = facts.repartition(8).withColumn("text", F.sha2(F.col("n").cast("string"), 256))
        joined = shuffled_join(wide, grouped, ["key"], "left").withColumn("p", F.spark_partition_id())
        got = joined.collect()
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert "skew=true" in plan
    assert len(got) == 3000 and {r.name for r in got if r.key == "hot"} == {"H"}
    places = {key: len({r.p for r in got if r.key == key}) for key in ("hot", None)}
    assert places["hot"] > 1 and places[None] > 8
