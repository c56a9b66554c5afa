"""Lookups and numbering without hot tasks."""

import pytest
from pyspark.sql import functions as F

from touchline.functions.joins import lookup
from touchline.functions.numbering import numbered
from touchline.operators import validate as V

c = F.col


@pytest.fixture
def split(spark):
    """Sixteen shuffle partitions that stay apart."""
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled",
                                           "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    yield spark
    for k, v in keep.items():
        spark.conf.set(k, v)


def largest(df):
    return max(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())


def hot_rows(spark, n=30_000):
    """A third of the rows without key, a third with -1, a sixth with 7, the rest spread."""
    key = F.when(c("id") % 6 < 2, None).when(c("id") % 6 < 4, -1).when(c("id") % 6 == 4, 7).otherwise(100 + c("id"))
    return spark.range(n).select(c("id"), key.cast("long").alias("k"))


@pytest.mark.parametrize("max_rows", [0, 10**6])
def test_staged_lookup_spreads_null_and_heavy_keys(split, max_rows):
    rows = hot_rows(split)
    side = split.range(100, 40_000, 2).select(c("id").alias("k"), (c("id") * 2).alias("v")).unionByName(
        split.createDataFrame([(7, 14), (-1, -2)], "k long, v long"))
    got = lookup(rows, side, ["k"], F.lit(True), staged=True, max_rows=max_rows, heavy_rows=1000)
    want = rows.join(side, "k", "left")
    assert got.count() == 30_000 and got.exceptAll(want.select(*got.columns)).count() == 0
    assert largest(got) < 30_000 / 8 * 1.5


def test_lazy_lookup_spreads_null_keys_and_non_members(split):
    rows = hot_rows(split).withColumn("member", c("k") != -1)
    side = split.range(100, 40_000, 2).select(c("id").alias("k"), F.lit(1).alias("v")).unionByName(split.createDataFrame([(-1, 5)], "k long, v int"))
    got = lookup(rows, side, ["k"], c("member"))
    assert got.where("k = -1 and v is not null").count() == 0
    assert got.where("v is not null").count() == rows.where("k >= 100 and k % 2 = 0").count()
    assert largest(got.where("k is null or k = -1")) < 20_000 / 8 * 1.5


def test_null_safe_lookup(split):
    rows = split.createDataFrame([(1, None), (2, "a"), (3, "b")], "id int, k string")
    side = split.createDataFrame([(None, 10), ("a", 20)], "k string, v int")
    for staged in (False, True):
        got = lookup(rows, side, ["k"], F.lit(True), null_safe=True, staged=staged, max_rows=0)
        assert sorted((r.id, r.v) for r in got.collect()) == [(1, 10), (2, 20), (3, None)]


@pytest.mark.parametrize("staged", [False, True])
def test_duplicate_and_key_rules_on_hot_keys(split, staged):
    stg = hot_rows(split).withColumnRenamed("k", "key")
    ref = split.range(0, 40_000).select(c("id").alias("key"))
    rules = [V.ForeignKey("fk", "no such key; ", "key", ref, "key", dimension=False),
             V.Duplicate("dup", "duplicate; ", [c("key")], keep="min", order=[c("id")])]
    v = V.validate(stg, rules, stage_sides=staged)
    counts = {r.rule: r.n for r in v.rule_counts.collect()}
    assert counts == {"fk": 20_000, "dup": 4_999}
    assert v.flagged.where("is_valid and key = 7").select("id").collect()[0].id == 4
    assert largest(v.flagged.where("key is null")) < 10_000 / 8 * 1.5


def test_numbers_are_gapless_and_in_order(split):
    rows = split.range(5000).select(F.pmod(c("id") * 7919, F.lit(5000)).alias("a"), (c("id") % 3).alias("b")).where("a % 5 <> 0")
    got = numbered(rows, ["b", "a"], "n", start=101).collect()
    want = sorted((r.b, r.a) for r in got)
    assert [(r.b, r.a) for r in sorted(got, key=lambda r: r.n)] == want
    assert sorted(r.n for r in got) == list(range(101, 101 + len(want)))
    assert numbered(rows.limit(0), ["a"], "n").count() == 0
