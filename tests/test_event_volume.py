"""Events are checked, merged and shown with few shuffles and without hot tasks."""

import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from touchline.functions.windows import latest_by
from touchline.operators import serve as Q
from touchline.operators import validate as V
from touchline.plans import bindings

c = F.col


def order():
    return [c("ord1"), c("ord2")]


def staged_events(spark):
    """Fixture 1 holds every second row, -1 and null are no fixtures; rows repeat within a fixture."""
    i = c("id")
    return spark.range(4000).select(
        i.alias("ord1"), (i % 5).alias("ord2"),
        F.when(i % 2 == 0, 1).when(i % 20 == 1, -1).when(i % 20 == 3, None).otherwise(2 + i % 300).cast("long").alias("fixture_id"),
        F.when(i % 97 == 0, 140).otherwise(i % 7 * 10).cast("int").alias("minute"), F.when(i % 3 == 0, 0).cast("int").alias("minute_extra"),
        (i % 4).cast("int").alias("team_id"), F.when(i % 5 < 3, i % 3).cast("int").alias("player_id"), F.when(i % 11 == 0, i % 40).cast("int").alias("assist_player_id"),
        F.when(i % 89 == 0, "Shot").when(i % 41 == 0, None).when(i % 2 == 0, "GOAL").otherwise("Goal").alias("event_type"),
        F.when(i % 13 != 0, "Normal").alias("event_detail"))


def checked(spark, **how):
    stg = staged_events(spark)
    fixtures = spark.range(1, 290).select(c("id").alias("fixture_id"))
    teams = spark.range(3).select(c("id").cast("int").alias("team_id"))
    return V.check_match_events(stg.unionByName(stg.where("ord1 < 50")), fixtures, teams, order=order(), **how)


def as_rows(df):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


@pytest.mark.parametrize("heavy_rows", [500, 10**6])
def test_gathered_rows_get_the_flags_of_the_lazy_plan(spark, monkeypatch, heavy_rows):
    monkeypatch.setattr(V, "HEAVY_ROWS", heavy_rows)
    lazy, got = checked(spark, stage_sides=False), checked(spark)
    assert as_rows(got.flagged) == as_rows(lazy.flagged)
    assert as_rows(got.valid) == as_rows(got.flagged.where("is_valid")) == as_rows(lazy.valid)
    assert as_rows(got.rule_counts) == as_rows(lazy.rule_counts)
    assert as_rows(got.totals) == as_rows(lazy.rule_counts.unionByName(V.summary(lazy.flagged)))


def test_valid_events_are_shuffled_once(spark):
    d = latest_by(checked(spark).valid, ["fixture_id", "minute", "team_id", "event_type"], [o.desc() for o in order()])
    d = d.withColumn("n", F.row_number().over(Window.partitionBy("fixture_id").orderBy(*order())))
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(fixture_id", plan)) == 1


def test_player_of_all_events_makes_no_hot_task(spark, monkeypatch):
    events = staged_events(spark).withColumn("player_id", F.lit(1)).withColumn("event_id", c("ord1")).repartition(16)
    players = spark.createDataFrame([(1, "Ann Bo"), (1, "Cy Do"), (11, "Ed Fu"), (None, "Gi Ho")], "player_id int, full_name string")
    want = as_rows(Q.match_timeline(events, players))
    keep = spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(Q, "is_small", lambda df, max_rows=0: False)
    got = Q.match_timeline(events, players)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert as_rows(got) == want
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", keep)
    assert max(sizes) < sum(sizes) / 4


def test_large_tables_are_stored_as_they_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(bindings, "EVENED_MAX_ROWS", 100)
    b, df = bindings.Bound(spark, "/nowhere"), spark.range(10)
    assert b._evened(df, [spark.range(50), spark.range(101)]) is df
    assert b._evened(df, [spark.range(50)]) is not df and b._evened(df, []) is not df
