"""Versioned tables (commit last, untouched partitions alone, replays recognised) and the ingest stream on them."""

import json
import os

import pytest
from pyspark.sql import functions as F

from touchline import schemas as SC
from touchline.operators import merge as M
from touchline.sources.versions import VersionedTable, succeeded
from touchline.streaming.incremental import fixtures_upsert_batch, incremental_ingest

AS_OF = "2024-09-10 00:00:00"
FIXTURES = ("fixture_id int, league_id int, season_year int, home_team_id int, away_team_id int, fixture_date timestamp_ntz, "
            "status string, round string, home_score int, away_score int, venue_id int, load_date timestamp_ntz, upd_date timestamp_ntz")
VENUES = "venue_id int, venue_name string, city string, country string, load_date timestamp_ntz, upd_date timestamp_ntz"
ERRORS = "staging_table string, record_key string, error_reason string, created_at timestamp_ntz"
ITEMS = "id int, season int, name string"


def files_of(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def upsert(table, rows, run=None):
    rows = table.spark.createDataFrame(rows, ITEMS)
    return table.upsert(rows, ["id"], lambda t: M.merge_upsert(t, rows, ["id"], ["season", "name"], AS_OF, audit=None), AS_OF, run)


@pytest.fixture
def items(spark, tmp_path):
    return VersionedTable(spark, str(tmp_path / "items"), ITEMS, partition=F.col("season"))


def content(table):
    return sorted(tuple(r) for r in table.read().collect())


def test_first_run_on_an_empty_folder(items):
    assert content(items) == []
    res = upsert(items, [(1, 2023, "a"), (2, 2024, "b")])
    assert content(items) == [(1, 2023, "a"), (2, 2024, "b")]
    assert {r.action: r.n for r in res.summary.collect()} == {"insert": 2}


def test_untouched_partitions_keep_their_files(items):
    upsert(items, [(1, 2023, "a"), (2, 2024, "b"), (3, None, "c")])
    before = files_of(items.path)
    old = {f for f in files_of(items.path) if "part=2023" in f or "part=null" in f}
    res = upsert(items, [(2, 2024, "x"), (4, 2024, "y")])
    assert {r.action: r.n for r in res.summary.collect()} == {"insert": 1, "update": 1}
    now = set(items.read().inputFiles())
    assert len(old) >= 2 and all(any(n.endswith(f) for n in now) for f in old)      # left alone, still read
    assert before <= files_of(items.path)                                          # nothing overwritten
    assert all("part=2024" in f for f in files_of(items.path + "/data") - before)
    assert content(items) == [(1, 2023, "a"), (2, 2024, "x"), (3, None, "c"), (4, 2024, "y")]


def test_a_row_that_moves_between_partitions_is_not_doubled(items):
    upsert(items, [(1, 2023, "a"), (2, 2023, "b"), (3, 2022, "c")])
    upsert(items, [(1, 2024, "moved")])
    assert content(items) == [(1, 2024, "moved"), (2, 2023, "b"), (3, 2022, "c")]


def test_crash_between_write_and_switch(items, monkeypatch):
    upsert(items, [(1, 2024, "a")], "r1")

    def stop(*args):
        raise OSError("stopped before the commit")

    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "_commit", stop)
        with pytest.raises(OSError):
            upsert(items, [(1, 2024, "b"), (2, 2024, "c")], "r2")
    assert content(items) == [(1, 2024, "a")] and not items.has("r2")       # the written version is not seen
    upsert(items, [(1, 2024, "b"), (2, 2024, "c")], "r2")
    assert content(items) == [(1, 2024, "b"), (2, 2024, "c")]


def test_a_run_is_taken_once(items):
    assert upsert(items, [(1, 2024, "a")], "r1") is not None
    assert upsert(items, [(1, 2024, "other")], "r1") is None
    assert content(items) == [(1, 2024, "a")]
    empty = items.spark.createDataFrame([], ITEMS)
    assert items.append(empty, AS_OF, "nothing") and not items.append(empty, AS_OF, "nothing")     # also a run without rows


def test_two_writers_of_one_number_are_found(items):
    upsert(items, [(1, 2024, "a")])
    (items.spark.createDataFrame([(1, "other", "x", "2024")], "seq long, version string, run string, part string")
     .withColumn("committed_at", M.ts(AS_OF)).write.mode("append").parquet(f"{items.path}/commits"))
    with pytest.raises(RuntimeError, match="two writers"):
        items.read()


def test_success_marker(spark, tmp_path):
    path = str(tmp_path / "t")
    assert not succeeded(spark, path)
    spark.range(3).write.parquet(path)
    assert succeeded(spark, path)
    os.remove(f"{path}/_SUCCESS")
    assert not succeeded(spark, path)


def fixture(fid, home, away, status="FT", gh=1, ga=0, venue=7):
    return {"fixture": {"id": fid, "date": "2024-08-10T14:00:00+00:00", "status": {"short": status}, "venue": {"id": venue}},
            "teams": {"home": {"id": home}, "away": {"id": away}}, "league": {"round": "R1"}, "goals": {"home": gh, "away": ga}}


def put(root, rel, payload):
    path = os.path.join(root, rel)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as fh:
        fh.write(payload if isinstance(payload, str) else json.dumps(payload))


@pytest.fixture
def tables(spark, tmp_path):
    return (VersionedTable(spark, str(tmp_path / "fixtures"), FIXTURES, partition=F.col("season_year")),
            VersionedTable(spark, str(tmp_path / "venues"), VENUES), VersionedTable(spark, str(tmp_path / "errors"), ERRORS))


def scores(table):
    return {r.fixture_id: (r.season_year, r.home_score) for r in table.read().collect()}


def test_stream_merges_new_files_logs_and_adds_venues(spark, tmp_path, tables):
    src, ckpt = str(tmp_path / "src"), str(tmp_path / "ckpt")
    teams = spark.createDataFrame([(t, "T") for t in (10, 11, 12)], "team_id int, team_name string")
    body = fixtures_upsert_batch(*tables, teams, AS_OF)
    put(src, "39/2023_24/full/full_20230801.json", {"response": [fixture(9, 10, 11)]})
    put(src, "39/2024_25/full/full_20240801.json", {"response": [fixture(1, 10, 11), fixture(2, 11, 12), fixture(3, 10, 99), fixture(4, 10, 10)]})
    put(src, "39/2024_25/full/full_20240802.json", "{broken")
    incremental_ingest(spark, src, SC.FIXTURES, body, ckpt).awaitTermination(120)
    assert scores(tables[0]) == {9: (2023, 1), 1: (2024, 1), 2: (2024, 1)}
    assert {(r.record_key, r.error_reason) for r in tables[2].read().collect()} == {("3", "missing_away_team"), ("4", "home_eq_away")}
    assert [(r.venue_id, r.venue_name) for r in tables[1].read().collect()] == [(7, "Unknown Venue")]
    last_season = {f for f in files_of(tables[0].path) if "part=2023" in f}

    put(src, "39/2024_25/inc/inc_20240805T1200Z.json", {"response": [fixture(2, 11, 12, "FT", 3, 3, venue=8), fixture(3, 10, 99)]})
    incremental_ingest(spark, src, SC.FIXTURES, body, ckpt).awaitTermination(120)
    assert scores(tables[0]) == {9: (2023, 1), 1: (2024, 1), 2: (2024, 3)}
    assert sorted(r.venue_id for r in tables[1].read().collect()) == [7, 8]
    assert tables[2].read().count() == 2                                     # the repeated reject is logged once
    assert last_season == {f for f in files_of(tables[0].path) if "part=2023" in f}


def test_batch_stopped_before_the_switch_is_done_on_restart(spark, tmp_path, tables, monkeypatch):
    src, ckpt = str(tmp_path / "src"), str(tmp_path / "ckpt")
    teams = spark.createDataFrame([(10, "T"), (11, "T")], "team_id int, team_name string")
    body = fixtures_upsert_batch(*tables, teams, AS_OF)
    put(src, "39/2024_25/full/full_20240801.json", {"response": [fixture(1, 10, 11), fixture(3, 10, 99)]})
    commit = VersionedTable._commit

    def stop_at_fixtures(self, *args):
        if self is tables[0]:
            raise OSError("stopped")
        commit(self, *args)

    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "_commit", stop_at_fixtures)
        with pytest.raises(Exception):
            incremental_ingest(spark, src, SC.FIXTURES, body, ckpt).awaitTermination(120)
    assert scores(tables[0]) == {} and tables[2].read().count() == 1         # the log was written before the stop
    incremental_ingest(spark, src, SC.FIXTURES, body, ckpt).awaitTermination(120)
    assert scores(tables[0]) == {1: (2024, 1)} and tables[2].read().count() == 1 and tables[1].read().count() == 1


def test_replayed_batch_changes_nothing(spark, tmp_path, tables):
    teams = spark.createDataFrame([(10, "T"), (11, "T")], "team_id int, team_name string")
    body = fixtures_upsert_batch(*tables, teams, AS_OF)
    put(str(tmp_path), "39/2024_25/full/full_20240801.json", {"response": [fixture(1, 10, 11)]})
    text = spark.read.text(str(tmp_path / "39"), wholetext=True, recursiveFileLookup=True)
    batch = text.select(F.col("_metadata.file_path").alias("file_path"), F.from_json("value", SC.FIXTURES).alias("doc"))
    body(batch, 0)
    before = files_of(str(tmp_path / "fixtures"))
    body(batch, 0)
    assert files_of(str(tmp_path / "fixtures")) == before and scores(tables[0]) == {1: (2024, 1)}
    assert tables[0].commits().count() == 1
