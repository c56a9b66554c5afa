"""T units: snapshot selection, read policies and flatteners on small JSON
documents written to a temp folder in the snapshot layout."""

import json
import os

from pyspark.sql import functions as F

from touchline import schemas as SC
from touchline.operators import flatten as FL
from touchline.sources import snapshots as SN


def _write(root, rel, payload):
    path = os.path.join(root, rel)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as fh:
        fh.write(payload if isinstance(payload, str) else json.dumps(payload))
    return path


def _fixture(fid, home, away, status="FT", gh=1, ga=0):
    return {"fixture": {"id": fid, "date": "2024-08-10T14:00:00+00:00", "status": {"short": status},
                        "venue": {"id": 7}},
            "teams": {"home": {"id": home}, "away": {"id": away}}, "league": {"round": "Regular Season - 1"},
            "goals": {"home": gh, "away": ga}}


def test_baseline_plus_increments(spark, tmp_path):
    root = str(tmp_path)
    for rel in ["fixtures/39/2024_25/full/full_20240801.json", "fixtures/39/2024_25/full/full_20240701.json",
                "fixtures/39/2024_25/inc/inc_20240802T1200Z.json", "fixtures/39/2024_25/inc/inc_20240715T1200Z.json",
                "fixtures/40/2024_25/inc/inc_20240802T1200Z.json"]:
        _write(root, rel, {"response": []})
    files = SN.list_files(spark, root).withColumn("league_id", F.regexp_extract("file_path", r"/(\d+)/\d{4}_", 1)) \
        .withColumn("season_year", F.lit(2024))
    chosen, missing = SN.baseline_plus_inc(files, ["league_id", "season_year"], "baseline")
    names = sorted(p.rsplit("/", 1)[1] for p in [r.file_path for r in chosen.collect()])
    assert names == ["full_20240801.json", "inc_20240802T1200Z.json"]
    assert [r.league_id for r in missing.collect()] == ["40"]
    inc, _ = SN.baseline_plus_inc(files, ["league_id", "season_year"], "inc")
    assert sorted(r.league_id for r in inc.collect()) == ["39", "40"]


def test_latest_run_ignores_bad_stamps(spark, tmp_path):
    root = str(tmp_path)
    _write(root, "match_events/39/2024_25/inc/inc_20240801_120000Z/events_1.json", {"response": []})
    _write(root, "match_events/39/2024_25/inc/inc_20240901_120000Z/events_2.json", {"response": []})
    _write(root, "match_events/39/2024_25/inc/inc_latest/events_3.json", {"response": []})
    files = SN.list_files(spark, root).withColumn("g", F.lit(1))
    chosen = SN.latest_run(files, ["g"], SN.RUN_STAMP_EVENTS, "yyyyMMdd_HHmmss", 2)
    assert [r.file_path.rsplit("/", 1)[1] for r in chosen.collect()] == ["events_2.json"]


def test_latest_file_lexicographic_and_embedded(spark, tmp_path):
    root = str(tmp_path)
    _write(root, "standings/39/2024/full_2024-09-01_10-00.json", {})
    _write(root, "standings/39/2024/inc_2024-08-01_10-00.json", {})
    files = SN.list_files(spark, root).withColumn("g", F.lit(1))
    lex = SN.latest_file(files, ["g"]).collect()[0].file_path
    emb = SN.latest_file(files, ["g"], by_embedded_ts=True).collect()[0].file_path
    assert lex.endswith("inc_2024-08-01_10-00.json") and emb.endswith("full_2024-09-01_10-00.json")


def test_read_policies(spark, tmp_path):
    root = str(tmp_path)
    good = _write(root, "s/statistics_11.json", {"response": []})
    bad = _write(root, "s/statistics_12.json", "{not json")
    skip = SN.read_snapshots(spark, [good, bad], SC.STATISTICS, "skip")
    assert skip.count() == 1
    err = SN.read_snapshots(spark, [good, bad], SC.STATISTICS, "error_row").orderBy("file_path").collect()
    assert [r.is_valid for r in err] == [True, False] and err[1].error_reason.startswith("exception:")
    miss = SN.read_snapshots(spark, [good, bad], SC.STATISTICS, "missing")
    assert miss.where(F.col("doc").isNull()).count() == 1


def test_flatten_fixtures_skips_items_without_fixture(spark, tmp_path):
    p = _write(str(tmp_path), "f/full_20240801.json", {"response": [_fixture(1, 10, 11), {"teams": {}}]})
    docs = SN.read_snapshots(spark, [p], SC.FIXTURES).withColumn("league_id", F.lit(39)) \
        .withColumn("season_year", F.lit(2024))
    rows = FL.flatten_fixtures(docs).collect()
    assert len(rows) == 1 and rows[0].fixture_id == 1 and rows[0].league_id == 39 and rows[0].venue_id == 7
    assert str(rows[0].fixture_date) == "2024-08-10 14:00:00"


def test_flatten_standings_groups(spark, tmp_path):
    row = {"team": {"id": 5}, "rank": 1, "points": 3, "goalsDiff": 1,
           "all": {"played": 1, "win": 1, "draw": 0, "lose": 0, "goals": {"for": 2, "against": 1}}}
    doc = {"response": [{"league": {"standings": [[dict(row, group="Group A")], [dict(row, group=None)],
                                                  [dict(row, group="Group B")]]}}]}
    p = _write(str(tmp_path), "st/full_x.json", doc)
    docs = SN.read_snapshots(spark, [p], SC.STANDINGS).withColumn("league_id", F.lit(1)) \
        .withColumn("season_year", F.lit(2024))
    out = FL.flatten_standings(docs).collect()
    assert sorted(r.group_label for r in out) == ["", "Group A", "Group B"]
    assert all(r.goals_for == 2 for r in out)


def test_flatten_events_fixture_from_file_name(spark, tmp_path):
    ev = {"time": {"elapsed": 45, "extra": 2}, "team": {"id": 1}, "player": {"id": 9}, "assist": None,
          "type": "Goal", "detail": "Normal Goal", "comments": None}
    a = _write(str(tmp_path), "e/events_77.json", {"parameters": {}, "response": [ev]})
    b = _write(str(tmp_path), "e/events_x.json", {"parameters": {}, "response": [ev]})
    c_ = _write(str(tmp_path), "e/events_y.json", {"parameters": {"fixture": "88"}, "response": [ev, ev]})
    out = FL.flatten_events(SN.read_snapshots(spark, [a, b, c_], SC.EVENTS)).collect()
    assert sorted(r.fixture_id for r in out) == [77, 88, 88]
    assert all(r.assist_player_id is None and r.minute_extra == 2 for r in out)


def test_pivot_statistics_synonyms_duplicates_and_empty(spark, tmp_path):
    stats = [{"type": "Shots insidebox", "value": "5"}, {"type": "Shots outside box", "value": 3},
             {"type": "Ball Possession", "value": "55%"}, {"type": "Total Shots", "value": 9},
             {"type": "Total Shots", "value": 12}, {"type": "expected_goals", "value": "2.43"},
             {"type": "Fouls", "value": None}, {"type": "Corner Kicks", "value": "abc"},
             {"type": "Unknown", "value": 1}]
    p = _write(str(tmp_path), "m/statistics_5.json", {"response": [{"team": {"id": 1}, "statistics": stats}]})
    e = _write(str(tmp_path), "m/statistics_6.json", {"response": []})
    docs = SN.read_snapshots(spark, [p, e], SC.STATISTICS, "error_row")
    rows = {r.fixture_id: r for r in FL.pivot_statistics(docs).collect()}
    r = rows[5]
    assert (r.shots_inside_box, r.shots_outside_box, r.possession, r.total_shots) == (5, 3, 55, 12)
    assert float(r.expected_goals) == 2.43 and r.fouls is None and r.corners is None
    assert rows[6].is_valid is False and rows[6].error_reason == "empty or invalid 'response' array"


def test_flatten_players_and_player_stats(spark, tmp_path):
    doc = {"response": [{"player": {"id": 10, "name": "J. Doe", "firstname": "John", "lastname": "Doe",
                                    "birth": {"date": "1999-02-03", "country": "X"}, "height": "180 cm"},
                         "statistics": [
                             {"team": {"id": 3}, "league": {"id": 39, "season": 2024},
                              "games": {"appearences": "6.700000", "lineups": "", "minutes": "540"},
                              "passes": {"accuracy": "81"}},
                             {"team": {"id": 3}, "league": {"id": 2, "season": 2024}, "games": {}}]}]}
    zero = {"response": [{"player": {"id": 0}, "statistics": []}]}
    a = _write(str(tmp_path), "p/player_10.json", doc)
    b = _write(str(tmp_path), "p/player_0.json", zero)
    docs = SN.read_snapshots(spark, [a, b], SC.PLAYER_DOC).withColumn("league_id", F.lit(39)) \
        .withColumn("season_year", F.lit(2024))
    players = FL.flatten_players(docs).collect()
    assert [p.player_id for p in players] == [10] and str(players[0].birth_date) == "1999-02-03"
    strict = FL.flatten_player_stats(docs).collect()
    assert len(strict) == 1 and strict[0].appearances == 6 and strict[0].lineups is None
    assert len(FL.flatten_player_stats(docs, strict_league=False).collect()) == 2


def test_flatten_news_flags(spark, tmp_path):
    res = {"response": {"results": [
        {"id": "a1", "webTitle": "T", "webPublicationDate": "2024-01-02T03:04:05Z", "webUrl": "u1",
         "fields": {"trailText": "<p>Tom &amp; Jerry&nbsp;win</p>"}},
        {"id": "a2", "webPublicationDate": "2024-01-02T03:04:05Z", "fields": {}},
        {"id": "a3", "webTitle": "T3", "webPublicationDate": "2024-01-02T03:04:05Z", "webUrl": "long",
         "fields": {"shortUrl": "short"}}]}}
    p = _write(str(tmp_path), "news/guardian/transfers/run_ts=2024-01-02T03-04-05/response.json", res)
    docs = SN.read_snapshots(spark, [p], SC.NEWS).withColumn("tab", F.lit("transfers")) \
        .withColumn("fetched_at_utc", F.lit(None).cast("timestamp_ntz"))
    rows = {r.article_id: r for r in FL.flatten_news(docs).collect()}
    assert rows["a1"].summary == "Tom & Jerry\xa0win" and rows["a1"].is_valid
    assert rows["a2"].error_reason == "missing webTitle; missing url"
    assert rows["a3"].url == "short"


def test_latest_batch_and_roster_and_venue_fills(spark, tmp_path):
    root = str(tmp_path)
    _write(root, "news/guardian/transfers/run_ts=2024-01-01T00-00-00/response.json", {})
    _write(root, "news/guardian/transfers/run_ts=2024-01-02T00-00-00/response.json", {})
    _write(root, "news/guardian/transfers/run_ts=2024-01-02T00-00-00/_meta.json", {})
    _write(root, "news/guardian/transfers/run_ts=2024-01-03T00-00-00/_meta.json", {})
    b = SN.latest_batch(SN.list_files(spark, os.path.join(root, "news"))).collect()
    assert len(b) == 1 and b[0].run_ts == "2024-01-02T00-00-00" and b[0].meta_path.endswith("_meta.json")

    _write(root, "squads/initial/39/2024_25/run_2024-08-01/squads.json", {"teams": {"1": [5, 6], "2": [6]}})
    _write(root, "squads/initial/39/2024_25/run_2024-09-01/squads.json", {"teams": {"1": [7, 8], "2": [8, None]}})
    files = SN.list_files(spark, os.path.join(root, "squads")).withColumn("league", F.lit(39)) \
        .withColumn("season", F.lit(2024))
    ids = sorted(r.player_id for r in SN.roster_player_ids(spark, files).collect())
    assert ids == [7, 8]

    v1 = _write(root, "venues/39/2024_25/venues.json",
                [{"id": 1, "name": "A", "city": "C1", "country": None}, {"response": [{"id": 2, "name": "B"}]}])
    v2 = _write(root, "venues/40/2024_25/venues.json", [{"id": 1, "name": "A2", "city": "C2"}])
    fills = {r.venue_id: r for r in SN.read_venue_fills(spark, [v1, v2]).collect()}
    assert fills[1].venue_name == "A" and fills[2].venue_name == "B"


def test_players_from_pages_and_squads(spark, tmp_path):
    page = _write(str(tmp_path), "pg/page_1.json", {"response": [{"player": {"id": 1, "name": "A"}, "statistics": []}]})
    squad = _write(str(tmp_path), "sq/squad_3.json", {"response": [{"players": [{"id": 1, "name": "A"},
                                                                                {"id": 2, "name": "B"}]}]})
    pages = SN.read_snapshots(spark, [page], SC.PLAYER_DOC)
    squads = SN.read_snapshots(spark, [squad], SC.SQUAD)
    out = {r.player_id: r.source for r in FL.players_from_pages_and_squads(pages, squads).collect()}
    assert out == {1: "page", 2: "squad"}
    from touchline.sources.sinks import player_documents
    docs = {r.player_id: json.loads(r.document) for r in player_documents(pages, squads).collect()}
    assert docs[2]["response"][0]["player"]["name"] == "B" and docs[1]["results"] == 1


def test_flatten_seasons_meta(spark, tmp_path):
    entry = {"league": {"id": 39, "name": "L"}, "country": {"name": "C"},
             "seasons": [{"year": 2021, "start": "2021-08-01", "end": "2022-05-01", "current": False},
                         {"year": 2022, "start": "2022-08-01", "end": "2023-05-01"},
                         {"year": 2023, "start": "2023-08-01", "end": "2024-05-01", "current": True}]}
    p = _write(str(tmp_path), "meta/39/league.json", {"response": [entry]})
    docs = SN.read_snapshots(spark, [p], SC.LEAGUES).withColumn("league_id", F.lit(39))
    catalog = spark.createDataFrame([(39, 2022, None, True)], "league_id int, first_season int, last_season int, "
                                                             "is_enabled boolean")
    rows = sorted((r.season_year, r.is_current, r.season_str) for r in FL.flatten_seasons(docs, catalog).collect())
    assert rows == [(2022, False, "2022_23"), (2023, True, "2023_24")]


def test_many_small_files_are_read_in_tasks(spark, tmp_path):
    """The listing is dealt out: nothing but counts reaches the driver."""
    import json
    from touchline import schemas as SC
    root = tmp_path / "many"
    for d in range(20):
        (root / f"d{d}").mkdir(parents=True)
        for i in range(300):
            (root / f"d{d}" / f"f {i}.json").write_text(json.dumps({"response": [{"fixture": {"id": d * 300 + i}}]}) if i else "{broken")
    files = SN.list_files(spark, str(root))
    docs = SN.read_snapshots(spark, files, SC.FIXTURES, on_bad="error_row")
    assert docs.rdd.getNumPartitions() >= 3
    assert docs.where("is_valid").count() == 20 * 299 and docs.where("not is_valid").count() == 20
    ids = docs.where("is_valid").selectExpr("doc.response[0].fixture.id as id").agg({"id": "sum"}).first()[0]
    assert ids == sum(d * 300 + i for d in range(20) for i in range(1, 300))


def test_tree_reader_agrees_with_task_reader(spark, tmp_path):
    for name in ("a/x.json", "a/b/y.json", "c/z ü%20.json"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    files = SN.list_files(spark, str(tmp_path))
    some = files.where("file_path not like '%y.json'")
    for part in (files, some, files.where("file_path like '%z%'"), files.limit(0)):
        want = sorted((r.file_path, bytes(r.content)) for r in SN.read_files(part).collect())
        assert sorted((r.file_path, bytes(r.content)) for r in SN.read_tree(spark, part).collect()) == want
    gone = SN.read_files(spark.createDataFrame([(str(tmp_path / "gone.json"),)], "file_path string")).collect()
    assert gone[0].content is None
