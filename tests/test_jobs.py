"""End-to-end jobs (J01–J09) and incremental streaming ingest (T01) on JSON
snapshots written in the source application's path layout."""

import json
import os

import pytest
from pyspark.sql import functions as F

from touchline.operators import merge as M
from touchline.operators import validate as V
from touchline.plans import jobs as J
from touchline.sources import snapshots as SN

AS_OF = "2024-09-10 00:00:00"


def _write(root, rel, payload):
    path = os.path.join(root, rel)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as fh:
        fh.write(payload if isinstance(payload, str) else json.dumps(payload))
    return path


def _fx(fid, home, away, status="FT", gh=1, ga=0, date="2024-08-10T14:00:00+00:00", venue=7):
    return {"fixture": {"id": fid, "date": date, "status": {"short": status}, "venue": {"id": venue}},
            "teams": {"home": {"id": home}, "away": {"id": away}}, "league": {"round": "R1"},
            "goals": {"home": gh, "away": ga}}


FIXTURES_SCHEMA = ("fixture_id int, league_id int, season_year int, home_team_id int, away_team_id int, "
                   "fixture_date timestamp_ntz, status string, round string, home_score int, away_score int, "
                   "venue_id int, load_date timestamp_ntz, upd_date timestamp_ntz")


def _teams(spark, ids):
    return spark.createDataFrame([(i, f"Team {i}") for i in ids], "team_id int, team_name string")


def test_run_fixtures_baseline_plus_increment(spark, tmp_path):
    root = str(tmp_path)
    _write(root, "fixtures/39/2024_25/full/full_20240801.json",
           {"response": [_fx(1, 10, 11), _fx(2, 12, 13, "NS", None, None), _fx(3, 10, 10), _fx(5, 10, 99)]})
    _write(root, "fixtures/39/2024_25/full/full_20240701.json", {"response": [_fx(9, 10, 11)]})
    _write(root, "fixtures/39/2024_25/inc/inc_20240805T1200Z.json",
           {"response": [_fx(2, 12, 13, "FT", 2, 2), _fx(4, 11, 12, venue=8)]})
    old = spark.createDataFrame([], FIXTURES_SCHEMA).unionByName(spark.sql(
        "select 1 as fixture_id, 39 as league_id, 2024 as season_year, 10 as home_team_id, 11 as away_team_id, "
        "timestamp_ntz '2024-08-10 14:00:00' as fixture_date, 'FT' as status, 'R1' as round, 1 as home_score, "
        "0 as away_score, 7 as venue_id, timestamp_ntz '2024-01-01 00:00:00' as load_date, "
        "timestamp_ntz '2024-01-01 00:00:00' as upd_date"))
    venues = spark.createDataFrame([(7, "V", "C", "X")], "venue_id int, venue_name string, city string, country string")
    out = J.run_fixtures(spark, root, old, _teams(spark, [10, 11, 12, 13]), venues, AS_OF)
    actions = {r.fixture_id: r.action for r in out["fixtures"].collect()}
    # 1 unchanged, 2 from the increment, 4 new, 3 (home = away) and 5 (unknown team) rejected, 9 older baseline.
    assert actions == {1: "unchanged", 2: "insert", 4: "insert"}
    fx2 = [r for r in out["fixtures"].collect() if r.fixture_id == 2][0]
    assert (fx2.status, fx2.home_score) == ("FT", 2)
    reasons = {r.record_key: r.error_reason for r in out["rejects"].collect()}
    assert reasons == {"3": "home_eq_away", "5": "missing_away_team"}
    assert [r.venue_id for r in out["placeholder_venues"].collect()] == [8]
    assert out["ledger"].collect()[0].all_ok is True


STANDINGS_SCHEMA = ("league_id int, season_year int, team_id int, group_label string, rank int, points int, "
                    "played int, win int, draw int, lose int, goals_for int, goals_against int, goals_diff int, "
                    "form_window short, form_compact string, load_date timestamp_ntz, upd_date timestamp_ntz")


def test_run_standings_with_form(spark, tmp_path):
    root = str(tmp_path)
    row = lambda t, rk, p, w, d, l_, gf, ga, grp="": {
        "team": {"id": t}, "rank": rk, "points": p, "goalsDiff": gf - ga, "group": grp,
        "all": {"played": w + d + l_, "win": w, "draw": d, "lose": l_, "goals": {"for": gf, "against": ga}}}
    _write(root, "standings/39/2024_25/full_2024-09-01_10-00.json",
           {"response": [{"league": {"standings": [[row(10, 1, 4, 1, 1, 0, 3, 1), row(11, 2, 1, 0, 1, 1, 1, 3),
                                                     row(12, 3, 9, 1, 0, 0, 1, 0)]]}}]})
    fixtures = spark.sql(
        "select * from values (1, 39, 2024, 10, 11, timestamp_ntz '2024-08-01 12:00:00', 'FT', 2, 0), "
        "(2, 39, 2024, 11, 10, timestamp_ntz '2024-08-08 12:00:00', 'FT', 1, 1) "
        "as t(fixture_id, league_id, season_year, home_team_id, away_team_id, fixture_date, status, home_score, away_score)")
    scope = spark.createDataFrame([(39, 2024)], "league_id int, season_year int")
    out = J.run_standings(spark, root, spark.createDataFrame([], STANDINGS_SCHEMA), fixtures,
                          _teams(spark, [10, 11, 12]), scope, AS_OF)
    got = {r.team_id: (r.form_compact, r.action) for r in out["standings"].collect()}
    assert got == {10: ("WD", "insert"), 11: ("LD", "insert")}
    bad = out["rejects"].collect()
    assert len(bad) == 1 and bad[0].error_reason == "Points != 3*W + D;"
    counts = out["counts"].collect()[0]
    assert (counts.inserted, counts.updated, counts.no_form) == (2, 0, 0)


EVENTS_SCHEMA = ("event_id bigint, fixture_id int, minute int, minute_extra int, team_id int, player_id int, "
                 "assist_player_id int, event_type string, event_detail string, comments string, "
                 "load_date timestamp_ntz, upd_date timestamp_ntz")


def test_run_match_events(spark, tmp_path):
    root = str(tmp_path)
    ev = lambda m, p, t="Goal", d="Normal Goal": {
        "time": {"elapsed": m, "extra": None}, "team": {"id": 10}, "player": {"id": p}, "assist": {"id": 77},
        "type": t, "detail": d, "comments": None}
    _write(root, "match_events/39/2024_25/inc/inc_20240801_120000Z/events_1.json",
           {"parameters": {"fixture": "1"}, "response": [ev(5, 9)]})
    _write(root, "match_events/39/2024_25/inc/inc_20240901_120000Z/events_1.json",
           {"parameters": {"fixture": "1"}, "response": [ev(10, 9), ev(10, 9), ev(150, 9), ev(20, 9, "Shot", "x"),
                                                        ev(30, 8, "Card", "Yellow Card")]})
    fixtures = spark.createDataFrame([(1,)], "fixture_id int")
    players = spark.createDataFrame([(9, "A B")], "player_id int, full_name string")
    scope = spark.createDataFrame([(39, 2024)], "league_id int, season_year int")
    out = J.run_match_events(spark, root, spark.createDataFrame([], EVENTS_SCHEMA), fixtures,
                             _teams(spark, [10]), players, scope, AS_OF)
    counts = {r.rule: r.n for r in out["rule_counts"].collect()}
    assert counts == {"fk": 0, "minute": 1, "type": 1, "dup": 1}
    ev_rows = out["events"].collect()
    assert sorted((r.minute, r.player_id) for r in ev_rows) == [(10, 9), (30, 8)]
    assert sorted(r.player_id for r in out["placeholder_players"].collect()) == [8, 77]


def test_run_match_statistics(spark, tmp_path):
    root = str(tmp_path)
    stats = lambda t, sog, saves: {"team": {"id": t}, "statistics": [
        {"type": "Shots on Goal", "value": sog}, {"type": "Goalkeeper Saves", "value": saves},
        {"type": "Total Shots", "value": 10}, {"type": "Ball Possession", "value": "50%"}]}
    _write(root, "match_statistics/39/2024_25/inc/2024-09-01_120000/statistics_1.json",
           {"response": [stats(10, 3, 5), stats(11, 4, 1)]})
    _write(root, "match_statistics/39/2024_25/inc/2024-09-01_120000/statistics_2.json", {"response": []})
    _write(root, "match_statistics/39/2024_25/inc/2024-09-01_120000/statistics_3.json", "{broken")
    _write(root, "match_statistics/39/2024_25/inc/2024-08-01_120000/statistics_9.json",
           {"response": [stats(10, 1, 1)]})
    fixtures = spark.createDataFrame([(1, 39, 2024, "FT"), (2, 39, 2024, "FT"), (3, 39, 2024, "NS")],
                                     "fixture_id int, league_id int, season_year int, status string")
    scope = spark.createDataFrame([(39, 2024)], "league_id int, season_year int")
    from touchline.operators.flatten import STAT_TYPES, FLOAT_STATS
    cols = list(dict.fromkeys(STAT_TYPES.values()))
    schema = ", ".join(["fixture_id int", "team_id int", "league_id int", "season_year int"]
                       + [f"{x} {'decimal(5,2)' if x in FLOAT_STATS else 'int'}" for x in cols]
                       + ["load_date timestamp_ntz", "upd_date timestamp_ntz"])
    out = J.run_match_statistics(spark, root, spark.createDataFrame([], schema), fixtures, scope, AS_OF)
    merged = out["statistics"].collect()
    assert sorted((r.fixture_id, r.team_id, r.possession) for r in merged) == [(1, 10, 50), (1, 11, 50)]
    staging = {r.fixture_id: r for r in out["staging"].where(F.col("team_id").isNull()).collect()}
    assert staging[2].error_reason.startswith("empty or invalid") and staging[3].is_valid is False
    cov = out["coverage"].collect()[0]
    assert (cov.complete2, cov.partial1, cov.missing0) == (1, 0, 1)
    assert out["dq"].collect()[0].dq_saves_gt_opponent_sog == 1


def test_run_teams_venues(spark, tmp_path):
    root = str(tmp_path)
    _write(root, "teams/39/2024_25/teams.json", {"response": [
        {"team": {"id": 10, "name": "Ten", "country": "E", "logo": "l"}, "venue": {"id": 7, "name": "V7", "city": "C"}},
        {"team": {"id": 11, "name": None}, "venue": {"id": 8, "name": "V8", "capacity": -1}}]})
    _write(root, "teams/39/2023_24/teams.json", {"response": []})
    teams = spark.createDataFrame([(10, "Old", None, None, None, None, None)],
                                  "team_id int, team_name string, team_country string, team_logo_url string, "
                                  "venue_id int, load_date timestamp_ntz, upd_date timestamp_ntz")
    venues = spark.createDataFrame([], "venue_id int, venue_name string, city string, country string, "
                                       "load_date timestamp_ntz, upd_date timestamp_ntz")
    bridge = spark.createDataFrame([], "team_id int, league_id int, season_year int, load_date timestamp_ntz, "
                                       "upd_date timestamp_ntz")
    ledger = spark.createDataFrame([(39, 2023, None, None), (39, 2024, None, None)],
                                   "league_id int, season_year int, teams_load_date date, upd_date date")
    out = J.run_teams_venues(spark, root, teams, venues, bridge, ledger, AS_OF)
    assert {r.venue_id: r.action for r in out["venues"].collect()} == {7: "insert"}
    assert {r.team_id: (r.team_name, r.venue_id, r.action) for r in out["teams"].collect()} == \
        {10: ("Ten", 7, "update")}
    assert [(r.team_id, r.action) for r in out["bridge"].collect()] == [(10, "insert")]


def test_run_players_and_player_stats(spark, tmp_path):
    root = str(tmp_path)
    doc = lambda pid, h: {"response": [{"player": {"id": pid, "name": "A B", "firstname": "A", "lastname": "B",  # noqa
                                                   "birth": {"date": "2000-01-01"}, "height": h},
                                        "statistics": [{"team": {"id": 3}, "league": {"id": 39, "season": 2024},
                                                        "games": {"appearences": "5", "lineups": "6"}}]}]}
    _write(root, "players/39/2024_25/summer_20240801_1200/player_details/player_1.json", doc(1, "180 cm"))
    _write(root, "players/39/2024_25/summer_20240701_1200/player_details/player_2.json", doc(2, "180 cm"))
    _write(root, "players/39/2024_25/winter_20250101_1200/player_details/player_3.json", doc(3, "300 cm"))
    files = (SN.list_files(spark, root)
             .withColumn("league_id", F.regexp_extract("file_path", r"players/(\d+)/", 1).cast("int"))
             .withColumn("season_year", F.lit(2024))
             .withColumn("snapshot", F.regexp_extract("file_path", r"/((?:summer|winter)_\d{8}_\d{4})/", 1)))
    players = spark.createDataFrame([], "player_id int, firstname string, lastname string, full_name string, "
                                        "birth_date date, height string, weight string, "
                                        "load_date timestamp_ntz, upd_date timestamp_ntz")
    out = J.run_players(spark, files, players, "summer", AS_OF)
    assert [(r.player_id, r.action) for r in out["players"].collect()] == [(1, "insert")]
    out_w = J.run_players(spark, files, players, "winter", AS_OF)
    assert out_w["players"].count() == 0
    assert out_w["staging"].collect()[0].error_reason == "Unrealistic height; "
    pss = spark.createDataFrame([], "player_id int, team_id int, league_id int, season int, appearances int, "
                                    "lineups int, load_date timestamp_ntz, upd_date timestamp_ntz")
    ps = J.run_player_season_stats(spark, files, pss, "summer", AS_OF)
    assert ps["staging"].collect()[0].error_reason == "lineups > appearances; "


def test_run_leagues(spark, tmp_path):
    root = str(tmp_path)
    entry = {"league": {"id": 39, "name": "Premier League", "logo": "l"}, "country": {"name": "England"},
             "seasons": [{"year": 2023, "start": "2023-08-11", "end": "2024-05-19", "current": False},
                         {"year": 2024, "start": "2024-08-16", "end": "2025-05-25", "current": True}]}
    d = _write(root, "league_directory/2024/leagues.json", {"response": [entry]})
    l1 = _write(root, "leagues/39/2024_25/league.json", {"response": [entry]})
    directory = spark.createDataFrame([], "league_id int, name string, country string, logo string, "
                                          "seasons array<int>, load_date timestamp_ntz, upd_date timestamp_ntz")
    catalog = spark.createDataFrame([(39, 2023, None, True)],
                                    "league_id int, first_season int, last_season int, is_enabled boolean")
    leagues = spark.createDataFrame([], "league_id int, name string, country string, logo string, "
                                        "load_date timestamp_ntz, upd_date timestamp_ntz")
    seasons = spark.createDataFrame([], "league_id int, season_year int, start_date date, end_date date, "
                                        "is_current boolean, season_str string, load_date timestamp_ntz, "
                                        "upd_date timestamp_ntz")
    docs = SN.read_snapshots(spark, [l1], __import__("touchline.schemas", fromlist=["x"]).LEAGUES) \
        .withColumn("league_id", F.lit(39)).withColumn("season_year", F.lit(2024))
    out = J.run_leagues(spark, [d], directory, catalog, leagues, seasons, docs, AS_OF)
    assert out["directory"].collect()[0].seasons == [2023, 2024]
    assert [(r.league_id, r.name) for r in out["leagues"].collect()] == [(39, "Premier League")]
    s = out["seasons"].collect()[0]
    assert (s.season_year, s.is_current, s.season_str) == (2024, True, "2024_25")


def test_run_news(spark, tmp_path):
    root = str(tmp_path)
    item = lambda i, t="T": {"id": i, "webTitle": t, "webPublicationDate": "2024-01-02T03:04:05Z",
                             "webUrl": f"https://x/{i}", "fields": {"trailText": "<b>x</b>"}}
    _write(root, "news/guardian/transfers/run_ts=2024-01-02T00-00-00/response.json",
           {"response": {"results": [item("a"), item("b")]}})
    _write(root, "news/guardian/transfers/run_ts=2024-01-02T00-00-00/_meta.json",
           {"fetched_at_utc": "2024-01-02T05:00:00Z"})
    _write(root, "news/guardian/injuries/run_ts=2024-01-03T00-00-00/response.json",
           {"response": {"results": [item("b", "T2"), item("c", None)]}})
    news = spark.createDataFrame([], "article_id string, tab string, title string, url string, "
                                     "published_at_utc timestamp_ntz, load_date timestamp_ntz, upd_date timestamp_ntz")
    out = J.run_news(spark, root, news, AS_OF)
    got = {r.article_id: (r.tab, r.title) for r in out["news"].collect()}
    # 'b' arrives in two tabs; the later tab in tab order wins. 'c' lacks a title.
    assert got == {"a": ("transfers", "T"), "b": ("injuries", "T2")}
    fetched = {r.article_id: str(r.fetched_at_utc) for r in out["staging"].collect()}
    assert fetched["a"] == "2024-01-02 05:00:00" and fetched["c"] == "2024-01-03 00:00:00"


VENUES_SCHEMA = "venue_id int, venue_name string, city string, country string"


def test_fixture_paths_with_marks_and_rows_without_id(spark, tmp_path):
    root = str(tmp_path / "a b%20ü+c")
    _write(root, "fixtures/39/2024_25/full/full_20240801.json",
           {"response": [_fx(1, 10, 11), _fx(None, 10, 11), _fx(None, 12, 13), _fx(2, 12, 13), _fx(2, 12, 13)]})
    _write(root, "fixtures/39/2024_25/inc/inc_20240805T1200Z.json", "{broken")
    _write(root, "fixtures/39/2024_25/inc/inc_20240806T1200Z.json", "")
    out = J.run_fixtures(spark, root, spark.createDataFrame([], FIXTURES_SCHEMA), _teams(spark, [10, 11, 12, 13]),
                         spark.createDataFrame([], VENUES_SCHEMA), AS_OF)
    assert out["staging"].count() == 5
    assert {(r.fixture_id, r.action) for r in out["fixtures"].collect()} == {(1, "insert")}
    assert {(r.record_key, r.error_reason) for r in out["rejects"].collect()} == {
        ("<NULL>", "missing_fixture_id"), ("2", "dup_fixture_id")}
    assert out["ledger"].collect()[0].all_ok is False


def test_repeated_source_key_is_an_error(spark):
    target = spark.createDataFrame([(1, "a")], "id int, name string")
    source = spark.createDataFrame([(2, "b"), (2, "c")], "id int, name string")
    merged = M.merge_upsert(target, source, ["id"], ["name"], AS_OF, audit=None).merged
    with pytest.raises(Exception, match="repeats a key"):
        merged.collect()
    nulls = spark.createDataFrame([(None, "b"), (None, "c")], "id int, name string")
    assert M.merge_upsert(target, nulls, ["id"], ["name"], AS_OF, audit=None).merged.count() == 3


def test_absent_statistics_are_an_error(spark):
    with pytest.raises(ValueError, match="red_cards"):
        V.check_match_statistics(spark.createDataFrame([(1, 2)], "fixture_id int, team_id int"), [F.col("team_id")])


def test_club_in_two_leagues_is_no_duplicate(spark):
    stg = spark.createDataFrame([(1, "A", 39, 2024), (1, "A", 2, 2024), (3, "B", 39, 2024), (3, "B", 39, 2024)],
                                "team_id int, name string, league_id int, season_year int")
    assert {(r.team_id, r.is_valid) for r in V.check_teams(stg).flagged.collect()} == {(1, True), (3, False)}
