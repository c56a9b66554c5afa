"""Jobs on versioned tables: own scope, rejects in the log, untouched seasons alone, a run taken once."""

import json
import os

import pytest
from pyspark.sql import functions as F

from touchline.operators.flatten import FLOAT_STATS, STAT_TYPES
from touchline.plans import jobs as J
from touchline.sources import snapshots as SN
from touchline.sources.versions import VersionedTable

AS_OF = "2024-09-10 00:00:00"
AUDIT = "load_date timestamp_ntz, upd_date timestamp_ntz"


def put(root, rel, payload):
    path = os.path.join(root, rel)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as fh:
        fh.write(payload if isinstance(payload, str) else json.dumps(payload))


def files_of(table):
    return {os.path.join(d, f) for d, _, names in os.walk(table.path) for f in names if f.endswith(".parquet")}


@pytest.fixture
def leagues(spark):
    """League 39 plays 2024, league 40 is disabled."""
    catalog = spark.createDataFrame([(39, "epl_39", "EPL", 2022, None, True, ["summer", "winter"]), (40, "x_40", "X", 2022, None, False, ["summer"])],
                                    "league_id int, folder_alias string, league_name string, first_season int, last_season int, is_enabled boolean, target_windows array<string>")
    seasons = spark.sql("""select * from values (39, 2023, date'2023-08-01', date'2024-05-20', false, '2023_24'), (39, 2024, date'2024-08-01', date'2025-05-20', true, '2024_25'),
        (40, 2024, date'2024-08-01', date'2025-05-20', true, '2024_25') as t(league_id, season_year, start_date, end_date, is_current, season_str)""")
    return J.Leagues(catalog, seasons, spark.createDataFrame([(39, "EPL"), (40, "X")], "league_id int, league_name string"))


@pytest.fixture
def errors(spark, tmp_path):
    return VersionedTable(spark, str(tmp_path / "errors"), "staging_table string, record_key string, error_reason string, created_at timestamp_ntz")


def fx(fid, home, away, gh=1):
    return {"fixture": {"id": fid, "date": "2024-08-10T14:00:00+00:00", "status": {"short": "FT"}, "venue": {"id": 7}},
            "teams": {"home": {"id": home}, "away": {"id": away}}, "league": {"round": "R1"}, "goals": {"home": gh, "away": 0}}


def teams(spark, *ids):
    return spark.createDataFrame([(i, "T") for i in ids], "team_id int, team_name string")


def test_fixtures_leave_other_seasons_alone(spark, tmp_path, errors):
    root = str(tmp_path / "snap")
    table = VersionedTable(spark, str(tmp_path / "t"), "fixture_id int, league_id int, season_year int, home_team_id int, away_team_id int, "
                           f"fixture_date timestamp_ntz, status string, round string, home_score int, away_score int, venue_id int, {AUDIT}", F.col("season_year"))
    venues = spark.createDataFrame([], "venue_id int, venue_name string, city string, country string")
    put(root, "fixtures/39/2023_24/full/full_20230801.json", {"response": [fx(9, 10, 11)]})
    put(root, "fixtures/39/2024_25/full/full_20240801.json", {"response": [fx(1, 10, 11), fx(2, 10, 10)]})
    put(root, "fixtures/39/2024_25/inc/inc_20240805T1200Z.json", "{broken")
    put(root, "fixtures/39/2024_25/inc/inc_20240806T1200Z.json", {"response": []})
    J.run_fixtures(spark, root, table, teams(spark, 10, 11), venues, AS_OF, errors=errors, run="a")
    first = files_of(table)
    put(root, "fixtures/39/2024_25/inc/inc_20240807T1200Z.json", {"response": [fx(1, 10, 11, gh=4)]})
    os.remove(os.path.join(root, "fixtures/39/2023_24/full/full_20230801.json"))
    out = J.run_fixtures(spark, root, table, teams(spark, 10, 11), venues, AS_OF, errors=errors, run="b")
    assert {r.fixture_id: r.home_score for r in table.read().collect()} == {9: 1, 1: 4}
    assert {r.action: r.n for r in out["summary"].collect()} == {"update": 1}
    assert all("part=2024" in f for f in files_of(table) - first if "/data/" in f)
    assert [(r.record_key, r.error_reason) for r in errors.read().collect()] == [("2", "home_eq_away")]
    before = files_of(table)
    J.run_fixtures(spark, root, table, teams(spark, 10, 11), venues, AS_OF, errors=errors, run="b")
    assert files_of(table) == before


def test_standings_events_and_statistics_resolve_their_scope(spark, tmp_path, leagues, errors):
    root = str(tmp_path / "snap")
    row = {"team": {"id": 10}, "rank": 1, "points": 3, "goalsDiff": 2, "group": "",
           "all": {"played": 1, "win": 1, "draw": 0, "lose": 0, "goals": {"for": 2, "against": 0}}}
    event = {"time": {"elapsed": 5, "extra": None}, "team": {"id": 10}, "player": {"id": 9}, "assist": {"id": None}, "type": "Goal", "detail": "Normal Goal", "comments": None}
    stats = lambda t: {"team": {"id": t}, "statistics": [{"type": "Total Shots", "value": 3}]}
    for league, season in ((39, "2024_25"), (39, "2023_24"), (40, "2024_25")):
        put(root, f"standings/{league}/{season}/full_2024-09-01_10-00.json", {"response": [{"league": {"standings": [[row]]}}]})
        fid = league * 10 + int(season[:4]) % 10
        put(root, f"match_events/{league}/{season}/inc/inc_20240801_120000Z/events_{fid}.json",
            {"parameters": {"fixture": str(fid)}, "response": [event, {**event, "time": {"elapsed": 500, "extra": None}}]})
        put(root, f"match_statistics/{league}/{season}/inc/2024-09-01_120000/statistics_{fid}.json", {"response": [stats(10), stats(11)]})
    fixtures = spark.sql("""select * from values (394, 39, 2024, 10, 11, timestamp_ntz'2024-08-10 12:00:00', 'FT', 2, 0), (393, 39, 2023, 10, 11, timestamp_ntz'2023-08-10 12:00:00', 'FT', 2, 0),
        (404, 40, 2024, 10, 11, timestamp_ntz'2024-08-10 12:00:00', 'FT', 2, 0) as t(fixture_id, league_id, season_year, home_team_id, away_team_id, fixture_date, status, home_score, away_score)""")
    standings = VersionedTable(spark, str(tmp_path / "standings"), "league_id int, season_year int, team_id int, group_label string, rank int, points int, played int, win int, draw int, "
                               f"lose int, goals_for int, goals_against int, goals_diff int, form_window short, form_compact string, {AUDIT}", F.col("season_year"), key_partition=True)
    J.run_standings(spark, root, standings, fixtures, teams(spark, 10, 11), leagues, AS_OF, errors=errors, run="r")
    assert [(r.league_id, r.season_year, r.form_compact) for r in standings.read().collect()] == [(39, 2024, "W")]

    events = VersionedTable(spark, str(tmp_path / "events"), "event_id bigint, fixture_id int, minute int, minute_extra int, team_id int, player_id int, assist_player_id int, "
                            f"event_type string, event_detail string, comments string, {AUDIT}", F.floor(F.col("fixture_id") / 5), key_partition=True)
    players = spark.createDataFrame([(9, "A B")], "player_id int, full_name string")
    J.run_match_events(spark, root, events, fixtures, teams(spark, 10, 11), players, leagues, AS_OF, errors=errors, run="r")
    assert [(r.event_id, r.fixture_id) for r in events.read().collect()] == [(1, 394)]
    kept = files_of(events)
    every = leagues.seasons.select("league_id", "season_year")
    J.run_match_events(spark, root, events, fixtures, teams(spark, 10, 11), players, every.where("season_year = 2024 and league_id = 40"), AS_OF, errors=errors, run="s")
    assert sorted((r.event_id, r.fixture_id) for r in events.read().collect()) == [(1, 394), (2, 404)] and kept <= files_of(events)

    cols = ", ".join(f"{x} {'decimal(5,2)' if x in FLOAT_STATS else 'int'}" for x in dict.fromkeys(STAT_TYPES.values()))
    table = VersionedTable(spark, str(tmp_path / "stats"), f"fixture_id int, team_id int, league_id int, season_year int, {cols}, {AUDIT}", F.col("season_year"))
    J.run_match_statistics(spark, root, table, fixtures, leagues, AS_OF, errors=errors, run="r")
    assert sorted((r.fixture_id, r.team_id, r.season_year) for r in table.read().collect()) == [(394, 10, 2024), (394, 11, 2024)]
    logged = {(r.staging_table, r.error_reason) for r in errors.read().collect()}
    assert ("stg_match_events", "Bad minute; ") in logged


def test_teams_fill_places_and_players_close_their_window(spark, tmp_path, leagues, errors):
    root = str(tmp_path / "snap")
    put(root, "teams/39/2024_25/teams.json", {"response": [{"team": {"id": 10, "name": "Ten"}, "venue": {"id": 7, "name": "V7", "city": "C"}},
                                                           {"team": {"id": 11, "name": "Eleven"}, "venue": {"id": 8, "name": "V8"}}]})
    put(root, "venues/39/venues.json", [{"id": 8, "name": "V8", "city": "Town", "country": "Land"}, {"response": [{"id": 99, "city": "Z"}]}])
    ledger = spark.createDataFrame([(39, 2024, None, None)], "league_id int, season_year int, teams_load_date date, upd_date date")
    venue_table = VersionedTable(spark, str(tmp_path / "venues"), f"venue_id int, venue_name string, city string, country string, {AUDIT}")
    team_table = VersionedTable(spark, str(tmp_path / "teams"), f"team_id int, team_name string, team_country string, team_logo_url string, venue_id int, {AUDIT}")
    bridge = VersionedTable(spark, str(tmp_path / "bridge"), f"team_id int, league_id int, season_year int, {AUDIT}", F.col("season_year"), key_partition=True)
    out = J.run_teams_venues(spark, root, team_table, venue_table, bridge, ledger, AS_OF, errors=errors, run="r")
    assert out["filled_count"].first().filled == 1
    assert {r.venue_id: (r.city, r.country) for r in venue_table.read().collect()} == {7: ("C", None), 8: ("Town", "Land")}
    assert sorted(r.team_id for r in team_table.read().collect()) == [10, 11] and bridge.read().count() == 2

    doc = lambda pid, h="180 cm": {"response": [{"player": {"id": pid, "name": "A B", "firstname": "A", "lastname": "B", "birth": {"date": "2000-01-01"}, "height": h},
                                                 "statistics": [{"team": {"id": 3}, "league": {"id": 39, "season": 2024}, "games": {"appearences": "5", "lineups": "4"}}]}]}
    for league in (39, 40):
        put(root, f"players/{league}/2024_25/summer_20240801_1200/player_details/player_{league}.json", doc(league))
    put(root, "players/39/2024_25/summer_20240801_1200/player_details/player_2.json", doc(2, "300 cm"))
    files = (SN.list_files(spark, f"{root}/players").withColumn("league_id", F.regexp_extract("file_path", r"players/(\d+)/", 1).cast("int"))
             .withColumn("season_year", F.lit(2024)).withColumn("snapshot", F.regexp_extract("file_path", r"/((?:summer|winter)_\d{8}_\d{4})/", 1)))
    players = VersionedTable(spark, str(tmp_path / "players"), f"player_id int, firstname string, lastname string, full_name string, birth_date date, height string, weight string, {AUDIT}")
    out = J.run_players(spark, files, players, "summer", AS_OF, scope=leagues, errors=errors, run="r")
    assert [r.player_id for r in players.read().collect()] == [39]                      # league 40 is no target, player 2 is too tall
    assert {r.league_id: r.target_windows for r in out["catalog"].collect()} == {39: ["winter"], 40: ["summer"]}
    pss = VersionedTable(spark, str(tmp_path / "pss"), f"player_id int, team_id int, league_id int, season int, appearances int, lineups int, {AUDIT}", F.col("season"), key_partition=True)
    J.run_player_season_stats(spark, files, pss, "summer", AS_OF, scope=leagues, errors=errors, run="r")
    assert sorted(r.player_id for r in pss.read().collect()) == [2, 39]
    assert any(r.staging_table == "stg_players" and r.error_reason.startswith("Unrealistic height") for r in errors.read().collect())


def test_leagues_enter_the_catalog_and_their_documents_are_counted(spark, tmp_path):
    from touchline import schemas as SC
    root = str(tmp_path)
    entry = {"league": {"id": 39, "name": "Premier League", "logo": "l"}, "country": {"name": "England"},
             "seasons": [{"year": y, "start": f"{y}-08-11", "end": f"{y + 1}-05-19", "current": y == 2024} for y in (2022, 2023, 2024)]}
    put(root, "dir/leagues.json", {"response": [entry]})
    put(root, "leagues/39/2024_25/league.json", {"response": [entry]})
    put(root, "leagues/39/2023_24/league.json", {"response": []})
    empty = lambda ddl: spark.createDataFrame([], f"{ddl}, {AUDIT}")
    catalog = empty("league_id int, folder_alias string, league_name string, first_season int, last_season int, is_enabled boolean")
    requested = spark.createDataFrame([(39, "Premier League", 2022, 2024)], "league_id int, league_name string, first_season int, last_season int")
    docs = SN.read_snapshots(spark, SN.list_files(spark, f"{root}/leagues"), SC.LEAGUES).withColumn("league_id", F.lit(39)) \
        .withColumn("season_year", F.regexp_extract("file_path", r"/(\d{4})_\d{2}/", 1).cast("int"))
    out = J.run_leagues(spark, [f"{root}/dir/leagues.json"], empty("league_id int, name string, country string, logo string, seasons array<int>"), catalog,
                        empty("league_id int, name string, country string, logo string"),
                        empty("league_id int, season_year int, start_date date, end_date date, is_current boolean, season_str string"), docs, AS_OF, requested=requested)
    assert [(r.folder_alias, r.action) for r in out["catalog"].collect()] == [("premier_league_39", "insert")]
    assert sorted(r.season_year for r in out["worklist"].collect()) == [2022, 2023, 2024]
    r = out["document_counts"].collect()[0]
    assert (r.expected, r.missing, r.empty, r.loaded) == (3, 1, 1, 1)
    assert [(s.season_year, s.is_current) for s in out["seasons"].collect()] == [(2024, True)]
