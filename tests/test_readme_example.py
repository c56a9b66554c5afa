"""The README's usage example, run on local folders."""

import json
import os

from touchline.operators import serve
from touchline.plans import jobs
from touchline.sources.sinks import write_version


def _write(root, rel, payload):
    path = os.path.join(root, rel)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as fh:
        json.dump(payload, fh)


def test_readme_example(spark, tmp_path):
    snap, tables = str(tmp_path / "snapshots"), str(tmp_path / "tables")
    fx = {"fixture": {"id": 1, "date": "2025-01-04T15:00:00+00:00", "status": {"short": "FT"}, "venue": {"id": 7}},
          "teams": {"home": {"id": 10}, "away": {"id": 11}}, "league": {"round": "R20"},
          "goals": {"home": 2, "away": 1}}
    _write(snap, "fixtures/39/2024_25/full/full_20250101.json", {"response": [fx]})
    fixtures = spark.createDataFrame([], "fixture_id int, league_id int, season_year int, home_team_id int, "
                                         "away_team_id int, fixture_date timestamp_ntz, status string, round string, "
                                         "home_score int, away_score int, venue_id int, load_date timestamp_ntz, "
                                         "upd_date timestamp_ntz")
    teams = spark.createDataFrame([(10, "Ten"), (11, "Eleven")], "team_id int, team_name string")
    venues = spark.createDataFrame([(7, "V", "C", "X")], "venue_id int, venue_name string, city string, country string")

    out = jobs.run_fixtures(spark, snap, fixtures, teams, venues, as_of="2025-01-06 00:00:00", mode="baseline")
    assert {r.action: r.n for r in out["summary"].collect()} == {"insert": 1}
    path = write_version(out["fixtures"].drop("action"), f"{tables}/fixtures")
    assert spark.read.parquet(path).count() == 1
    out["rejects"].write.mode("append").parquet(f"{tables}/data_load_errors")

    standings = spark.createDataFrame(
        [(39, 2024, 10, "", 1, 3, 1, 1, 0, 0, 2, 1, 1, "W", None), (39, 2024, 11, "", 2, 0, 1, 0, 0, 1, 1, 2, -1, "L", None)],
        "league_id int, season_year int, team_id int, group_label string, rank int, points int, played int, win int, "
        "draw int, lose int, goals_for int, goals_against int, goals_diff int, form_compact string, "
        "upd_date timestamp_ntz")
    table = serve.league_standings(standings, teams)
    rows = table.where("league_id = 39 and season_year = 2024").orderBy("display_rank").collect()
    assert [(r.team_name, r.form) for r in rows] == [("Ten", ["W"]), ("Eleven", ["L"])]
