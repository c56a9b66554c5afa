"""JSON documents are made and parsed once a row, whatever filters follow."""

import json

from pyspark.sql import functions as F

from touchline import schemas as SC
from touchline.operators import flatten as FL
from touchline.plans import bound_documents as BD

GOOD = {"response": [{"player": {"id": 7}, "statistics": [
    {"team": {"id": 3}, "league": {"id": 1, "season": 2024}, "games": {"appearences": "6.7"}}, None,
    {"team": {"id": 3}, "league": {"id": 2, "season": 2024}}, {"team": {"id": 0}, "league": {"id": 1, "season": 2024}},
    {"team": {"id": 4}, "league": {"id": 1}, "goals": {"total": " 2 "}}]}]}
TEXTS = [json.dumps(GOOD), json.dumps(GOOD)[:-3], None, "", "{}", '{"response": [{"player": {"id": 0}, "statistics": [{"team": {"id": 1}, "league": {"id": 1, "season": 2}}]}]}',
         '{"response": [{"player": {"id": 8}, "statistics": null}]}', '{"response": [{"player": {"id": 9}}]}']


def _docs(spark, value="value"):
    rows = spark.createDataFrame([(i, 1, 2000, t) for i, t in enumerate(TEXTS)], "k int, league_id int, season_year int, value string")
    return BD._parsed(rows.withColumn("value", F.expr(value)), SC.PLAYER_DOC, F.col("k").cast("string"))


def test_parsed_documents(spark):
    got = {r.k: r for r in _docs(spark).collect()}
    assert [k for k in sorted(got) if got[k].is_valid] == [0, 4, 5, 6, 7] and len(got) == len(TEXTS)
    assert all((got[k].doc is None) == (not got[k].is_valid) for k in got)
    assert got[0].file_path == "0" and got[0].error_reason is None and "value" not in got[0].asDict()


def test_player_stats_rows(spark):
    def rows(strict):
        return sorted((r.player_id, r.team_id, r.league_id, r.season, r.appearances, r.goals, r.stg_order.file_path, r.stg_order.pos)
                      for r in FL.flatten_player_stats(_docs(spark), strict_league=strict).collect())
    own = [(7, 3, 1, 2024, 6, None, "0", 0), (7, 4, 1, 2000, None, 2, "0", 4)]
    assert rows(True) == own
    assert rows(False) == sorted([*own, (7, 3, 2, 2024, None, None, "0", 2)])


def test_filters_do_not_parse_again(spark):
    docs = _docs(spark, "concat(value, ' ')")
    for df in (FL.flatten_player_stats(docs), FL.flatten_players(docs.where("is_valid"))):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert [plan.count(x) for x in ("from_json(", "parseJson(", "concat(value")] == [1, 1, 1]
