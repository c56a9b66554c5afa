"""Recent-form computation (M07a) — the library's flagship operator.

For every (league, season, team) with finished fixtures: the team's last
``n`` results as a W/D/L string, oldest to newest (or newest first for the
team page). Ties on equal kick-off times are broken by fixture id so the
result is deterministic.

Plan shape: one scan of fixtures (pushed filter on status), ``inline`` to
the long form (two rows per fixture, no second scan), ``WindowGroupLimit``
top-n per team (partial, before the shuffle — a hot team ships <= n rows per
map task), then a bounded ordered aggregate per team.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.scalars import FINISHED, wdl
from touchline.functions.windows import finished_with_scores, long_form, top_n_per_group

FORM_KEYS = ["league_id", "season_year", "team_id"]


def last_n_results(fixtures: DataFrame, n: int = 5, statuses=FINISHED) -> DataFrame:
    """The last ``n`` finished results per team, one row each, with ``form_rank``
    (1 = most recent)."""
    lf = long_form(finished_with_scores(fixtures, statuses).select(
        "fixture_id", "league_id", "season_year", "fixture_date", "status",
        "home_team_id", "away_team_id", "home_score", "away_score"))
    lf = lf.withColumn("result", wdl("goals_for", "goals_against"))
    return top_n_per_group(
        lf, FORM_KEYS, [F.col("fixture_date").desc(), F.col("fixture_id").desc()], n,
        rank_col="form_rank")


def team_form(fixtures: DataFrame, n: int = 5, statuses=FINISHED,
              newest_first: bool = False) -> DataFrame:
    """(league_id, season_year, team_id, form_compact, form_games)."""
    if not 1 <= n <= 20:
        raise ValueError("form window must be within 1..20")
    last = last_n_results(fixtures, n, statuses)
    # form_rank 1 is the newest game: sort by it descending for oldest first.
    order_key = F.col("form_rank") if newest_first else -F.col("form_rank")
    s = F.struct(order_key.alias("k"), F.col("result").alias("r"))
    return last.groupBy(*FORM_KEYS).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(s)), lambda x: x["r"]), "")
        .alias("form_compact"),
        F.count(F.lit(1)).cast("int").alias("form_games"))
