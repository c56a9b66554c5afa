"""Window idioms shared by many operators.

* ``latest_by``      — one row per key (replaces DISTINCT ON / keep-newest).
* ``top_n_per_group`` — first n rows per key under a total order.
* ``long_form``      — one row per (fixture, side): the team's view of a match.

``row_number() <= n`` filters are planned by Spark as ``WindowGroupLimit``:
a partial top-n runs on every map task *before* the shuffle, so a hot key
(one team or league holding a third of all rows) ships at most n rows per
map partition instead of all of its rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.scalars import FINISHED


def _cols(keys) -> list[Column]:
    return [F.col(k) if isinstance(k, str) else k for k in keys]


def top_n_per_group(df: DataFrame, keys: Sequence, order: Sequence[Column], n: int,
                    rank_col: str | None = None) -> DataFrame:
    """Keep the first ``n`` rows per ``keys`` under ``order`` (must be total)."""
    w = Window.partitionBy(*_cols(keys)).orderBy(*order)
    name = rank_col or "__rn"
    out = df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)
    return out if rank_col else out.drop(name)


def latest_by(df: DataFrame, keys: Sequence, order: Sequence[Column]) -> DataFrame:
    """One row per key: the first under ``order`` (e.g. newest load first)."""
    return top_n_per_group(df, keys, order, 1)


def newest(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """All rows of each key's greatest ``value`` (ties kept; rows that lack a key or the value go):
    one scan and one shuffle, of the rows that a map task's own ``rank() <= 1`` leaves."""
    known = df.dropna(subset=[*keys, value])
    place = F.rank().over(Window.partitionBy(*keys).orderBy(F.col(value).desc()))
    return known.withColumn("__place", place).filter(F.col("__place") <= 1).drop("__place")


def long_form(fixtures: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Each fixture twice, once from each side.

    Output: fixture_id, league_id, season_year, fixture_date, status,
    team_id, opponent_id, is_home, goals_for, goals_against, *extra.
    Built with ``inline(array(home, away))`` so the fixtures are scanned once
    (a union of two projections would scan them twice).
    """
    def side(team, opp, is_home, gf, ga):
        return F.struct(F.col(team).alias("team_id"), F.col(opp).alias("opponent_id"),
                        F.lit(is_home).alias("is_home"), F.col(gf).alias("goals_for"),
                        F.col(ga).alias("goals_against"))

    base = ["fixture_id", "league_id", "season_year", "fixture_date", "status", *extra]
    return fixtures.select(
        *base,
        F.inline(F.array(side("home_team_id", "away_team_id", True, "home_score", "away_score"),
                         side("away_team_id", "home_team_id", False, "away_score", "home_score"))))


def finished_with_scores(fixtures: DataFrame, statuses=FINISHED) -> DataFrame:
    return fixtures.filter(F.col("status").isin(list(statuses))
                           & F.col("home_score").isNotNull() & F.col("away_score").isNotNull())
