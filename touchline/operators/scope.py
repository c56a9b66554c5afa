"""Scope operators (W01–W13): which leagues, seasons, fixtures and files a run
touches.

Control tables (leagues, seasons, catalog, ledger) are small by nature; the
results of these operators are joined to the large side (fixtures, files) —
with a semi join that AQE turns into a broadcast once the scope's real size
is known. Correlated "pick the season" subqueries of the source become one
conditional aggregate per league.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions import scalars as S

c = F.col


def _date(x) -> Column:
    return x if isinstance(x, Column) else F.lit(str(x)).cast("date")


# W01 -----------------------------------------------------------------------------
def league_scope(catalog: DataFrame, ids: Sequence[int] | None = None,
                 include_disabled: bool = True) -> DataFrame:
    """Enabled leagues; with explicit ids, those ids (even disabled ones unless
    ``include_disabled=False``)."""
    if ids is None:
        return catalog.where(c("is_enabled"))
    df = catalog.where(c("league_id").isin(list(ids)))
    return df if include_disabled else df.where(c("is_enabled"))


# W02 / W03 -----------------------------------------------------------------------
def resolve_season(scope: DataFrame, seasons: DataFrame, as_of, forced: int | None = None,
                   open_bounds: bool = False, catalog_fallback: bool = True) -> DataFrame:
    """Per league in scope: forced season, else the current season, else the
    season whose [start, end] contains as_of, else the newest season, else
    (with ``catalog_fallback``) the catalog's last season. With
    ``open_bounds`` a NULL start or end does not bound the range."""
    d = _date(as_of)
    if open_bounds:
        in_range = (c("start_date").isNull() | (c("start_date") <= d)) & (c("end_date").isNull() | (c("end_date") >= d))
    else:
        in_range = (c("start_date") <= d) & (c("end_date") >= d)
    agg = seasons.groupBy("league_id").agg(
        F.max(F.when(c("is_current"), c("season_year"))).alias("__cur"),
        F.max(F.when(in_range, c("season_year"))).alias("__rng"),
        F.max("season_year").alias("__max"))
    j = scope.select("league_id", *(["last_season"] if catalog_fallback else [])).join(agg, "league_id", "left")
    chain = [c("__cur"), c("__rng"), c("__max")] + ([c("last_season")] if catalog_fallback else [])
    if forced is not None:
        chain = [F.lit(forced)] + chain
    return j.select("league_id", F.coalesce(*chain).cast("int").alias("season_year"))


# W04 -----------------------------------------------------------------------------
def in_season(leagues: DataFrame, seasons: DataFrame, catalog: DataFrame, as_of, grace_days: int = 7) -> DataFrame:
    """Enabled leagues with a current season containing as_of (end + grace)."""
    d = _date(as_of)
    s = seasons.where(c("is_current") & (c("start_date") <= d) & (F.date_add(c("end_date"), grace_days) >= d))
    cat = catalog.where(c("is_enabled")).select("league_id", "folder_alias")
    return (s.join(cat, "league_id").join(leagues.select("league_id", "league_name"), "league_id", "left")
            .select("league_id", "season_year", "season_str",
                    F.coalesce(c("folder_alias"), S.folder_alias(c("league_name"), c("league_id"))).alias("alias")))


# W05 -----------------------------------------------------------------------------
def current_worklist(catalog: DataFrame, seasons: DataFrame, leagues: DataFrame) -> DataFrame:
    cat = catalog.where(c("is_enabled")).select("league_id", "folder_alias")
    cur = seasons.where(c("is_current")).select("league_id", "season_year", "season_str")
    return (cat.join(cur, "league_id").join(leagues.select("league_id", "league_name"), "league_id", "left")
            .select("league_id", "season_year", "season_str",
                    F.coalesce(c("folder_alias"), S.folder_alias(c("league_name"), c("league_id"))).alias("alias")))


# W06 -----------------------------------------------------------------------------
def calendar_season(as_of) -> Column:
    d = _date(as_of)
    return F.when(F.month(d) >= 7, F.year(d)).otherwise(F.year(d) - 1)


def window_targets(catalog: DataFrame, seasons: DataFrame, window: str, as_of) -> DataFrame:
    """Leagues whose target-window array contains ``window`` with their
    current season; if there are none, every enabled league with the
    calendar season (July boundary)."""
    enabled = catalog.where(c("is_enabled"))
    cur = seasons.where(c("is_current")).select("league_id", "season_year")
    first = (enabled.where(F.array_contains(c("target_windows"), window))
             .join(cur, "league_id").select("league_id", "season_year"))
    # Fallback only when the first set is empty: semi join on a one-row flag.
    empty = first.agg(F.count(F.lit(1)).alias("n")).where(c("n") == 0).select(F.lit(1).alias("__k"))
    fallback = (enabled.select("league_id", F.lit(1).alias("__k")).join(empty, "__k", "left_semi")
                .select("league_id", calendar_season(as_of).cast("int").alias("season_year")))
    return first.unionByName(fallback)


# W07 -----------------------------------------------------------------------------
def ingest_outcomes(outcomes: DataFrame, as_of, keys: Sequence[str] = ("league_id", "season_year")) -> DataFrame:
    """Per group: done only if every file succeeded; file count; newest load."""
    return outcomes.groupBy(*keys).agg(
        F.bool_and(c("ok")).alias("all_ok"), F.count(F.lit(1)).alias("files"),
        F.count_if(~c("ok")).alias("failed"), F.max("loaded_at").alias("last_load_ts"),
        F.lit(str(as_of)).cast("timestamp_ntz").alias("stamped_at"))


def drop_finished_windows(catalog: DataFrame, finished: DataFrame) -> DataFrame:
    """Remove windows that finished (``finished``: league_id, target_window)
    from each league's target array."""
    done = finished.groupBy("league_id").agg(F.collect_set("target_window").alias("__done"))
    return (catalog.join(done, "league_id", "left")
            .withColumn("target_windows", F.when(c("__done").isNull(), c("target_windows"))
                        .otherwise(F.array_except(c("target_windows"), c("__done"))))
            .drop("__done"))


# W08 -----------------------------------------------------------------------------
def finished_in_lookback(fixtures: DataFrame, as_of, days: int, statuses=("FT",), closed: bool = True) -> DataFrame:
    """``closed``: timestamps in [as_of - days, as_of]; else dates in
    [as_of_date - days, as_of_date + 1)."""
    if closed:
        t = F.lit(str(as_of)).cast("timestamp_ntz")
        lo = t - F.make_dt_interval(F.lit(days))
        cond = (c("fixture_date") >= lo) & (c("fixture_date") <= t)
    else:
        d = F.to_date(F.lit(str(as_of)))
        lo = F.date_sub(d, days).cast("timestamp_ntz")
        hi = F.date_add(d, 1).cast("timestamp_ntz")
        cond = (c("fixture_date") >= lo) & (c("fixture_date") < hi)
    return fixtures.where(cond & c("status").isin(list(statuses)))


# W09 -----------------------------------------------------------------------------
def season_fixtures(fixtures: DataFrame, resolved: DataFrame, statuses: Sequence[str] | None = None) -> DataFrame:
    f = fixtures if statuses is None else fixtures.where(c("status").isin(list(statuses)))
    return f.join(resolved.select("league_id", "season_year"), ["league_id", "season_year"], "left_semi") \
            .withColumn("season_folder", S.season_label(c("season_year")))


# W10 -----------------------------------------------------------------------------
def missing_seasons(seasons: DataFrame, leagues: DataFrame, ledger: DataFrame) -> DataFrame:
    s = seasons.join(ledger.select("league_id", "season_year"), ["league_id", "season_year"], "left_anti")
    return (s.join(leagues.select("league_id", "league_name"), "league_id", "left")
            .select("league_id", "season_year",
                    F.coalesce(c("season_str"), S.season_label(c("season_year"))).alias("season_str"),
                    S.folder_alias(c("league_name"), c("league_id")).alias("alias")))


# W11 -----------------------------------------------------------------------------
def venues_missing_geo(venues: DataFrame, teams: DataFrame, bridge: DataFrame, scope: DataFrame) -> DataFrame:
    """Venues with NULL city or country used by teams of the scoped
    league-seasons; if the bridge has no row in scope, all such venues."""
    missing = venues.where(c("city").isNull() | c("country").isNull())
    scoped_teams = bridge.join(scope.select("league_id", "season_year"), ["league_id", "season_year"], "left_semi")
    used = (scoped_teams.select("team_id").distinct().join(teams.select("team_id", "venue_id"), "team_id")
            .select("venue_id").where(c("venue_id").isNotNull()).distinct())
    scoped = missing.join(used, "venue_id", "left_semi")
    empty = scoped_teams.agg(F.count(F.lit(1)).alias("n")).where(c("n") == 0).select(F.lit(1).alias("__k"))
    global_ = missing.withColumn("__k", F.lit(1)).join(empty, "__k", "left_semi").drop("__k")
    return scoped.unionByName(global_)


# W12 -----------------------------------------------------------------------------
def latest_seasons(ledger: DataFrame, leagues: DataFrame) -> DataFrame:
    mx = ledger.groupBy("league_id").agg(F.max("season_year").alias("season_year"))
    return (mx.join(leagues.select("league_id", "league_name"), "league_id", "left")
            .select("league_id", "season_year", S.slugify(c("league_name")).alias("slug"),
                    S.season_label(c("season_year")).alias("season_str")))


# W13 -----------------------------------------------------------------------------
def expand_seasons(catalog: DataFrame, directory: DataFrame) -> DataFrame:
    """League x year work-list first..last (NULL last -> newest directory season)."""
    j = catalog.where(c("is_enabled")).join(directory.select("league_id", "seasons"), "league_id", "left")
    last = F.coalesce(c("last_season"), F.array_max(c("seasons")))
    return (j.where(last.isNotNull() & (last >= c("first_season")))
            .select("league_id", F.explode(F.sequence(c("first_season"), last)).alias("season_year")))
