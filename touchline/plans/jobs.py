"""Composite jobs (J01–J09): scope -> snapshot files -> staging -> validation -> merge -> log.

Each job is one Spark lineage from the file scan to the merged table; the
returned dict holds DataFrames (new table versions, staging, rejects,
summaries). A target is a DataFrame, and the caller writes the result
(``sinks.write_version``), or a ``VersionedTable``: then the job reads and
rewrites only the partitions its valid rows touch and commits them, as
the run ``run`` if given, which a table takes once. ``errors``, a
``VersionedTable`` of the error log, takes the job's rejects.

The scope (which leagues and seasons) is a DataFrame, or the ``Leagues``
tables, from which each job resolves its own scope as the source's does.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline import schemas as SC
from touchline.functions.joins import bounded_broadcast
from touchline.operators import flatten as FL
from touchline.operators import merge as M
from touchline.operators import scope as W
from touchline.operators import validate as V
from touchline.sources import sinks as K
from touchline.sources import snapshots as SN
from touchline.sources.versions import VersionedTable

c = F.col
SEASON = ["league_id", "season_year"]


@dataclass
class Leagues:
    """The tables a job's scope is resolved from."""
    catalog: DataFrame
    seasons: DataFrame
    leagues: DataFrame | None = None


def _scope_cols(files: DataFrame, league_map: DataFrame | None) -> DataFrame:
    """league folder + season folder (YYYY_YY) from the path -> league_id, season_year."""
    f = files.withColumn("season_folder", F.regexp_extract(c("file_path"), r"/(\d{4}_\d{2})/", 1)) \
             .withColumn("season_year", F.regexp_extract(c("season_folder"), r"^(\d{4})", 1).try_cast("int"))
    if league_map is not None:
        f = f.withColumn("league_folder", F.regexp_extract(c("file_path"), r"/([^/]+)/\d{4}_\d{2}/", 1)) \
             .join(league_map.select(c("folder_alias").alias("league_folder"), "league_id"), "league_folder", "left")
    else:
        f = f.withColumn("league_id", F.regexp_extract(c("file_path"), r"/(\d+)/\d{4}_\d{2}/", 1).try_cast("int"))
    return f


def _in_scope(files: DataFrame, scope: DataFrame) -> DataFrame:
    return files.join(bounded_broadcast(scope.select(*SEASON).distinct()), SEASON, "left_semi")


def work_dir(spark: SparkSession, job: str) -> str:
    """A fresh folder for this run's intermediate tables, below the cluster's
    shared ``spark.checkpoint.dir`` (set to a scratch folder only when unset,
    as in local tests)."""
    from touchline.session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/touchline-{job}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, path: str | None) -> DataFrame:
    """Write the rows as a table and continue from the written table.
    JSON parsing then runs once, the validation branches (FK, duplicate
    groups) re-scan only pruned Parquet columns, and the lineage is cut — a
    lost executor recomputes from the staging table, not from the snapshots."""
    if path is None:
        return df
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


def _docs(spark, files: DataFrame, schema, on_bad="skip") -> DataFrame:
    docs = SN.read_snapshots(spark, files, schema, on_bad=on_bad)
    extra = [x for x in files.columns if x not in ("file_path", "modified", "size")]
    return docs.join(files.select("file_path", *extra), "file_path")


def _path(spark: SparkSession, staging_path: str | None, table: str) -> str | None:
    """A folder of this run's own for each staging table."""
    if staging_path == "auto":
        return f"{work_dir(spark, table)}/{table}"
    return None if staging_path is None else f"{staging_path.rstrip('/')}/{uuid.uuid4().hex[:12]}/{table}"


def _apply(target, rows: DataFrame, keys, merge: Callable[[DataFrame], M.MergeResult], as_of, run: str | None) -> M.MergeResult:
    """``merge`` on the whole target, or on the partitions that ``rows`` touch of a versioned table, committed."""
    if not isinstance(target, VersionedTable):
        return merge(target)
    done = target.upsert(rows, keys, merge, as_of, run)
    # a run that the table holds already: its rows as they are now
    return done or M.MergeResult(target.read().withColumn("action", F.lit(M.UNCHANGED)), list(keys))


def _rows(target) -> DataFrame:
    return target.read() if isinstance(target, VersionedTable) else target


def _log(errors: VersionedTable | None, job: str, rejects: DataFrame, as_of, run: str | None, dedupe: bool = False) -> DataFrame:
    """The rejects go to the error log, if there is one; each job of a run logs once."""
    if errors is not None:
        errors.append(K.append_errors(errors.read() if dedupe else None, rejects, as_of, dedupe), as_of, run and f"{run}/{job}")
    return rejects


# J01 -----------------------------------------------------------------------------
def last_file_wins(stg: DataFrame) -> DataFrame:
    """A later file overrides the rows of a fixture in earlier ones. Rows without an id, and rows a
    file repeats, stay for the rules; the former are each a group of their own, so they meet in no task."""
    alone = F.when(c("fixture_id").isNull(), F.xxhash64("stg_order"))
    last = F.max("stg_order.file_path").over(Window.partitionBy("fixture_id", alone))
    return stg.withColumn("__last", last).where(c("stg_order.file_path") == c("__last")).drop("__last")


def run_fixtures(spark: SparkSession, root: str, fixtures, teams: DataFrame, venues: DataFrame,
                 as_of, mode: str = "baseline", league_map: DataFrame | None = None,
                 staging_path: str | None = "auto", errors: VersionedTable | None = None, run: str | None = None) -> dict:
    files = _scope_cols(SN.list_files(spark, f"{root.rstrip('/')}/fixtures"), league_map)
    chosen, missing_base = SN.baseline_plus_inc(files, SEASON, mode)
    lacking = missing_base.limit(5).collect()
    if lacking:
        raise ValueError(f"no baseline snapshot for some leagues' seasons, such as {[tuple(r) for r in lacking]}")
    # every document is parsed here, once: rows and ledger come from the stored table
    docs = stage(_docs(spark, chosen, SC.FIXTURES, on_bad="error_row"), _path(spark, staging_path, "docs_fixtures"))
    stg = stage(last_file_wins(FL.flatten_fixtures(docs)), _path(spark, staging_path, "stg_fixtures"))
    v = V.check_fixtures(stg, teams, stage_sides=True)
    _log(errors, "fixtures", v.rejects, as_of, run, dedupe=True)
    new_venues = M.placeholders(v.flagged.where("is_valid"), venues, "venue_id", M.VENUE_PLACEHOLDER)
    res = _apply(fixtures, v.flagged.where("is_valid"), ["fixture_id"],
                 lambda target: M.merge_fixtures(target, v.flagged, venues, as_of)[0], as_of, run)
    outcomes = docs.select(*SEASON, c("is_valid").alias("ok"), F.lit(str(as_of)).cast("timestamp_ntz").alias("loaded_at"))
    return {"staging": v.flagged, "rejects": v.rejects, "fixtures": res.merged, "summary": res.summary,
            "placeholder_venues": new_venues, "missing_baseline": missing_base, "ledger": W.ingest_outcomes(outcomes, as_of)}


# J02 -----------------------------------------------------------------------------
def run_standings(spark: SparkSession, root: str, standings, fixtures: DataFrame, teams: DataFrame,
                  scope: DataFrame | Leagues, as_of, n: int = 5, league_map: DataFrame | None = None,
                  staging_path: str | None = "auto", errors: VersionedTable | None = None, run: str | None = None) -> dict:
    """Scope from ``Leagues``: seasons that run at ``as_of``, with a week's grace."""
    if isinstance(scope, Leagues):
        scope = W.in_season(scope.leagues, scope.seasons, scope.catalog, as_of)
    files = _in_scope(_scope_cols(SN.list_files(spark, f"{root.rstrip('/')}/standings"), league_map), scope)
    chosen = SN.latest_file(files, SEASON)
    stg = stage(FL.flatten_standings(_docs(spark, chosen, SC.STANDINGS)), _path(spark, staging_path, "stg_standings"))
    v = V.check_standings(stg, teams, order=[c("stg_order")], stage_sides=True)
    _log(errors, "standings", v.rejects, as_of, run)
    counts = []

    def merge(target):
        res, n_of = M.merge_standings(target, v.flagged, fixtures, as_of, n)
        counts.append(n_of)
        return res

    res = _apply(standings, v.flagged.where("is_valid"), M.STANDING_KEY, merge, as_of, run)
    return {"staging": v.flagged, "rejects": v.rejects, "standings": res.merged, "summary": res.summary,
            "counts": counts[0] if counts else None}


# J03 -----------------------------------------------------------------------------
def run_match_events(spark: SparkSession, root: str, events, fixtures: DataFrame, teams: DataFrame,
                     players: DataFrame, scope: DataFrame | Leagues, as_of, league_map: DataFrame | None = None,
                     staging_path: str | None = "auto", mode: str | None = None,
                     errors: VersionedTable | None = None, run: str | None = None) -> dict:
    """``mode``: run folders of this mode only (``full``, ``incremental``); None takes the newest of each.
    Scope from ``Leagues``: the enabled leagues' season at ``as_of`` (W01, W02)."""
    if isinstance(scope, Leagues):
        scope = W.resolve_season(W.league_scope(scope.catalog), scope.seasons, as_of)
    files = _in_scope(_scope_cols(SN.list_files(spark, f"{root.rstrip('/')}/match_events"), league_map), scope)
    files = files.withColumn("mode", F.regexp_extract(c("file_path"), r"/([a-z]+)/[a-z]+_\d{8}_\d{6}Z/", 1))
    if mode:
        files = files.where(c("mode") == mode)
    chosen = SN.latest_run(files, [*SEASON, "mode"], SN.RUN_STAMP_EVENTS, "yyyyMMdd_HHmmss", 2)
    stg = stage(FL.flatten_events(_docs(spark, chosen, SC.EVENTS)), _path(spark, staging_path, "stg_match_events"))
    v = V.check_match_events(stg, fixtures, teams, order=[c("stg_order")], id_col=c("stg_order").cast("string"))
    _log(errors, "match_events", v.rejects, as_of, run)
    valid = M.event_keys(v.flagged.where("is_valid"))
    new_players = M.placeholders(valid.select("player_id").unionByName(valid.select(c("assist_player_id").alias("player_id"))),
                                 players, "player_id", M.PLAYER_PLACEHOLDER)
    first_id = 1 + (_rows(events).agg(F.max("event_id")).first()[0] or 0)
    res = _apply(events, valid, ["fixture_id"], lambda target: M.merge_match_events(
        target, v.flagged, players, as_of, order=[c("stg_order")], first_id=first_id)[0], as_of, run)
    return {"staging": v.flagged, "rule_counts": v.rule_counts, "rejects": v.rejects, "events": res.merged, "summary": res.summary,
            "placeholder_players": new_players}


# J04 -----------------------------------------------------------------------------
def run_match_statistics(spark: SparkSession, root: str, stats, fixtures: DataFrame, scope: DataFrame | Leagues,
                         as_of, league_map: DataFrame | None = None, staging_path: str | None = "auto",
                         errors: VersionedTable | None = None, run: str | None = None) -> dict:
    """Scope from ``Leagues``: the season at ``as_of``, open bounds, no fallback to the catalog."""
    if isinstance(scope, Leagues):
        scope = W.resolve_season(W.league_scope(scope.catalog), scope.seasons, as_of, open_bounds=True, catalog_fallback=False)
    files = _in_scope(_scope_cols(SN.list_files(spark, f"{root.rstrip('/')}/match_statistics"), league_map), scope)
    chosen = SN.latest_run(files, SEASON, SN.RUN_STAMP_STATS, "yyyy-MM-dd_HHmmss")
    stg = stage(FL.pivot_statistics(_docs(spark, chosen, SC.STATISTICS, on_bad="error_row")),
                _path(spark, staging_path, "stg_match_statistics"))
    base = stg.withColumnRenamed("is_valid", "__pv").withColumnRenamed("error_reason", "__pr")
    v = V.check_match_statistics(base, latest_order=[c("stg_order")], stage_sides=True)
    flagged = (v.flagged.withColumn("is_valid", c("is_valid") & c("__pv"))
               .withColumn("error_reason", F.coalesce(c("__pr"), c("error_reason"))).drop("__pv", "__pr"))
    key = F.concat_ws("-", F.coalesce(c("fixture_id"), F.lit(-1)), F.coalesce(c("team_id"), F.lit(-1)))
    rejects = _log(errors, "match_statistics", V.rejects(flagged, "stg_match_statistics", key), as_of, run)
    season = fixtures.select("fixture_id", *SEASON)
    touched = flagged.where("is_valid and team_id is not null").select("fixture_id", "team_id").join(season, "fixture_id")
    res = _apply(stats, touched, ["fixture_id", "team_id"], lambda target: M.merge_match_statistics(target, flagged, fixtures, as_of), as_of, run)
    return {"staging": flagged, "rejects": rejects, "coverage": V.statistics_coverage(flagged, fixtures),
            "dq": V.saves_exceed_opponent_shots(flagged), "statistics": res.merged, "summary": res.summary}


# J05 -----------------------------------------------------------------------------
def run_teams_venues(spark: SparkSession, root: str, teams, venues, bridge, ledger: DataFrame, as_of,
                     league_map: DataFrame | None = None, errors: VersionedTable | None = None, run: str | None = None) -> dict:
    """Changed team documents (S08), venues before teams, so that the venue key holds; then the places that
    ``venues/**/venues.json`` has for venues in scope without city or country (W11, S10, M15)."""
    changed = SN.changed_blobs(ledger)
    files = _in_scope(_scope_cols(SN.list_files(spark, f"{root.rstrip('/')}/teams", "teams.json"), league_map), changed)
    docs = stage(_docs(spark, files, SC.TEAMS), _path(spark, "auto", "docs_teams"))
    vv = V.check_venues(FL.flatten_venues(docs))
    stg_venues = vv.flagged.withColumnRenamed("name", "venue_name")
    venues_res = _apply(venues, stg_venues.where("is_valid"), ["venue_id"], lambda t: M.merge_venues(t, stg_venues, as_of), as_of, run)
    now = _rows(venues) if isinstance(venues, VersionedTable) else venues_res.new_target
    vt = V.check_teams(FL.flatten_teams(docs).withColumn("name", c("team_name")), now)
    _log(errors, "teams_venues", vv.rejects.unionByName(vt.rejects), as_of, run)
    teams_res = _apply(teams, vt.flagged.where("is_valid"), ["team_id"], lambda t: M.merge_teams(t, vt.flagged, as_of), as_of, run)
    pairs = FL.team_bridge(vt.flagged.where(c("is_valid")))
    bridge_res = _apply(bridge, pairs, ["team_id", *SEASON], lambda t: M.merge_team_bridge(t, pairs, as_of), as_of, run)
    out = {"venues": venues_res.merged, "teams": teams_res.merged, "bridge": bridge_res.merged,
           "team_rejects": vt.rejects, "venue_rejects": vv.rejects}

    all_teams = _rows(teams) if isinstance(teams, VersionedTable) else teams_res.new_target
    all_pairs = _rows(bridge) if isinstance(bridge, VersionedTable) else bridge_res.new_target
    lacking = W.venues_missing_geo(now, all_teams, all_pairs, changed)
    fill_files = SN.list_files(spark, root, "venues.json")
    fills = SN.read_venue_fills(spark, fill_files).join(lacking.select("venue_id"), "venue_id", "left_semi")
    filled, n = M.fill_venue_geo(now, fills, as_of)
    if isinstance(venues, VersionedTable):
        rows = filled.join(fills.select("venue_id"), "venue_id", "left_semi")
        cols = ["venue_name", "city", "country"]
        venues.upsert(rows, ["venue_id"], lambda t: M.merge_upsert(t, rows.select("venue_id", *cols), ["venue_id"], cols, as_of, unique_source=True),
                      as_of, f"{run}/fills" if run else None)
    return out | {"venues_filled": filled, "filled_count": n}


# J06 / J07 -----------------------------------------------------------------------
def run_players(spark: SparkSession, files: DataFrame, players, window: str, as_of, scope: Leagues | None = None,
                since: str | None = None, errors: VersionedTable | None = None, run: str | None = None) -> dict:
    """``files``: listing with league_id, season_year and ``snapshot`` label. With ``scope`` only the window's
    targets (W06) are read, and the catalog without the windows whose documents were all readable comes back (W07)."""
    targets = None
    if scope is not None:
        targets = W.window_targets(scope.catalog, scope.seasons, window, as_of)
        files = _in_scope(files, targets)
    chosen = SN.latest_window(files, SEASON, window)
    docs = stage(_docs(spark, chosen, SC.PLAYER_DOC, on_bad="error_row"), _path(spark, "auto", "docs_players"))
    stg = FL.flatten_players(docs.where("is_valid"))
    v = V.check_players(stg, str(as_of)[:10], stg_id="stg_order", since=since)
    _log(errors, "players", v.rejects, as_of, run)
    cols = ["firstname", "lastname", "full_name", "birth_date", "height", "weight"]
    cols += [x for x in ("birth_country", "nationality", "photo_url") if x in _rows(players).columns]
    # the last staging row of a player wins
    res = _apply(players, v.flagged.where("is_valid"), ["player_id"],
                 lambda t: M.merge_players(t, v.flagged, as_of, cols, stg_id="stg_order"), as_of, run)
    out = {"staging": v.flagged, "rejects": v.rejects, "players": res.merged, "summary": res.summary}
    if scope is not None:
        ledger = W.ingest_outcomes(docs.select(*SEASON, c("is_valid").alias("ok"),
                                               F.lit(str(as_of)).cast("timestamp_ntz").alias("loaded_at")), as_of)
        done = ledger.where("all_ok").select("league_id", F.lit(window).alias("target_window")).distinct()
        out |= {"ledger": ledger, "catalog": W.drop_finished_windows(scope.catalog, done)}
    return out


def run_player_season_stats(spark: SparkSession, files: DataFrame, pss, window: str, as_of, scope: Leagues | None = None,
                            errors: VersionedTable | None = None, run: str | None = None) -> dict:
    """With ``scope`` only enabled leagues' current seasons."""
    if scope is not None:
        files = _in_scope(files, W.current_worklist(scope.catalog, scope.seasons, scope.leagues))
    chosen = SN.latest_window(files, SEASON, window)
    stg = stage(FL.flatten_player_stats(_docs(spark, chosen, SC.PLAYER_DOC)), _path(spark, "auto", "stg_player_season_stats"))
    v = V.check_player_season_stats(stg.withColumn("stg_stats_id", c("stg_order").cast("string")))
    _log(errors, "player_season_stats", v.rejects, as_of, run)
    res = _apply(pss, v.flagged.where("is_valid"), M.PSS_KEY,
                 lambda t: M.merge_player_season_stats(t, v.flagged, as_of, order=[c("stg_order")]), as_of, run)
    return {"staging": v.flagged, "rejects": v.rejects, "player_season_stats": res.merged, "summary": res.summary}


# J08 -----------------------------------------------------------------------------
def run_leagues(spark: SparkSession, directory_files, directory, catalog, leagues, seasons, league_docs: DataFrame, as_of,
                requested: DataFrame | None = None, run: str | None = None) -> dict:
    """``requested`` leagues enter the catalog first (M16); the work-list is the catalog's years (W13), and
    ``document_counts`` says for each league how many of its years' documents are missing or empty (F11)."""
    d = FL.flatten_directory(SN.read_snapshots(spark, directory_files, SC.LEAGUES))
    dir_res = _apply(directory, d, ["league_id"], lambda t: M.merge_league_directory(t, d, as_of), as_of, run)
    out = {"directory": dir_res.merged}
    now = _rows(catalog)
    if requested is not None:
        cat_res = _apply(catalog, requested, ["league_id"], lambda t: M.merge_catalog(t, requested, as_of), as_of, run)
        out["catalog"], now = cat_res.merged, (_rows(catalog) if isinstance(catalog, VersionedTable) else cat_res.new_target)
    known = _rows(directory) if isinstance(directory, VersionedTable) else dir_res.new_target
    worklist = W.expand_seasons(now, known)
    l_rows, s_rows = FL.flatten_leagues(league_docs, now)
    return out | {
        "worklist": worklist, "document_counts": FL.league_document_counts(league_docs, worklist),
        "leagues": _apply(leagues, l_rows, ["league_id"], lambda t: M.merge_leagues(t, l_rows, as_of), as_of, run).merged,
        "seasons": _apply(seasons, s_rows, SEASON, lambda t: M.merge_league_seasons(t, s_rows, as_of), as_of, run).merged}


# J09 -----------------------------------------------------------------------------
def run_news(spark: SparkSession, root: str, news, as_of, tab_order=("transfers", "injuries", "matchreports"),
             errors: VersionedTable | None = None, run: str | None = None) -> dict:
    from touchline.functions.scalars import run_ts_to_timestamp
    files = SN.list_files(spark, f"{root.rstrip('/')}/news")
    batches = SN.latest_batch(files)
    resp = SN.read_snapshots(spark, batches.select(c("response_path").alias("file_path")), SC.NEWS)
    # _meta.json sidecars are skipped by Spark's file sources: read them in tasks.
    meta = SN.read_small_files(batches.select(c("meta_path")), "meta_path").select(
        "meta_path", F.from_json(c("text"), SC.NEWS_META)["fetched_at_utc"].alias("meta_fetched"))
    b = batches.join(meta, "meta_path", "left").withColumn(
        "fetched_at_utc", F.coalesce(F.try_to_timestamp(c("meta_fetched")).cast("timestamp_ntz"),
                                     run_ts_to_timestamp(c("run_ts")).cast("timestamp_ntz")))
    docs = resp.join(b.select(c("response_path").alias("file_path"), c("tab_dir").alias("tab"), "fetched_at_utc"),
                     "file_path")
    stg = stage(FL.flatten_news(docs), _path(spark, "auto", "stg_news"))
    v = V.check_news(stg)
    _log(errors, "news", v.rejects, as_of, run)
    cols = [x for x in _rows(news).columns if x not in ("article_id", "load_date", "upd_date")]
    rows = v.flagged.select("article_id", "tab", *[x for x in cols if x != "tab"], "is_valid")
    res = _apply(news, rows.where("is_valid"), ["article_id"], lambda t: M.merge_news(t, rows, as_of, list(tab_order)), as_of, run)
    from touchline.operators.serve import latest_n_per_group
    now = news.read() if isinstance(news, VersionedTable) else res.new_target
    latest50 = latest_n_per_group(now, "tab", [c("published_at_utc").desc(), c("article_id").desc()], 50)
    return {"staging": v.flagged, "rejects": v.rejects, "news": res.merged, "latest50": latest50}
