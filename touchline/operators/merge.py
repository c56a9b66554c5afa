"""Keyed upserts (M00) and the merge units M01–M16.

``merge_upsert`` replaces ``INSERT ... ON CONFLICT DO UPDATE [WHERE ...]``:
a full outer join of target and source on the key, then one projection that
picks each column's new value. The result carries an ``action`` column
(insert / update / unchanged) from which the change list and the counts
(the source's ``xmax = 0`` trick) follow without a second pass over the data.

Scale notes: both sides shuffle on the key once; the source is de-duplicated
per key first (``latest_by``), as ``ON CONFLICT`` requires. A writer can use
``changes`` to rewrite only touched partitions (e.g. one season).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.numbering import numbered
from touchline.functions.windows import latest_by

INSERT, UPDATE, UNCHANGED = "insert", "update", "unchanged"
c = F.col


@dataclass
class MergeResult:
    merged: DataFrame            # new target + action
    keys: list[str]
    counts: dict | None = None   # rows by action, when a write of ``merged`` has counted them

    @property
    def new_target(self) -> DataFrame:
        return self.merged.drop("action")

    @property
    def changes(self) -> DataFrame:
        return self.merged.where(c("action") != UNCHANGED).select(*self.keys, "action")

    @property
    def summary(self) -> DataFrame:
        if self.counts is not None:
            rows = [(a, self.counts[a]) for a in (INSERT, UPDATE, UNCHANGED) if self.counts[a]]
            return self.merged.sparkSession.createDataFrame(rows, "action string, n long")
        return self.merged.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def ts(value) -> Column:
    """as_of literal as timestamp_ntz (timestamps stay zone-less end to end)."""
    return value if isinstance(value, Column) else F.lit(str(value)).cast("timestamp_ntz")


def _t(x):
    return c(f"t__{x}")


def _s(x):
    return c(f"s__{x}")


def merge_upsert(target: DataFrame, source: DataFrame, keys: Sequence[str],
                 update_cols: Sequence[str], as_of,
                 when: str | Callable = "distinct", compare_cols: Sequence[str] | None = None,
                 update_exprs: dict[str, Callable] | None = None,
                 insert_defaults: dict[str, Column] | None = None,
                 audit: tuple[str, str] | None = ("load_date", "upd_date"),
                 partition_cols: Sequence[str] | None = None, unique_source: bool = False) -> MergeResult:
    """Upsert ``source`` into ``target`` on ``keys``.

    * ``when="distinct"`` — update only if any of ``compare_cols`` (default
      ``update_cols``) is distinct (NULL-safe, ``IS DISTINCT FROM``);
      ``when="always"`` — every matched row is updated; or a callable
      ``(t, s) -> Column`` with ``t(name)`` / ``s(name)`` column accessors.
    * ``update_exprs[name] = (t, s) -> Column`` overrides the updated value.
    * ``insert_defaults`` fills target columns the source does not have.
    * ``audit`` = (load_date, upd_date) column names stamped with ``as_of``.
    * A key that ``source`` holds twice is an error when the result is computed
      (as ``ON CONFLICT`` raises); keys with a NULL never conflict. The count
      shares the join's shuffle; ``unique_source`` leaves it out, for a caller
      that has just ranked ``source`` to one row a key.
    * ``partition_cols`` (a subset of ``keys``, e.g. season_year): only target
      partitions the source touches take part, and the result holds only
      those partitions — write it with dynamic partition overwrite
      (``write_touched_partitions``) so untouched partitions are never
      rewritten. The touched-partition list is a distinct aggregate of the
      source (few rows); the semi join becomes a broadcast once AQE sees it.
    """
    keys = list(keys)
    if partition_cols:
        if not set(partition_cols) <= set(keys):
            raise ValueError("partition columns must be part of the merge key")
        touched = source.select(*partition_cols).distinct()
        target = target.join(touched, list(partition_cols), "left_semi")
    stamp = ts(as_of)
    audit_cols = [a for a in (audit or ()) if a]
    tcols = [x for x in target.columns if x not in keys]
    scols = [x for x in source.columns if x not in keys]
    t = target.select(*keys, *[c(x).alias(f"t__{x}") for x in tcols], F.lit(True).alias("__in_t"))
    in_source = F.lit(True)
    if not unique_source:
        repeated = F.count(F.lit(1)).over(Window.partitionBy(*keys)) > 1
        for k in keys:
            repeated = repeated & c(k).isNotNull()
        in_source = F.when(repeated, F.raise_error(F.lit(f"merge source repeats a key of {keys}")).cast("boolean")).otherwise(True)
    s = source.select(*keys, *[c(x).alias(f"s__{x}") for x in scols], in_source.alias("__in_s"))
    j = t.join(s, keys, "full")
    in_t = c("__in_t").isNotNull()
    in_s = c("__in_s").isNotNull()

    if when == "always":
        changed = F.lit(True)
    elif when == "distinct":
        cmp = list(compare_cols or update_cols)
        changed = F.lit(False)
        for x in cmp:
            changed = changed | ~_t(x).eqNullSafe(_s(x))
    else:
        changed = F.coalesce(when(_t, _s), F.lit(False))
    action = (F.when(in_s & ~in_t, F.lit(INSERT))
              .when(in_s & in_t & changed, F.lit(UPDATE))
              .otherwise(F.lit(UNCHANGED)))
    j = j.withColumn("action", action)
    is_ins, is_upd = c("action") == INSERT, c("action") == UPDATE

    out = [c(k) for k in keys]
    defaults = insert_defaults or {}
    exprs = update_exprs or {}
    for x in tcols:
        if x in audit_cols:
            continue
        ins_val = _s(x) if x in scols else defaults.get(x, F.lit(None))
        if x in update_cols:
            upd_val = exprs[x](_t, _s) if x in exprs else _s(x)
        else:
            upd_val = _t(x)
        out.append(F.when(is_ins, ins_val).when(is_upd, upd_val).otherwise(_t(x))
                   .cast(target.schema[x].dataType).alias(x))
    if audit_cols:
        load_c, upd_c = (audit_cols + [None])[:2]
        if load_c:
            out.append(F.when(is_ins, stamp).otherwise(_t(load_c)).alias(load_c))
        if upd_c:
            out.append(F.when(is_ins | is_upd, stamp).otherwise(_t(upd_c)).alias(upd_c))
    out.append(c("action"))
    return MergeResult(j.select(*out), keys)


def write_touched_partitions(merged: DataFrame, path: str, partition_cols: Sequence[str]) -> None:
    """Overwrite only the partitions present in ``merged`` (a partition-scoped
    merge result); every other partition of the table stays as it is."""
    (merged.drop("action").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(*partition_cols).parquet(path))


def with_audit(df: DataFrame, as_of, cols=("load_date", "upd_date")) -> DataFrame:
    for x in cols:
        df = df.withColumn(x, ts(as_of))
    return df


def placeholders(ids: DataFrame, existing: DataFrame, id_col: str, values: dict[str, str]) -> DataFrame:
    """Distinct non-null ids absent from ``existing`` -> placeholder rows."""
    new_ids = (ids.where(c(id_col).isNotNull()).select(id_col).distinct()
               .join(existing.select(id_col), id_col, "left_anti"))
    return new_ids.select(id_col, *[F.lit(v).alias(k) for k, v in values.items()])


# ---------------------------------------------------------------------------
# Fixed values (placeholder texts of the source application)
# ---------------------------------------------------------------------------
VENUE_PLACEHOLDER = {"venue_name": "Unknown Venue", "city": "Unknown City", "country": "Unknown Country"}
PLAYER_PLACEHOLDER = {"firstname": "Unknown", "lastname": "Player", "full_name": "Unknown Player"}

FIXTURE_COLS = ["league_id", "season_year", "home_team_id", "away_team_id", "fixture_date", "status",
                "round", "home_score", "away_score", "venue_id"]


# M01 -----------------------------------------------------------------------------
def merge_fixtures(target: DataFrame, stg_flagged: DataFrame, venues: DataFrame, as_of):
    """Placeholder venues for unknown ids, then true-diff upsert of valid rows.
    Returns (MergeResult for fixtures, placeholder venue rows)."""
    valid = stg_flagged.where(c("is_valid")).select("fixture_id", *FIXTURE_COLS)
    new_venues = placeholders(valid, venues, "venue_id", VENUE_PLACEHOLDER)
    return merge_upsert(target, valid, ["fixture_id"], FIXTURE_COLS, as_of), new_venues


# M02 -----------------------------------------------------------------------------
def merge_teams(target: DataFrame, stg_flagged: DataFrame, as_of,
                null_safe_venue: bool = False) -> MergeResult:
    """Newest season row per team; venue kept if the new one is NULL; update if
    name/country/logo differ (NULL = '') or the venue differs by plain ``<>``."""
    cols = ["team_name", "team_country", "team_logo_url", "venue_id"]
    d = latest_by(stg_flagged.where(c("is_valid")), ["team_id"],
                  [c("season_year").desc(), c("league_id").desc()]).select("team_id", *cols)

    def changed(t, s):
        e = F.lit(False)
        for x in cols[:3]:
            e = e | (F.coalesce(t(x), F.lit("")) != F.coalesce(s(x), F.lit("")))
        venue = s("venue_id").isNotNull() & (~t("venue_id").eqNullSafe(s("venue_id")) if null_safe_venue
                                              else (t("venue_id") != s("venue_id")))
        return e | F.coalesce(venue, F.lit(False))

    return merge_upsert(target, d, ["team_id"], cols, as_of, when=changed, unique_source=True,
                        update_exprs={"venue_id": lambda t, s: F.coalesce(s("venue_id"), t("venue_id"))})


# M03 -----------------------------------------------------------------------------
def merge_players(target: DataFrame, stg_flagged: DataFrame, as_of, cols: Sequence[str],
                  stg_id: str = "stg_player_id") -> MergeResult:
    d = latest_by(stg_flagged.where(c("is_valid")), ["player_id"], [c(stg_id).desc()]).select("player_id", *cols)
    return merge_upsert(target, d, ["player_id"], list(cols), as_of, unique_source=True)


# M04 -----------------------------------------------------------------------------
def merge_venues(target: DataFrame, stg_flagged: DataFrame, as_of) -> MergeResult:
    cols = ["venue_name", "city", "country"]
    d = stg_flagged.where(c("is_valid")).select("venue_id", *cols)

    def changed(t, s):
        e = F.lit(False)
        for x in cols:
            e = e | (F.coalesce(t(x), F.lit("")) != F.coalesce(s(x), F.lit("")))
        return e

    return merge_upsert(target, d, ["venue_id"], cols, as_of, when=changed)


# M05 -----------------------------------------------------------------------------
EVENT_KEY = ["fixture_id", "minute", "k_extra", "team_id", "k_player", "event_type"]


def event_keys(df: DataFrame) -> DataFrame:
    return (df.withColumn("k_extra", F.coalesce(c("minute_extra"), F.lit(0)))
            .withColumn("k_player", F.coalesce(c("player_id"), F.lit(0))))


def merge_match_events(target: DataFrame, stg_flagged: DataFrame, players: DataFrame, as_of,
                       order: Sequence[Column], first_id: int | None = None):
    """Latest staging row per natural key (detail not in the key); placeholder
    players for unknown player / assist ids; on conflict only detail,
    comments and upd_date change; every matched row counts as touched.
    ``target`` must carry ``event_id``. Each source row draws the next number
    in key order from ``first_id`` (default: after the target's greatest), as a
    sequence does, and an inserted row keeps it: unique, and the same in every
    run. Returns (MergeResult, placeholder player rows)."""
    cols = ["minute_extra", "player_id", "assist_player_id", "event_detail", "comments"]
    valid = event_keys(stg_flagged.where(c("is_valid")))
    d = latest_by(valid, EVENT_KEY, [o.desc() for o in order]).select(*EVENT_KEY, *cols)
    if first_id is None:
        first_id = 1 + (target.agg(F.max("event_id")).first()[0] or 0)
    d = numbered(d, EVENT_KEY, "event_id", first_id)
    ids = (d.select(c("player_id").alias("player_id"))
           .unionByName(d.select(c("assist_player_id").alias("player_id"))))
    new_players = placeholders(ids, players, "player_id", PLAYER_PLACEHOLDER)
    tgt = event_keys(target)
    res = merge_upsert(tgt, d, EVENT_KEY, ["event_detail", "comments"], as_of, when="always", unique_source=True)
    return MergeResult(res.merged.drop("k_extra", "k_player"), ["event_id"]), new_players


# M06 -----------------------------------------------------------------------------
def merge_match_statistics(target: DataFrame, stg_flagged: DataFrame, fixtures: DataFrame, as_of,
                           statuses=("FT", "AET", "PEN")) -> MergeResult:
    """Only fixtures with exactly two valid rows with a team, finished; league
    and season attached from fixtures; every matched row is updated."""
    v = stg_flagged.where(c("is_valid") & c("team_id").isNotNull())
    eligible = v.groupBy("fixture_id").agg(F.count(F.lit(1)).alias("n")).where(c("n") == 2).select("fixture_id")
    fx = fixtures.where(c("status").isin(list(statuses))).select("fixture_id", "league_id", "season_year")
    stat_cols = [x for x in target.columns if x not in ("fixture_id", "team_id", "league_id", "season_year",
                                                        "load_date", "upd_date")]
    d = v.join(eligible, "fixture_id", "left_semi").join(fx, "fixture_id").select(
        "fixture_id", "team_id", "league_id", "season_year", *stat_cols)
    return merge_upsert(target, d, ["fixture_id", "team_id"], ["league_id", "season_year", *stat_cols],
                        as_of, when="always")


# M07 -----------------------------------------------------------------------------
STANDING_KEY = ["league_id", "season_year", "team_id", "group_label"]
STANDING_COLS = ["rank", "points", "played", "win", "draw", "lose", "goals_for", "goals_against", "goals_diff",
                 "form_window", "form_compact"]
_REQUIRED = ["rank", "points", "played", "win", "draw", "lose", "goals_for", "goals_against", "goals_diff"]


def standings_candidates(stg_flagged: DataFrame, fixtures: DataFrame, n: int = 5):
    """(valid rows with form attached, rows skipped for NULL required columns)."""
    from touchline.operators.form import team_form
    raw = (stg_flagged.where(c("is_valid"))
           .withColumn("group_label", F.coalesce(c("group_label"), F.lit("")))
           .withColumn("goals_diff", F.coalesce(c("goals_diff"), c("goals_for") - c("goals_against"))))
    any_null = F.lit(False)
    for x in _REQUIRED:
        any_null = any_null | c(x).isNull()
    invalid = raw.where(any_null)
    gap = F.max(any_null).over(Window.partitionBy(*STANDING_KEY))
    valid = raw.withColumn("__gap", gap).where(~c("__gap")).drop("__gap")
    # Form per distinct team key (decision: a team in two groups gets one form).
    form = team_form(fixtures, n).select("league_id", "season_year", "team_id", "form_compact")
    cand = (valid.join(form, ["league_id", "season_year", "team_id"], "left")
            .withColumn("form_compact", F.coalesce(c("form_compact"), F.lit("")))
            .withColumn("form_window", F.lit(n).cast("short")))
    return cand.select(*STANDING_KEY, *STANDING_COLS), invalid


def merge_standings(target: DataFrame, stg_flagged: DataFrame, fixtures: DataFrame, as_of, n: int = 5):
    """Returns (MergeResult, counts DataFrame (inserted, updated, skipped_nulls, no_form))."""
    cand, invalid = standings_candidates(stg_flagged, fixtures, n)
    res = merge_upsert(target, cand, STANDING_KEY, STANDING_COLS, as_of)
    counts = standings_counts(res, cand, invalid)
    return res, counts


def standings_counts(res: MergeResult, cand: DataFrame, invalid: DataFrame) -> DataFrame:
    a = res.merged.agg(F.count_if(c("action") == INSERT).alias("inserted"),
                       F.count_if(c("action") == UPDATE).alias("updated")).withColumn("__k", F.lit(1))
    b = invalid.agg(F.count(F.lit(1)).alias("skipped_nulls")).withColumn("__k", F.lit(1))
    d = cand.agg(F.count_if(c("form_compact") == "").alias("no_form")).withColumn("__k", F.lit(1))
    return a.join(b, "__k").join(d, "__k").drop("__k")


# M08 -----------------------------------------------------------------------------
def merge_standings_targets(target: DataFrame, stg_flagged: DataFrame, fixtures: DataFrame,
                            targets: DataFrame, as_of, n: int = 5):
    """Same as M07 restricted to (league_id, season_year) targets; per-target
    summary (inserted, updated, skipped_nulls, no_form)."""
    keys = ["league_id", "season_year"]
    stg = stg_flagged.join(targets.select(*keys), keys, "left_semi")
    cand, invalid = standings_candidates(stg, fixtures.join(targets.select(*keys), keys, "left_semi"), n)
    res = merge_upsert(target, cand, STANDING_KEY, STANDING_COLS, as_of)
    per = res.merged.join(targets.select(*keys), keys, "left_semi").groupBy(*keys).agg(
        F.count_if(c("action") == INSERT).alias("inserted"), F.count_if(c("action") == UPDATE).alias("updated"))
    sk = invalid.groupBy(*keys).agg(F.count(F.lit(1)).alias("skipped_nulls"))
    nf = cand.groupBy(*keys).agg(F.count_if(c("form_compact") == "").alias("no_form"))
    summary = (targets.select(*keys).distinct().join(per, keys, "left").join(sk, keys, "left").join(nf, keys, "left")
               .select(*keys, *[F.coalesce(c(x), F.lit(0)).cast("bigint").alias(x)
                                for x in ("inserted", "updated", "skipped_nulls", "no_form")]))
    return res, summary


# M09 -----------------------------------------------------------------------------
PSS_KEY = ["player_id", "team_id", "league_id", "season"]


def merge_player_season_stats(target: DataFrame, stg_flagged: DataFrame, as_of,
                              order: Sequence[Column]) -> MergeResult:
    v = stg_flagged.where(c("is_valid"))
    stat_cols = [x for x in target.columns if x not in PSS_KEY + ["load_date", "upd_date"]]
    d = latest_by(v, PSS_KEY, [o.desc() for o in order]).select(*PSS_KEY, *stat_cols)
    return merge_upsert(target, d, PSS_KEY, stat_cols, as_of, when="always", unique_source=True)


# M10 -----------------------------------------------------------------------------
def merge_news(target: DataFrame, stg_flagged: DataFrame, as_of, tab_order: Sequence[str]) -> MergeResult:
    """Latest staging row per article (last tab in tab order wins), true-diff."""
    rank = F.array_position(F.array(*[F.lit(t) for t in tab_order]), c("tab"))
    v = stg_flagged.where(c("is_valid")).withColumn("__tab_rank", rank)
    cols = [x for x in target.columns if x not in ("article_id", "load_date", "upd_date")]
    # one tab may list an article twice: its later staging row wins
    later = [c("stg_order").desc()] if "stg_order" in v.columns else []
    d = latest_by(v, ["article_id"], [c("__tab_rank").desc(), *later]).select("article_id", *cols)
    return merge_upsert(target, d, ["article_id"], cols, as_of, unique_source=True)


# M11 -----------------------------------------------------------------------------
def merge_team_bridge(target: DataFrame, source: DataFrame, as_of) -> MergeResult:
    keys = ["team_id", "league_id", "season_year"]
    d = source.select(*keys).where(c("team_id").isNotNull()).distinct()
    return merge_upsert(target, d, keys, [], as_of, when="always", unique_source=True)


# M12 -----------------------------------------------------------------------------
def merge_league_directory(target: DataFrame, source: DataFrame, as_of) -> MergeResult:
    cols = [x for x in source.columns if x != "league_id"]
    return merge_upsert(target, source, ["league_id"], cols, as_of, when="always")


# M13 / M14 -----------------------------------------------------------------------
def merge_leagues(target: DataFrame, source: DataFrame, as_of) -> MergeResult:
    """One row per league (last season year wins); update if the tuple differs."""
    d = latest_by(source, ["league_id"], [c("season_year").desc()]).drop("season_year")
    cols = [x for x in d.columns if x != "league_id"]
    return merge_upsert(target, d, ["league_id"], cols, as_of, unique_source=True)


def merge_league_seasons(target: DataFrame, source: DataFrame, as_of, always: bool = False) -> MergeResult:
    """Update if the tuple differs (dates compared as their first 10 chars) or always."""
    cols = ["start_date", "end_date", "is_current", "season_str"]
    keys = ["league_id", "season_year"]
    if always:
        return merge_upsert(target, source, keys, cols, as_of, when="always")

    def changed(t, s):
        e = F.lit(False)
        for x in cols:
            if x.endswith("_date"):
                e = e | ~F.substring(t(x).cast("string"), 1, 10).eqNullSafe(F.substring(s(x).cast("string"), 1, 10))
            else:
                e = e | ~t(x).eqNullSafe(s(x))
        return e
    return merge_upsert(target, source, keys, cols, as_of, when=changed)


# M15 -----------------------------------------------------------------------------
def fill_venue_geo(target: DataFrame, fills: DataFrame, as_of):
    """Fill name/city/country by coalesce(new, old) only on venues whose city or
    country is NULL; never inserts. ``fills`` must be unique per venue_id.
    Returns the new venues table (rows filled get ``upd_date = as_of``) and a
    row with their number (``filled``)."""
    f = fills.select("venue_id", F.lit(True).alias("__has_fill"),
                     *[c(x).alias(f"f__{x}") for x in ("venue_name", "city", "country")])
    j = target.join(f, "venue_id", "left")
    hit = c("__has_fill").isNotNull() & (c("city").isNull() | c("country").isNull())
    out = j.withColumn("__filled", hit)
    count = out.agg(F.count_if("__filled").alias("filled"))
    for x in ("venue_name", "city", "country"):
        out = out.withColumn(x, F.when(c("__filled"), F.coalesce(c(f"f__{x}"), c(x))).otherwise(c(x)))
    if "upd_date" in target.columns:
        out = out.withColumn("upd_date", F.when(c("__filled"), ts(as_of)).otherwise(c("upd_date")))
    return out.drop("f__venue_name", "f__city", "f__country", "__has_fill", "__filled"), count


# M16 -----------------------------------------------------------------------------
def merge_catalog(target: DataFrame, requested: DataFrame, as_of) -> MergeResult:
    """Bulk upsert of requested leagues: alias = slug + '_' + id, last_season only
    moves forward, re-enabled."""
    from touchline.functions.scalars import folder_alias
    src = requested.select("league_id", "league_name", "first_season", "last_season",
                           folder_alias(c("league_name"), c("league_id")).alias("folder_alias"),
                           F.lit(True).alias("is_enabled"))
    cols = ["folder_alias", "league_name", "first_season", "last_season", "is_enabled"]
    return merge_upsert(target, src, ["league_id"], cols, as_of, when="always",
                        update_exprs={"last_season": lambda t, s: F.greatest(F.coalesce(t("last_season"), F.lit(0)),
                                                                             s("last_season"))},
                        audit=("load_date", "upd_date") if "upd_date" in target.columns else None)
