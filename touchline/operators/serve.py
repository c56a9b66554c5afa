"""Serving queries (Q01–Q16), set-based.

The source application answers one league / team / fixture per request.
Here each query answers for *all* of them at once; the per-request form is a
filter on the result (``.where(team_id == x)``), which Catalyst pushes down
to the scans. Dimensions (leagues, teams, venues) are broadcast after a
row-count check (``functions.joins.bounded_broadcast``); facts (fixtures,
events, statistics) are never broadcast on an estimate — AQE may still
broadcast a side at runtime once its real size is known to be small.

Ordering inside a group (a league table, a team's fixture list) is given as
an explicit rank column computed with a window partitioned by the group, so
the result is ordered without a global single-partition sort. Global
top-k (league list, ticker) uses ``orderBy().limit()`` (TakeOrdered: per
partition top-k then merge).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import scalars as S
from touchline.functions.joins import bounded_broadcast as dim
from touchline.functions.joins import DERIVED_MAX_ROWS, is_small, lookup, stored
from touchline.functions.windows import latest_by, long_form, top_n_per_group

c = F.col


def clean_str(x) -> Column:
    """HTML-unescape + trim; blank -> NULL."""
    return S.blank_to_null(S.html_unescape(x if isinstance(x, Column) else c(x)))


def _teams(teams: DataFrame, role: str, small: bool | None = None) -> DataFrame:
    return dim(teams.select(c("team_id").alias(f"{role}_id"), c("team_name").alias(f"{role}_name")), small=small)


def _team_sides(fixtures: DataFrame, teams: DataFrame) -> DataFrame:
    """Fixtures with home and away team names (one size check for both roles)."""
    small = is_small(teams.select("team_id", "team_name"))
    return (fixtures.join(_teams(teams, "home", small), c("home_team_id") == c("home_id"))
            .join(_teams(teams, "away", small), c("away_team_id") == c("away_id")))


# Q01 -----------------------------------------------------------------------------
def popular_leagues(leagues: DataFrame) -> DataFrame:
    return (leagues.where(c("is_popular"))
            .select(c("league_id").alias("id"), c("league_name").alias("name"),
                    c("league_country").alias("country"), "display_order")
            .orderBy(c("display_order").asc_nulls_last(), c("id")))


# Q02 -----------------------------------------------------------------------------
def matches_on_local_day(fixtures: DataFrame, leagues: DataFrame, teams: DataFrame,
                         local_date: str, tz: str = "UTC") -> DataFrame:
    """Fixtures whose kickoff falls in the local calendar day of ``tz``
    (23- or 25-hour days at DST changes), with league and team names."""
    start, end = S.local_day_bounds(local_date, tz)
    start, end = start.cast("timestamp_ntz"), end.cast("timestamp_ntz")
    f = fixtures.where((c("fixture_date") >= start) & (c("fixture_date") < end))
    return (_team_sides(f.join(dim(leagues.select("league_id", "league_name")), "league_id"), teams)
            .select(c("fixture_id").alias("id"), "league_name", "home_name", "away_name",
                    c("fixture_date").alias("kickoff_utc"), "status")
            .orderBy("league_name", "kickoff_utc", "id"))


# Q03 / Q04 / Q05 -----------------------------------------------------------------
def _league_item(df: DataFrame) -> DataFrame:
    return df.select(c("league_id").alias("id"), c("league_name").alias("name"),
                     c("league_country").alias("country"))


def league_list(leagues: DataFrame, limit: int = 20) -> DataFrame:
    """First ``limit`` leagues by name (top-k is the feature)."""
    return _league_item(leagues).orderBy("name", "id").limit(limit)


def league_page(leagues: DataFrame, page: int = 1, page_size: int = 50,
                country: str | None = None) -> DataFrame:
    """One page by name, optionally of countries that contain ``country``;
    ``has_next`` is true iff the page is full."""
    if not 1 <= page_size <= 100 or page < 1:
        raise ValueError("page >= 1 and 1 <= page_size <= 100")
    df = leagues if country is None else leagues.where(c("league_country").ilike(f"%{country}%"))
    rows = _league_item(df).orderBy("name", "id").offset((page - 1) * page_size).limit(page_size)
    # The page is bounded by page_size, so an unpartitioned count over it is small.
    return rows.withColumn("has_next", F.count(F.lit(1)).over(Window.partitionBy()) == page_size)


def league_search(leagues: DataFrame, q: str, country: str | None = None, limit: int = 20) -> DataFrame:
    """Name or country ILIKE %q% (``%`` / ``_`` in q stay wildcards); exact
    name match first, then by name."""
    q = q.strip()
    if len(q) < 2 or not 1 <= limit <= 50:
        raise ValueError("q needs >= 2 characters; 1 <= limit <= 50")
    pattern = f"%{q}%"
    df = leagues if country is None else leagues.where(c("league_country").ilike(f"%{country}%"))
    df = df.where(c("league_name").ilike(pattern) | c("league_country").ilike(pattern))
    exact = F.when(F.lower(c("league_name")) == q.lower(), 0).otherwise(1)
    return _league_item(df.withColumn("__exact", exact).orderBy("__exact", "league_name", "league_id")
                        ).limit(limit)


# Q06 / Q07 -----------------------------------------------------------------------
def current_season(leagues: DataFrame, catalog: DataFrame, standings: DataFrame) -> DataFrame:
    """Per league: the catalog's last season, else the newest standings season."""
    mx = standings.groupBy("league_id").agg(F.max("season_year").alias("__max"))
    return (leagues.select("league_id")
            .join(catalog.select("league_id", "last_season"), "league_id", "left")
            .join(mx, "league_id", "left")
            .select("league_id", F.coalesce(c("last_season"), c("__max")).alias("current_season")))


def league_detail(leagues: DataFrame, catalog: DataFrame, standings: DataFrame) -> DataFrame:
    cur = current_season(leagues, catalog, standings)
    last = standings.groupBy("league_id", "season_year").agg(F.max("upd_date").alias("last_updated_utc"))
    return (leagues.select(c("league_id").alias("id"), c("league_name").alias("name"),
                           c("league_country").alias("country"), "league_id")
            .join(cur, "league_id", "left")
            .join(last.withColumnRenamed("season_year", "current_season"), ["league_id", "current_season"], "left")
            .select("id", "name", "country", "current_season", "last_updated_utc"))


# Q08 -----------------------------------------------------------------------------
def league_standings(standings: DataFrame, teams: DataFrame) -> DataFrame:
    """One row per (league, season, team): latest upd_date, then lowest rank;
    ``display_rank`` orders blank group last, then rank, then name."""
    one = latest_by(standings, ["league_id", "season_year", "team_id"],
                    [c("upd_date").desc_nulls_last(), c("rank").asc_nulls_last(), c("group_label")])
    j = one.join(dim(teams.select("team_id", "team_name")), "team_id")
    w = Window.partitionBy("league_id", "season_year").orderBy(
        F.nullif(c("group_label"), F.lit("")).asc_nulls_last(), c("rank").asc_nulls_last(),
        c("team_name"), c("team_id"))
    return j.select(
        "league_id", "season_year", c("rank").alias("position"), "team_id", "team_name", "played",
        c("win").alias("wins"), c("draw").alias("draws"), c("lose").alias("losses"), "goals_for",
        "goals_against", c("goals_diff").alias("goal_diff"), "points",
        F.regexp_extract_all(F.coalesce(c("form_compact"), F.lit("")), F.lit("(.)"), 1).alias("form"),
        F.coalesce(c("group_label"), F.lit("")).alias("group_label"),
        F.row_number().over(w).alias("display_rank"))


# Q09 -----------------------------------------------------------------------------
def weekly_matches(fixtures: DataFrame, teams: DataFrame, start: str | None = None, days: int = 7, as_of: str | None = None) -> DataFrame:
    """Every league's fixtures in [start, start + days); without ``start`` from the Monday of ``as_of``'s week."""
    if not 1 <= days <= 14:
        raise ValueError("days must be within 1..14")
    if not (start or as_of):
        raise ValueError("start or as_of is needed")
    first = F.lit(start).cast("date") if start else S.week_start_monday(F.lit(str(as_of)[:10]).cast("date"))
    s, e = first.cast("timestamp_ntz"), F.date_add(first, days).cast("timestamp_ntz")
    f = fixtures.where((c("fixture_date") >= s) & (c("fixture_date") < e))
    return (_team_sides(f, teams)
            .select("league_id", c("fixture_id").alias("id"), c("fixture_date").alias("kickoff_utc"), "status",
                    "round", "home_id", "home_name", "away_id", "away_name", "home_score", "away_score"))


# Q10 -----------------------------------------------------------------------------
def match_header(fixtures: DataFrame, leagues: DataFrame, teams: DataFrame, venues: DataFrame) -> DataFrame:
    v = dim(venues.select("venue_id", c("venue_name").alias("v_name"), c("city").alias("v_city"),
                          c("country").alias("v_country")))
    j = _team_sides(fixtures.join(dim(leagues.select("league_id", "league_name")), "league_id"), teams) \
        .join(v, "venue_id", "left")
    fin = S.is_finished(c("status"))
    return j.select(
        c("fixture_id").alias("match_id"), c("season_year").alias("season"),
        c("league_id").alias("competition_id"),
        F.coalesce(clean_str("league_name"), F.lit("")).alias("competition_name"),
        clean_str("round").alias("round"), S.iso_utc(c("fixture_date")).alias("date_utc"),
        S.status_label_match(c("status")).alias("status"),
        "home_id", F.coalesce(clean_str("home_name"), F.lit("")).alias("home_name"),
        "away_id", F.coalesce(clean_str("away_name"), F.lit("")).alias("away_name"),
        clean_str("v_name").alias("venue_name"), clean_str("v_city").alias("venue_city"),
        clean_str("v_country").alias("venue_country"),
        F.when(fin, c("home_score")).alias("home_score"), F.when(fin, c("away_score")).alias("away_score"))


# Q11 -----------------------------------------------------------------------------
STAT_SIDE_COLS = ["total_shots", "shots_on_goal", "shots_inside_box", "shots_outside_box", "corners", "offsides",
                  "fouls", "total_passes", "passes_accurate", "possession", "yellow_cards", "red_cards"]


def match_stats_sides(stats: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Each statistics row tagged home / away / other; numbers default to 0;
    pass accuracy: stored, else round(100 * accurate / total), else 0."""
    s = fixtures.select("fixture_id", "home_team_id", "away_team_id")
    j = stats.join(s, "fixture_id")
    computed = F.when((c("total_passes") > 0) & c("passes_accurate").isNotNull(),
                      F.round(F.lit(100.0) * c("passes_accurate") / c("total_passes")))
    return j.select(
        "fixture_id", "team_id",
        F.when(c("team_id") == c("home_team_id"), "home").when(c("team_id") == c("away_team_id"), "away")
        .otherwise("other").alias("side"),
        *[F.coalesce(c(x), F.lit(0)).cast("int").alias(x) for x in STAT_SIDE_COLS],
        F.coalesce(c("pass_accuracy"), computed, F.lit(0)).cast("int").alias("pass_accuracy"))


def stats_by_side(sides: DataFrame) -> DataFrame:
    """Pivot the tagged rows into one row per fixture with home / away structs
    (defaults of 0 when a side is missing; 'other' rows are ignored)."""
    cols = STAT_SIDE_COLS + ["pass_accuracy"]
    zero = F.struct(*[F.lit(0).alias(x) for x in cols])
    agg = sides.where(c("side") != "other").groupBy("fixture_id").agg(
        *[F.max(F.when(c("side") == sd, F.struct(*[c(x) for x in cols]))).alias(sd) for sd in ("home", "away")])
    return agg.select("fixture_id", F.coalesce(c("home"), zero).alias("home"),
                      F.coalesce(c("away"), zero).alias("away"))


# Q12 -----------------------------------------------------------------------------
def match_timeline(events: DataFrame, players: DataFrame) -> DataFrame:
    names = players.select("player_id", "full_name")
    small = is_small(names)
    if not small:
        # Only the players that events name; those few or many, a player of very many events is no group of a join.
        named = events.select(F.explode(F.array("player_id", "assist_player_id")).alias("player_id")).distinct()
        names = stored(names.join(named, "player_id", "left_semi"))
        small = is_small(names, DERIVED_MAX_ROWS)
    p = names.select("player_id", c("full_name").alias("actor"))
    pa = names.select(c("player_id").alias("assist_player_id"), c("full_name").alias("assistant"))
    if small:
        j = events.join(dim(p, small=True), "player_id", "left").join(dim(pa, small=True), "assist_player_id", "left")
    else:
        j = lookup(events, p, ["player_id"], F.lit(True), staged=True)
        j = lookup(j, pa, ["assist_player_id"], F.lit(True), staged=True)
    ed = F.lower(F.trim(F.coalesce(c("event_detail"), F.lit(""))))
    return j.select(
        "fixture_id", "event_id", "minute", F.coalesce(c("minute_extra"), F.lit(0)).alias("minute_extra"),
        "team_id", S.event_type_ui(c("event_type"), c("event_detail")).alias("type"),
        S.short_name(S.html_unescape(c("actor"))).alias("player"),
        S.short_name(S.html_unescape(c("assistant"))).alias("assist"),
        clean_str(F.nullif(ed, F.lit(""))).alias("detail"))


# Q12a ----------------------------------------------------------------------------
def match_details(header: DataFrame, sides: DataFrame, timeline: DataFrame) -> DataFrame:
    """One nested document per fixture: header + home/away stats + ordered
    events. The event list is one match's events (bounded by a match's
    length); it is assembled with ``collect_list`` and sorted in the row."""
    ev = F.struct(c("minute"), c("minute_extra"), c("event_id"), c("team_id"), c("type"), c("player"),
                  c("assist"), c("detail"))
    events = timeline.groupBy("fixture_id").agg(F.array_sort(F.collect_list(ev)).alias("events"))
    stats = stats_by_side(sides)
    return (header.join(stats, header["match_id"] == stats["fixture_id"], "left").drop("fixture_id")
            .join(events, header["match_id"] == events["fixture_id"], "left").drop("fixture_id")
            .withColumn("events", F.coalesce(c("events"), F.array().cast(events.schema["events"].dataType))))


# Q13 -----------------------------------------------------------------------------
def team_summary(teams: DataFrame, bridge: DataFrame, standings: DataFrame, fixtures: DataFrame,
                 leagues: DataFrame) -> DataFrame:
    """Per (team, season) present in membership, standings or fixtures: the
    chosen league (membership, then standings, then the league with most
    fixtures, ties to the lowest id; within a priority the lowest league id)
    and the best standings row in it (blank group first, then rank)."""
    keys = ["team_id", "season_year"]
    memb = bridge.select(*keys, "league_id", F.lit(1).alias("pri"))
    stand = standings.select(*keys, "league_id").distinct().withColumn("pri", F.lit(2))
    lf = long_form(fixtures.select("fixture_id", "league_id", "season_year", "fixture_date", "status",
                                   "home_team_id", "away_team_id", "home_score", "away_score"))
    games = lf.groupBy(*keys, "league_id").agg(F.count(F.lit(1)).alias("games"))
    # Majority vote without a window: min of (-games, league_id) per team-season.
    major = (games.groupBy(*keys).agg(F.min(F.struct((-c("games")).alias("g"), c("league_id"))).alias("m"))
             .select(*keys, c("m.league_id").alias("league_id"), F.lit(3).alias("pri")))
    picks = memb.unionByName(stand).unionByName(major)
    chosen = (picks.groupBy(*keys).agg(F.min(F.struct("pri", "league_id")).alias("p"))
              .select(*keys, c("p.league_id").alias("league_id")))
    best = latest_by(standings, ["team_id", "season_year", "league_id"],
                     [(c("group_label") == "").desc_nulls_last(), c("rank").asc_nulls_last(), c("group_label")])
    j = (chosen.join(dim(teams.select("team_id", "team_name")), "team_id")
         .join(dim(leagues.select("league_id", "league_name", "league_country")), "league_id", "left")
         .join(best.select(*keys, "league_id", "rank", "points", "win", "draw", "lose", "goals_diff"),
               [*keys, "league_id"], "left"))
    has_record = c("win").isNotNull() & c("draw").isNotNull() & c("lose").isNotNull() & c("goals_diff").isNotNull()
    return j.select("team_id", "season_year", "team_name", "league_id", "league_name", "league_country",
                    c("rank").alias("position"), "points", c("win").alias("wins"), c("draw").alias("draws"),
                    c("lose").alias("losses"), c("goals_diff").alias("goal_diff"), has_record.alias("has_record"))


# Q14 / Q15 -----------------------------------------------------------------------
def team_fixtures(fixtures: DataFrame, teams: DataFrame, leagues: DataFrame, venues: DataFrame,
                  status: str = "all", q: str = "", limit: int = 50, offset: int = 0) -> DataFrame:
    """Per (team, season): the team's fixtures filtered by status and a search
    in home / away name or round, newest first if ``played`` else oldest
    first, paged with ``offset`` / ``limit`` (``page_rank`` is 1-based)."""
    if status not in ("all", "upcoming", "played") or not 1 <= limit <= 200 or offset < 0:
        raise ValueError("bad status / limit / offset")
    f = fixtures
    if status == "upcoming":
        f = f.where(c("status").isin(S.UPCOMING))
    elif status == "played":
        f = f.where(c("status").isin(S.FINISHED))
    j = _team_sides(f, teams)
    if q:
        like = f"%{q.strip()}%"
        j = j.where(c("home_name").ilike(like) | c("away_name").ilike(like) | c("round").ilike(like))
    sides = F.array(c("home_team_id"), c("away_team_id"))
    per_team = j.withColumn("team_id", F.explode(F.array_distinct(sides)))
    order = [c("fixture_date").desc_nulls_last() if status == "played" else c("fixture_date").asc_nulls_last(),
             c("fixture_id")]
    page = top_n_per_group(per_team, ["team_id", "season_year"], order, offset + limit, rank_col="page_rank")
    page = page.where(c("page_rank") > offset).withColumn("page_rank", c("page_rank") - offset)
    v = dim(venues.select("venue_id", "venue_name"))
    out = (page.join(dim(leagues.select("league_id", "league_name")), "league_id")
           .join(v, "venue_id", "left"))
    fin = S.is_finished(c("status"))
    return out.select(
        "team_id", "season_year", "page_rank", c("fixture_id").alias("match_id"),
        S.iso_utc(c("fixture_date")).alias("date_utc"), S.status_label_team(c("status")).alias("status"),
        "round", "home_id", "home_name", "away_id", "away_name",
        F.when(fin, c("home_score")).alias("home_score"), F.when(fin, c("away_score")).alias("away_score"),
        c("league_id").alias("competition_id"), c("league_name").alias("competition_name"),
        clean_str("venue_name").alias("venue"))


def team_fixture_counts(fixtures: DataFrame) -> DataFrame:
    per_team = fixtures.select("season_year", "status", F.explode(
        F.array_distinct(F.array(c("home_team_id"), c("away_team_id")))).alias("team_id"))
    return per_team.groupBy("team_id", "season_year").agg(
        F.count(F.lit(1)).alias("count_total"),
        F.count_if(c("status").isin(S.UPCOMING)).alias("count_upcoming"),
        F.count_if(c("status").isin(S.FINISHED)).alias("count_played"))


# Q16 -----------------------------------------------------------------------------
def news_page(news: DataFrame, tab: str | None = None, after: tuple | None = None, limit: int = 20,
              per_tab: bool = False) -> DataFrame:
    """Newest first; optional tab; keyset cursor ``after = (published_at, article_id)``
    keeps strictly older rows. ``per_tab=True`` pages every tab at once.
    ``has_next`` is true iff the page is full."""
    if not 1 <= limit <= 50:
        raise ValueError("limit must be within 1..50")
    df = news
    if tab is not None:
        if tab not in S.NEWS_TABS:
            raise ValueError(f"invalid tab {tab!r}")
        df = df.where(c("tab") == tab)
    if after is not None:
        ts = F.lit(after[0]).cast("timestamp_ntz")
        df = df.where((c("published_at_utc") < ts) |
                      ((c("published_at_utc") == ts) & (c("article_id") < F.lit(after[1]))))
    order = [c("published_at_utc").desc_nulls_last(), c("article_id").desc()]
    if per_tab:
        page = top_n_per_group(df, ["tab"], order, limit, rank_col="page_rank")
        w = Window.partitionBy("tab")
    else:
        page = df.orderBy(*order).limit(limit)
        page = page.withColumn("page_rank", F.row_number().over(Window.partitionBy().orderBy(*order)))
        w = Window.partitionBy()
    return page.withColumn("has_next", F.count(F.lit(1)).over(w) == limit)


# K05 -----------------------------------------------------------------------------
def latest_n_per_group(df: DataFrame, group: str, order: list, n: int = 50) -> DataFrame:
    return top_n_per_group(df, [group], order, n)
