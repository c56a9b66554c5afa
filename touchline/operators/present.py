"""Presentation-layer table transforms.

The source application computes these in the browser on one page's rows;
here they are DataFrame operators over all leagues / fixtures / teams at
once. Windows are partitioned by the natural group (league-season, fixture,
team), never global.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import scalars as S
from touchline.functions.windows import long_form, top_n_per_group

c = F.col


# P01 -----------------------------------------------------------------------------
def standings_by_group(table: DataFrame) -> DataFrame:
    """Input: ``serve.league_standings``. Adds the normalised group key, the
    group's display label (label of its first row in display order), the
    group's position (blank label first, then label) and a multi-group flag."""
    lg = ["league_id", "season_year"]
    t = table.withColumn("group_key", S.normalize_group_key(c("group_label")))
    first = Window.partitionBy(*lg, "group_key").orderBy("display_rank")
    t = t.withColumn("group_display", F.first("group_label").over(first))
    order = Window.partitionBy(*lg).orderBy((c("group_display") != "").cast("int"), c("group_display"))
    whole = Window.partitionBy(*lg)
    return (t.withColumn("group_order", F.dense_rank().over(order))
            .withColumn("is_multi_group",
                        (F.size(F.collect_set("group_key").over(whole)) > 1)
                        | F.max((c("group_label") != "").cast("int")).over(whole).cast("boolean"))
            .withColumn("group_title", S.clean_group_label(c("group_display"))))


# P02 -----------------------------------------------------------------------------
def matches_by_day(weekly: DataFrame) -> DataFrame:
    """Input: ``serve.weekly_matches``. UTC day key and centre text (score if
    finished, NULL scores as 0, else the kickoff time HH:mm)."""
    fin = c("status").isin(S.FINISHED)
    return weekly.select(
        "*", F.to_date(c("kickoff_utc")).alias("day"),
        F.when(fin, F.concat(F.coalesce(c("home_score"), F.lit(0)).cast("string"), F.lit(" - "),
                             F.coalesce(c("away_score"), F.lit(0)).cast("string")))
        .otherwise(F.date_format(c("kickoff_utc"), "HH:mm")).alias("center_text"))


# P03 -----------------------------------------------------------------------------
def quick_find(day_matches: DataFrame, query: str | None) -> DataFrame:
    """Input: ``serve.matches_on_local_day``. Time-like queries ('13:30',
    '1330', '9.') match the kickoff time text; others match team or league
    names (case-insensitive substring). Rows stay grouped by league_name."""
    if not query:
        return day_matches
    qn = query.strip().lower()
    import re
    if re.fullmatch(r"\d{1,2}[:.]?\d{0,2}", qn):
        q_time = qn.replace(".", ":")
        return day_matches.where(F.date_format(c("kickoff_utc"), "HH:mm").contains(q_time))
    return day_matches.where(F.lower(c("home_name")).contains(qn) | F.lower(c("away_name")).contains(qn)
                             | F.lower(c("league_name")).contains(qn))


def matches_by_league(day_matches: DataFrame, query: str | None = None) -> DataFrame:
    """One row per league name with a match of the day that ``quick_find`` leaves: its matches in kickoff order
    (at most one day of one league) and their number."""
    found = quick_find(day_matches, query)
    match = F.struct("kickoff_utc", "id", *[x for x in found.columns if x not in ("kickoff_utc", "id", "league_name")])
    return found.groupBy("league_name").agg(F.count(F.lit(1)).alias("n_matches"), F.array_sort(F.collect_list(match)).alias("matches"))


# P04 -----------------------------------------------------------------------------
def ticker(day_matches: DataFrame, n: int = 10) -> DataFrame:
    return day_matches.orderBy(c("kickoff_utc").asc_nulls_last(), c("id")).limit(n)


# P05 / P06 -----------------------------------------------------------------------
def next_match(fixtures: DataFrame) -> DataFrame:
    """Earliest upcoming fixture per (team, season); NULL dates last."""
    lf = long_form(fixtures.select("fixture_id", "league_id", "season_year", "fixture_date", "status",
                                   "home_team_id", "away_team_id", "home_score", "away_score"))
    up = lf.where(c("status").isin(S.UPCOMING))
    return top_n_per_group(up, ["team_id", "season_year"],
                           [c("fixture_date").asc_nulls_last(), c("fixture_id")], 1).select(
        "team_id", "season_year", "fixture_id", "fixture_date", "opponent_id", "is_home")


def last5_results(fixtures: DataFrame, n: int = 5) -> DataFrame:
    """Last ``n`` finished fixtures per (team, season), newest first, with
    opponent, score text and W/D/L (missing score -> D)."""
    lf = long_form(fixtures.select("fixture_id", "league_id", "season_year", "fixture_date", "status",
                                   "home_team_id", "away_team_id", "home_score", "away_score"),
                   extra=["home_score", "away_score"])
    played = lf.where(c("status").isin(S.FINISHED))
    top = top_n_per_group(played, ["team_id", "season_year"],
                          [c("fixture_date").desc_nulls_last(), c("fixture_id").desc()], n, rank_col="recency")
    both = c("goals_for").isNotNull() & c("goals_against").isNotNull()
    return top.select(
        "team_id", "season_year", "recency", "fixture_id", "opponent_id", "is_home",
        F.when(both, S.wdl("goals_for", "goals_against")).otherwise("D").alias("result"),
        F.when(c("home_score").isNotNull() & c("away_score").isNotNull(),
               F.concat(c("home_score").cast("string"), F.lit("–"), c("away_score").cast("string")))
        .otherwise("").alias("score_text"))


# P07 / P08 / P09 -----------------------------------------------------------------
def substitution_numbers(timeline: DataFrame) -> DataFrame:
    """Running substitution number per (fixture, team) in match order."""
    w = (Window.partitionBy("fixture_id", "team_id")
         .orderBy("minute", "minute_extra", "event_id")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    is_sub = F.lower(c("type")) == "substitution"
    return timeline.withColumn("sub_no", F.when(is_sub, F.count_if(is_sub).over(w)))


def phase_of(minute) -> F.Column:
    m = F.coalesce(minute, F.lit(0))
    return F.when(m < 46, "first").when(m < 91, "second").otherwise("extra")


def timeline_phases(timeline: DataFrame, fixtures: DataFrame) -> DataFrame:
    """One row per (fixture, minute, extra) with its phase and the home and
    away event lists (each ordered by substitution number, then event id).
    Lists hold one minute of one match, so they stay small."""
    t = substitution_numbers(timeline).join(fixtures.select("fixture_id", "home_team_id"), "fixture_id")
    ev = F.struct(F.coalesce(c("sub_no"), F.lit(0)).alias("sub_no"), c("event_id"), c("type"), c("player"),
                  c("assist"), c("detail"))
    return (t.withColumn("phase", phase_of(c("minute")))
            .groupBy("fixture_id", "phase", "minute", "minute_extra").agg(
                F.array_sort(F.collect_list(F.when(c("team_id") == c("home_team_id"), ev))).alias("home"),
                F.array_sort(F.collect_list(F.when(~(c("team_id") == c("home_team_id"))
                                                   | c("team_id").isNull(), ev))).alias("away")))


def timeline_phase_counts(timeline: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Flat check of P07: events per (fixture, phase, side)."""
    t = timeline.join(fixtures.select("fixture_id", "home_team_id"), "fixture_id")
    side = F.when(c("team_id") == c("home_team_id"), "home").otherwise("away")
    return (t.withColumn("phase", phase_of(c("minute"))).withColumn("side", side)
            .groupBy("fixture_id", "phase", "side").agg(F.count(F.lit(1)).alias("n_events"),
                                                        F.count_distinct("minute", "minute_extra").alias("n_rows")))


def event_text(timeline_with_subs: DataFrame) -> DataFrame:
    """Chip label, primary and secondary text per event (input carries sub_no)."""
    t = F.lower(c("type"))
    d = F.lower(F.coalesce(c("detail"), F.lit("")))
    who = F.coalesce(c("player"), F.lit("—"))
    primary = (F.when(t == "substitution",
                      F.trim(F.concat(who, F.lit(" · substitution "),
                                      F.coalesce(c("sub_no").cast("string"), F.lit("")))))
               .when(t == "goal", F.concat(who, F.when(d.contains("penalty"), " · penalty")
                                           .when(d.contains("own goal"), " · own goal").otherwise("")))
               .otherwise(F.concat(who, F.when(c("detail").isNotNull() & (c("detail") != ""),
                                               F.concat(F.lit(" · "), c("detail"))).otherwise(""))))
    secondary = (F.when((t == "goal") & c("assist").isNotNull(), F.concat(F.lit("assist "), c("assist")))
                 .when((t == "substitution") & c("assist").isNotNull(), F.concat(F.lit("for "), c("assist")))
                 .otherwise(""))
    return timeline_with_subs.select(
        "fixture_id", "event_id", S.timeline_chip(t, c("detail")).alias("chip"),
        S.minute_text(c("minute"), c("minute_extra")).alias("minute_text"),
        primary.alias("primary_text"), secondary.alias("secondary_text"))


# P10 -----------------------------------------------------------------------------
# The 12 compared statistics, in display order (key, label, kind).
STAT_ROWS = [
    ("possession", "Possession", "possession"),
    ("total_shots", "Total Shots", "value"),
    ("shots_on_goal", "Shots on Target", "value"),
    ("shots_inside_box", "Shots Inside Box", "value"),
    ("shots_outside_box", "Shots Outside Box", "value"),
    ("corners", "Corners", "value"),
    ("offsides", "Offsides", "value"),
    ("total_passes", "Total Passes", "value"),
    ("pass_accuracy", "Pass Accuracy", "value"),
    ("fouls", "Fouls", "value"),
    ("yellow_cards", "Yellow Cards", "value"),
    ("red_cards", "Red Cards", "value"),
]


def stat_comparison(by_side: DataFrame) -> DataFrame:
    """Input: ``serve.stats_by_side``. Long table (fixture, stat) with home,
    away, winner side, and possession shares normalised to 100."""
    stack = ", ".join(f"{i}, '{label}', home.{key}, away.{key}, '{kind}'"
                      for i, (key, label, kind) in enumerate(STAT_ROWS))
    long = by_side.selectExpr(
        "fixture_id", f"stack({len(STAT_ROWS)}, {stack}) as (stat_order, stat, home_value, away_value, kind)")
    hv = F.coalesce(c("home_value"), F.lit(0))
    av = F.coalesce(c("away_value"), F.lit(0))
    lp = F.least(F.greatest(hv, F.lit(0)), F.lit(100)).cast("double")
    rp = F.least(F.greatest(av, F.lit(0)), F.lit(100)).cast("double")
    total = lp + rp
    return long.select(
        "fixture_id", "stat_order", "stat", "home_value", "away_value",
        F.when(hv > av, "home").when(av > hv, "away").otherwise("none").alias("winner"),
        # Shares as exact decimals (4 places): equal across engines, unlike doubles.
        F.when(c("kind") == "possession", F.when(total > 0, F.round(lp * 100 / total, 4)).otherwise(lp))
        .cast("decimal(7,4)").alias("home_bar_pct"),
        F.when(c("kind") == "possession", F.when(total > 0, F.round(rp * 100 / total, 4)).otherwise(rp))
        .cast("decimal(7,4)").alias("away_bar_pct"))


# P11 -----------------------------------------------------------------------------
def news_feed(pages: DataFrame, as_of) -> DataFrame:
    """Concatenated pages with repeated article ids dropped (the first page a
    row appeared on wins) and a relative age."""
    first = top_n_per_group(pages, ["article_id"], [c("page_no"), c("page_rank")], 1)
    ts = F.lit(str(as_of)).cast("timestamp_ntz") if not isinstance(as_of, F.Column) else as_of
    return first.withColumn("age", S.time_ago(c("published_at_utc"), ts))
