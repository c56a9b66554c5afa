"""Flatteners (F01–F14): parsed snapshot documents -> typed staging rows.

Input is the output of :func:`touchline.sources.snapshots.read_snapshots`
(``file_path``, ``doc``, ``is_valid``, ``error_reason``) plus scope columns
taken from the path or the work-list (league, season). Arrays are exploded
with ``posexplode`` so (file_path, position...) gives every staging row a
deterministic surrogate order (``stg_order`` struct) — Spark has no stable
row id, and ``monotonically_increasing_id`` is not stable across runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions import scalars as S

c = F.col

# Statistic type names of the API and their columns (two
# spellings exist for the box-shot statistics).
STAT_TYPES = {
    "Shots on Goal": "shots_on_goal",
    "Shots off Goal": "shots_off_goal",
    "Shots insidebox": "shots_inside_box",
    "Shots inside box": "shots_inside_box",
    "Shots outsidebox": "shots_outside_box",
    "Shots outside box": "shots_outside_box",
    "Blocked Shots": "blocked_shots",
    "Goalkeeper Saves": "goalkeeper_saves",
    "Total Shots": "total_shots",
    "Corner Kicks": "corners",
    "Offsides": "offsides",
    "Fouls": "fouls",
    "Ball Possession": "possession",
    "Yellow Cards": "yellow_cards",
    "Red Cards": "red_cards",
    "Total passes": "total_passes",
    "Passes accurate": "passes_accurate",
    "Passes %": "pass_accuracy",
    "expected_goals": "expected_goals",
    "goals_prevented": "goals_prevented",
}
PERCENT_STATS = {"possession", "pass_accuracy"}
FLOAT_STATS = {"expected_goals", "goals_prevented"}
NEWS_MANDATORY = ["id", "webTitle", "webPublicationDate"]


# F01 -----------------------------------------------------------------------------
def flatten_fixtures(docs: DataFrame) -> DataFrame:
    """One row per response item with a ``fixture``; league and season come
    from the scope columns (``league_id``, ``season_year``), not the payload."""
    items = docs.select("file_path", "league_id", "season_year", F.posexplode("doc.response").alias("pos", "r"))
    items = items.where(c("r.fixture").isNotNull())
    return items.select(
        c("r.fixture.id").alias("fixture_id"), "league_id", "season_year",
        c("r.teams.home.id").alias("home_team_id"), c("r.teams.away.id").alias("away_team_id"),
        F.try_to_timestamp(c("r.fixture.date")).cast("timestamp_ntz").alias("fixture_date"),
        c("r.fixture.status.short").alias("status"), c("r.league.round").alias("round"),
        c("r.goals.home").alias("home_score"), c("r.goals.away").alias("away_score"),
        c("r.fixture.venue.id").alias("venue_id"),
        F.struct("file_path", "pos").alias("stg_order"))


# F02 -----------------------------------------------------------------------------
def flatten_standings(docs: DataFrame) -> DataFrame:
    """response[] -> league.standings[] (groups) -> rows; missing group -> ''."""
    r = docs.select("file_path", "league_id", "season_year", F.posexplode("doc.response").alias("p1", "r"))
    g = r.select("*", F.posexplode("r.league.standings").alias("p2", "grp"))
    x = g.select("*", F.posexplode("grp").alias("p3", "s"))
    return x.select(
        "league_id", "season_year", c("s.team.id").alias("team_id"),
        F.coalesce(F.nullif(c("s.group"), F.lit("")), F.lit("")).alias("group_label"),
        c("s.rank").alias("rank"), c("s.points").alias("points"), c("s.all.played").alias("played"),
        c("s.all.win").alias("win"), c("s.all.draw").alias("draw"), c("s.all.lose").alias("lose"),
        c("s.all.goals.for").alias("goals_for"), c("s.all.goals.against").alias("goals_against"),
        c("s.goalsDiff").alias("goals_diff"), F.struct("file_path", "p1", "p2", "p3").alias("stg_order"))


# F03 -----------------------------------------------------------------------------
def flatten_events(docs: DataFrame) -> DataFrame:
    """Fixture id from ``parameters.fixture``, else from the file name
    (``events_<id>.json``); documents with neither are ignored."""
    fid = F.coalesce(c("doc.parameters.fixture").try_cast("int"),
                     S.key_from_path(c("file_path"), r"events_(\d+)\.json$"))
    d = docs.withColumn("fixture_id", fid).where(c("fixture_id").isNotNull())
    e = d.select("file_path", "fixture_id", F.posexplode("doc.response").alias("pos", "e"))
    return e.select(
        "fixture_id", c("e.time.elapsed").alias("minute"), c("e.time.extra").alias("minute_extra"),
        c("e.team.id").alias("team_id"), c("e.player.id").alias("player_id"),
        c("e.assist.id").alias("assist_player_id"), c("e.type").alias("event_type"),
        c("e.detail").alias("event_detail"), c("e.comments").alias("comments"),
        F.struct("file_path", "pos").alias("stg_order"))


# F04 -----------------------------------------------------------------------------
def _stat_value(col_name: str, v: Column) -> Column:
    if col_name in PERCENT_STATS:
        v = F.regexp_replace(v, "%$", "")
    v = F.trim(v)
    if col_name in FLOAT_STATS:
        return v.try_cast("double").try_cast("decimal(5,2)")
    return v.try_cast("int")


def pivot_statistics(docs: DataFrame) -> DataFrame:
    """EAV ``{type, value}`` list -> one typed column per statistic. Synonyms
    map to one column; the last duplicate type wins (``map_from_entries``
    with LAST_WIN de-duplication, set by the session); unparseable -> NULL.
    A document with an empty or invalid response gives one invalid row."""
    fid = S.key_from_path(c("file_path"), r"statistics_(\d+)\.json$")
    d = docs.withColumn("fixture_id", fid)
    mapping = F.create_map(*[x for k, v in STAT_TYPES.items() for x in (F.lit(k), F.lit(v))])
    has_resp = F.coalesce(F.size(c("doc.response")) > 0, F.lit(False))
    ok = d.where(has_resp & c("is_valid"))
    bad = d.where(~(has_resp & c("is_valid")))
    t = ok.select("file_path", "fixture_id", F.posexplode("doc.response").alias("pos", "t"))
    kv = F.filter(F.transform(c("t.statistics"), lambda s: F.struct(
        F.element_at(mapping, s["type"]).alias("k"), s["value"].alias("v"))), lambda e: e["k"].isNotNull())
    t = t.withColumn("__m", F.map_from_entries(kv))
    cols = sorted(set(STAT_TYPES.values()), key=list(STAT_TYPES.values()).index)
    good = t.select("fixture_id", c("t.team.id").alias("team_id"),
                    *[_stat_value(x, F.element_at(c("__m"), F.lit(x))).alias(x) for x in cols],
                    F.lit(True).alias("is_valid"), F.lit(None).cast("string").alias("error_reason"),
                    F.struct("file_path", "pos").alias("stg_order"))
    invalid = bad.select("fixture_id", F.lit(None).cast("int").alias("team_id"),
                         *[F.lit(None).cast("decimal(5,2)" if x in FLOAT_STATS else "int").alias(x) for x in cols],
                         F.lit(False).alias("is_valid"),
                         F.coalesce(c("error_reason"), F.lit("empty or invalid 'response' array")).alias("error_reason"),
                         F.struct("file_path", F.lit(0).alias("pos")).alias("stg_order"))
    return good.unionByName(invalid)


def pivot_stat_entries(entries: DataFrame, keys, type_col: str = "type", value_col: str = "value",
                       order_col: str = "pos") -> DataFrame:
    """F04 on a long entity-attribute-value table: one row per ``keys`` with a
    typed column per statistic; the last entry of a type (largest
    ``order_col``) wins. Conditional ``max_by`` per column: partial
    aggregation before the shuffle, so a hot key never gathers its rows in
    one place."""
    mapping = F.create_map(*[x for k, v in STAT_TYPES.items() for x in (F.lit(k), F.lit(v))])
    e = entries.withColumn("__col", F.element_at(mapping, c(type_col))).where(c("__col").isNotNull())
    cols = list(dict.fromkeys(STAT_TYPES.values()))
    aggs = [_stat_value(x, F.max_by(F.when(c("__col") == x, c(value_col).cast("string")),
                                    F.when(c("__col") == x, c(order_col)))).alias(x) for x in cols]
    return e.groupBy(*keys).agg(*aggs)


# F05 -----------------------------------------------------------------------------
def flatten_players(docs: DataFrame) -> DataFrame:
    """response[0].player identity; null / 0 id rejected."""
    p = c("doc.response")[0]["player"]
    out = docs.select(
        p["id"].alias("player_id"), p["firstname"].alias("firstname"), p["lastname"].alias("lastname"),
        p["name"].alias("full_name"), F.try_to_date(p["birth"]["date"]).alias("birth_date"),
        p["birth"]["country"].alias("birth_country"), p["nationality"].alias("nationality"),
        p["height"].alias("height"), p["weight"].alias("weight"), p["photo"].alias("photo_url"),
        F.struct("file_path").alias("stg_order"))
    return out.where(F.coalesce(c("player_id"), F.lit(0)) != 0)


# F06 -----------------------------------------------------------------------------
def flatten_player_stats(docs: DataFrame, strict_league: bool = True) -> DataFrame:
    """One row per statistics block of the target league (``league_id`` scope
    column) unless non-strict; all four ids required non-zero; integers via
    float ('6.700000' -> 6), blanks -> NULL; the API spells 'appearences'."""
    p = c("doc.response")[0]
    blocks = F.transform(p["statistics"], lambda s, pos: F.struct(pos.alias("pos"), s.alias("s")))
    if strict_league:
        blocks = F.filter(blocks, lambda x: x["s"]["league"]["id"] == c("league_id"))
    # blocks of other leagues go before they are rows, and a row does not carry its document
    b = docs.select("file_path", "league_id", "season_year", p["player"]["id"].alias("player_id"), blocks.alias("blocks"))
    b = b.select("file_path", "league_id", "season_year", "player_id", F.inline("blocks"))
    i = S.to_int_lenient
    out = b.select(
        "player_id", c("s.team.id").alias("team_id"), c("s.league.id").alias("stat_league_id"),
        F.coalesce(c("s.league.season"), c("season_year")).alias("season"),
        c("s.games.position").alias("position"), i(c("s.games.number")).alias("shirt_number"),
        i(c("s.games.appearences")).alias("appearances"), i(c("s.games.lineups")).alias("lineups"),
        i(c("s.games.minutes")).alias("minutes_played"), i(c("s.goals.total")).alias("goals"),
        i(c("s.goals.assists")).alias("assists"), i(c("s.goals.saves")).alias("saves"),
        i(c("s.dribbles.attempts")).alias("dribbles_attempts"), i(c("s.dribbles.success")).alias("dribbles_success"),
        i(c("s.fouls.committed")).alias("fouls_committed"), i(c("s.tackles.total")).alias("tackles_total"),
        i(c("s.passes.total")).alias("passes_total"), i(c("s.passes.key")).alias("passes_key"),
        S.to_num_lenient(c("s.passes.accuracy")).alias("pass_accuracy"),
        i(c("s.cards.yellow")).alias("yellow_cards"), i(c("s.cards.red")).alias("red_cards"),
        F.struct("file_path", "pos").alias("stg_order"))
    out = out.withColumnRenamed("stat_league_id", "league_id")
    nz = F.lit(True)
    for k in ("player_id", "team_id", "league_id", "season"):
        nz = nz & (F.coalesce(c(k), F.lit(0)) != 0)
    return out.where(nz)


# F07 / F08 / F09 -----------------------------------------------------------------
def flatten_teams(docs: DataFrame) -> DataFrame:
    r = docs.select("file_path", "league_id", "season_year", F.posexplode("doc.response").alias("pos", "r"))
    return r.select(c("r.team.id").alias("team_id"), c("r.team.name").alias("team_name"),
                    c("r.team.country").alias("team_country"), c("r.team.logo").alias("team_logo_url"),
                    c("r.venue.id").alias("venue_id"), "league_id", "season_year",
                    F.struct("file_path", "pos").alias("stg_order"))


def flatten_venues(docs: DataFrame) -> DataFrame:
    """Venue objects with an id; the first occurrence (file, position) wins."""
    from touchline.functions.windows import latest_by
    r = docs.select("file_path", F.posexplode("doc.response").alias("pos", "r")).where(c("r.venue.id").isNotNull())
    v = r.select(c("r.venue.id").alias("venue_id"), c("r.venue.name").alias("name"), c("r.venue.city").alias("city"),
                 c("r.venue.country").alias("country"), c("r.venue.capacity").alias("capacity"),
                 F.struct("file_path", "pos").alias("stg_order"))
    return latest_by(v, ["venue_id"], [c("stg_order")])


def team_bridge(stg_teams: DataFrame) -> DataFrame:
    return stg_teams.select("team_id", "league_id", "season_year").where(c("team_id").isNotNull()).distinct()


# F10 / F11 / F12 -----------------------------------------------------------------
def flatten_directory(docs: DataFrame) -> DataFrame:
    e = docs.select(F.explode("doc.response").alias("e"))
    return e.select(c("e.league.id").alias("league_id"), c("e.league.name").alias("name"),
                    c("e.country.name").alias("country"), c("e.league.logo").alias("logo"),
                    F.array_sort(F.transform(c("e.seasons"), lambda s: s["year"])).alias("seasons"))


def flatten_leagues(docs: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per enabled league and year first..last: league attributes and the
    season object of that year. ``docs`` carries ``league_id`` and
    ``season_year`` scope columns (one document per league-year); a missing or
    empty document simply yields no row. Returns (leagues, seasons)."""
    e = docs.select("league_id", "season_year", F.explode("doc.response").alias("e"))
    e = e.join(catalog.where(c("is_enabled")).select("league_id", "first_season", "last_season"), "league_id")
    e = e.where(c("season_year").between(c("first_season"), F.coalesce(c("last_season"), c("season_year"))))
    season = F.filter(c("e.seasons"), lambda s: s["year"] == c("season_year"))[0]
    leagues = e.select("league_id", "season_year", c("e.league.name").alias("name"),
                       c("e.country.name").alias("country"), c("e.league.logo").alias("logo"))
    seasons = e.where(season.isNotNull()).select(
        "league_id", "season_year", F.try_to_date(season["start"]).alias("start_date"),
        F.try_to_date(season["end"]).alias("end_date"), F.coalesce(season["current"], F.lit(False)).alias("is_current"),
        S.season_label(c("season_year")).alias("season_str"))
    return leagues, seasons


def league_document_counts(docs: DataFrame, worklist: DataFrame) -> DataFrame:
    """F11 counts per league over the work-list's (league, year)s: documents
    ``expected``, ``missing`` (no document), ``empty`` (no response items), ``loaded``."""
    state = docs.groupBy("league_id", "season_year").agg(F.max(F.coalesce(F.size("doc.response") > 0, F.lit(False))).alias("__full"))
    j = worklist.select("league_id", "season_year").distinct().join(state, ["league_id", "season_year"], "left")
    return j.groupBy("league_id").agg(
        F.count(F.lit(1)).alias("expected"), F.count_if(c("__full").isNull()).alias("missing"),
        F.count_if(~c("__full")).alias("empty"), F.count_if(c("__full")).alias("loaded"))


def flatten_seasons(docs: DataFrame, catalog: DataFrame) -> DataFrame:
    """one document per league (``league_id`` scope column) -> one row per
    season object within the catalog's first..last season (open last = no
    upper bound); ``current`` as a boolean, canonical season label."""
    e = docs.select("league_id", F.explode("doc.response").alias("e"))
    s = e.select("league_id", F.explode("e.seasons").alias("s"))
    s = s.join(catalog.where(c("is_enabled")).select("league_id", "first_season", "last_season"), "league_id")
    s = s.where((c("s.year") >= c("first_season")) & (c("last_season").isNull() | (c("s.year") <= c("last_season"))))
    return s.select("league_id", c("s.year").alias("season_year"), F.try_to_date(c("s.start")).alias("start_date"),
                    F.try_to_date(c("s.end")).alias("end_date"),
                    F.coalesce(c("s.current"), F.lit(False)).alias("is_current"),
                    S.season_label(c("s.year")).alias("season_str"))


# F13 -----------------------------------------------------------------------------
def flatten_news(docs: DataFrame) -> DataFrame:
    """One row per result; short URL preferred; summary = trailText without
    tags and entities; first missing mandatory key only, then '; missing url'.
    ``docs`` carries ``tab`` and ``fetched_at_utc`` columns."""
    r = docs.select("tab", "fetched_at_utc", "file_path", F.posexplode("doc.response.results").alias("pos", "r"))
    url = F.coalesce(F.nullif(c("r.fields.shortUrl"), F.lit("")), F.nullif(c("r.webUrl"), F.lit("")))
    missing = F.lit(None).cast("string")
    for k in reversed(NEWS_MANDATORY):
        v = c(f"r.{k}")
        missing = F.when(v.isNull() | (v == ""), F.lit(f"missing {k}")).otherwise(missing)
    reason = F.when(url.isNull(), F.when(missing.isNull(), F.lit("missing url"))
                    .otherwise(F.concat(missing, F.lit("; missing url")))).otherwise(missing)
    return r.select(
        c("r.id").alias("article_id"), "tab", c("r.webTitle").alias("title"),
        S.strip_html(c("r.fields.trailText")).alias("summary"),
        c("r.fields.thumbnail").alias("image_url"), url.alias("url"),
        F.try_to_timestamp(c("r.webPublicationDate")).cast("timestamp_ntz").alias("published_at_utc"),
        "fetched_at_utc", F.to_json(c("r")).alias("raw"),
        reason.isNull().alias("is_valid"), reason.alias("error_reason"),
        F.struct("file_path", "pos").alias("stg_order"))


# F14 -----------------------------------------------------------------------------
def players_from_pages_and_squads(pages: DataFrame, squads: DataFrame) -> DataFrame:
    """Players seen on league pages, plus a minimal record for every squad
    member not seen there (set difference by anti join). Inputs are parsed
    page / squad documents."""
    seen = pages.select(F.explode("doc.response").alias("r")).select(
        c("r.player.id").alias("player_id"), c("r.player.name").alias("name"), c("r.player.photo").alias("photo"))
    sq = (squads.select(F.explode("doc.response").alias("r")).select(F.explode("r.players").alias("p"))
          .select(c("p.id").alias("player_id"), c("p.name").alias("name"), c("p.photo").alias("photo")))
    return supplement_players(seen, sq)


def supplement_players(seen: DataFrame, squad: DataFrame) -> DataFrame:
    """F14 on flat (player_id, name, photo) rows: one row per player seen on
    pages (first name wins), plus squad members not seen, tagged by source."""
    def one_per_id(df):
        from touchline.functions.windows import latest_by
        return latest_by(df.where(c("player_id").isNotNull()), ["player_id"],
                         [c("name").asc_nulls_last(), c("photo").asc_nulls_last()])
    s = one_per_id(seen).withColumn("source", F.lit("page"))
    extra = (one_per_id(squad).join(s.select("player_id"), "player_id", "left_anti")
             .withColumn("source", F.lit("squad")))
    return s.unionByName(extra)
