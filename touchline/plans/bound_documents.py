"""Flattener units (F01–F03, F05–F13) and the news batches (S06) on documents made of the test tables.

Each whole table is written as the API's documents (``to_json`` of the payload's
shape, a page of at most ``PAGE`` items a document), parsed with the
payload's schema as the snapshot reader does, and flattened. The oracle reads
the table the documents were made of, with the same defects planted: items
without their object, blank and textual numbers, null groups, and documents whose JSON is cut off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline import schemas as SC
from touchline.functions.joins import stored
from touchline.operators import flatten as FL
from touchline.plans.registry import bound_query
from touchline.sources import snapshots as SN

c = F.col
PAGE = 64      # possible ids in a page, so a document's size does not grow with the table


def _documents(rows: DataFrame, item: Column, page: list[str], order: str, root=lambda items: F.struct(items.alias("response"))) -> DataFrame:
    """One JSON text a page: (page columns..., value)."""
    items = rows.select(*page, c(order).alias("__o"), item.alias("__item"))
    grouped = items.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct("__o", "__item"))).alias("__items"))
    return grouped.select(*page, F.to_json(root(c("__items.__item")), {"ignoreNullFields": "false"}).alias("value"))


def _parsed(docs: DataFrame, schema, path: Column) -> DataFrame:
    """As ``read_snapshots`` gives them: file_path, doc, is_valid, error_reason and the scope columns."""
    parsed = SN.parse_once(docs, lambda v: F.try_parse_json(v).isNotNull(), schema)
    return parsed.withColumns({"file_path": path, "error_reason": F.lit(None).cast("string")})


def _page(x: str) -> Column:
    return F.floor(c(x) / PAGE).alias("page")


def _cut(docs: DataFrame, when: Column) -> DataFrame:
    """Documents whose JSON ends too early."""
    return docs.withColumn("value", F.when(when, F.expr("left(value, length(value) - 3)")).otherwise(c("value")))


# F01 -----------------------------------------------------------------------------
@bound_query("flatten_fixtures", """
select cast(fixture_id as integer) as fixture_id, league_id, season_year, home_team_id, away_team_id, cast(fixture_date as timestamp) as fixture_date, status, round,
  home_score, away_score, venue_id
from v_fixtures where fixture_id % 101 <> 0 and floor(fixture_id / 64) % 19 <> 3
""")
def q_flatten_fixtures(b):
    f = b.v_fixtures.withColumns({"page": F.floor(c("fixture_id") / PAGE)})
    item = F.struct(
        F.when(c("fixture_id") % 101 != 0, F.struct(
            c("fixture_id").alias("id"), F.date_format("fixture_date", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("date"),
            F.struct(c("status").alias("short")).alias("status"), F.struct(c("venue_id").alias("id")).alias("venue"))).alias("fixture"),
        F.struct(F.struct(c("home_team_id").alias("id")).alias("home"), F.struct(c("away_team_id").alias("id")).alias("away")).alias("teams"),
        F.struct(c("round")).alias("league"), F.struct(c("home_score").alias("home"), c("away_score").alias("away")).alias("goals"))
    docs = _cut(_documents(f, item, ["league_id", "season_year", "page"], "fixture_id"), c("page") % 19 == 3)
    parsed = _parsed(docs, SC.FIXTURES, F.concat_ws("/", "league_id", "season_year", "page"))
    return FL.flatten_fixtures(parsed.where("is_valid")).drop("stg_order")


# F02 -----------------------------------------------------------------------------
@bound_query("flatten_standings", """
select league_id, season_year, team_id, case when league_id = 1 and team_id % 2 = 0 then 'Group A' else '' end as group_label,
  rnk as rank, pts as points, n as played, w as win, d as draw, l as lose, gf as goals_for, ga as goals_against,
  case when team_id % 10 <> 0 then gf - ga end as goals_diff
from v_standings_base
""")
def q_flatten_standings(b):
    group = F.when((c("league_id") == 1) & (c("team_id") % 2 == 0), "Group A").when(c("team_id") % 3 == 0, "")
    row = F.struct(F.struct(c("team_id").alias("id")).alias("team"), c("rnk").alias("rank"), c("pts").alias("points"),
                   F.when(c("team_id") % 10 != 0, c("gf") - c("ga")).alias("goalsDiff"), group.alias("group"),
                   F.struct(c("n").alias("played"), c("w").alias("win"), c("d").alias("draw"), c("l").alias("lose"),
                            F.struct(c("gf").alias("for"), c("ga").alias("against")).alias("goals")).alias("all"))
    tables = (b.v_standings_base.withColumn("__two", c("team_id") % 2)
              .groupBy("league_id", "season_year", "__two").agg(F.collect_list(row).alias("rows"))
              .groupBy("league_id", "season_year").agg(F.collect_list("rows").alias("standings")))
    docs = tables.select("league_id", "season_year", F.to_json(F.struct(F.array(F.struct(F.struct("standings").alias("league"))).alias("response")),
                                                               {"ignoreNullFields": "false"}).alias("value"))
    return FL.flatten_standings(_parsed(docs, SC.STANDINGS, F.concat_ws("/", "league_id", "season_year"))).drop("stg_order")


# F03 -----------------------------------------------------------------------------
@bound_query("flatten_events", """
select cast(fixture_id as integer) as fixture_id, minute, minute_extra, team_id, player_id, assist_player_id, event_type, event_detail,
  case when minute > 45 then 'late' end as comments
from v_stg_events where fixture_id >= 0 and fixture_id % 23 <> 5
""")
def q_flatten_events(b):
    """Fixture id from the parameters or, in every second document, from the file's name; documents with neither are passed over."""
    e = b.v_stg_events.where("fixture_id >= 0")
    item = F.struct(
        F.struct(c("minute").alias("elapsed"), c("minute_extra").alias("extra")).alias("time"), F.struct(c("team_id").alias("id")).alias("team"),
        F.struct(c("player_id").alias("id")).alias("player"), F.struct(c("assist_player_id").alias("id")).alias("assist"),
        c("event_type").alias("type"), c("event_detail").alias("detail"), F.when(c("minute") > 45, "late").alias("comments"))
    odd, lost = c("fixture_id") % 2 == 1, c("fixture_id") % 23 == 5
    docs = _documents(e, item, ["fixture_id"], "ord1", lambda items: F.struct(
        F.struct(F.when(odd & ~lost, c("fixture_id").cast("string")).alias("fixture")).alias("parameters"), items.alias("response")))
    path = F.when(odd | lost, F.lit("run/part.json")).otherwise(F.concat(F.lit("run/events_"), c("fixture_id"), F.lit(".json")))
    return FL.flatten_events(_parsed(docs, SC.EVENTS, path).drop("fixture_id")).drop("stg_order")


# F05 / F06 -----------------------------------------------------------------------
@bound_query("flatten_players", """
select player_id, firstname, lastname, full_name, case when player_id % 9 <> 4 then birth_date end as birth_date, 'B' || (player_id % 7) as birth_country,
  'N' || (player_id % 5) as nationality, height, weight, cast(null as varchar) as photo_url
from v_stg_players where coalesce(player_id, 0) <> 0 and stg_player_id % 31 <> 7
""")
def q_flatten_players(b):
    """One document a player; unreadable birth dates are null, cut documents are passed over."""
    p = b.v_stg_players
    born = F.when(c("player_id") % 9 != 4, c("birth_date").cast("string")).otherwise("unknown")
    player = F.struct(c("player_id").alias("id"), "firstname", "lastname", c("full_name").alias("name"),
                      F.struct(born.alias("date"), F.concat(F.lit("B"), c("player_id") % 7).alias("country")).alias("birth"),
                      F.concat(F.lit("N"), c("player_id") % 5).alias("nationality"), "height", "weight")
    docs = p.select("stg_player_id", F.to_json(F.struct(F.array(F.struct(player.alias("player"))).alias("response")),
                                               {"ignoreNullFields": "false"}).alias("value"))
    parsed = _parsed(_cut(docs, c("stg_player_id") % 31 == 7), SC.PLAYER_DOC, c("stg_player_id").cast("string"))
    return FL.flatten_players(parsed.where("is_valid")).drop("stg_order")


@bound_query("flatten_player_stats", """
select player_id, team_id, league_id, season, case when stg_stats_id % 3 = 0 then 'M' end as position, cast(null as integer) as shirt_number,
  case when stg_stats_id % 5 <> 0 then appearances end as appearances, lineups, minutes_played, goals, cast(null as integer) as assists,
  cast(null as integer) as saves, cast(null as integer) as dribbles_attempts, cast(null as integer) as dribbles_success,
  cast(null as integer) as fouls_committed, cast(null as integer) as tackles_total, cast(null as integer) as passes_total,
  cast(null as integer) as passes_key, cast(6.75 as decimal(5,2)) as pass_accuracy, cast(null as integer) as yellow_cards, cast(null as integer) as red_cards
from v_stg_player_stats where coalesce(player_id, 0) <> 0 and team_id <> 0 and league_id <> 0
""")
def q_flatten_player_stats(b):
    """Every row as the block of its league and, beside it, a block of another league, which goes; numbers as text."""
    def block(league: Column) -> Column:
        return F.struct(
            F.struct(c("team_id").alias("id")).alias("team"), F.struct(league.alias("id"), c("season")).alias("league"),
            F.struct(F.when(c("stg_stats_id") % 3 == 0, "M").alias("position"), F.lit("").alias("number"),
                     F.when(c("stg_stats_id") % 5 == 0, " ").otherwise(F.concat(c("appearances"), F.lit(".0"))).alias("appearences"),
                     c("lineups").cast("string").alias("lineups"), F.concat(c("minutes_played"), F.lit(".700000")).alias("minutes")).alias("games"),
            F.struct(c("goals").cast("string").alias("total")).alias("goals"), F.struct(F.lit("6.75").alias("accuracy")).alias("passes"))
    docs = b.v_stg_player_stats.select("stg_stats_id", "ord2", "league_id", c("season").alias("season_year"), F.to_json(F.struct(F.array(F.struct(
        F.struct(c("player_id").alias("id")).alias("player"), F.array(block(c("league_id")), block(c("league_id") + 100)).alias("statistics")
    )).alias("response")), {"ignoreNullFields": "false"}).alias("value"))
    parsed = _parsed(docs, SC.PLAYER_DOC, F.concat_ws("/", "stg_stats_id", "ord2"))
    out = FL.flatten_player_stats(parsed).drop("stg_order")
    return out.withColumn("pass_accuracy", c("pass_accuracy").cast("decimal(5,2)"))


# F07 / F08 / F09 -----------------------------------------------------------------
def _team_docs(b) -> DataFrame:
    t = b.v_bridge.join(b.v_teams.select("team_id", "team_name", "venue_id"), "team_id")
    item = F.struct(
        F.struct(c("team_id").alias("id"), c("team_name").alias("name"), F.lit("C").alias("country")).alias("team"),
        F.struct(c("venue_id").alias("id"), F.concat(F.lit("V"), c("venue_id")).alias("name"), (c("venue_id") * 100).alias("capacity")).alias("venue"))
    docs = _documents(t, item, ["league_id", "season_year"], "team_id")
    return _parsed(docs, SC.TEAMS, F.concat_ws("/", "league_id", "season_year"))


@bound_query("flatten_teams", """
select b.team_id, t.team_name, 'C' as team_country, cast(null as varchar) as team_logo_url, t.venue_id, b.league_id, b.season_year
from v_bridge b join v_teams t on t.team_id = b.team_id
""")
def q_flatten_teams(b):
    return FL.flatten_teams(_team_docs(b)).drop("stg_order")


@bound_query("flatten_venues", """
select distinct t.venue_id, 'V' || t.venue_id as name, cast(null as varchar) as city, cast(null as varchar) as country, t.venue_id * 100 as capacity
from v_bridge b join v_teams t on t.team_id = b.team_id where t.venue_id is not null
""")
def q_flatten_venues(b):
    return FL.flatten_venues(_team_docs(b)).drop("stg_order")


@bound_query("extract_team_bridge", "select distinct b.* from v_bridge b join v_teams t on t.team_id = b.team_id")
def q_extract_team_bridge(b):
    return FL.team_bridge(FL.flatten_teams(_team_docs(b)))


# F10 / F11 / F12 -----------------------------------------------------------------
def _entry(b, seasons: Column) -> Column:
    return F.struct(F.struct(c("league_id").alias("id"), c("league_name").alias("name")).alias("league"),
                    F.struct(c("league_country").alias("name")).alias("country"), seasons.alias("seasons"))


def _league_rows(b) -> DataFrame:
    season = F.struct(c("season_year").alias("year"), c("start_date").cast("string").alias("start"), c("end_date").cast("string").alias("end"),
                      F.when(c("season_year") % 2 == 0, c("is_current")).alias("current"))
    seasons = b.v_seasons.groupBy("league_id").agg(F.collect_list(season).alias("all_seasons"))
    return seasons.join(b.v_leagues, "league_id")


@bound_query("flatten_directory", """
select l.league_id, l.league_name as name, l.league_country as country, cast(null as varchar) as logo,
  list_sort(list(s.season_year)) as seasons
from v_leagues l join v_seasons s on s.league_id = l.league_id group by all
""")
def q_flatten_directory(b):
    docs = _documents(_league_rows(b).withColumn("page", F.lit(1)), _entry(b, c("all_seasons")), ["page"], "league_id")
    return FL.flatten_directory(_parsed(docs, SC.LEAGUES, F.lit("leagues.json")))


def _league_docs(b) -> DataFrame:
    """A document for each league and year; every fifth has no response items, every seventh is absent."""
    rows = b.v_seasons.select("league_id", "season_year").join(_league_rows(b), "league_id")
    rows = rows.where((c("season_year") + c("league_id")) % 7 != 0)
    entry = F.when(c("season_year") % 5 == 0, F.array().cast("array<string>").isNull()).isNotNull()
    items = F.filter(F.array(_entry(b, c("all_seasons"))), lambda _: ~entry)
    docs = rows.select("league_id", "season_year", F.to_json(F.struct(items.alias("response")), {"ignoreNullFields": "false"}).alias("value"))
    return _parsed(docs, SC.LEAGUES, F.concat_ws("/", "league_id", "season_year"))


_LOADED = """(select s.* from v_seasons s join v_catalog k on k.league_id = s.league_id and k.is_enabled
  where s.season_year between k.first_season and coalesce(k.last_season, s.season_year)
    and (s.season_year + s.league_id) % 7 <> 0 and s.season_year % 5 <> 0)"""


@bound_query("flatten_leagues", f"""
select s.league_id, s.season_year, l.league_name as name, l.league_country as country, cast(null as varchar) as logo
from {_LOADED} s join v_leagues l on l.league_id = s.league_id
""")
def q_flatten_leagues(b):
    return FL.flatten_leagues(_league_docs(b), b.v_catalog)[0]


@bound_query("flatten_league_seasons", f"""
select league_id, season_year, start_date, end_date, case when season_year % 2 = 0 then is_current else false end as is_current, season_str
from {_LOADED} s
""")
def q_flatten_league_seasons(b):
    return FL.flatten_leagues(_league_docs(b), b.v_catalog)[1]


@bound_query("league_document_counts", """
select league_id, count(*) as expected, count(*) filter (where (season_year + league_id) % 7 = 0) as missing,
  count(*) filter (where (season_year + league_id) % 7 <> 0 and season_year % 5 = 0) as empty,
  count(*) filter (where (season_year + league_id) % 7 <> 0 and season_year % 5 <> 0) as loaded
from v_seasons group by league_id
""")
def q_league_document_counts(b):
    return FL.league_document_counts(_league_docs(b), b.v_seasons)


@bound_query("flatten_seasons", """
select s.league_id, s.season_year, start_date, end_date, case when season_year % 2 = 0 then is_current else false end as is_current, season_str
from v_seasons s join v_catalog k on k.league_id = s.league_id and k.is_enabled
where season_year >= first_season and (last_season is null or season_year <= last_season)
""")
def q_flatten_seasons(b):
    docs = _documents(_league_rows(b), _entry(b, c("all_seasons")), ["league_id"], "league_name")
    return FL.flatten_seasons(_parsed(docs, SC.LEAGUES, c("league_id").cast("string")), b.v_catalog)


# F13 -----------------------------------------------------------------------------
@bound_query("flatten_news", """
with n as (select *, cast(article_id as bigint) as k from v_news),
items as (select case when k % 17 <> 0 then article_id end as article_id, tab, case when k % 11 <> 0 then title else '' end as title,
    case when k % 13 = 0 then null when k % 3 = 0 then 'https://s.example/' || article_id else url end as url, k,
    date_trunc('second', published_at_utc) as published_at_utc from n)
select article_id, tab, title, 'A & B — <' || k as summary, cast(null as varchar) as image_url, url, published_at_utc,
  timestamp '2024-01-10 00:00:00' as fetched_at_utc,
  article_id is not null and title <> '' and url is not null as is_valid,
  nullif(concat_ws('; ', case when article_id is null then 'missing id' when title = '' then 'missing webTitle' end,
                   case when url is null then 'missing url' end), '') as error_reason
from items
""")
def q_flatten_news(b):
    k = c("article_id").cast("long")
    item = F.struct(
        F.when(k % 17 != 0, c("article_id")).alias("id"), F.when(k % 11 != 0, c("title")).otherwise("").alias("webTitle"),
        F.date_format("published_at_utc", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("webPublicationDate"),
        F.when(k % 13 != 0, c("url")).alias("webUrl"),
        F.struct(F.when((k % 3 == 0) & (k % 13 != 0), F.concat(F.lit("https://s.example/"), "article_id")).otherwise("").alias("shortUrl"),
                 F.concat(F.lit("<p>A &amp; <b>B</b> &mdash; &lt;"), "article_id", F.lit("</p>")).alias("trailText")).alias("fields"))
    n = b.v_news.withColumn("page", F.floor(k / PAGE))
    docs = _documents(n, item, ["tab", "page"], "article_id", lambda items: F.struct(F.struct(items.alias("results")).alias("response")))
    docs = docs.withColumn("fetched_at_utc", F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))
    return FL.flatten_news(_parsed(docs, SC.NEWS, F.concat_ws("/", "tab", "page"))).drop("raw", "stg_order")


# S06 -----------------------------------------------------------------------------
@bound_query("latest_news_batch", """
with files as (select tab, strftime(published_at_utc, '%Y-%m-%dT%H-%M') || '-00' as run_ts from v_news where cast(article_id as bigint) % 4 <> 0)
select tab as tab_dir, max(run_ts) as run_ts, 'news/' || tab || '/run_ts=' || max(run_ts) || '/response.json' as response_path,
  'news/' || tab || '/run_ts=' || max(run_ts) || '/_meta.json' as meta_path
from files group by tab
""")
def q_latest_news_batch(b):
    """Every news item as a batch's file; a quarter of the batches have no response."""
    run = F.date_format("published_at_utc", "yyyy-MM-dd'T'HH-mm-'00'")
    name = F.when(c("article_id").cast("long") % 4 == 0, "other.json").otherwise("response.json")
    return SN.latest_batch(b.v_news.select(F.concat(F.lit("news/"), "tab", F.lit("/run_ts="), run, F.lit("/"), name).alias("file_path"))).distinct()
