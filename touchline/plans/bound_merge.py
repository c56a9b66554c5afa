"""Merge units (M01–M16, M07a) bound to the test tables.

A merge needs a prior target. Each one is derived from the whole bound
table with a deterministic alteration (some rows absent, some values
changed) so inserts, updates and unchanged rows all occur. The oracle states
``INSERT ... ON CONFLICT DO UPDATE [WHERE ...]`` as a full outer join with
one CASE per column (``upsert_oracle``).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import form
from touchline.operators import merge as M
from touchline.operators import validate as V
from touchline.plans import bound_validate as BV
from touchline.plans.registry import bound_query

FINISHED_SQL = "('FT','AET','PEN')"
AS_OF = "2024-01-15 00:00:00"
OLD = "2023-01-01 00:00:00"
c = F.col


def upsert_oracle(src: str, tgt: str, keys, cols, tcols_extra=(), when: str = "distinct",
                  update_exprs: dict | None = None, audit=("load_date", "upd_date"),
                  src_extra=()) -> str:
    """SQL for ON CONFLICT semantics. ``src`` / ``tgt`` are CTE bodies;
    ``cols`` are updated, ``tcols_extra`` are target-only columns kept on update
    (taken from the source on insert when listed in ``src_extra``)."""
    update_exprs = update_exprs or {}
    on = " and ".join(f"t.{k} = s.{k}" for k in keys)
    kcols = ", ".join(f"coalesce(s.{k}, t.{k}) as {k}" for k in keys)
    sc = ", ".join(f"s.{x} as s_{x}" for x in list(cols) + list(src_extra))
    tc = ", ".join(f"t.{x} as t_{x}" for x in list(cols) + list(tcols_extra) + [a for a in audit if a])
    if when == "always":
        changed = "true"
    elif when == "distinct":
        changed = " or ".join(f"t_{x} is distinct from s_{x}" for x in cols) or "false"
    else:
        changed = when
    sel = [", ".join(keys)]
    for x in cols:
        upd = update_exprs.get(x, f"s_{x}")
        sel.append(f"case when action = 'insert' then s_{x} when action = 'update' then {upd} else t_{x} end as {x}")
    for x in tcols_extra:
        ins = f"s_{x}" if x in src_extra else "null"
        sel.append(f"case when action = 'insert' then {ins} else t_{x} end as {x}")
    load_c, upd_c = audit
    if load_c:
        sel.append(f"case when action = 'insert' then timestamp '{AS_OF}' else t_{load_c} end as {load_c}")
    if upd_c:
        sel.append(f"case when action in ('insert', 'update') then timestamp '{AS_OF}' else t_{upd_c} end as {upd_c}")
    sel.append("action")
    k0 = keys[0]
    return f"""
with src as ({src}), tgt as ({tgt}),
j as (select {", ".join(x for x in (kcols, sc, tc) if x)}, t.{k0} is not null as in_t, s.{k0} is not null as in_s
      from tgt t full outer join src s on {on}),
a as (select *, case when in_s and not in_t then 'insert'
                     when in_s and in_t and ({changed}) then 'update' else 'unchanged' end as action from j)
select {", ".join(sel)} from a
"""


def _audit_sql(body: str) -> str:
    return f"select *, timestamp '{OLD}' as load_date, timestamp '{OLD}' as upd_date from ({body}) x"


def _target(b, sql: str, source=None):
    """The prior version of a production table (a stored table in the
    application), derived from the bindings and stored once per run."""
    import hashlib
    name = "target_" + hashlib.sha1(sql.encode()).hexdigest()[:12]
    return b.stored(name, lambda: M.with_audit(b.sql(sql), OLD), source)


# M07a — flagship ---------------------------------------------------------------
TEAM_FORM_ORACLE = f"""
with lf as (
  select league_id, season_year, home_team_id as team_id, fixture_id, fixture_date,
         case when home_score > away_score then 'W' when home_score = away_score then 'D' else 'L' end as r
  from v_fixtures
  where status in {FINISHED_SQL} and home_score is not null and away_score is not null
  union all
  select league_id, season_year, away_team_id as team_id, fixture_id, fixture_date,
         case when away_score > home_score then 'W' when away_score = home_score then 'D' else 'L' end as r
  from v_fixtures
  where status in {FINISHED_SQL} and home_score is not null and away_score is not null
), ranked as (
  select *, row_number() over (partition by league_id, season_year, team_id
                               order by fixture_date desc, fixture_id desc) as rn
  from lf
)
select league_id, season_year, team_id,
       string_agg(r, '' order by fixture_date, fixture_id) as form_compact,
       cast(count(*) as integer) as form_games
from ranked where rn <= 5
group by league_id, season_year, team_id
"""


@bound_query("team_form", TEAM_FORM_ORACLE)
def q_team_form(b):
    return form.team_form(b.v_fixtures, n=5)


@bound_query("team_form_newest_first", TEAM_FORM_ORACLE.replace(
    "string_agg(r, '' order by fixture_date, fixture_id)",
    "string_agg(r, '' order by fixture_date desc, fixture_id desc)"))
def q_team_form_newest_first(b):
    return form.team_form(b.v_fixtures, n=5, newest_first=True)


# M01 ---------------------------------------------------------------------------
FIXTURES_TARGET = """
select fixture_id, league_id, season_year, home_team_id, away_team_id, fixture_date,
  case when fixture_id % 10 = 0 then 'PST' else status end as status, round, home_score, away_score, venue_id
from v_fixtures where fixture_id % 3 <> 0
"""
_FX_COLS = M.FIXTURE_COLS
FIXTURES_SRC = f"""
select s.fixture_id, {", ".join("s." + x for x in _FX_COLS)}
from v_stg_fixtures s join ({BV.FIXTURES_FLAGGED_SQL}) f on f.stg_id = s.stg_id where f.is_valid
"""


def _merge_fixtures(b):
    flagged = V.check_fixtures(b.v_stg_fixtures, b.v_teams).flagged
    return M.merge_fixtures(_target(b, FIXTURES_TARGET), flagged, b.v_venues, AS_OF)


@bound_query("merge_fixtures", upsert_oracle(FIXTURES_SRC, _audit_sql(FIXTURES_TARGET), ["fixture_id"], _FX_COLS))
def q_merge_fixtures(b):
    return _merge_fixtures(b)[0].merged


@bound_query("fixture_placeholder_venues", f"""
select distinct s.venue_id, 'Unknown Venue' as venue_name, 'Unknown City' as city, 'Unknown Country' as country
from ({FIXTURES_SRC}) s
where s.venue_id is not null and not exists (select 1 from v_venues v where v.venue_id = s.venue_id)
""")
def q_fixture_placeholder_venues(b):
    return _merge_fixtures(b)[1]


@bound_query("merge_fixtures_summary", f"""
with m as ({upsert_oracle(FIXTURES_SRC, _audit_sql(FIXTURES_TARGET), ["fixture_id"], _FX_COLS)})
select action, count(*) as n from m group by action
""")
def q_merge_fixtures_summary(b):
    return _merge_fixtures(b)[0].summary


# M02 ---------------------------------------------------------------------------
STG_TEAMS_FULL = """
select b.team_id, t.team_name, case when b.league_id % 2 = 0 then 'East' else 'West' end as team_country,
  concat('https://logo.example/', cast(b.team_id as string), '/', cast(b.league_id as string)) as team_logo_url,
  t.venue_id, b.league_id, b.season_year
from v_bridge b join v_teams t on t.team_id = b.team_id
"""
TEAMS_TARGET = """
select team_id, case when team_id % 4 = 0 then lower(team_name) else team_name end as team_name,
  cast(null as string) as team_country, cast(null as string) as team_logo_url,
  case when team_id % 5 = 0 then null else venue_id end as venue_id
from v_teams where team_id % 3 <> 0
"""
TEAMS_SRC = """
select team_id, team_name, team_country, team_logo_url, venue_id from (
  select *, row_number() over (partition by team_id order by season_year desc, league_id desc) as rn
  from v_stg_teams_full) x where rn = 1
"""


@bound_query("merge_teams", upsert_oracle(
    TEAMS_SRC.replace("v_stg_teams_full", f"({STG_TEAMS_FULL.replace('as string)', 'as varchar)')})"),
    _audit_sql(TEAMS_TARGET.replace("as string)", "as varchar)")), ["team_id"],
    ["team_name", "team_country", "team_logo_url", "venue_id"],
    when="coalesce(t_team_name, '') <> coalesce(s_team_name, '') or coalesce(t_team_country, '') <> "
         "coalesce(s_team_country, '') or coalesce(t_team_logo_url, '') <> coalesce(s_team_logo_url, '') "
         "or coalesce(s_venue_id is not null and t_venue_id <> s_venue_id, false)",
    update_exprs={"venue_id": "coalesce(s_venue_id, t_venue_id)"}))
def q_merge_teams(b):
    stg = V.check_teams(b.sql(STG_TEAMS_FULL).withColumn("name", c("team_name"))).flagged
    return M.merge_teams(_target(b, TEAMS_TARGET), stg, AS_OF).merged


# M03 ---------------------------------------------------------------------------
_PL_COLS = ["firstname", "lastname", "full_name", "birth_date", "height", "weight"]
PLAYERS_TARGET = """
select player_id, cast(null as string) as firstname, cast(null as string) as lastname,
  case when player_id % 4 = 0 then concat(full_name, ' Jr') else full_name end as full_name,
  make_date(1980 + player_id % 25, 6, 15) as birth_date, cast(null as string) as height, cast(null as string) as weight
from v_players where player_id % 3 <> 0
"""
PLAYERS_SRC = f"""
select p.player_id, p.firstname, p.lastname, p.full_name, s.birth_date, s.height, s.weight from (
  select *, row_number() over (partition by player_id order by stg_player_id desc) as rn
  from ({BV.PLAYERS_FLAGGED_SQL}) f where is_valid) p
join v_stg_players s on s.stg_player_id = p.stg_player_id
where rn = 1
"""


@bound_query("merge_players", upsert_oracle(
    PLAYERS_SRC, _audit_sql(PLAYERS_TARGET.replace("as string)", "as varchar)")), ["player_id"], _PL_COLS))
def q_merge_players(b):
    flagged = V.check_players(b.v_stg_players, BV.AS_OF_PLAYERS).flagged
    flagged = flagged.drop("height", "weight").join(
        b.v_stg_players.select("stg_player_id", "height", "weight"), "stg_player_id")
    return M.merge_players(_target(b, PLAYERS_TARGET), flagged, AS_OF, _PL_COLS).merged


_PL_EXTRA = {"birth_country": "concat('B', cast(player_id % 7 as string))", "nationality": "case when player_id % 3 = 0 then 'N' end",
             "photo_url": "concat('p/', cast(player_id as string))"}
_PL_NINE = [*_PL_COLS, *_PL_EXTRA]
PLAYERS_NINE_TARGET = "select *, " + ", ".join(f"{v.replace('% 7', '% 6')} as {k}" for k, v in _PL_EXTRA.items()) + f" from ({PLAYERS_TARGET}) t"
_duck_text = lambda x: x.replace("as string)", "as varchar)")


@bound_query("merge_players_nine_columns", upsert_oracle(
    "select *, " + ", ".join(f"{_duck_text(v)} as {k}" for k, v in _PL_EXTRA.items()) + f" from ({PLAYERS_SRC}) s",
    _audit_sql(_duck_text(PLAYERS_NINE_TARGET)), ["player_id"], _PL_NINE))
def q_merge_players_nine(b):
    flagged = V.check_players(b.v_stg_players, BV.AS_OF_PLAYERS).flagged
    flagged = flagged.drop("height", "weight").join(b.v_stg_players.select("stg_player_id", "height", "weight"), "stg_player_id")
    flagged = flagged.withColumns({k: F.expr(v) for k, v in _PL_EXTRA.items()})
    return M.merge_players(_target(b, PLAYERS_NINE_TARGET), flagged, AS_OF, _PL_NINE).merged


# M04 ---------------------------------------------------------------------------
VENUES_TARGET = """
select venue_id, venue_name, case when venue_id % 5 = 0 then 'Old City' else city end as city, country
from v_venues where venue_id % 4 <> 1
"""


@bound_query("merge_venues", upsert_oracle(
    f"select venue_id, name as venue_name, city, country from ({BV.STG_VENUES_SQL}) s "
    "where capacity >= 0 and name is not null",
    _audit_sql(VENUES_TARGET), ["venue_id"], ["venue_name", "city", "country"],
    when="coalesce(t_venue_name, '') <> coalesce(s_venue_name, '') or coalesce(t_city, '') <> coalesce(s_city, '') "
         "or coalesce(t_country, '') <> coalesce(s_country, '')"))
def q_merge_venues(b):
    flagged = V.check_venues(b.sql(BV.STG_VENUES_SQL)).flagged.withColumnRenamed("name", "venue_name")
    return M.merge_venues(_target(b, VENUES_TARGET), flagged, AS_OF).merged


# M05 ---------------------------------------------------------------------------
EVENTS_TARGET = """
select ord1 as event_id, fixture_id, minute, minute_extra, team_id, player_id, assist_player_id, event_type,
  concat(event_detail, ' (old)') as event_detail, cast(null as string) as comments from (
  select *, row_number() over (partition by fixture_id, minute, coalesce(minute_extra, 0), team_id,
                                            coalesce(player_id, 0), event_type
                               order by ord1 desc, ord2 desc, ord3 desc, ord4 desc) as rn
  from v_stg_events where fixture_id % 3 = 0 and minute is not null) x
where rn = 1
"""
EVENTS_SRC = f"""
select fixture_id, minute, coalesce(minute_extra, 0) as k_extra, team_id, coalesce(player_id, 0) as k_player,
  event_type, minute_extra, player_id, assist_player_id, event_detail, cast(null as varchar) as comments,
  (select max(event_id) from ({EVENTS_TARGET.replace("as string)", "as varchar)")}) t) + row_number() over (
    order by fixture_id, minute, coalesce(minute_extra, 0), team_id, coalesce(player_id, 0), event_type nulls first) as event_id from (
  select e.*, row_number() over (partition by e.fixture_id, e.minute, coalesce(e.minute_extra, 0), e.team_id,
                                              coalesce(e.player_id, 0), e.event_type
                                 order by e.ord1 desc, e.ord2 desc, e.ord3 desc, e.ord4 desc) as rn
  from v_stg_events e join ({BV.EVENTS_FLAGGED_SQL}) f
    on f.ord1 = e.ord1 and f.ord2 = e.ord2 and f.ord3 = e.ord3 and f.ord4 = e.ord4
  where f.is_valid) x
where rn = 1
"""
_EV_TGT_ORACLE = f"""
select event_id, fixture_id, minute, coalesce(minute_extra, 0) as k_extra, team_id, coalesce(player_id, 0) as k_player,
  event_type, minute_extra, player_id, assist_player_id, event_detail, comments,
  timestamp '{OLD}' as load_date, timestamp '{OLD}' as upd_date
from ({EVENTS_TARGET.replace("as string)", "as varchar)")}) t
"""
_EV_MERGE_ORACLE = upsert_oracle(
    EVENTS_SRC, _EV_TGT_ORACLE, M.EVENT_KEY, ["event_detail", "comments"],
    tcols_extra=["event_id", "minute_extra", "player_id", "assist_player_id"],
    src_extra=["event_id", "minute_extra", "player_id", "assist_player_id"], when="always")


def _merge_events(b):
    valid = V.check_match_events(b.v_stg_events.withColumn("comments", F.lit(None).cast("string")),
                                   b.v_fixtures, b.v_teams,
                                   order=[c("ord1"), c("ord2"), c("ord3"), c("ord4")]).valid
    return M.merge_match_events(_target(b, EVENTS_TARGET, b.v_stg_events), valid, b.v_players, AS_OF,
                                order=[c("ord1"), c("ord2"), c("ord3"), c("ord4")])


@bound_query("merge_match_events", f"""
select event_id, fixture_id, minute, team_id, event_type, minute_extra, player_id, assist_player_id, event_detail, comments,
  load_date, upd_date, action from ({_EV_MERGE_ORACLE}) m
""")
def q_merge_match_events(b):
    return _merge_events(b)[0].merged


@bound_query("event_placeholder_players", f"""
with s as ({EVENTS_SRC})
select distinct ids.player_id, 'Unknown' as firstname, 'Player' as lastname, 'Unknown Player' as full_name
from (select player_id from s where player_id is not null
      union select assist_player_id from s where assist_player_id is not null) ids
where not exists (select 1 from v_players p where p.player_id = ids.player_id)
""")
def q_event_placeholder_players(b):
    return _merge_events(b)[1]


# M06 ---------------------------------------------------------------------------
_ST_COLS = ["shots_on_goal", "shots_off_goal", "shots_inside_box", "shots_outside_box", "total_shots", "possession",
            "goalkeeper_saves", "total_passes", "passes_accurate", "pass_accuracy"]
STATS_TARGET = f"""
select s.fixture_id, s.team_id, f.league_id, f.season_year,
  {", ".join("s." + x if x != "total_shots" else "s.total_shots + 100 as total_shots" for x in _ST_COLS)}
from v_stg_stats s join v_fixtures f on f.fixture_id = s.fixture_id
where s.fixture_id % 4 = 0 and s.team_id is not null and s.load_seq = 1
"""
STATS_SRC = f"""
with v as (select * from ({BV.STATS_FLAGGED_SQL}) f where is_valid and team_id is not null),
e as (select fixture_id from v group by fixture_id having count(*) = 2)
select v.fixture_id, v.team_id, x.league_id, x.season_year, {", ".join("v." + k for k in _ST_COLS)}
from v join e on e.fixture_id = v.fixture_id join v_fixtures x on x.fixture_id = v.fixture_id
where x.status in {FINISHED_SQL}
"""


@bound_query("merge_match_statistics", upsert_oracle(
    STATS_SRC, _audit_sql(STATS_TARGET), ["fixture_id", "team_id"], ["league_id", "season_year", *_ST_COLS],
    when="always"))
def q_merge_match_statistics(b):
    flagged = V.check_match_statistics(b.v_stg_stats, latest_order=[c("load_seq")]).flagged
    return M.merge_match_statistics(_target(b, STATS_TARGET), flagged, b.v_fixtures, AS_OF).merged


# M07 ---------------------------------------------------------------------------
STANDINGS_TARGET = """
select league_id, season_year, team_id, coalesce(group_label, '') as group_label, rank, points, played, win, draw,
  lose, goals_for, goals_against, coalesce(goals_diff, goals_for - goals_against) as goals_diff,
  cast(5 as smallint) as form_window, case when team_id % 2 = 0 then 'W' else '' end as form_compact
from v_stg_standings
where stg_seq = 1 and league_id is not null and season_year in (1996, 1998) and rank is not null
"""
# A key is merged if none of its valid rows lacks a value.
STANDINGS_SRC = f"""
select k.*, cast(5 as smallint) as form_window, coalesce(form.form_compact, '') as form_compact
from (
  select league_id, season_year, team_id, coalesce(group_label, '') as group_label, rank, points, played, win, draw,
    lose, goals_for, goals_against, coalesce(goals_diff, goals_for - goals_against) as goals_diff
  from ({BV.STANDINGS_FLAGGED_SQL}) flagged where is_valid
  window per_key as (partition by league_id, season_year, team_id, coalesce(group_label, ''))
  qualify count(*) over per_key = count(rank) over per_key
    and least({", ".join(f"count({x}) over per_key" for x in
                         ("points", "played", "win", "draw", "lose", "goals_for", "goals_against"))})
        = count(*) over per_key) k
left join ({TEAM_FORM_ORACLE}) form using (league_id, season_year, team_id)
"""
_SD_COLS = M.STANDING_COLS
_SD_MERGE_ORACLE = upsert_oracle(STANDINGS_SRC, _audit_sql(STANDINGS_TARGET), M.STANDING_KEY, _SD_COLS)


def _merge_standings(b):
    flagged = V.check_standings(b.v_stg_standings, b.v_teams, order=[c("stg_seq")]).flagged
    return M.merge_standings(_target(b, STANDINGS_TARGET), flagged, b.v_fixtures, AS_OF)


@bound_query("merge_standings", _SD_MERGE_ORACLE)
def q_merge_standings(b):
    return _merge_standings(b)[0].merged


@bound_query("merge_standings_counts", f"""
with m as ({_SD_MERGE_ORACLE}), src as ({STANDINGS_SRC}),
raw as (select * from ({BV.STANDINGS_FLAGGED_SQL}) f where is_valid)
select (select count(*) from m where action = 'insert') as inserted,
  (select count(*) from m where action = 'update') as updated,
  (select count(*) from raw where rank is null or points is null or played is null or win is null or draw is null
     or lose is null or goals_for is null or goals_against is null
     or coalesce(goals_diff, goals_for - goals_against) is null) as skipped_nulls,
  (select count(*) from src where form_compact = '') as no_form
""")
def q_merge_standings_counts(b):
    return _merge_standings(b)[1]


# M08 ---------------------------------------------------------------------------
TARGETS_SQL = "select league_id, season_year from v_seasons where season_year in (1996, 1997) and league_id < 3"


@bound_query("merge_standings_targets", f"""
with src as ({STANDINGS_SRC}),
m as ({_SD_MERGE_ORACLE}),
tg as ({TARGETS_SQL}),
raw as (select * from ({BV.STANDINGS_FLAGGED_SQL}) f where is_valid)
select tg.league_id, tg.season_year,
  (select count(*) from m where m.league_id = tg.league_id and m.season_year = tg.season_year and action = 'insert') as inserted,
  (select count(*) from m where m.league_id = tg.league_id and m.season_year = tg.season_year and action = 'update') as updated,
  (select count(*) from raw r where r.league_id = tg.league_id and r.season_year = tg.season_year and (
     rank is null or points is null or played is null or win is null or draw is null or lose is null
     or goals_for is null or goals_against is null or coalesce(goals_diff, goals_for - goals_against) is null)) as skipped_nulls,
  (select count(*) from src s where s.league_id = tg.league_id and s.season_year = tg.season_year
     and form_compact = '') as no_form
from tg
""")
def q_merge_standings_targets(b):
    flagged = V.check_standings(b.v_stg_standings, b.v_teams, order=[c("stg_seq")]).flagged
    res, summary = M.merge_standings_targets(_target(b, STANDINGS_TARGET), flagged, b.v_fixtures,
                                             b.sql(TARGETS_SQL), AS_OF)
    return summary


# M09 ---------------------------------------------------------------------------
_PS_COLS = ["appearances", "lineups", "minutes_played", "goals"]
PSS_TARGET = """
select player_id, team_id, league_id, season, appearances, lineups, minutes_played, goals + 1 as goals from (
  select *, row_number() over (partition by player_id, team_id, league_id, season order by stg_stats_id desc, ord2 desc) as rn
  from v_stg_player_stats where stg_stats_id % 7 = 0 and player_id is not null) x where rn = 1
"""
PSS_SRC = f"""
select player_id, team_id, league_id, season, {", ".join(_PS_COLS)} from (
  select *, row_number() over (partition by player_id, team_id, league_id, season order by stg_stats_id desc, ord2 desc) as rn
  from ({BV.PLAYER_STATS_FLAGGED_SQL}) f where is_valid) x where rn = 1
"""


@bound_query("merge_player_season_stats", upsert_oracle(
    PSS_SRC, _audit_sql(PSS_TARGET), M.PSS_KEY, _PS_COLS, when="always"))
def q_merge_player_season_stats(b):
    flagged = V.check_player_season_stats(b.v_stg_player_stats).flagged
    return M.merge_player_season_stats(_target(b, PSS_TARGET), flagged, AS_OF,
                                       order=[c("stg_stats_id"), c("ord2")]).merged


# M10 ---------------------------------------------------------------------------
NEWS_TARGET = """
select article_id, tab, case when cast(article_id as bigint) % 5 = 0 then 'Old title' else title end as title,
  url, published_at_utc from v_news where cast(article_id as bigint) % 4 <> 0
"""


@bound_query("merge_news", upsert_oracle(
    "select article_id, tab, title, url, published_at_utc from v_news",
    _audit_sql(NEWS_TARGET), ["article_id"], ["tab", "title", "url", "published_at_utc"]))
def q_merge_news(b):
    flagged = V.check_news(b.v_news).flagged
    return M.merge_news(_target(b, NEWS_TARGET), flagged, AS_OF,
                        tab_order=["transfers", "injuries", "matchreports"]).merged


# M11 ---------------------------------------------------------------------------
@bound_query("merge_team_bridge", upsert_oracle(
    f"select distinct team_id, league_id, season_year from ({BV.STG_TEAMS_SQL}) s where team_id is not null",
    _audit_sql("select team_id, league_id, season_year from v_bridge where season_year < 1996"),
    ["team_id", "league_id", "season_year"], [], when="always"))
def q_merge_team_bridge(b):
    tgt = _target(b, "select team_id, league_id, season_year from v_bridge where season_year < 1996")
    return M.merge_team_bridge(tgt, b.sql(BV.STG_TEAMS_SQL), AS_OF).merged


# M12 ---------------------------------------------------------------------------
DIRECTORY_SRC_SPARK = """
select l.league_id, l.league_name as name, l.league_country as country,
  concat('https://logo.example/', cast(l.league_id as string)) as logo, s.seasons
from v_leagues l left join (
  select league_id, array_sort(collect_list(season_year)) as seasons from v_seasons group by league_id) s
  on s.league_id = l.league_id
"""
DIRECTORY_SRC_DUCK = """
select l.league_id, l.league_name as name, l.league_country as country,
  concat('https://logo.example/', cast(l.league_id as varchar)) as logo, s.seasons
from v_leagues l left join (
  select league_id, list_sort(list(season_year)) as seasons from v_seasons group by league_id) s
  on s.league_id = l.league_id
"""


@bound_query("merge_league_directory", upsert_oracle(
    DIRECTORY_SRC_DUCK,
    _audit_sql(f"select league_id, lower(name) as name, country, logo, seasons from ({DIRECTORY_SRC_DUCK}) d "
               "where league_id < 3"),
    ["league_id"], ["name", "country", "logo", "seasons"], when="always"))
def q_merge_league_directory(b):
    src = b.sql(DIRECTORY_SRC_SPARK)
    tgt = M.with_audit(src.where(c("league_id") < 3).withColumn("name", F.lower("name")), OLD)
    return M.merge_league_directory(tgt, src, AS_OF).merged


# M13 / M14 -----------------------------------------------------------------------
LEAGUE_ROWS = """
select l.league_id, s.season_year, l.league_name as name, l.league_country as country,
  concat('https://logo.example/', cast(l.league_id as string)) as logo
from v_leagues l join v_seasons s on s.league_id = l.league_id
"""
LEAGUES_TARGET = """
select league_id, case when league_id = 1 then lower(league_name) else league_name end as name,
  league_country as country, concat('https://logo.example/', cast(league_id as string)) as logo
from v_leagues where league_id <> 4
"""


@bound_query("merge_leagues", upsert_oracle(
    f"""select league_id, name, country, logo from (
      select *, row_number() over (partition by league_id order by season_year desc) as rn
      from ({LEAGUE_ROWS.replace("as string)", "as varchar)")}) x) y where rn = 1""",
    _audit_sql(LEAGUES_TARGET.replace("as string)", "as varchar)")), ["league_id"], ["name", "country", "logo"]))
def q_merge_leagues(b):
    return M.merge_leagues(_target(b, LEAGUES_TARGET), b.sql(LEAGUE_ROWS), AS_OF).merged


SEASONS_TARGET = """
select league_id, season_year, start_date, end_date,
  case when league_id = 0 then not is_current else is_current end as is_current, season_str
from v_seasons where season_year < 1997
"""
_SEASON_COLS = ["start_date", "end_date", "is_current", "season_str"]


@bound_query("merge_league_seasons", upsert_oracle(
    "select league_id, season_year, start_date, end_date, is_current, season_str from v_seasons",
    _audit_sql(SEASONS_TARGET), ["league_id", "season_year"], _SEASON_COLS,
    when=" or ".join(
        [f"substr(cast(t_{x} as varchar), 1, 10) is distinct from substr(cast(s_{x} as varchar), 1, 10)"
         for x in ("start_date", "end_date")]
        + [f"t_{x} is distinct from s_{x}" for x in ("is_current", "season_str")])))
def q_merge_league_seasons(b):
    return M.merge_league_seasons(_target(b, SEASONS_TARGET), b.v_seasons, AS_OF).merged


@bound_query("merge_league_seasons_always", upsert_oracle(
    "select league_id, season_year, start_date, end_date, is_current, season_str from v_seasons",
    _audit_sql(SEASONS_TARGET), ["league_id", "season_year"], _SEASON_COLS, when="always"))
def q_merge_league_seasons_always(b):
    return M.merge_league_seasons(_target(b, SEASONS_TARGET), b.v_seasons, AS_OF, always=True).merged


# M15 ---------------------------------------------------------------------------
VENUE_FILLS = """
select cast(s_suppkey as int) as venue_id, s_name as venue_name,
  concat('City ', cast(s_nationkey as string)) as city, concat('Country ', cast(s_nationkey % 5 as string)) as country
from supplier
"""


@bound_query("fill_venue_geo", f"""
with t as ({_audit_sql("select venue_id, venue_name, city, country from v_venues")}),
f as ({VENUE_FILLS.replace("as string)", "as varchar)")}),
j as (select t.*, f.venue_id is not null and (t.city is null or t.country is null) as hit,
        f.venue_name as f_name, f.city as f_city, f.country as f_country
      from t left join f on f.venue_id = t.venue_id)
select venue_id,
  case when hit then coalesce(f_name, venue_name) else venue_name end as venue_name,
  case when hit then coalesce(f_city, city) else city end as city,
  case when hit then coalesce(f_country, country) else country end as country,
  load_date, case when hit then timestamp '{AS_OF}' else upd_date end as upd_date
from j
""")
def q_fill_venue_geo(b):
    tgt = M.with_audit(b.v_venues.select("venue_id", "venue_name", "city", "country"), OLD)
    return M.fill_venue_geo(tgt, b.sql(VENUE_FILLS), AS_OF)[0]


# M16 ---------------------------------------------------------------------------
REQUESTED = """
select l.league_id, l.league_name, 1995 as first_season, s.last_season
from v_leagues l join (select league_id, max(season_year) as last_season from v_seasons group by league_id) s
  on s.league_id = l.league_id
"""
_CAT_TGT = """
select league_id, folder_alias, league_name, first_season, last_season, is_enabled,
  backfill_done, full_done, baseline_loaded from v_catalog
"""


@bound_query("merge_catalog", upsert_oracle(
    f"""select league_id, league_name, first_season, last_season, true as is_enabled,
      case when ends_with(lower(regexp_replace(trim(league_name), '\\s+', '_', 'g')), '_' || cast(league_id as varchar))
           then lower(regexp_replace(trim(league_name), '\\s+', '_', 'g'))
           else lower(regexp_replace(trim(league_name), '\\s+', '_', 'g')) || '_' || cast(league_id as varchar)
      end as folder_alias
    from ({REQUESTED}) r""",
    _audit_sql(_CAT_TGT), ["league_id"],
    ["folder_alias", "league_name", "first_season", "last_season", "is_enabled"],
    tcols_extra=["backfill_done", "full_done", "baseline_loaded"], when="always",
    update_exprs={"last_season": "greatest(coalesce(t_last_season, 0), s_last_season)"}))
def q_merge_catalog(b):
    return M.merge_catalog(_target(b, _CAT_TGT), b.sql(REQUESTED), AS_OF).merged
