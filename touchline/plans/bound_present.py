"""Presentation units (P01–P11) bound to the test tables, with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import present as P
from touchline.operators import serve as Q
from touchline.plans import bound_serve as BS
from touchline.plans.registry import bound_query

c = F.col
AS_OF_NEWS = "2024-01-31 00:00:00"

_YEAR = r"\b20\d{2}(?:[/\-]\d{2})?\b"
_WORDS = "MLS|La Liga|Serie A|Premier League"


def _norm_key(x: str) -> str:
    t = f"regexp_replace(coalesce({x}, ''), '{_YEAR}', '', 'g')"
    t = f"regexp_replace({t}, '(?i)\\b({_WORDS})\\b', '', 'g')"
    t = f"regexp_replace({t}, '[,–-]+', ' ', 'g')"
    t = f"regexp_replace({t}, '\\s+', ' ', 'g')"
    return f"lower(trim({t}))"


# P01 -----------------------------------------------------------------------------
@bound_query("standings_by_group", BS._with_standings(BS.LEAGUE_STANDINGS_SQL).replace("\n, latest", ", latest")
             .replace("select l.league_id, l.season_year, l.rank as position",
                      ", q8 as (select l.league_id, l.season_year, l.rank as position", 1)
             + f"""
), k as (select *, {_norm_key('group_label')} as group_key from q8),
g as (select *, first_value(group_label) over (partition by league_id, season_year, group_key
                                               order by display_rank) as group_display from k)
select league_id, season_year, team_id, display_rank, group_key, group_display,
  cast(dense_rank() over (partition by league_id, season_year
                          order by cast(group_display <> '' as integer), group_display) as integer) as group_order,
  count(distinct group_key) over (partition by league_id, season_year) > 1
    or max(cast(group_label <> '' as integer)) over (partition by league_id, season_year) = 1 as is_multi_group
from g
""")
def q_standings_by_group(b):
    t = Q.league_standings(BS._standings_prod(b), b.v_teams)
    return P.standings_by_group(t).select("league_id", "season_year", "team_id", "display_rank", "group_key",
                                          "group_display", "group_order", "is_multi_group")


# P02 -----------------------------------------------------------------------------
@bound_query("matches_by_day", f"""
select id, cast(kickoff_utc as date) as day,
  case when status in ('FT','AET','PEN') then cast(coalesce(home_score, 0) as varchar) || ' - ' || cast(coalesce(away_score, 0) as varchar)
       else strftime(kickoff_utc, '%H:%M') end as center_text
from ({BS.WEEKLY_SQL}) w
""")
def q_matches_by_day(b):
    w = Q.weekly_matches(b.v_fixtures, b.v_teams, BS.WEEK_START, 7)
    return P.matches_by_day(w).select("id", "day", "center_text")


# P03 / P04 -----------------------------------------------------------------------
@bound_query("matches_quick_find", f"""
select * from ({BS.MATCHES_DAY_SQL}) m
where lower(home_name) like '%ica%' or lower(away_name) like '%ica%' or lower(league_name) like '%ica%'
""")
def q_quick_find(b):
    day = Q.matches_on_local_day(b.v_fixtures, b.v_leagues, b.v_teams, BS.DAY, "UTC")
    return P.quick_find(day, "ICA")


@bound_query("matches_by_league", f"""
select league_name, row_number() over (partition by league_name order by kickoff_utc, id) - 1 as pos, id, home_name, away_name,
  count(*) over (partition by league_name) as n_matches
from ({BS.MATCHES_DAY_SQL}) m where strftime(kickoff_utc, '%H:%M') like '%00:0%'
""")
def q_matches_by_league(b):
    """The leagues' lists, one row for each match in its place; found by time."""
    day = Q.matches_on_local_day(b.v_fixtures, b.v_leagues, b.v_teams, BS.DAY, "UTC")
    leagues = P.matches_by_league(day, "00:0")
    return leagues.select("league_name", F.posexplode("matches").alias("pos", "m"), "n_matches").select(
        "league_name", c("pos").cast("long").alias("pos"), "m.id", "m.home_name", "m.away_name", "n_matches")


@bound_query("ticker", f"select * from ({BS.MATCHES_DAY_SQL}) m order by kickoff_utc, id limit 10")
def q_ticker(b):
    day = Q.matches_on_local_day(b.v_fixtures, b.v_leagues, b.v_teams, BS.DAY, "UTC")
    return P.ticker(day, 10)


# P05 / P06 -----------------------------------------------------------------------
_LF = """
lf as (select fixture_id, season_year, fixture_date, status, home_score, away_score, home_team_id as team_id,
              away_team_id as opponent_id, true as is_home, home_score as gf, away_score as ga from v_fixtures
       union all
       select fixture_id, season_year, fixture_date, status, home_score, away_score, away_team_id, home_team_id,
              false, away_score, home_score from v_fixtures)
"""


@bound_query("next_match", f"""
with {_LF}
select team_id, season_year, fixture_id, fixture_date, opponent_id, is_home from (
  select *, row_number() over (partition by team_id, season_year order by fixture_date asc nulls last, fixture_id) as rn
  from lf where status in ('NS','TBD','PST','SUSP','INT','POST')) x where rn = 1
""")
def q_next_match(b):
    return P.next_match(b.v_fixtures)


@bound_query("last5_results", f"""
with {_LF}
select team_id, season_year, cast(rn as integer) as recency, fixture_id, opponent_id, is_home,
  case when gf is not null and ga is not null then case when gf > ga then 'W' when gf = ga then 'D' else 'L' end
       else 'D' end as result,
  case when home_score is not null and away_score is not null
       then cast(home_score as varchar) || '–' || cast(away_score as varchar) else '' end as score_text
from (select *, row_number() over (partition by team_id, season_year
                                   order by fixture_date desc nulls last, fixture_id desc) as rn
      from lf where status in ('FT','AET','PEN')) x
where rn <= 5
""")
def q_last5(b):
    return P.last5_results(b.v_fixtures).withColumn("recency", c("recency").cast("int"))


# P07 / P08 / P09 -----------------------------------------------------------------
_SUBS = f"""
tl as ({BS.TIMELINE_SQL}),
subs as (select *, case when lower(type) = 'substitution' then
           sum(case when lower(type) = 'substitution' then 1 else 0 end) over (
             partition by fixture_id, team_id order by minute, minute_extra, event_id
             rows between unbounded preceding and current row) end as sub_no from tl)
"""


@bound_query("substitution_numbers", f"""
with {_SUBS}
select fixture_id, event_id, team_id, type, cast(sub_no as bigint) as sub_no from subs
""")
def q_substitution_numbers(b):
    return P.substitution_numbers(BS._timeline(b)).select("fixture_id", "event_id", "team_id", "type", "sub_no")


@bound_query("timeline_phase_counts", f"""
with tl as ({BS.TIMELINE_SQL}),
t as (select tl.*, case when coalesce(minute, 0) < 46 then 'first' when coalesce(minute, 0) < 91 then 'second'
                        else 'extra' end as phase,
        case when tl.team_id = f.home_team_id then 'home' else 'away' end as side
      from tl join v_fixtures f on f.fixture_id = tl.fixture_id)
select fixture_id, phase, side, count(*) as n_events, count(distinct (minute, minute_extra)) as n_rows
from t group by fixture_id, phase, side
""")
def q_timeline_phase_counts(b):
    return P.timeline_phase_counts(BS._timeline(b), b.v_fixtures)


@bound_query("timeline_phases", f"""
with {_SUBS},
t as (select subs.*, coalesce(sub_no, 0) as no, case when coalesce(minute, 0) < 46 then 'first' when coalesce(minute, 0) < 91 then 'second'
                                  else 'extra' end as phase,
        case when subs.team_id = f.home_team_id then 'home' else 'away' end as side
      from subs join v_fixtures f on f.fixture_id = subs.fixture_id)
select fixture_id, phase, minute, minute_extra, side,
  cast(row_number() over (partition by fixture_id, phase, minute, minute_extra, side order by no, event_id) - 1 as integer) as pos,
  cast(no as bigint) as sub_no, event_id, type, player, assist, detail
from t
""")
def q_timeline_phases(b):
    """The rows' nested event lists, one row for each event with its side and place."""
    rows = P.timeline_phases(BS._timeline(b), b.v_fixtures)
    key = ["fixture_id", "phase", "minute", "minute_extra"]
    sides = [rows.select(*key, F.lit(side).alias("side"), F.posexplode(side).alias("pos", "e")) for side in ("home", "away")]
    return sides[0].unionByName(sides[1]).select(*key, "side", "pos", "e.*")


@bound_query("event_text", f"""
with {_SUBS}
select fixture_id, event_id,
  case when lower(type) = 'goal' and lower(coalesce(detail, '')) like '%penalty%' then 'PEN'
       when lower(type) = 'goal' and lower(coalesce(detail, '')) like '%own goal%' then 'OWN'
       when lower(type) = 'goal' then 'GOAL' when lower(type) = 'yellow' then 'YC' when lower(type) = 'red' then 'RC'
       when lower(type) = 'substitution' then 'SUB' when lower(type) = 'var' then 'VAR' else 'EVT' end as chip,
  cast(coalesce(minute, 0) as varchar) || case when coalesce(minute_extra, 0) > 0
       then '+' || cast(minute_extra as varchar) else '' end || '′' as minute_text,
  case when lower(type) = 'substitution'
         then trim(coalesce(player, '—') || ' · substitution ' || coalesce(cast(sub_no as varchar), ''))
       when lower(type) = 'goal' then coalesce(player, '—') ||
         case when lower(coalesce(detail, '')) like '%penalty%' then ' · penalty'
              when lower(coalesce(detail, '')) like '%own goal%' then ' · own goal' else '' end
       else coalesce(player, '—') || case when detail is not null and detail <> '' then ' · ' || detail else '' end
  end as primary_text,
  case when lower(type) = 'goal' and assist is not null then 'assist ' || assist
       when lower(type) = 'substitution' and assist is not null then 'for ' || assist else '' end as secondary_text
from subs
""")
def q_event_text(b):
    return P.event_text(P.substitution_numbers(BS._timeline(b)))


# P10 -----------------------------------------------------------------------------
def _stack_sql() -> str:
    parts = []
    for i, (key, label, kind) in enumerate(P.STAT_ROWS):
        parts.append(f"select fixture_id, {i} as stat_order, '{label}' as stat, h_{key} as home_value, "
                     f"a_{key} as away_value, '{kind}' as kind from bs")
    return "\nunion all ".join(parts)


@bound_query("stat_comparison", f"""
with sides as ({BS.SIDES_SQL}),
bs as (select fixture_id,
         {", ".join(f"coalesce(max(case when side = 'home' then {k} end), 0) as h_{k}, "
                    f"coalesce(max(case when side = 'away' then {k} end), 0) as a_{k}" for k, _, _ in P.STAT_ROWS)}
       from sides where side <> 'other' group by fixture_id),
long as ({_stack_sql()}),
p as (select *, least(greatest(home_value, 0), 100) * 1.0 as lp, least(greatest(away_value, 0), 100) * 1.0 as rp from long)
select fixture_id, stat_order, stat, home_value, away_value,
  case when home_value > away_value then 'home' when away_value > home_value then 'away' else 'none' end as winner,
  cast(case when kind = 'possession' then case when lp + rp > 0 then round(lp * 100 / (lp + rp), 4) else lp end end
       as decimal(7,4)) as home_bar_pct,
  cast(case when kind = 'possession' then case when lp + rp > 0 then round(rp * 100 / (lp + rp), 4) else rp end end
       as decimal(7,4)) as away_bar_pct
from p
""")
def q_stat_comparison(b):
    sides = Q.match_stats_sides(BS._stats_prod(b), b.v_fixtures)
    return P.stat_comparison(Q.stats_by_side(sides))


# P11 -----------------------------------------------------------------------------
@bound_query("news_feed", f"""
with pg as (
  select *, 1 as page_no, row_number() over (partition by tab order by published_at_utc desc, article_id desc) as page_rank
  from v_news),
pages as (select * from pg where page_rank <= 20
          union all select article_id, tab, title, url, published_at_utc, 2, page_rank - 10 from pg
          where page_rank > 10 and page_rank <= 30),
firsts as (select * from (select *, row_number() over (partition by article_id order by page_no, page_rank) as rn
                          from pages) x where rn = 1),
aged as (select *, greatest(0, epoch(timestamp '{AS_OF_NEWS}') - epoch(published_at_utc)) as secs from firsts)
select article_id, tab, page_no, cast(page_rank as integer) as page_rank,
  case when secs < 60 then 'just now' when secs < 3600 then cast(floor(secs / 60) as bigint) || 'm ago'
       when secs < 86400 then cast(floor(secs / 3600) as bigint) || 'h ago'
       else cast(floor(secs / 86400) as bigint) || 'd ago' end as age
from aged
""")
def q_news_feed(b):
    from touchline.functions.windows import top_n_per_group
    order = [c("published_at_utc").desc(), c("article_id").desc()]
    p1 = top_n_per_group(b.v_news, ["tab"], order, 30, rank_col="page_rank")
    pages = (p1.where(c("page_rank") <= 20).withColumn("page_no", F.lit(1))
             .unionByName(p1.where(c("page_rank") > 10).withColumn("page_no", F.lit(2))
                          .withColumn("page_rank", c("page_rank") - 10)))
    return P.news_feed(pages, AS_OF_NEWS).select("article_id", "tab", "page_no", c("page_rank").cast("int"), "age")
