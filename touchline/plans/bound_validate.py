"""Validation units (V01–V11) bound to the test tables, with DuckDB oracles
written the way the source procedures state the rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import validate as V
from touchline.plans.registry import bound_query

AS_OF_PLAYERS = "2024-01-15"
c = F.col

# V01 -----------------------------------------------------------------------------
FIXTURES_FLAGGED_SQL = """
with s1 as (
  select stg_id, fixture_id, home_team_id, away_team_id,
    case when fixture_id is null then 'missing_fixture_id; '
         when home_team_id = away_team_id then 'home_eq_away; '
         when not exists (select 1 from v_teams t where t.team_id = s.home_team_id) then 'missing_home_team; '
         when not exists (select 1 from v_teams t where t.team_id = s.away_team_id) then 'missing_away_team; '
    end as r
  from v_stg_fixtures s
), s2 as (
  select *, sum(case when r is null then 1 else 0 end) over (partition by fixture_id) as n_valid from s1
)
select stg_id, fixture_id, home_team_id, away_team_id,
  case when r is null and fixture_id is not null and n_valid > 1 then false else r is null end as is_valid,
  case when r is null and fixture_id is not null and n_valid > 1 then 'dup_fixture_id; ' else r end as error_reason
from s2
"""


def _fixtures(b):
    stg = b.v_stg_fixtures.select("stg_id", "fixture_id", "home_team_id", "away_team_id")
    return V.check_fixtures(stg, b.v_teams)


@bound_query("check_fixtures", FIXTURES_FLAGGED_SQL)
def q_check_fixtures(b):
    return _fixtures(b).flagged


@bound_query("fixtures_error_log", f"""
with f as ({FIXTURES_FLAGGED_SQL})
select distinct 'stg_fixtures' as staging_table, coalesce(cast(fixture_id as varchar), '<NULL>') as record_key,
  trim(error_reason, '; ') as error_reason
from f where not is_valid and error_reason is not null
""")
def q_fixtures_error_log(b):
    return _fixtures(b).rejects


# V02 -----------------------------------------------------------------------------
EVENTS_FLAGGED_SQL = """
with s1 as (
  select *,
    case when not exists (select 1 from v_fixtures f where f.fixture_id = s.fixture_id)
              or not exists (select 1 from v_teams t where t.team_id = s.team_id) then 'Missing fixture/team; '
         when minute is null or minute < -10 or minute > 130
              or (minute_extra is not null and (minute_extra < 0 or minute_extra > 40)) then 'Bad minute; '
         when lower(event_type) not in ('goal','card','subst','var') then 'Unknown type; '
    end as r
  from v_stg_events s
), s2 as (
  select *, row_number() over (
      partition by r is null, fixture_id, minute, coalesce(minute_extra, 0), team_id, coalesce(player_id, 0),
                   lower(event_type), coalesce(lower(event_detail), '')
      order by ord1, ord2, ord3, ord4) as rn
  from s1
)
select ord1, ord2, ord3, ord4, fixture_id, team_id, event_type,
  r is null and rn = 1 as is_valid,
  case when r is null and rn > 1 then 'Duplicate; ' else r end as error_reason
from s2
"""


def _events(b):
    stg = b.v_stg_events
    return V.check_match_events(stg, b.v_fixtures, b.v_teams,
                                order=[c("ord1"), c("ord2"), c("ord3"), c("ord4")])


@bound_query("check_match_events", EVENTS_FLAGGED_SQL)
def q_check_match_events(b):
    return _events(b).flagged.select("ord1", "ord2", "ord3", "ord4", "fixture_id", "team_id",
                                     "event_type", "is_valid", "error_reason")


@bound_query("match_events_validation_summary", f"""
with f as ({EVENTS_FLAGGED_SQL})
select 'fk' as rule, count(*) filter (where not is_valid and error_reason ilike '%Missing fixture/team%') as n from f
union all select 'minute', count(*) filter (where not is_valid and error_reason ilike '%Bad minute%') from f
union all select 'type', count(*) filter (where not is_valid and error_reason ilike '%Unknown type%') from f
union all select 'dup', count(*) filter (where not is_valid and error_reason ilike '%Duplicate%') from f
union all select 'total_rows', count(*) from f
union all select 'valid_rows', count(*) filter (where is_valid) from f
union all select 'invalid_rows', count(*) filter (where not is_valid) from f
""")
def q_events_summary(b):
    v = _events(b)
    return v.totals


# V03 -----------------------------------------------------------------------------
_NEG = ["shots_on_goal", "shots_off_goal", "shots_inside_box", "shots_outside_box", "blocked_shots",
        "goalkeeper_saves", "total_shots", "corners", "offsides", "fouls", "yellow_cards", "red_cards", "total_passes",
        "passes_accurate"]
_COMP = ["shots_on_goal", "shots_off_goal", "shots_inside_box", "shots_outside_box"]
STATS_FLAGGED_SQL = f"""
with s as (
  select *, row_number() over (partition by fixture_id, team_id order by load_seq desc) as rn from v_stg_stats
), r as (
  select *, nullif(concat(
    case when fixture_id is null or team_id is null then 'Missing fixture_id or team_id; ' else '' end,
    {", ".join(f"case when {x} < 0 then 'Negative {x}; ' else '' end" for x in _NEG)},
    case when possession is not null and (possession < 0 or possession > 100) then 'Invalid possession (0..100); ' else '' end,
    case when pass_accuracy is not null and (pass_accuracy < 0 or pass_accuracy > 100) then 'Invalid pass_accuracy (0..100); ' else '' end,
    case when shots_on_goal + shots_off_goal > total_shots then 'Shots mismatch (on+off > total_shots); ' else '' end,
    case when shots_inside_box + shots_outside_box > total_shots then 'Inside+Outside > total_shots; ' else '' end,
    {", ".join(f"case when {x} > total_shots then '{x} > total_shots; ' else '' end" for x in _COMP)},
    case when fixture_id is not null and team_id is not null and rn > 1 then 'Duplicate staging row; ' else '' end
  ), '') as error_reason
  from s
)
select fixture_id, team_id, load_seq, shots_on_goal, shots_off_goal, shots_inside_box, shots_outside_box,
  total_shots, possession, goalkeeper_saves, total_passes, passes_accurate, pass_accuracy,
  error_reason is null as is_valid, error_reason
from r
"""


def _stats(b):
    stg = b.v_stg_stats
    return V.check_match_statistics(stg, latest_order=[c("load_seq")])


@bound_query("check_match_statistics", f"""
select fixture_id, team_id, load_seq, goalkeeper_saves, shots_on_goal, is_valid, error_reason
from ({STATS_FLAGGED_SQL}) x
""")
def q_check_match_statistics(b):
    return _stats(b).flagged.select("fixture_id", "team_id", "load_seq", "goalkeeper_saves", "shots_on_goal",
                                    "is_valid", "error_reason")


@bound_query("match_statistics_error_log", f"""
with f as ({STATS_FLAGGED_SQL})
select 'stg_match_statistics' as staging_table,
  cast(coalesce(fixture_id, -1) as varchar) || '-' || cast(coalesce(team_id, -1) as varchar) as record_key,
  error_reason
from f where not is_valid and error_reason is not null
""")
def q_stats_error_log(b):
    return _stats(b).rejects


# Finished fixtures by their number of valid rows, where the season's staging holds any row.
_COVERAGE_SQL = """
select {keys} count(*) filter (where good = 2) as complete2, count(*) filter (where good = 0) as missing0,
  count(*) filter (where good = 1) as partial1
from (
  select league_id, status, count(*) filter (where is_valid and flagged.team_id is not null) as good,
    sum(count(flagged.fixture_id)) over (partition by league_id, season_year) as season_rows
  from v_fixtures left join ({flagged}) flagged using (fixture_id)
  group by fixture_id, league_id, season_year, status)
where season_rows > 0 and status in ('FT','AET','PEN') {group}
"""


@bound_query("statistics_coverage", _COVERAGE_SQL.format(flagged=STATS_FLAGGED_SQL, keys="", group=""))
def q_statistics_coverage(b):
    return V.statistics_coverage(_stats(b).flagged, b.v_fixtures)


@bound_query("statistics_coverage_by_league",
             _COVERAGE_SQL.format(flagged=STATS_FLAGGED_SQL, keys="league_id,", group="group by league_id"))
def q_statistics_coverage_by_league(b):
    return V.statistics_coverage(_stats(b).flagged, b.v_fixtures, by_league=True)


@bound_query("saves_exceed_opponent_shots", f"""
select count(distinct fixture_id) as dq_saves_gt_opponent_sog
from (
  select fixture_id, max(goalkeeper_saves) as most_saves,
    min(min(shots_on_goal)) over (partition by fixture_id rows between unbounded preceding and unbounded following
                                  exclude current row) as fewest_shots_of_others
  from ({STATS_FLAGGED_SQL}) flagged where is_valid and team_id is not null group by fixture_id, team_id)
where most_saves > fewest_shots_of_others
""")
def q_saves_exceed(b):
    return V.saves_exceed_opponent_shots(_stats(b).flagged)


# V04 -----------------------------------------------------------------------------
PLAYERS_FLAGGED_SQL = f"""
with s as (
  select stg_player_id, player_id, nullif(trim(firstname), '') as firstname, nullif(trim(lastname), '') as lastname,
    nullif(trim(full_name), '') as full_name, birth_date,
    try_cast(nullif(regexp_replace(height, '[^0-9]', '', 'g'), '') as integer) as h,
    try_cast(nullif(regexp_replace(weight, '[^0-9]', '', 'g'), '') as integer) as w
  from v_stg_players
), keep as (
  select player_id, max(stg_player_id) as keep_id from s where player_id is not null group by player_id
), r as (
  select s.*, case
    when s.player_id is null then 'Missing player_id; '
    when firstname is null and lastname is null and full_name is null then 'Name fields blank; '
    when birth_date is not null and (birth_date < date '1900-01-01' or birth_date > date '{AS_OF_PLAYERS}')
      then 'Unrealistic birth_date; '
    when s.stg_player_id <> k.keep_id then 'Duplicate player_id; '
    when (h is not null and (h < 140 or h > 220)) or (w is not null and (w < 40 or w > 150)) then
      concat(case when h is not null and (h < 140 or h > 220) then 'Unrealistic height; ' else '' end,
             case when w is not null and (w < 40 or w > 150) then 'Unrealistic weight; ' else '' end)
  end as error_reason
  from s left join keep k on k.player_id = s.player_id
)
select stg_player_id, player_id, firstname, lastname, full_name, error_reason is null as is_valid, error_reason from r
"""


@bound_query("check_players", PLAYERS_FLAGGED_SQL)
def q_check_players(b):
    stg = b.v_stg_players
    v = V.check_players(stg, AS_OF_PLAYERS)
    return v.flagged.select("stg_player_id", "player_id", "firstname", "lastname", "full_name",
                            "is_valid", "error_reason")


@bound_query("players_rule_counts", f"""
with s as (
  select player_id, nullif(trim(firstname), '') as fn, nullif(trim(lastname), '') as ln, nullif(trim(full_name), '') as fu,
    birth_date,
    try_cast(nullif(regexp_replace(height, '[^0-9]', '', 'g'), '') as integer) as h,
    try_cast(nullif(regexp_replace(weight, '[^0-9]', '', 'g'), '') as integer) as w
  from v_stg_players
)
select 'scoped_total' as rule, cast(count(*) as bigint) as n from s
union all select 'cnt_missing_id', count(*) filter (where player_id is null) from s
union all select 'cnt_blank_name', count(*) filter (where fn is null and ln is null and fu is null) from s
union all select 'cnt_birthdate_bad', count(*) filter (where birth_date is not null and
    (birth_date < date '1900-01-01' or birth_date > date '{AS_OF_PLAYERS}')) from s
union all select 'cnt_dupes', cast(coalesce(sum(cnt - 1), 0) as bigint) from (
    select player_id, count(*) as cnt from s where player_id is not null group by player_id having count(*) > 1) g
union all select 'cnt_height_bad', count(*) filter (where h is not null and (h < 140 or h > 220)) from s
union all select 'cnt_weight_bad', count(*) filter (where w is not null and (w < 40 or w > 150)) from s
""")
def q_players_rule_counts(b):
    return V.players_rule_counts(b.v_stg_players, AS_OF_PLAYERS)


# V05 -----------------------------------------------------------------------------
STANDINGS_FLAGGED_SQL = """
with e as (
  select *,
    (league_id is null or season_year is null or team_id is null) as r1, (points < 0) as r2,
    (rank is not null and rank < 1) as r3,
    (played < 0 or win < 0 or draw < 0 or lose < 0 or goals_for < 0 or goals_against < 0) as r4,
    (played is not null and win is not null and draw is not null and lose is not null and played <> (win + draw + lose)) as r5,
    (goals_diff is not null and goals_for is not null and goals_against is not null and goals_diff <> (goals_for - goals_against)) as r6,
    (points is not null and win is not null and draw is not null and points <> (3*win + draw)) as r7
  from v_stg_standings
), e1 as (
  select *, nullif(trim(concat(
      case when r1 then 'Missing league/season/team; ' else '' end,
      case when r2 then 'Negative points; ' else '' end,
      case when r3 then 'Invalid rank (<1); ' else '' end,
      case when r4 then 'Negative numeric; ' else '' end,
      case when r5 then 'Played != W+D+L; ' else '' end,
      case when r6 then 'GoalsDiff != GF-GA; ' else '' end,
      case when r7 then 'Points != 3*W + D; ' else '' end)), '') as reason17,
    case when (r1 or r2 or r3 or r4 or r5 or r6 or r7) then false else true end as valid17
  from e
), d as (
  select league_id, season_year, coalesce(group_label, '') as g, team_id, min(stg_seq) as keep_seq
  from v_stg_standings group by 1, 2, 3, 4 having count(*) > 1
), e2 as (
  select e1.*,
    exists (select 1 from d where d.league_id = e1.league_id and d.season_year = e1.season_year
            and d.g = coalesce(e1.group_label, '') and d.team_id = e1.team_id and e1.stg_seq <> d.keep_seq) as r8,
    not exists (select 1 from v_teams t where t.team_id = e1.team_id) as r9
  from e1
), e3 as (
  select *, case when r8 then concat_ws(' ', reason17, 'Duplicate team row in group;') else reason17 end as reason8 from e2
)
select league_id, season_year, team_id, group_label, stg_seq, rank, points, played, win, draw, lose,
  goals_for, goals_against, goals_diff,
  valid17 and not r8 and not r9 as is_valid,
  case when r9 then concat_ws(' ', reason8, 'Missing team FK;') else reason8 end as error_reason
from e3
"""


def _standings(b):
    return V.check_standings(b.v_stg_standings, b.v_teams, order=[c("stg_seq")])


@bound_query("check_standings", f"""
select league_id, season_year, team_id, group_label, stg_seq, is_valid, error_reason from ({STANDINGS_FLAGGED_SQL}) x
""")
def q_check_standings(b):
    return _standings(b).flagged.select("league_id", "season_year", "team_id", "group_label", "stg_seq",
                                        "is_valid", "error_reason")


@bound_query("standings_rule_counts", """
with s as (select * from v_stg_standings),
d as (select league_id, season_year, coalesce(group_label, '') as g, team_id, min(stg_seq) as keep_seq
      from s group by 1, 2, 3, 4 having count(*) > 1)
select 'R1' as rule, count(*) filter (where league_id is null or season_year is null or team_id is null) as n from s
union all select 'R2', count(*) filter (where points < 0) from s
union all select 'R3', count(*) filter (where rank is not null and rank < 1) from s
union all select 'R4', count(*) filter (where played < 0 or win < 0 or draw < 0 or lose < 0 or goals_for < 0 or goals_against < 0) from s
union all select 'R5', count(*) filter (where played <> win + draw + lose) from s
union all select 'R6', count(*) filter (where goals_diff <> goals_for - goals_against) from s
union all select 'R7', count(*) filter (where points <> 3*win + draw) from s
union all select 'R8', count(*) from s join d on d.league_id = s.league_id and d.season_year = s.season_year
    and d.g = coalesce(s.group_label, '') and d.team_id = s.team_id and s.stg_seq <> d.keep_seq
union all select 'R9', count(*) filter (where not exists (select 1 from v_teams t where t.team_id = s.team_id)) from s
""")
def q_standings_rule_counts(b):
    return _standings(b).rule_counts


@bound_query("standings_error_log", f"""
with f as ({STANDINGS_FLAGGED_SQL})
select 'stg_standings' as staging_table,
  cast(league_id as varchar) || '-' || cast(season_year as varchar) || '-' || coalesce(group_label, '') || '-'
    || cast(team_id as varchar) as record_key,
  error_reason
from f where not is_valid and error_reason is not null
""")
def q_standings_error_log(b):
    return _standings(b).rejects


# V06 -----------------------------------------------------------------------------
PLAYER_STATS_FLAGGED_SQL = """
select stg_stats_id, ord2, player_id, team_id, league_id, season, appearances, lineups, minutes_played, goals,
  r is null as is_valid, r as error_reason
from (
  select *, case
    when player_id is null or team_id is null or league_id is null or season is null then 'Missing required IDs; '
    when coalesce(appearances, 0) < 0 or coalesce(lineups, 0) < 0 or coalesce(minutes_played, 0) < 0
      then 'Negative appearances/lineups/minutes; '
    when lineups is not null and appearances is not null and lineups > appearances then 'lineups > appearances; '
  end as r
  from v_stg_player_stats) x
"""


@bound_query("check_player_season_stats", PLAYER_STATS_FLAGGED_SQL)
def q_check_player_season_stats(b):
    return V.check_player_season_stats(b.v_stg_player_stats).flagged


@bound_query("player_season_stats_validation_summary", f"""
with f as ({PLAYER_STATS_FLAGGED_SQL})
select 'missing_ids' as rule, count(*) filter (where error_reason = 'Missing required IDs; ') as n from f
union all select 'negative_core', count(*) filter (where error_reason = 'Negative appearances/lineups/minutes; ') from f
union all select 'lineups_gt_apps', count(*) filter (where error_reason = 'lineups > appearances; ') from f
union all select 'total_rows', count(*) from f
union all select 'valid_rows', count(*) filter (where is_valid) from f
union all select 'invalid_rows', count(*) filter (where not is_valid) from f
""")
def q_player_stats_summary(b):
    v = V.check_player_season_stats(b.v_stg_player_stats)
    return v.rule_counts.unionByName(V.summary(v.flagged))


# V07 / V08 / V09 -----------------------------------------------------------------
# stg_teams: one row per team and league-season (from the bridge; a club may play in several
# leagues of one season), and some of them twice.
STG_TEAMS_SQL = """
select b.team_id, t.team_name as name, t.venue_id, b.league_id, b.season_year
from v_bridge b join v_teams t on t.team_id = b.team_id
union all
select b.team_id, t.team_name, t.venue_id, b.league_id, b.season_year
from v_bridge b join v_teams t on t.team_id = b.team_id where b.team_id % 5 = 1 and b.season_year % 3 = 0
"""


@bound_query("check_teams", f"""
with s as ({STG_TEAMS_SQL}),
r as (select s.*, case
    when team_id is null or coalesce(trim(name) = '', true) then 'Missing team_id or name; '
  end as r1 from s),
r2 as (select *, sum(case when r1 is null then 1 else 0 end) over (partition by team_id, league_id, season_year) as n from r),
r3 as (select *, case when r1 is not null then r1
                      when n > 1 then 'Duplicate team_id; '
                      when venue_id is not null and not exists (select 1 from v_venues v where v.venue_id = r2.venue_id)
                        then 'Unknown venue_id; ' end as error_reason from r2)
select team_id, league_id, season_year, venue_id, error_reason is null as is_valid, error_reason from r3
""")
def q_check_teams(b):
    stg = b.sql(STG_TEAMS_SQL)
    return V.check_teams(stg, b.v_venues).flagged.select(
        "team_id", "league_id", "season_year", "venue_id", "is_valid", "error_reason")


STG_VENUES_SQL = """
select v.venue_id, v.venue_name as name, v.city, v.country, cast(floor(s.s_acctbal) as int) as capacity
from v_venues v join supplier s on s.s_suppkey = v.venue_id
"""


@bound_query("check_venues", f"""
with s as ({STG_VENUES_SQL}),
r as (select s.*, case when venue_id is null or coalesce(trim(name) = '', true) then 'Missing venue_id or name; ' end as r1 from s),
r2 as (select *, sum(case when r1 is null then 1 else 0 end) over (partition by venue_id) as n from r)
select venue_id, capacity,
  coalesce(r1, case when n > 1 then 'Duplicate venue_id; ' when capacity < 0 then 'Negative capacity; ' end) is null as is_valid,
  coalesce(r1, case when n > 1 then 'Duplicate venue_id; ' when capacity < 0 then 'Negative capacity; ' end) as error_reason
from r2
""")
def q_check_venues(b):
    return V.check_venues(b.sql(STG_VENUES_SQL)).flagged.select("venue_id", "capacity", "is_valid", "error_reason")


@bound_query("check_news", """
with r as (select *, case
    when article_id is null or title is null or url is null or published_at_utc is null then 'missing mandatory field; '
    when tab not in ('transfers', 'injuries', 'matchreports') then 'unknown tab; ' end as r1 from v_news),
d as (select url from v_news where url is not null group by url having count(distinct article_id) > 1)
select article_id, tab,
  coalesce(r1, case when url in (select url from d) then 'duplicate url; ' end) is null as is_valid,
  coalesce(r1, case when url in (select url from d) then 'duplicate url; ' end) as error_reason from r
""")
def q_check_news(b):
    return V.check_news(b.v_news).flagged.select("article_id", "tab", "is_valid", "error_reason")


# V10 -----------------------------------------------------------------------------
@bound_query("table_constraints", """
select 'catalog_windows_subset' as rule,
  count(*) filter (where not coalesce(list_has_all(['summer', 'winter'], target_windows), true)) as n from v_catalog
union all select 'news_tab_whitelist', count(*) filter (where not coalesce(tab in ('transfers', 'injuries', 'matchreports'), true)) from v_news
union all select 'fixtures_home_ne_away', count(*) filter (where not coalesce(home_team_id <> away_team_id, true)) from v_fixtures
""")
def q_table_constraints(b):
    from touchline.functions.scalars import CATALOG_WINDOWS, NEWS_TABS
    allowed = F.array(*[F.lit(x) for x in CATALOG_WINDOWS])
    a = V.check_constraints(b.v_catalog, {"catalog_windows_subset":
                                          F.size(F.array_except(c("target_windows"), allowed)) == 0})
    n = V.check_constraints(b.v_news, {"news_tab_whitelist": c("tab").isin(NEWS_TABS)})
    f = V.check_constraints(b.v_fixtures, {"fixtures_home_ne_away": c("home_team_id") != c("away_team_id")})
    return a.unionByName(n).unionByName(f)
