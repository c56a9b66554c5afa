"""Scope units (W01–W13) bound to the test control tables, with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import scope as W
from touchline.plans.registry import bound_query

c = F.col
AS_OF = "2000-08-15"
_SLUG_ALIAS = ("case when ends_with(lower(regexp_replace(trim({n}), '\\s+', '_', 'g')), '_' || cast({i} as varchar)) "
               "then lower(regexp_replace(trim({n}), '\\s+', '_', 'g')) "
               "else lower(regexp_replace(trim({n}), '\\s+', '_', 'g')) || '_' || cast({i} as varchar) end")


def _alias(n, i):
    return _SLUG_ALIAS.format(n=n, i=i)


@bound_query("league_scope", "select * from v_catalog where is_enabled")
def q_league_scope(b):
    return W.league_scope(b.v_catalog)


@bound_query("league_scope_ids", "select * from v_catalog where league_id in (1, 2)")
def q_league_scope_ids(b):
    return W.league_scope(b.v_catalog, ids=[1, 2], include_disabled=True)


_RESOLVE = """
select sc.league_id, cast(coalesce({forced}
    (select max(season_year) from v_seasons s where s.league_id = sc.league_id and s.is_current),
    (select max(season_year) from v_seasons s where s.league_id = sc.league_id and {rng}),
    (select max(season_year) from v_seasons s where s.league_id = sc.league_id){fallback}) as integer) as season_year
from v_catalog sc where sc.is_enabled
"""


@bound_query("resolve_season_4", _RESOLVE.format(
    forced="", rng=f"date '{AS_OF}' between s.start_date and s.end_date", fallback=", sc.last_season"))
def q_resolve4(b):
    return W.resolve_season(W.league_scope(b.v_catalog), b.v_seasons, AS_OF)


@bound_query("resolve_season_3", _RESOLVE.format(
    forced="", rng=f"(s.start_date is null or s.start_date <= date '{AS_OF}') and "
                   f"(s.end_date is null or s.end_date >= date '{AS_OF}')", fallback=""))
def q_resolve3(b):
    return W.resolve_season(W.league_scope(b.v_catalog), b.v_seasons, AS_OF, open_bounds=True,
                            catalog_fallback=False)


@bound_query("resolve_season_forced", _RESOLVE.format(
    forced="1997,", rng=f"date '{AS_OF}' between s.start_date and s.end_date", fallback=", sc.last_season"))
def q_resolve_forced(b):
    return W.resolve_season(W.league_scope(b.v_catalog), b.v_seasons, AS_OF, forced=1997)


@bound_query("in_season_scope", f"""
select s.league_id, s.season_year, s.season_str, coalesce(c.folder_alias, {_alias('l.league_name', 's.league_id')}) as alias
from v_seasons s join v_catalog c on c.league_id = s.league_id and c.is_enabled
left join v_leagues l on l.league_id = s.league_id
where s.is_current and s.start_date <= date '{AS_OF}' and s.end_date + interval 7 day >= date '{AS_OF}'
""")
def q_in_season(b):
    return W.in_season(b.v_leagues, b.v_seasons, b.v_catalog, AS_OF, 7)


@bound_query("current_season_worklist", f"""
select s.league_id, s.season_year, s.season_str, coalesce(c.folder_alias, {_alias('l.league_name', 's.league_id')}) as alias
from v_catalog c join v_seasons s on s.league_id = c.league_id and s.is_current
left join v_leagues l on l.league_id = c.league_id
where c.is_enabled
""")
def q_worklist(b):
    return W.current_worklist(b.v_catalog, b.v_seasons, b.v_leagues)


_WINDOW_SQL = """
with first as (select c.league_id, s.season_year from v_catalog c join v_seasons s on s.league_id = c.league_id
               where c.is_enabled and s.is_current and list_contains(c.target_windows, '{w}'))
select * from first
union all
select league_id, cast(case when month(date '{a}') >= 7 then year(date '{a}') else year(date '{a}') - 1 end as integer)
from v_catalog where is_enabled and not exists (select 1 from first)
"""


@bound_query("window_targets", _WINDOW_SQL.format(w="summer", a=AS_OF))
def q_window_targets(b):
    return W.window_targets(b.v_catalog, b.v_seasons, "summer", AS_OF)


@bound_query("window_targets_fallback", _WINDOW_SQL.format(w="spring", a=AS_OF))
def q_window_targets_fallback(b):
    return W.window_targets(b.v_catalog, b.v_seasons, "spring", AS_OF)


# Per-file outcomes derived from the ledger: a file failed when its load
# date is missing; the group is done only if every file succeeded.
OUTCOMES = """
select league_id, season_year, blob_path, teams_load_date is not null as ok,
  cast(teams_load_date as timestamp) as loaded_at from v_ledger
union all
select league_id, season_year, concat(blob_path, '.inc'), league_id <> 1 as ok, cast(upd_date as timestamp) from v_ledger
"""


@bound_query("ingest_outcomes", f"""
select league_id, season_year, bool_and(ok) as all_ok, count(*) as files, count(*) filter (where not ok) as failed,
  max(loaded_at) as last_load_ts, timestamp '{AS_OF} 00:00:00' as stamped_at
from ({OUTCOMES}) o group by league_id, season_year
""")
def q_ingest_outcomes(b):
    o = b.sql(OUTCOMES).withColumn("loaded_at", c("loaded_at").cast("timestamp_ntz"))
    return W.ingest_outcomes(o, f"{AS_OF} 00:00:00")


@bound_query("finished_in_lookback", """
select * from v_fixtures where fixture_date >= timestamp '1998-07-20 00:00:00' - interval 8 day
  and fixture_date <= timestamp '1998-07-20 00:00:00' and status in ('FT')
""")
def q_lookback_closed(b):
    return W.finished_in_lookback(b.v_fixtures, "1998-07-20 00:00:00", 8, ("FT",), closed=True)


@bound_query("finished_in_lookback_dates", """
select * from v_fixtures where fixture_date >= cast(date '1998-07-20' - interval 14 day as timestamp)
  and fixture_date < cast(date '1998-07-20' + interval 1 day as timestamp) and status in ('FT','AET','PEN')
""")
def q_lookback_dates(b):
    return W.finished_in_lookback(b.v_fixtures, "1998-07-20", 14, ("FT", "AET", "PEN"), closed=False)


@bound_query("season_fixtures", f"""
with r as ({_RESOLVE.format(forced="", rng=f"date '{AS_OF}' between s.start_date and s.end_date",
                              fallback=", sc.last_season")})
select f.*, cast(f.season_year as varchar) || '_' || lpad(cast((f.season_year + 1) % 100 as varchar), 2, '0') as season_folder
from v_fixtures f where exists (select 1 from r where r.league_id = f.league_id and r.season_year = f.season_year)
  and f.status in ('FT','AET','PEN')
""")
def q_season_fixtures(b):
    r = W.resolve_season(W.league_scope(b.v_catalog), b.v_seasons, AS_OF)
    return W.season_fixtures(b.v_fixtures, r, ("FT", "AET", "PEN"))


@bound_query("missing_league_seasons", f"""
select s.league_id, s.season_year, coalesce(s.season_str, cast(s.season_year as varchar) || '_' ||
  lpad(cast((s.season_year + 1) % 100 as varchar), 2, '0')) as season_str, {_alias('l.league_name', 's.league_id')} as alias
from v_seasons s left join v_leagues l on l.league_id = s.league_id
where not exists (select 1 from v_ledger g where g.league_id = s.league_id and g.season_year = s.season_year)
""")
def q_missing_seasons(b):
    return W.missing_seasons(b.v_seasons, b.v_leagues, b.v_ledger)


_GEO = """
with sc as (select league_id, season_year from v_seasons where {scope}),
st as (select b.team_id from v_bridge b join sc on sc.league_id = b.league_id and sc.season_year = b.season_year),
missing as (select * from v_venues where city is null or country is null)
select * from missing m where exists (select 1 from st join v_teams t on t.team_id = st.team_id where t.venue_id = m.venue_id)
union all
select * from missing where not exists (select 1 from st)
"""


@bound_query("venues_missing_geo", _GEO.format(scope="season_year = 1997"))
def q_venues_geo(b):
    return W.venues_missing_geo(b.v_venues, b.v_teams, b.v_bridge, b.v_seasons.where(c("season_year") == 1997))


@bound_query("venues_missing_geo_global", _GEO.format(scope="season_year = 1900"))
def q_venues_geo_global(b):
    return W.venues_missing_geo(b.v_venues, b.v_teams, b.v_bridge, b.v_seasons.where(c("season_year") == 1900))


@bound_query("latest_season_per_league", """
select g.league_id, max(g.season_year) as season_year, lower(regexp_replace(trim(any_value(l.league_name)), '\\s+', '_', 'g')) as slug,
  cast(max(g.season_year) as varchar) || '_' || lpad(cast((max(g.season_year) + 1) % 100 as varchar), 2, '0') as season_str
from v_ledger g left join v_leagues l on l.league_id = g.league_id group by g.league_id
""")
def q_latest_seasons(b):
    return W.latest_seasons(b.v_ledger, b.v_leagues)


DIRECTORY = """
select league_id, array_sort(collect_list(season_year)) as seasons from v_seasons group by league_id
"""


@bound_query("season_year_expand", """
with d as (select league_id, list_sort(list(season_year)) as seasons from v_seasons group by league_id),
j as (select c.league_id, c.first_season, coalesce(c.last_season, list_max(d.seasons)) as last
      from v_catalog c left join d on d.league_id = c.league_id where c.is_enabled)
select league_id, cast(unnest(range(first_season, last + 1)) as integer) as season_year from j
where last is not null and last >= first_season
""")
def q_expand(b):
    return W.expand_seasons(b.v_catalog, b.sql(DIRECTORY))


# W07 (window pruning) -------------------------------------------------------------
FINISHED_WINDOWS = "select league_id, 'summer' as target_window from v_catalog where league_id % 2 = 0"


@bound_query("drop_finished_windows", f"""
with d as (select league_id, list(target_window) as done from ({FINISHED_WINDOWS}) x group by league_id)
select c.league_id, case when d.done is null then c.target_windows
  else list_filter(c.target_windows, lambda w: not list_contains(d.done, w)) end as target_windows
from v_catalog c left join d on d.league_id = c.league_id
""")
def q_drop_finished_windows(b):
    return W.drop_finished_windows(b.v_catalog, b.sql(FINISHED_WINDOWS)).select("league_id", "target_windows")
