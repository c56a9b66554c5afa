"""Source, sink and flattener units bound to the test tables (S02–S05, S08,
K03, F04) with DuckDB oracles.

The snapshot selectors work on file *listings*; here the listings are
derived from whole tables (every order becomes a fixtures / standings /
player snapshot file, every line item a match-events file), so the
selection logic is checked on tens of thousands of paths, including
folders whose names fail the stamp pattern.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import flatten as FL
from touchline.operators import validate as V
from touchline.plans import bound_validate as BV
from touchline.sources import sinks as K
from touchline.sources import snapshots as SN
from touchline.plans.registry import bound_query

c = F.col
AS_OF = "2024-01-15 00:00:00"


def _ymd(d: str) -> str:
    return f"cast(year({d}) * 10000 + month({d}) * 100 + day({d}) as string)"


def _p2(x: str) -> str:
    return f"lpad(cast({x} as string), 2, '0')"


_SEASON = f"concat(cast(year(o_orderdate) as string), '_', {_p2('(year(o_orderdate) + 1) % 100')})"

FIXTURE_FILES = f"""
select cast(c_nationkey % 5 as int) as league_id, cast(year(o_orderdate) as int) as season_year,
  concat('fixtures/', cast(c_nationkey % 5 as string), '/', {_SEASON}, '/',
    case when o_orderkey % 4 = 0 then concat('full/full_', {_ymd('o_orderdate')}, '.json')
         else concat('inc/inc_', {_ymd('o_orderdate')}, 'T', {_p2('o_orderkey % 24')}, {_p2('o_orderkey % 60')}, 'Z.json')
    end) as file_path
from orders join customer on c_custkey = o_custkey
"""

STANDINGS_FILES = f"""
select cast(c_nationkey % 5 as int) as league_id, cast(year(o_orderdate) as int) as season_year,
  concat('standings/', cast(c_nationkey % 5 as string), '/', {_SEASON}, '/',
    case when o_orderkey % 3 = 0 then 'inc_' else 'full_' end,
    cast(year(o_orderdate) as string), '-', {_p2('month(o_orderdate)')}, '-', {_p2('day(o_orderdate)')}, '_',
    {_p2('o_orderkey % 24')}, '-', {_p2('o_orderkey % 60')}, '.json') as file_path
from orders join customer on c_custkey = o_custkey
"""

EVENT_FILES = f"""
select cast(l_suppkey % 5 as int) as league_id, cast(year(l_shipdate) as int) as season_year,
  case when l_linenumber % 2 = 0 then 'full' else 'inc' end as mode,
  concat('match_events/', cast(l_suppkey % 5 as string), '/', cast(year(l_shipdate) as string), '/',
    case when l_linenumber % 2 = 0 then 'full' else 'inc' end, '/',
    case when l_linenumber = 7 then 'inc_latest'
         else concat(case when l_linenumber % 2 = 0 then 'full' else 'inc' end, '_', {_ymd('l_shipdate')}, '_',
                     {_p2('l_partkey % 24')}, {_p2('l_partkey % 60')}, {_p2('l_suppkey % 60')}, 'Z') end,
    '/events_', cast(l_orderkey as string), '.json') as file_path
from lineitem
"""

PLAYER_SNAPSHOTS = f"""
select cast(c_nationkey % 5 as int) as league_id, cast(year(o_orderdate) as int) as season_year,
  concat(case when o_orderkey % 2 = 0 then 'summer' else 'winter' end, '_', {_ymd('o_orderdate')}, '_',
         {_p2('o_orderkey % 24')}, {_p2('o_orderkey % 60')}) as snapshot
from orders join customer on c_custkey = o_custkey
"""


def _duck(sql: str) -> str:
    return sql.replace("as string)", "as varchar)")


# S05 -------------------------------------------------------------------------------
_S05 = f"""
with f as (
  select *, case when regexp_matches(file_path, 'full_(\\d{{8}})\\.json$')
                 then strptime(regexp_extract(file_path, 'full_(\\d{{8}})\\.json$', 1), '%Y%m%d') end as full_ts,
            case when regexp_matches(file_path, 'inc_(\\d{{8}}T\\d{{4}})Z\\.json$')
                 then strptime(regexp_extract(file_path, 'inc_(\\d{{8}}T\\d{{4}})Z\\.json$', 1), '%Y%m%dT%H%M') end as inc_ts
  from ({_duck(FIXTURE_FILES)}) x),
b as (select league_id, season_year, max(full_ts) as base_ts from f where full_ts is not null group by 1, 2)
"""


@bound_query("baseline_plus_increments", _S05 + """
select f.league_id, f.season_year, f.file_path from f join b using (league_id, season_year)
where f.full_ts = b.base_ts or f.inc_ts > b.base_ts
""")
def q_baseline_plus_inc(b):
    chosen, _ = SN.baseline_plus_inc(b.sql(FIXTURE_FILES), ["league_id", "season_year"], "baseline")
    return chosen


@bound_query("latest_increment_only", _S05 + """
, i as (select league_id, season_year, max(inc_ts) as m from f where inc_ts is not null group by 1, 2)
select f.league_id, f.season_year, f.file_path from f join i using (league_id, season_year) where f.inc_ts = i.m
""")
def q_latest_inc(b):
    chosen, _ = SN.baseline_plus_inc(b.sql(FIXTURE_FILES), ["league_id", "season_year"], "inc")
    return chosen


# S02 -------------------------------------------------------------------------------
@bound_query("latest_run_by_timestamp", f"""
with f as (
  select *, try_strptime(nullif(regexp_extract(file_path, '(?:^|/)([a-z]+)_(\\d{{8}}_\\d{{6}})Z/', 2), ''),
                         '%Y%m%d_%H%M%S') as run_ts
  from ({_duck(EVENT_FILES)}) x),
g as (select league_id, season_year, mode, max(run_ts) as m from f where run_ts is not null group by 1, 2, 3)
select f.league_id, f.season_year, f.mode, f.file_path, f.run_ts
from f join g using (league_id, season_year, mode) where f.run_ts = g.m
""")
def q_latest_run(b):
    return SN.latest_run(b.sql(EVENT_FILES), ["league_id", "season_year", "mode"], SN.RUN_STAMP_EVENTS,
                         "yyyyMMdd_HHmmss", 2).withColumn("run_ts", c("run_ts").cast("timestamp_ntz"))


# S03 -------------------------------------------------------------------------------
@bound_query("latest_snapshot_by_window", f"""
with f as (select * from ({_duck(PLAYER_SNAPSHOTS)}) x where starts_with(snapshot, 'summer_')),
g as (select league_id, season_year, max(snapshot) as m from f group by 1, 2)
select f.* from f join g using (league_id, season_year) where f.snapshot = g.m
""")
def q_latest_window(b):
    return SN.latest_window(b.sql(PLAYER_SNAPSHOTS), ["league_id", "season_year"], "summer")


def _window_oracle(condition: str) -> str:
    return f"""
with f as (select * from ({_duck(PLAYER_SNAPSHOTS)}) x where {condition}),
g as (select league_id, season_year, max(snapshot) as m from f group by 1, 2)
select f.* from f join g using (league_id, season_year) where f.snapshot = g.m
"""


@bound_query("latest_snapshot_winter", _window_oracle("starts_with(snapshot, 'winter_')"))
def q_latest_window_winter(b):
    return SN.latest_window(b.sql(PLAYER_SNAPSHOTS), ["league_id", "season_year"], "winter")


@bound_query("latest_snapshot_any", _window_oracle("true"))
def q_latest_window_any(b):
    return SN.latest_window(b.sql(PLAYER_SNAPSHOTS), ["league_id", "season_year"], "latest")


# S04 -------------------------------------------------------------------------------
@bound_query("latest_file_by_stamp", f"""
with f as (select *, try_strptime(regexp_extract(file_path, '([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}_[0-9]{{2}}-[0-9]{{2}})\\.json$', 1), '%Y-%m-%d_%H-%M') as t
           from ({_duck(STANDINGS_FILES)}) x)
select league_id, season_year, file_path from (
  select *, rank() over (partition by league_id, season_year order by t desc nulls last, file_path desc) as n from f) y where n = 1
""")
def q_latest_file_by_stamp(b):
    return SN.latest_file(b.sql(STANDINGS_FILES), ["league_id", "season_year"], by_embedded_ts=True)


@bound_query("latest_file_lexicographic", f"""
with f as ({_duck(STANDINGS_FILES)}),
g as (select league_id, season_year, max(file_path) as m from f group by 1, 2)
select f.* from f join g using (league_id, season_year) where f.file_path = g.m
""")
def q_latest_file(b):
    return SN.latest_file(b.sql(STANDINGS_FILES), ["league_id", "season_year"])


# S08 -------------------------------------------------------------------------------
@bound_query("changed_blobs", """
with m as (select league_id, max(season_year) as season_year from v_ledger group by league_id)
select l.* from v_ledger l join m using (league_id, season_year)
where l.teams_load_date is null or l.teams_load_date < l.upd_date
""")
def q_changed_blobs(b):
    return SN.changed_blobs(b.v_ledger)


# K03 -------------------------------------------------------------------------------
_LOG = f"""
with f as ({BV.FIXTURES_FLAGGED_SQL}),
rej as (select 'stg_fixtures' as staging_table, coalesce(cast(fixture_id as varchar), '<NULL>') as record_key,
               trim(error_reason, '; ') as error_reason from f where not is_valid and error_reason is not null),
old as (select * from rej where error_reason = 'missing_home_team')
"""


@bound_query("append_error_log_dedupe", _LOG + f"""
select distinct staging_table, record_key, error_reason, timestamp '{AS_OF}' as created_at from rej r
where not exists (select 1 from old o where o.staging_table = r.staging_table and o.record_key = r.record_key
                  and o.error_reason = r.error_reason)
""")
def q_append_errors_dedupe(b):
    rej = V.check_fixtures(b.v_stg_fixtures, b.v_teams).rejects
    old = rej.where(c("error_reason") == "missing_home_team")
    return K.append_errors(old, rej, AS_OF, dedupe=True)


@bound_query("append_error_log_plain", f"""
with f as ({BV.STATS_FLAGGED_SQL})
select 'stg_match_statistics' as staging_table,
  cast(coalesce(fixture_id, -1) as varchar) || '-' || cast(coalesce(team_id, -1) as varchar) as record_key,
  error_reason, timestamp '{AS_OF}' as created_at
from f where not is_valid and error_reason is not null
""")
def q_append_errors_plain(b):
    rej = V.check_match_statistics(b.v_stg_stats, latest_order=[c("load_seq")]).rejects
    return K.append_errors(None, rej, AS_OF, dedupe=False)


# F04 on an EAV table ----------------------------------------------------------------
# Which statistic type each line number plays (both spellings of
# the box statistics appear; line 7 repeats line 6's type, so the later wins).
LINE_TYPES = [(1, "Shots on Goal"), (2, "Shots insidebox"), (3, "Shots inside box"), (4, "Ball Possession"),
              (5, "Passes %"), (6, "Total Shots"), (7, "Total Shots")]
_TYPE_CASE = "case l_linenumber " + " ".join(f"when {n} then '{t}'" for n, t in LINE_TYPES) + " end"
EAV = f"""
select l_orderkey as fixture_id, cast(l_suppkey % 2 as int) as team_id, l_linenumber as pos,
  l_partkey as ord2, l_suppkey as ord3, l_extendedprice as ord4, {_TYPE_CASE} as type,
  case when l_linenumber in (4, 5) then concat(cast(cast(l_quantity as int) as string), '%')
       when l_partkey % 13 = 0 then 'n/a'
       when l_partkey % 11 = 0 then cast(l_quantity + 0.5 as string)
       else cast(cast(l_quantity as int) as string) end as value
from lineitem
"""
_COLS = list(dict.fromkeys(FL.STAT_TYPES.values()))


def _duck_stat(x: str) -> str:
    v = f"arg_max(value, struct_pack(p := pos, a := ord2, b := ord3, c := ord4)) filter (where col = '{x}')"
    if x in FL.PERCENT_STATS:
        v = f"regexp_replace({v}, '%$', '')"
    if x in FL.FLOAT_STATS:
        return f"cast(try_cast(trim({v}) as double) as decimal(5,2)) as {x}"
    # int(text) in the source accepts integral text only ('2.5' -> NULL).
    return f"case when regexp_matches(trim({v}), '^[+-]?[0-9]+$') then try_cast(trim({v}) as integer) end as {x}"


_MAP = " ".join(f"when '{k}' then '{v}'" for k, v in FL.STAT_TYPES.items())


@bound_query("pivot_statistics_eav", f"""
with e as (select *, case type {_MAP} end as col from ({_duck(EAV)}) x)
select fixture_id, team_id, {", ".join(_duck_stat(x) for x in _COLS)}
from e where col is not null group by fixture_id, team_id
""")
def q_pivot_eav(b):
    # (line, part, supplier, price) is the unique entry order within a fixture.
    eav = b.sql(EAV).withColumn("entry_order", F.struct("pos", "ord2", "ord3", "ord4"))
    return FL.pivot_stat_entries(eav, ["fixture_id", "team_id"], order_col="entry_order")


# F14 -------------------------------------------------------------------------------
# Players on league pages: customers of even nations; squads: customers with
# orders (the squad of each order's home team), many not on pages.
PAGE_PLAYERS = """
select cast(c_custkey as int) as player_id, c_name as name, concat('p/', cast(c_custkey as string)) as photo
from customer where c_nationkey % 2 = 0
"""
SQUAD_PLAYERS = """
select cast(o_custkey as int) as player_id, concat('Squad ', cast(o_custkey as string)) as name,
  cast(null as string) as photo from orders
"""


@bound_query("players_from_pages_and_squads", f"""
with seen as (select * from (select *, row_number() over (partition by player_id order by name, photo) as rn
                             from ({_duck(PAGE_PLAYERS)}) x where player_id is not null) y where rn = 1),
sq as (select * from (select *, row_number() over (partition by player_id order by name, photo) as rn
                      from ({_duck(SQUAD_PLAYERS)}) x where player_id is not null) y where rn = 1)
select player_id, name, photo, 'page' as source from seen
union all
select player_id, name, photo, 'squad' from sq where player_id not in (select player_id from seen)
""")
def q_supplement_players(b):
    return FL.supplement_players(b.sql(PAGE_PLAYERS), b.sql(SQUAD_PLAYERS))


# C05 / C06 -----------------------------------------------------------------------
@bound_query("html_clean_pages", r"""
select page_id, nullif(trim(regexp_replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'),
    '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;?', '&', 'g')), '') as text
from pages
""")
def q_html_clean_pages(b):
    """All pages' text; the oracle knows the references that occur in them by itself."""
    from touchline.functions.scalars import strip_html
    return b.pages.select("page_id", strip_html("html").alias("text"))
