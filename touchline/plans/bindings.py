"""Test-table bindings: the star-schema test tables viewed as football tables.

The driver's test data is a TPC-H-like star schema. These views derive the
football tables from it by integer arithmetic (defects are planted on
purpose so every validation rule has something to find). The same SQL text
runs on Spark (temp views) and on DuckDB (inlined as CTEs in the oracle);
for DuckDB ``as string)`` is spelled ``as varchar)``.

Every view reads whole base tables, so the work of each bound query grows
with the scale factor.
"""

from __future__ import annotations

import re
import threading

from pyspark.sql import DataFrame, SparkSession

from touchline.functions.joins import bounded_broadcast, is_small
from touchline.sources.versions import succeeded

# Base tables the views join to the large ones (orders, lineitem).
CHECKED_BROADCAST = ("region", "nation", "customer", "supplier")

# Tables of more rows come in many files or row groups, or out of a shuffle: they are stored as they are dealt.
EVENED_MAX_ROWS = 2_000_000

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
               "lineitem", "events", "documents", "embeddings", "pages",
               "benchmark", "labels", "conversations")

# Binding views, in dependency order.
VIEWS: dict[str, str] = {}

VIEWS["v_leagues"] = """
select r_regionkey as league_id, r_name as league_name,
  case when r_regionkey % 2 = 0 then 'East' else 'West' end as league_country,
  r_regionkey < 3 as is_popular, 5 - r_regionkey as display_order from region
"""

VIEWS["v_teams"] = """
select n_nationkey as team_id, n_name as team_name, n_regionkey as league_id,
  case when n_nationkey % 11 = 10 then -n_nationkey when n_nationkey % 7 <> 0 then n_nationkey end as venue_id from nation
"""

VIEWS["v_venues"] = """
select cast(s_suppkey as int) as venue_id,
  case when s_suppkey % 3 = 0 then concat('Caf&eacute; ', s_name, ' &#8212; &notin; &amp;lt;') when s_suppkey % 3 = 1
       then concat(s_name, ' &#x1F3DF;&ampx') else s_name end as venue_name,
  case when s_suppkey % 4 <> 0 then concat('City ', cast(s_nationkey as string)) end as city,
  case when s_suppkey % 6 <> 0 then concat('Country ', cast(s_nationkey % 5 as string)) end as country
from supplier
"""

VIEWS["v_players"] = """
select cast(c_custkey as int) as player_id,
  case when c_custkey % 2 = 0 then concat('&Eacute;', cast(c_custkey % 9 as string), ' ', c_name, '&rsquo;s&#233')
       else concat('First', cast(c_custkey % 9 as string), ' ', c_name) end as full_name from customer
"""

VIEWS["v_fixtures"] = """
select o_orderkey as fixture_id, cast(c_nationkey % 5 as int) as league_id,
  cast(year(o_orderdate) as int) as season_year, cast(c_nationkey as int) as home_team_id,
  cast((c_nationkey + 5*(1 + o_orderkey % 4)) % 25 as int) as away_team_id, o_orderdate as fixture_date,
  case when o_orderstatus='F' then case when o_orderkey % 11 = 0 then 'AET' when o_orderkey % 13 = 0 then 'PEN' else 'FT' end
       when o_orderstatus='O' then 'NS'
       else case when o_orderkey % 3 = 0 then 'PST' when o_orderkey % 3 = 1 then 'INT' else '1H' end end as status,
  concat('Round ', cast(month(o_orderdate) as string)) as round,
  case when o_orderstatus='F' then cast(o_custkey % 5 as int) end as home_score,
  case when o_orderstatus='F' then cast(o_orderkey % 3 as int) end as away_score,
  cast(case when o_custkey % 40 < 30 then o_custkey % 40 else -(o_custkey % 40) end as int) as venue_id
from orders join customer on c_custkey = o_custkey
"""

VIEWS["v_bridge"] = """
select distinct team_id, league_id, season_year from (
  select home_team_id as team_id, league_id, season_year from v_fixtures
  union all select away_team_id, league_id, season_year from v_fixtures) x where team_id % 6 <> 5
"""

VIEWS["v_seasons"] = """
select league_id, season_year, make_date(season_year, 1, 15) as start_date,
  case when league_id = 4 then null else make_date(season_year, 11, 30) end as end_date,
  season_year = 2000 and league_id < 3 as is_current,
  concat(cast(season_year as string), '_', lpad(cast((season_year + 1) % 100 as string), 2, '0')) as season_str
from (select distinct league_id, season_year from v_fixtures) x
"""

VIEWS["v_catalog"] = """
select r_regionkey as league_id, concat(lower(r_name), '_', cast(r_regionkey as string)) as folder_alias, r_name as league_name,
  1995 as first_season, case when r_regionkey <> 3 then 2001 end as last_season, r_regionkey <> 2 as is_enabled,
  r_regionkey >= 1 as backfill_done, r_regionkey >= 2 as full_done, r_regionkey >= 4 as baseline_loaded,
  split(case when r_regionkey % 2 = 0 then 'summer,winter' else 'winter' end, ',') as target_windows from region
"""

VIEWS["v_ledger"] = """
select league_id, season_year, concat('teams/', cast(league_id as string), '/', season_str, '/teams.json') as blob_path,
  case when league_id % 3 = 0 then null else make_date(season_year, 8, 1) end as teams_load_date,
  make_date(season_year, case when league_id = 1 then 9 else 7 end, 1) as upd_date
from v_seasons where season_year < 2001 or league_id < 3
"""

VIEWS["v_stg_fixtures"] = """
select fixture_id as stg_id,
  case when fixture_id % 97 = 0 then null else fixture_id - (case when fixture_id % 50 = 1 then 1 else 0 end) end as fixture_id,
  league_id, season_year,
  case when fixture_id % 61 = 0 then away_team_id when fixture_id % 71 = 0 then 900 else home_team_id end as home_team_id,
  case when fixture_id % 73 = 0 then 901 else away_team_id end as away_team_id,
  fixture_date, status, round, home_score, away_score, venue_id from v_fixtures
"""

VIEWS["v_stg_events"] = """
select l_orderkey*10 + l_linenumber as ord1, l_partkey as ord2, l_suppkey as ord3, l_extendedprice as ord4,
  case when l_partkey % 89 = 0 then -1 else l_orderkey end as fixture_id,
  case when l_partkey % 83 = 0 then 140 when l_partkey % 79 = 0 then null
       else cast(l_quantity as int)*2 - (cast(l_quantity as int)*2) % 30 end as minute,
  case when l_linenumber = 7 then cast(l_suppkey % 50 as int) end as minute_extra,
  cast(l_suppkey % 2 as int) as team_id, cast(l_partkey % 2 as int) as player_id,
  case when l_returnflag = 'A' then cast(case when l_suppkey % 17 = 0 then -l_suppkey else l_suppkey end as int) end as assist_player_id,
  case when l_partkey % 67 = 0 then 'Shot' when l_returnflag = 'A' then 'Goal' when l_returnflag = 'N' then 'Card' else 'subst' end as event_type,
  case when l_returnflag = 'N' then case when l_linestatus = 'F' then 'Yellow Card' else 'Red Card' end
       when l_returnflag = 'A' then 'Normal Goal' else 'Substitution 1' end as event_detail from lineitem
"""

VIEWS["v_stg_stats"] = """
select fixture_id, team_id, shots_on_goal, shots_off_goal, shots_inside_box, shots_outside_box, total_shots, possession,
  goalkeeper_saves, total_passes, passes_accurate, pass_accuracy, blocked_shots, corners, offsides, fouls, yellow_cards,
  red_cards, load_seq from (
  select fixture_id, case when fixture_id % 59 = 0 then null else home_team_id end as team_id,
    cast(fixture_id % 9 as int) - 1 as shots_on_goal,
    case when fixture_id % 67 = 0 then -1 else cast(fixture_id % 7 as int) end as shots_off_goal,
    case when fixture_id % 61 = 0 then -1 else cast(fixture_id % 8 as int) end as shots_inside_box,
    case when fixture_id % 53 = 0 then -1 else cast(fixture_id % 6 as int) end as shots_outside_box,
    case when fixture_id % 127 = 0 then -1 else cast(10 + fixture_id % 5 as int) end as total_shots,
    cast(fixture_id % 104 as int) as possession,
    case when fixture_id % 113 = 0 then -1 else cast(fixture_id % 6 as int) end as goalkeeper_saves,
    case when fixture_id % 109 = 0 then -1 else cast(300 + fixture_id % 200 as int) end as total_passes,
    case when fixture_id % 107 = 0 then -1 else cast(200 + fixture_id % 90 as int) end as passes_accurate,
    case when fixture_id % 3 = 0 then cast(fixture_id % 101 as int) end as pass_accuracy,
    cast(fixture_id % 97 as int) - 1 as blocked_shots, cast(fixture_id % 89 as int) - 1 as corners,
    cast(fixture_id % 83 as int) - 1 as offsides, cast(fixture_id % 79 as int) - 1 as fouls,
    cast(fixture_id % 73 as int) - 1 as yellow_cards, cast(fixture_id % 71 as int) - 1 as red_cards, 1 as load_seq
  from v_fixtures where fixture_id % 5 <> 4
  union all
  select fixture_id, away_team_id, cast(fixture_id % 5 as int), cast(fixture_id % 4 as int), cast(fixture_id % 3 as int),
    cast(fixture_id % 2 as int), 9, cast(100 - fixture_id % 100 as int), cast(fixture_id % 7 as int), 250, 180, cast(null as int),
    3, 4, 2, 11, 1, 0, 1
  from v_fixtures where fixture_id % 6 <> 5
  union all
  select fixture_id, away_team_id, 3, 3, 3, 3, 9, 50, 2, 0, null, cast(null as int),
    null, 4, 2, 11, 1, 0, 2 from v_fixtures where fixture_id % 41 = 0) x
"""

# Per-team season totals from finished fixtures; v_stg_standings plants its
# defects on top (written as a union instead of a join with a 2-row table).
VIEWS["v_standings_base"] = """
select league_id, season_year, team_id, n, w, d, l, gf, ga, 3*w + d as pts,
  cast(row_number() over (partition by league_id, season_year order by 3*w + d desc, gf - ga desc, team_id) as int) as rnk
from (select league_id, season_year, team_id, cast(count(*) as int) as n, cast(sum(case when g > a then 1 else 0 end) as int) as w,
        cast(sum(case when g = a then 1 else 0 end) as int) as d, cast(sum(case when g < a then 1 else 0 end) as int) as l,
        cast(sum(g) as int) as gf, cast(sum(a) as int) as ga
      from (select league_id, season_year, home_team_id as team_id, home_score as g, away_score as a from v_fixtures where status in ('FT','AET','PEN')
            union all select league_id, season_year, away_team_id, away_score, home_score from v_fixtures where status in ('FT','AET','PEN')) lf
      group by league_id, season_year, team_id) t
"""

_STG_STANDINGS_COLS = """case when team_id = 11 and season_year = 1997 then null else league_id end as league_id, season_year,
  case when team_id = 12 and season_year = 1998 then 999 else team_id end as team_id,
  case when league_id = 1 then 'MLS, Group A 2024/25' when league_id = 2 and team_id % 2 = 0 then 'East - 2024' else '' end as group_label,
  case when team_id = 3 and season_year = 1996 then 0 when team_id = 4 and season_year = 1999 then null else rnk end as rank,
  case when team_id = 7 then pts - 1 when team_id = 8 and season_year = 1996 then -1 else pts end as points,
  case when team_id = 9 and season_year = 1997 then n + 1 else n end as played, case when team_id = 16 and season_year = 1997 then -1 else w end as win, d as draw, l as lose, gf as goals_for, ga as goals_against,
  case when team_id = 13 and season_year = 1999 then gf when team_id % 10 = 0 then null else gf - ga end as goals_diff"""

VIEWS["v_stg_standings"] = f"""
select {_STG_STANDINGS_COLS}, 1 as stg_seq from v_standings_base
union all
select {_STG_STANDINGS_COLS}, 2 as stg_seq from v_standings_base where team_id = 14 and season_year = 1995
"""

VIEWS["v_stg_players"] = """
select c_custkey as stg_player_id, cast(case when c_custkey % 53 = 0 then null else c_custkey - (case when c_custkey % 40 = 1 then 1 else 0 end) end as int) as player_id,
  case when c_custkey % 47 = 0 then '  ' else concat(' First', cast(c_custkey % 9 as string), ' ') end as firstname,
  case when c_custkey % 47 = 0 then '' else c_name end as lastname,
  case when c_custkey % 47 = 0 then null else concat('First', cast(c_custkey % 9 as string), ' ', c_name) end as full_name,
  make_date(cast(case when c_custkey % 43 = 0 then 1890 when c_custkey % 44 = 0 then 2090 else 1980 + c_custkey % 25 end as int), 6, 15) as birth_date,
  case when c_custkey % 5 = 0 then null else concat(cast(130 + c_custkey % 100 as string), ' cm') end as height,
  case when c_custkey % 7 = 0 then 'n/a' else concat(cast(35 + c_custkey % 120 as string), ' kg') end as weight from customer
"""

VIEWS["v_stg_player_stats"] = """
select l_orderkey*10 + l_linenumber as stg_stats_id, l_extendedprice as ord2,
  case when l_orderkey % 211 = 0 then null else cast(l_partkey as int) end as player_id, cast(l_suppkey % 25 as int) as team_id,
  cast(l_suppkey % 5 as int) as league_id, cast(year(l_shipdate) as int) as season,
  cast(l_quantity as int) - (case when l_orderkey % 101 = 0 then 60 else 0 end) as appearances,
  cast(l_quantity as int) - 3 + (case when l_orderkey % 103 = 0 then 9 else 0 end) as lineups,
  cast(l_quantity as int) * 80 as minutes_played, cast(l_linenumber as int) as goals from lineitem
"""

VIEWS["v_news"] = """
select cast(event_id as string) as article_id,
  case when event_type in ('click','view') then 'transfers' when event_type = 'error' then 'injuries' else 'matchreports' end as tab,
  concat('Item ', cast(event_id as string)) as title, concat('https://x.example/', cast(event_id as string)) as url, ts as published_at_utc from events
"""

_VIEW_REF = re.compile(r"\bv_[a-z_]+\b")
# Build-if-missing of stored tables must not race when queries run from threads.
_STORE_LOCK = threading.RLock()


def _deps(name: str) -> list[str]:
    return [v for v in dict.fromkeys(_VIEW_REF.findall(VIEWS[name])) if v in VIEWS and v != name]


def _bases(name: str) -> list[str]:
    return [t for t in BASE_TABLES if re.search(rf"\b{t}\b", VIEWS[name])]


def _closure(names) -> list[str]:
    """Views needed by ``names`` (transitively), in dependency order."""
    needed: set[str] = set()

    def visit(n: str) -> None:
        if n in needed:
            return
        for d in _deps(n):
            visit(d)
        needed.add(n)

    for n in names:
        visit(n)
    return [v for v in VIEWS if v in needed]


def duckdb_sql(body: str) -> str:
    """Inline every binding view ``body`` uses as a CTE, in DuckDB dialect."""
    used = [v for v in dict.fromkeys(_VIEW_REF.findall(body)) if v in VIEWS]
    ctes = []
    for v in _closure(used):
        text = VIEWS[v].strip().replace("as string)", "as varchar)")
        ctes.append(f"{v} as (\n{text}\n)")
    body = body.strip()
    if not ctes:
        return body
    if body[:4].lower() == "with":
        return "with " + ",\n".join(ctes) + ",\n" + body[4:].lstrip()
    return "with " + ",\n".join(ctes) + "\n" + body


class Bound:
    """Base tables of one scale-factor folder plus the binding views.

    ``bound.table("v_fixtures")`` returns a DataFrame. Base tables are read
    with ``spark.read.parquet`` (column pruning and filter pushdown apply);
    views are registered as temp views so SQL and DataFrame code can mix.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, materialize: bool = True):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self.materialize = materialize
        self._loaded: set[str] = set()

    def _stored_path(self, name: str) -> str:
        import hashlib
        from touchline.session import ensure_checkpoint_dir
        key = hashlib.sha1(self.sf_dir.encode()).hexdigest()[:12]
        return f"{ensure_checkpoint_dir(self.spark).rstrip('/')}/touchline-bound/{key}/{name}"

    def _read_stored(self, name: str) -> DataFrame | None:
        path = self._stored_path(name)
        return self.spark.read.parquet(path) if succeeded(self.spark, path) else None

    def _stored(self, name: str) -> DataFrame:
        with _STORE_LOCK:
            return self._stored_unlocked(name)

    def _stored_unlocked(self, name: str) -> DataFrame:
        """The view as a stored Parquet table (the application's tables are
        stored, not views over other tables): written once per run below the
        session's checkpoint folder, then read. Cuts the lineage, so every
        unit starts from the stored table instead of re-deriving it."""
        df = self._read_stored(name)
        if df is None:
            self._ensure_deps(name)
            sources = [self.spark.table(t) for t in (*_deps(name), *_bases(name))]
            self._evened(self.spark.sql(VIEWS[name]), sources).write.mode("overwrite").parquet(self._stored_path(name))
            df = self.spark.read.parquet(self._stored_path(name))
        return df

    def _evened(self, df: DataFrame, sources) -> DataFrame:
        """One file per core: a single small file would be scanned by one task. With a large
        source there are files enough, and no row is moved for it."""
        if not all(is_small(s, EVENED_MAX_ROWS) for s in sources):
            return df
        return df.repartition(self.spark.sparkContext.defaultParallelism)

    def stored(self, name: str, build, source: DataFrame | None = None) -> DataFrame:
        """A table derived by library operators (e.g. the production events
        table a serving query reads), stored once per run like the views;
        ``build()`` returns its DataFrame, of about the rows of ``source``,
        if given. Inline when not materializing."""
        if not self.materialize:
            return build()
        with _STORE_LOCK:
            return self._stored_build(name, build, source)

    def _stored_build(self, name: str, build, source: DataFrame | None) -> DataFrame:
        df = self._read_stored(name)
        if df is None:
            df = build()
            self._evened(df, [] if source is None else [source]).write.mode("overwrite").parquet(self._stored_path(name))
            df = self.spark.read.parquet(self._stored_path(name))
        return df

    def _ensure_deps(self, name: str) -> None:
        for dep in _deps(name):
            self._ensure(dep)
        for base in _bases(name):
            self._ensure(base)

    def _ensure(self, name: str) -> None:
        if name in self._loaded:
            return
        if name in VIEWS:
            if self.materialize:
                df = self._stored(name)
            else:
                self._ensure_deps(name)
                df = self.spark.sql(VIEWS[name])
            df.createOrReplaceTempView(name)
        elif name in BASE_TABLES:
            df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            if name in CHECKED_BROADCAST:
                # Joined to the large tables in the views; broadcast only while
                # a row-count check says it is small, else shuffle.
                df = bounded_broadcast(df)
            df.createOrReplaceTempView(name)
        else:
            raise KeyError(name)
        self._loaded.add(name)

    def table(self, name: str) -> DataFrame:
        self._ensure(name)
        return self.spark.table(name)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("v_") or name in BASE_TABLES:
            return self.table(name)
        raise AttributeError(name)

    def sql(self, text: str) -> DataFrame:
        for v in dict.fromkeys(_VIEW_REF.findall(text)):
            if v in VIEWS:
                self._ensure(v)
        for base in BASE_TABLES:
            if re.search(rf"\b{base}\b", text):
                self._ensure(base)
        return self.spark.sql(text)
