"""Declarative staging validation (V00) and the rule sets V01–V11.

``validate(df, rules, mode)`` returns a :class:`Validation` with

* ``flagged``     — the input plus ``is_valid`` and ``error_reason``;
* ``rule_counts`` — long table ``(rule, n)``: rows each rule fired on;
* ``rejects``     — ``(staging_table, record_key, error_reason)`` for the log.

Two modes, as in the source procedures:

* ``first_failure`` — a rule only looks at rows still valid, so each row
  carries the reason of the first rule it failed;
* ``accumulate``    — every rule tags every row; reasons concatenate.

Rule kinds:

* :class:`RowRule`    — a predicate on the row (NULL counts as not failing);
* :class:`ForeignKey` — the key must exist in a reference table (NULL key =
  missing). Implemented as a left join to the *distinct* reference keys, so
  rows are never duplicated or dropped;
* :class:`Duplicate`  — key groups among a population (valid rows or all
  rows). Either every copy fails (``keep=None``) or all but the one with the
  smallest / largest ``order`` struct. Implemented as a grouped aggregate
  (partial aggregation before the shuffle) looked up by the key
  (``functions.joins.lookup``): null keys, rows outside the population and
  keys with very many rows meet no group of a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.joins import HEAVY_ROWS, bounded_broadcast, is_small, lookup, stored

FIRST_FAILURE = "first_failure"
ACCUMULATE = "accumulate"


@dataclass
class RowRule:
    name: str
    reason: str | Column
    predicate: Column


@dataclass
class ForeignKey:
    name: str
    reason: str | Column
    column: str | Column
    ref: DataFrame
    ref_column: str
    # A dimension reference (teams, venues) is broadcast after a row-count
    # check; a fact reference (fixtures) is left to AQE's runtime choice.
    dimension: bool = True


@dataclass
class Duplicate:
    name: str
    reason: str | Column
    keys: Sequence[Column]
    keep: str | None = None          # None: all copies fail; "min" / "max": keep one
    order: Sequence[Column] = ()     # struct compared for keep
    among: str = "valid"             # population: "valid" rows or "all" rows
    # Key groups only form among rows where every key is non-null.
    require_keys: bool = True


@dataclass
class Validation:
    flagged: DataFrame
    rule_counts: DataFrame
    rejects: DataFrame | None = None
    valid: DataFrame | None = None       # the valid rows of ``flagged``, as it lays them out
    totals: DataFrame | None = None      # ``rule_counts`` and the counts of ``summary``, from one pass
    hit_columns: list[str] = field(default_factory=list)


def _lit_reason(reason) -> Column:
    return F.lit(reason) if isinstance(reason, str) else reason


def _append(reason_col: Column, text: Column, sep: str | None) -> Column:
    if sep is None:
        return F.concat(F.coalesce(reason_col, F.lit("")), text)
    return F.concat_ws(sep, reason_col, text)


def validate(df: DataFrame, rules: Sequence, mode: str = FIRST_FAILURE,
             reason_sep: str | None = None, keep_hits: bool = False,
             start_valid: Column | None = None, start_reason: Column | None = None,
             stage_sides: bool = False) -> Validation:
    """Apply ``rules`` in order. See module docstring for semantics.

    ``reason_sep=None`` appends reasons verbatim (``coalesce(r,'') || text``);
    a string joins them with ``concat_ws(sep, ...)``. ``start_valid`` /
    ``start_reason`` carry flags set upstream (e.g. unreadable documents).
    ``stage_sides=True`` stores duplicate groups and fact reference keys as
    tables (``functions.joins.lookup``): computed once, broadcast when
    they turn out small, so the large staging side is not shuffled — the
    choice for full-size staging tables (the jobs use it). ``False`` keeps one
    lazy plan and leaves join choices to AQE, cheaper for small inputs.
    """
    if mode not in (FIRST_FAILURE, ACCUMULATE):
        raise ValueError(mode)
    out = df.withColumn("is_valid", start_valid if start_valid is not None else F.lit(True)) \
            .withColumn("error_reason", start_reason if start_reason is not None
                        else F.lit(None).cast("string"))
    hits = []
    for i, rule in enumerate(rules):
        hit_name = f"__hit_{i}"
        eligible = F.col("is_valid") if mode == FIRST_FAILURE else F.lit(True)
        if isinstance(rule, RowRule):
            fired = F.coalesce(rule.predicate, F.lit(False))
            out = out.withColumn(hit_name, eligible & fired)
        elif isinstance(rule, ForeignKey):
            local = F.col(rule.column) if isinstance(rule.column, str) else rule.column
            name = f"__fk_{i}"
            ref_keys = (rule.ref.select(F.col(rule.ref_column).alias(name)).where(F.col(name).isNotNull()).distinct()
                        .withColumn(f"__fk_ok_{i}", F.lit(True)))
            out = out.withColumn(name, local)
            if rule.dimension and is_small(ref_keys):
                out = out.join(F.broadcast(ref_keys), name, "left")
            else:
                out = lookup(out, ref_keys, [name], F.lit(True), staged=stage_sides)
            out = out.withColumn(hit_name, eligible & F.col(f"__fk_ok_{i}").isNull()).drop(name, f"__fk_ok_{i}")
        elif isinstance(rule, Duplicate):
            out = _apply_duplicate(out, rule, i, hit_name, eligible, stage_sides)
        else:
            raise TypeError(type(rule))
        out = (out.withColumn("error_reason",
                              F.when(F.col(hit_name), _append(F.col("error_reason"),
                                                              _lit_reason(rule.reason), reason_sep))
                              .otherwise(F.col("error_reason")))
               .withColumn("is_valid", F.col("is_valid") & ~F.col(hit_name)))
        hits.append((rule.name, hit_name))

    v = _counted(out, hits)
    if not keep_hits:
        v.flagged = out.drop(*v.hit_columns)
    return v


def _counted(out: DataFrame, hits: Sequence[tuple[str, str]]) -> Validation:
    """The validation of ``out``, which carries the flag column of each (rule, flag column)."""
    aggs = {n: F.count_if(F.col(h)) for n, h in hits}
    rule_counts = _to_long(out.agg(*[x.alias(n) for n, x in aggs.items()]), list(aggs)) if hits else None
    return Validation(out, rule_counts, valid=out.where("is_valid").drop(*[h for _, h in hits]),
                      totals=summary(out, aggs), hit_columns=[h for _, h in hits])


def _apply_duplicate(out: DataFrame, rule: Duplicate, i: int, hit_name: str,
                     eligible: Column, stage_sides: bool = False) -> DataFrame:
    key_names = [f"__dk_{i}_{j}" for j in range(len(rule.keys))]
    out = out.select("*", *[k.alias(n) for k, n in zip(rule.keys, key_names)])
    if rule.order:
        out = out.withColumn(f"__do_{i}", F.struct(*rule.order))
    population = F.lit(True) if rule.among == "all" else F.col("is_valid")
    if rule.require_keys:
        for n in key_names:
            population = population & F.col(n).isNotNull()
    pop = out.where(population)
    aggs = [F.count(F.lit(1)).alias(f"__dn_{i}")]
    if rule.keep == "min":
        aggs.append(F.min(f"__do_{i}").alias(f"__dkeep_{i}"))
    elif rule.keep == "max":
        aggs.append(F.max(f"__do_{i}").alias(f"__dkeep_{i}"))
    groups = pop.groupBy(*key_names).agg(*aggs).where(F.col(f"__dn_{i}") > 1)
    # Tag population membership so only members of a group can be hit; other rows, and null
    # keys, meet no group of the join.
    out = out.withColumn(f"__dpop_{i}", population)
    joined = lookup(out, groups, key_names, F.col(f"__dpop_{i}"), null_safe=not rule.require_keys, staged=stage_sides)
    in_group = F.col(f"__dpop_{i}") & F.col(f"__dn_{i}").isNotNull()
    if rule.keep is None:
        fired = in_group
    else:
        fired = in_group & (F.col(f"__do_{i}") != F.col(f"__dkeep_{i}"))
    joined = joined.withColumn(hit_name, eligible & F.coalesce(fired, F.lit(False)))
    drop = key_names + [f"__dn_{i}", f"__dpop_{i}"]
    if rule.order:
        drop.append(f"__do_{i}")
    if rule.keep:
        drop.append(f"__dkeep_{i}")
    return joined.drop(*drop)


def _to_long(wide: DataFrame, names: Sequence[str]) -> DataFrame:
    """One-row wide counts -> long (rule, n)."""
    pairs = ", ".join(f"'{n}', `{n}`" for n in names)
    return wide.selectExpr(f"stack({len(names)}, {pairs}) as (rule, n)")


def rejects(flagged: DataFrame, staging_table: str, record_key: Column,
            reason: Column | None = None) -> DataFrame:
    """Rows to log: invalid with a reason."""
    r = reason if reason is not None else F.col("error_reason")
    return (flagged.where(~F.col("is_valid") & F.col("error_reason").isNotNull())
            .select(F.lit(staging_table).alias("staging_table"),
                    record_key.cast("string").alias("record_key"), r.alias("error_reason")))


def summary(flagged: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    """Total / valid / invalid (+ extra named counts) as a long table."""
    cols = {"total_rows": F.count(F.lit(1)),
            "valid_rows": F.count_if(F.col("is_valid")),
            "invalid_rows": F.count_if(~F.col("is_valid"))}
    cols.update(extra or {})
    wide = flagged.agg(*[c.alias(n) for n, c in cols.items()])
    return _to_long(wide, list(cols))


# ---------------------------------------------------------------------------
# Rule sets V01–V09
# ---------------------------------------------------------------------------
c = F.col


def check_fixtures(stg: DataFrame, teams: DataFrame, stage_sides: bool = False) -> Validation:
    """V01 — five rules, first failure; log key fixture_id or '<NULL>'."""
    rules = [
        RowRule("missing_fixture_id", "missing_fixture_id; ", c("fixture_id").isNull()),
        RowRule("home_eq_away", "home_eq_away; ", c("home_team_id") == c("away_team_id")),
        ForeignKey("missing_home_team", "missing_home_team; ", "home_team_id", teams, "team_id"),
        ForeignKey("missing_away_team", "missing_away_team; ", "away_team_id", teams, "team_id"),
        Duplicate("dup_fixture_id", "dup_fixture_id; ", [c("fixture_id")], keep=None, among="valid"),
    ]
    v = validate(stg, rules, FIRST_FAILURE, stage_sides=stage_sides)
    v.rejects = rejects(v.flagged, "stg_fixtures",
                        F.coalesce(c("fixture_id").cast("string"), F.lit("<NULL>")),
                        F.trim(c("error_reason"), F.lit("; "))).distinct()
    return v


def check_match_events(stg: DataFrame, fixtures: DataFrame, teams: DataFrame,
                       order: Sequence[Column], id_col: Column | None = None,
                       strict_nulls: bool = False, stage_sides: bool = True) -> Validation:
    """V02 — four rules, first failure. ``order`` is the staging order
    (surrogate id) used to keep the first of duplicates."""
    type_pred = ~F.lower(c("event_type")).isin("goal", "card", "subst", "var")
    if strict_nulls:
        type_pred = F.coalesce(type_pred, F.lit(True))
    rules = [
        _events_fk(fixtures, teams),
        RowRule("minute", "Bad minute; ",
                c("minute").isNull() | (c("minute") < -10) | (c("minute") > 130)
                | (c("minute_extra").isNotNull() & ((c("minute_extra") < 0) | (c("minute_extra") > 40)))),
        RowRule("type", "Unknown type; ", type_pred),
        Duplicate("dup", "Duplicate; ",
                  [c("fixture_id"), c("minute"), F.coalesce(c("minute_extra"), F.lit(0)), c("team_id"),
                   F.coalesce(c("player_id"), F.lit(0)), F.lower(c("event_type")),
                   F.coalesce(F.lower(c("event_detail")), F.lit(""))],
                  keep="min", order=order, among="valid", require_keys=False),
    ]
    # The fk rule is a composite (fixture OR team missing): expand it.
    v = _validate_events(stg, rules, stage_sides)
    if id_col is not None:
        v.rejects = rejects(v.flagged, "stg_match_events", id_col)
    return v


class _EventsFK:
    """Marker: fixture missing OR team missing, evaluated as two joins."""

    def __init__(self, fixtures, teams):
        self.fixtures, self.teams = fixtures, teams
        self.name, self.reason = "fk", "Missing fixture/team; "


def _events_fk(fixtures, teams):
    return _EventsFK(fixtures, teams)


def _validate_events(stg: DataFrame, rules, stage_sides: bool = False) -> Validation:
    """``stage_sides``: the keys of missing fixtures, and of those with very many rows, are found by one count of the
    rows a fixture and stored, so the rows are not shuffled for them. Then the valid rows of
    a fixture meet once, and duplicates are ranks among them; a heavy fixture's go through
    the groups of ``_apply_duplicate``. ``valid`` stays partitioned by ``fixture_id`` if no fixture is heavy."""
    fk = rules[0]
    if stage_sides:
        return _validate_gathered(stg, rules)
    fx = (fk.fixtures.select(c("fixture_id").alias("__fx")).where(c("__fx").isNotNull()).distinct()
          .withColumn("__fx_ok", F.lit(True)))
    tm = bounded_broadcast(fk.teams.select(c("team_id").alias("__tm")).where(c("__tm").isNotNull()).distinct()
                           .withColumn("__tm_ok", F.lit(True)))
    pre = (lookup(stg.withColumn("__fx", c("fixture_id")), fx, ["__fx"], F.lit(True), staged=stage_sides)
           .join(tm, c("team_id") == c("__tm"), "left")
           .withColumn("__fk_missing", c("__fx_ok").isNull() | c("__tm_ok").isNull())
           .drop("__fx", "__fx_ok", "__tm", "__tm_ok"))
    first = RowRule(fk.name, fk.reason, c("__fk_missing"))
    v = validate(pre, [first, *rules[1:]], FIRST_FAILURE, stage_sides=stage_sides)
    v.flagged, v.valid = v.flagged.drop("__fk_missing"), v.valid.drop("__fk_missing")
    return v


def _validate_gathered(stg: DataFrame, rules) -> Validation:
    fk, *row_rules, dup = rules
    known = fk.fixtures.select(c("fixture_id").alias("__fx")).where(c("__fx").isNotNull()).distinct().withColumn("__known", F.lit(True))
    per_fixture = stg.where(c("fixture_id").isNotNull()).groupBy("fixture_id").agg(F.count(F.lit(1)).alias("__n"))
    odd = stored(per_fixture.join(known, c("fixture_id") == c("__fx"), "left")
                 .select("fixture_id", c("__known").isNull().alias("__unknown"), (c("__n") > HEAVY_ROWS).alias("__heavy"))
                 .where(c("__unknown") | c("__heavy")))
    tm = bounded_broadcast(fk.teams.select(c("team_id").alias("__tm")).where(c("__tm").isNotNull()).distinct()
                           .withColumn("__tm_ok", F.lit(True)))
    pre = (lookup(stg, odd, ["fixture_id"], F.lit(True), staged=True).join(tm, c("team_id") == c("__tm"), "left")
           .withColumn("__fk_missing", c("fixture_id").isNull() | c("__unknown").eqNullSafe(F.lit(True)) | c("__tm_ok").isNull())
           .withColumn("__heavy", c("__heavy").eqNullSafe(F.lit(True))).drop("__unknown", "__tm", "__tm_ok"))
    checked = validate(pre, [RowRule(fk.name, fk.reason, c("__fk_missing")), *row_rules], FIRST_FAILURE, keep_hits=True)
    hit = f"__hit_{len(checked.hit_columns)}"
    rows = checked.flagged
    place = F.rank().over(Window.partitionBy(*dup.keys).orderBy(*dup.order))       # 1: as the smallest of the group
    few = rows.where(c("is_valid") & ~c("__heavy")).repartition("fixture_id").withColumn(hit, place > 1)
    any_heavy = not odd.where(c("__heavy") & ~c("__unknown")).isEmpty()
    if not any_heavy:
        rest = rows.where(~c("is_valid")).withColumn(hit, F.lit(False))
    else:
        rest = _apply_duplicate(rows.where(~c("is_valid") | c("__heavy")), dup, len(checked.hit_columns), hit, c("is_valid"), True)

    def judged(part: DataFrame) -> DataFrame:
        reason = F.when(c(hit), _append(c("error_reason"), _lit_reason(dup.reason), None)).otherwise(c("error_reason"))
        return part.withColumn("error_reason", reason).withColumn("is_valid", c("is_valid") & ~c(hit)).drop("__fk_missing", "__heavy")

    hits = [*zip([fk.name, *[r.name for r in row_rules], dup.name], [*checked.hit_columns, hit])]
    few, rest = judged(few), judged(rest)
    v = _counted(few.unionByName(rest), hits)
    v.flagged = v.flagged.drop(*v.hit_columns)
    if not any_heavy:
        v.valid = few.where("is_valid").drop(*v.hit_columns)
    return v


STAT_COLUMNS = ["shots_on_goal", "shots_off_goal", "shots_inside_box", "shots_outside_box",
                "blocked_shots", "goalkeeper_saves", "total_shots", "corners", "offsides", "fouls",
                "yellow_cards", "red_cards", "total_passes", "passes_accurate"]


def check_match_statistics(stg: DataFrame, latest_order: Sequence[Column],
                           columns: Sequence[str] | None = None, stage_sides: bool = False) -> Validation:
    """V03 — 23 row predicates + duplicate-keep-latest, accumulate-all.

    ``columns`` names the columns of the negative checks (the source checks
    14); a staging frame without one of them is an error.
    ``latest_order`` orders rows so the max is the one kept (e.g. load time,
    then file and position).
    """
    cols = list(columns or STAT_COLUMNS)
    absent = [x for x in cols if x not in stg.columns]
    if absent:
        raise ValueError(f"staging lacks the statistics {absent}")
    rules = [RowRule("missing_keys", "Missing fixture_id or team_id; ",
                     c("fixture_id").isNull() | c("team_id").isNull())]
    rules += [RowRule(f"negative_{x}", f"Negative {x}; ", c(x) < 0) for x in cols]
    rules += [RowRule("range_possession", "Invalid possession (0..100); ",
                      c("possession").isNotNull() & ((c("possession") < 0) | (c("possession") > 100))),
              RowRule("range_pass_accuracy", "Invalid pass_accuracy (0..100); ",
                      c("pass_accuracy").isNotNull() & ((c("pass_accuracy") < 0) | (c("pass_accuracy") > 100))),
              RowRule("shots_sum", "Shots mismatch (on+off > total_shots); ",
                      (c("shots_on_goal") + c("shots_off_goal")) > c("total_shots")),
              RowRule("box_sum", "Inside+Outside > total_shots; ",
                      (c("shots_inside_box") + c("shots_outside_box")) > c("total_shots"))]
    rules += [RowRule(f"component_{x}", f"{x} > total_shots; ", c(x) > c("total_shots"))
              for x in ["shots_on_goal", "shots_off_goal", "shots_inside_box", "shots_outside_box"]]
    rules += [Duplicate("duplicate", "Duplicate staging row; ", [c("fixture_id"), c("team_id")],
                        keep="max", order=latest_order, among="all")]
    v = validate(stg, rules, ACCUMULATE, stage_sides=stage_sides)
    key = F.concat(F.coalesce(c("fixture_id"), F.lit(-1)).cast("string"), F.lit("-"),
                   F.coalesce(c("team_id"), F.lit(-1)).cast("string"))
    v.rejects = rejects(v.flagged, "stg_match_statistics", key)
    return v


def statistics_coverage(flagged_stats: DataFrame, fixtures: DataFrame,
                        statuses=("FT", "AET", "PEN"), by_league: bool = False) -> DataFrame:
    """V03-cov — finished fixtures of the (league, season)s present in staging
    with 2 / 0 / 1 valid team rows (complete / missing / partial)."""
    fx = fixtures.select("fixture_id", "league_id", "season_year", "status")
    scope = (flagged_stats.select("fixture_id").join(fx, "fixture_id")
             .select("league_id", "season_year").distinct())
    valid_rows = (flagged_stats.where(c("is_valid") & c("team_id").isNotNull())
                  .groupBy("fixture_id").agg(F.count(F.lit(1)).alias("valid_rows")))
    finished = fx.where(c("status").isin(list(statuses))).join(scope, ["league_id", "season_year"], "left_semi")
    roll = (finished.join(valid_rows, "fixture_id", "left")
            .withColumn("valid_rows", F.coalesce(c("valid_rows"), F.lit(0))))
    keys = ["league_id"] if by_league else []
    return roll.groupBy(*keys).agg(
        F.count_if(c("valid_rows") == 2).alias("complete2"),
        F.count_if(c("valid_rows") == 0).alias("missing0"),
        F.count_if(c("valid_rows") == 1).alias("partial1"))


def saves_exceed_opponent_shots(flagged_stats: DataFrame) -> DataFrame:
    """V03-dq — fixtures where a keeper's saves exceed the opponent's shots on
    goal (valid rows, teams differ).

    Pair-free: a pair (i, j) with team_i <> team_j and saves_i > sog_j exists
    iff some team's max saves beats the smallest shots-on-goal of *another*
    team. Per fixture only the two smallest per-team minima are needed, so the
    work is linear in the rows even if one fixture holds many rows.
    """
    v = flagged_stats.where(c("is_valid") & c("team_id").isNotNull())
    per_team = v.groupBy("fixture_id", "team_id").agg(
        F.max("goalkeeper_saves").alias("ms"), F.min("shots_on_goal").alias("mg"))
    # One row per team and fixture now, so the windows hold a fixture's teams only: the
    # team with the fewest shots, its shots, and the fewest of the others.
    fixture = Window.partitionBy("fixture_id")
    t = (per_team.withColumn("t1", F.min_by("team_id", F.when(c("mg").isNotNull(), F.struct("mg", "team_id"))).over(fixture))
         .withColumn("g1", F.min("mg").over(fixture))
         .withColumn("g2", F.min(F.when(c("team_id") != c("t1"), c("mg"))).over(fixture)))
    other_min = F.when(c("team_id") == c("t1"), c("g2")).otherwise(c("g1"))
    return (t.where(c("ms") > other_min).groupBy("fixture_id").agg(F.lit(1).alias("__one"))
            .agg(F.count(F.lit(1)).alias("dq_saves_gt_opponent_sog")))


def check_players(stg: DataFrame, as_of, stg_id: str = "stg_player_id", stage_sides: bool = False,
                  since=None) -> Validation:
    """V04 — names normalised (trim -> NULL), five rules, first failure.
    ``since``: rows loaded before it (``load_timestamp``) stay out of the check and its result."""
    from touchline.functions.scalars import blank_to_null, digits_int
    if since is not None:
        stg = stg.where(c("load_timestamp") >= F.lit(str(since)).cast("timestamp_ntz"))
    norm = (stg.withColumn("firstname", blank_to_null("firstname"))
            .withColumn("lastname", blank_to_null("lastname"))
            .withColumn("full_name", blank_to_null("full_name"))
            .withColumn("__h", digits_int("height")).withColumn("__w", digits_int("weight")))
    as_of_d = F.lit(as_of).cast("date") if not isinstance(as_of, Column) else as_of
    bad_h = c("__h").isNotNull() & ((c("__h") < 140) | (c("__h") > 220))
    bad_w = c("__w").isNotNull() & ((c("__w") < 40) | (c("__w") > 150))
    rules = [
        RowRule("missing_id", "Missing player_id; ", c("player_id").isNull()),
        RowRule("blank_name", "Name fields blank; ",
                c("firstname").isNull() & c("lastname").isNull() & c("full_name").isNull()),
        RowRule("birth_date", "Unrealistic birth_date; ",
                c("birth_date").isNotNull() & ((c("birth_date") < F.lit("1900-01-01").cast("date"))
                                               | (c("birth_date") > as_of_d))),
        Duplicate("duplicate", "Duplicate player_id; ", [c("player_id")], keep="max",
                  order=[c(stg_id)], among="all"),
        RowRule("height_weight",
                F.concat(F.when(bad_h, "Unrealistic height; ").otherwise(""),
                         F.when(bad_w, "Unrealistic weight; ").otherwise("")),
                bad_h | bad_w),
    ]
    v = validate(norm, rules, FIRST_FAILURE, stage_sides=stage_sides)
    v.flagged = v.flagged.drop("__h", "__w")
    key = F.concat(F.coalesce(c("player_id").cast("string"), F.lit("NULL")), F.lit("-"), c(stg_id).cast("string"))
    v.rejects = rejects(v.flagged, "stg_players", key)
    return v


def players_rule_counts(stg: DataFrame, as_of) -> DataFrame:
    """V04 counters — independent of validity, as the source prints them."""
    from touchline.functions.scalars import blank_to_null, digits_int
    as_of_d = F.lit(as_of).cast("date")
    n = (stg.withColumn("fn", blank_to_null("firstname")).withColumn("ln", blank_to_null("lastname"))
         .withColumn("fu", blank_to_null("full_name"))
         .withColumn("h", digits_int("height")).withColumn("w", digits_int("weight")))
    dup = (stg.where(c("player_id").isNotNull()).groupBy("player_id").count()
           .where(c("count") > 1).agg(F.coalesce(F.sum(c("count") - 1), F.lit(0)).alias("cnt_dupes")))
    wide = n.agg(
        F.count(F.lit(1)).alias("scoped_total"),
        F.count_if(c("player_id").isNull()).alias("cnt_missing_id"),
        F.count_if(c("fn").isNull() & c("ln").isNull() & c("fu").isNull()).alias("cnt_blank_name"),
        F.count_if(c("birth_date").isNotNull() & ((c("birth_date") < F.lit("1900-01-01").cast("date"))
                                                  | (c("birth_date") > as_of_d))).alias("cnt_birthdate_bad"),
        F.count_if(c("h").isNotNull() & ((c("h") < 140) | (c("h") > 220))).alias("cnt_height_bad"),
        F.count_if(c("w").isNotNull() & ((c("w") < 40) | (c("w") > 150))).alias("cnt_weight_bad"))
    # one-row x one-row: attach with a constant key instead of a cross join
    wide = wide.withColumn("__k", F.lit(1))
    dup = dup.withColumn("__k", F.lit(1))
    both = wide.join(dup, "__k").drop("__k")
    cols = ["scoped_total", "cnt_missing_id", "cnt_blank_name", "cnt_birthdate_bad", "cnt_dupes",
            "cnt_height_bad", "cnt_weight_bad"]
    return _to_long(both.select(*[c(x).cast("bigint").alias(x) for x in cols]), cols)


def check_standings(stg: DataFrame, teams: DataFrame, order: Sequence[Column],
                    stage_sides: bool = False) -> Validation:
    """V05 — R1–R7 accumulate into one trimmed reason; then R8 (duplicate in
    group, keep the first by ``order``) and R9 (team FK) append with a space."""
    r = {
        "R1": c("league_id").isNull() | c("season_year").isNull() | c("team_id").isNull(),
        "R2": c("points") < 0,
        "R3": c("rank").isNotNull() & (c("rank") < 1),
        "R4": (c("played") < 0) | (c("win") < 0) | (c("draw") < 0) | (c("lose") < 0)
              | (c("goals_for") < 0) | (c("goals_against") < 0),
        "R5": c("played") != (c("win") + c("draw") + c("lose")),
        "R6": c("goals_diff") != (c("goals_for") - c("goals_against")),
        "R7": c("points") != (3 * c("win") + c("draw")),
    }
    texts = {"R1": "Missing league/season/team; ", "R2": "Negative points; ", "R3": "Invalid rank (<1); ",
             "R4": "Negative numeric; ", "R5": "Played != W+D+L; ", "R6": "GoalsDiff != GF-GA; ",
             "R7": "Points != 3*W + D; "}
    hit = {k: F.coalesce(p, F.lit(False)) for k, p in r.items()}
    reason = F.trim(F.concat(*[F.when(hit[k], texts[k]).otherwise("") for k in r]))
    any_hit = hit["R1"]
    for k in list(r)[1:]:
        any_hit = any_hit | hit[k]
    pre = stg.withColumn("__r17", F.when(reason == "", F.lit(None).cast("string")).otherwise(reason)) \
             .withColumn("__v17", ~any_hit)
    rules = [
        Duplicate("R8", "Duplicate team row in group;",
                  [c("league_id"), c("season_year"), F.coalesce(c("group_label"), F.lit("")), c("team_id")],
                  keep="min", order=order, among="all"),
        ForeignKey("R9", "Missing team FK;", "team_id", teams, "team_id"),
    ]
    v = validate(pre, rules, ACCUMULATE, reason_sep=" ", start_valid=c("__v17"), start_reason=c("__r17"),
                 stage_sides=stage_sides)
    v.flagged = v.flagged.drop("__r17", "__v17")
    key = F.concat(c("league_id").cast("string"), F.lit("-"), c("season_year").cast("string"), F.lit("-"),
                   F.coalesce(c("group_label"), F.lit("")), F.lit("-"), c("team_id").cast("string"))
    v.rejects = rejects(v.flagged, "stg_standings", key)
    # Counters R1..R7 are computed over all rows, independent of validity.
    wide = stg.agg(*[F.count_if(hit[k]).alias(k) for k in r])
    r89 = v.rule_counts
    v.rule_counts = _to_long(wide, list(r)).unionByName(r89)
    return v


def check_player_season_stats(stg: DataFrame, id_col: str = "stg_stats_id") -> Validation:
    """V06 — three rules, first failure."""
    rules = [
        RowRule("missing_ids", "Missing required IDs; ",
                c("player_id").isNull() | c("team_id").isNull() | c("league_id").isNull() | c("season").isNull()),
        RowRule("negative_core", "Negative appearances/lineups/minutes; ",
                (F.coalesce(c("appearances"), F.lit(0)) < 0) | (F.coalesce(c("lineups"), F.lit(0)) < 0)
                | (F.coalesce(c("minutes_played"), F.lit(0)) < 0)),
        RowRule("lineups_gt_apps", "lineups > appearances; ", c("lineups") > c("appearances")),
    ]
    v = validate(stg, rules, FIRST_FAILURE)
    v.rejects = rejects(v.flagged, "stg_player_season_stats", c(id_col))
    return v


def check_teams(stg: DataFrame, venues: DataFrame | None = None, stage_sides: bool = False) -> Validation:
    """V07 (defined from the result contract): id or name missing; duplicate
    (team, league, season) — a club may play in several leagues of a season;
    venue id not in venues."""
    rules = [
        RowRule("missing_id_or_name", "Missing team_id or name; ",
                c("team_id").isNull() | F.coalesce(F.trim(c("name")) == "", F.lit(True))),
        Duplicate("duplicate", "Duplicate team_id; ", [c("team_id"), c("league_id"), c("season_year")], keep=None),
    ]
    v = validate(stg, rules, FIRST_FAILURE, stage_sides=stage_sides)
    if venues is not None:
        vk = venues.select(c("venue_id").alias("__vk")).distinct().withColumn("__vok", F.lit(True))
        f = v.flagged.join(vk, v.flagged["venue_id"] == vk["__vk"], "left")
        bad = c("is_valid") & c("venue_id").isNotNull() & c("__vok").isNull()
        f = (f.withColumn("error_reason", F.when(bad, F.concat(F.coalesce(c("error_reason"), F.lit("")),
                                                                 F.lit("Unknown venue_id; ")))
                          .otherwise(c("error_reason")))
             .withColumn("is_valid", c("is_valid") & ~bad).drop("__vk", "__vok"))
        v.flagged = f
    v.rejects = rejects(v.flagged, "stg_teams", c("team_id"))
    return v


def check_venues(stg: DataFrame, stage_sides: bool = False) -> Validation:
    """V08 (defined from the result contract): id or name missing; duplicate id;
    negative capacity."""
    rules = [
        RowRule("missing_id_or_name", "Missing venue_id or name; ",
                c("venue_id").isNull() | F.coalesce(F.trim(c("name")) == "", F.lit(True))),
        Duplicate("duplicate", "Duplicate venue_id; ", [c("venue_id")], keep=None),
        RowRule("bad_capacity", "Negative capacity; ", c("capacity") < 0),
    ]
    v = validate(stg, rules, FIRST_FAILURE, stage_sides=stage_sides)
    v.rejects = rejects(v.flagged, "stg_venues", c("venue_id"))
    return v


def check_news(stg: DataFrame, tabs: Sequence[str] | None = None, stage_sides: bool = False) -> Validation:
    """V09 (defined from the contract): keeps flags set while flattening,
    then mandatory fields, tab whitelist, url shared by different articles."""
    from touchline.functions.scalars import NEWS_TABS
    tabs = list(tabs or NEWS_TABS)
    start_valid = c("is_valid") if "is_valid" in stg.columns else F.lit(True)
    start_reason = c("error_reason") if "error_reason" in stg.columns else F.lit(None).cast("string")
    base = stg.withColumn("__sv", start_valid).withColumn("__sr", start_reason) \
              .drop(*[x for x in ("is_valid", "error_reason") if x in stg.columns])
    rules = [
        RowRule("mandatory", "missing mandatory field; ",
                c("article_id").isNull() | c("title").isNull() | c("url").isNull()
                | c("published_at_utc").isNull()),
        RowRule("tab", "unknown tab; ", ~c("tab").isin(tabs)),
        # The same article may sit in several tabs; a url shared by
        # *different* articles breaks the unique url of the news table.
        RowRule("duplicate_url", "duplicate url; ", c("__url_ids") > 1),
    ]
    url_ids = (stg.where(c("url").isNotNull()).groupBy("url")
               .agg(F.count_distinct("article_id").alias("__url_ids")))
    base = base.join(url_ids, "url", "left")
    v = validate(base, rules, FIRST_FAILURE, start_valid=c("__sv"), start_reason=c("__sr"), stage_sides=stage_sides)
    v.flagged = v.flagged.drop("__sv", "__sr", "__url_ids")
    v.rejects = rejects(v.flagged, "stg_news", c("article_id"))
    return v


def check_constraints(df: DataFrame, specs: dict[str, Column]) -> DataFrame:
    """V10 — count rows violating each declarative check ``name -> predicate
    that must hold``; NULL satisfies a check, as in SQL CHECK constraints."""
    wide = df.agg(*[F.count_if(~F.coalesce(p, F.lit(True))).alias(n) for n, p in specs.items()])
    return _to_long(wide, list(specs))


def standings_constraints() -> dict[str, Column]:
    return {"form_compact_wdl": c("form_compact").rlike("^[WDL]*$"),
            "form_window_1_20": c("form_window").between(1, 20)}


def key_violations(df: DataFrame, keys: Sequence[str], name: str = "pk") -> DataFrame:
    """Primary-key check: rows whose key is NULL or repeated."""
    w = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    null_key = F.lit(False)
    for k in keys:
        null_key = null_key | c(k).isNull()
    return w.agg(F.coalesce(F.sum(F.when(null_key | (c("n") > 1), c("n"))), F.lit(0)).cast("bigint").alias(name))
