"""Column helpers on literal inputs, and metamorphic properties of the
engines (SURVEY §5.3)."""

import datetime as dt

from pyspark.sql import functions as F

from touchline.functions import scalars as S
from touchline.operators import merge as M
from touchline.operators import serve as Q
from touchline.operators import validate as V
from touchline.plans.bindings import Bound

from sample_tables import SF_SMALL

c = F.col


def _one(spark, expr, schema="x string", value=None):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).collect()[0].r


def test_local_day_bounds_across_dst(spark):
    df = spark.createDataFrame([("2025-03-09",), ("2025-11-02",), ("2025-06-01",)], "d string")
    start, end = S.local_day_bounds(c("d"), "America/Chicago")
    rows = df.select("d", start.cast("timestamp_ntz").alias("s"), end.cast("timestamp_ntz").alias("e")).collect()
    hours = {r.d: (r.e - r.s).total_seconds() / 3600 for r in rows}
    assert hours == {"2025-03-09": 23.0, "2025-11-02": 25.0, "2025-06-01": 24.0}
    assert [r.s for r in rows if r.d == "2025-03-09"][0] == dt.datetime(2025, 3, 9, 6, 0)


def test_season_label_slug_alias(spark):
    assert _one(spark, S.season_label(c("x")), "x int", 2024) == "2024_25"
    assert _one(spark, S.season_label(c("x")), "x int", 1999) == "1999_00"
    assert _one(spark, S.slugify(c("x")), value="  Premier   League ") == "premier_league"
    assert _one(spark, S.folder_alias(c("x"), F.lit(39)), value="Premier League") == "premier_league_39"
    assert _one(spark, S.folder_alias(c("x"), F.lit(39)), value="x_39") == "x_39"


def test_digits_blank_short_name(spark):
    assert _one(spark, S.digits_int(c("x")), value="180 cm") == 180
    assert _one(spark, S.digits_int(c("x")), value="n/a") is None
    assert _one(spark, S.blank_to_null(c("x")), value="   ") is None
    assert _one(spark, S.short_name(c("x")), value="  John  Ronald Smith ") == "J. Smith"
    assert _one(spark, S.short_name(c("x")), value="Pelé") == "Pelé"
    assert _one(spark, S.short_name(c("x")), value="") is None


def test_html_unescape_and_strip(spark):
    assert _one(spark, S.html_unescape(c("x")), value="Tom &amp; Jerry &lt;3") == "Tom & Jerry <3"
    assert _one(spark, S.html_unescape(c("x")), value="caf&eacute; &#8212; &nbsp;x") == "café — \xa0x"
    assert _one(spark, S.strip_html(c("x")), value="<p> <b>Hi</b> &amp; bye </p>") == "Hi & bye"
    assert _one(spark, S.strip_html(c("x")), value="<p>  </p>") is None


def test_status_labels_and_finished(spark):
    df = spark.createDataFrame([("FT",), (" aet ",), ("NS",), ("PST",), ("SUSP",), ("HT",), ("",), (None,)], "s string")
    rows = df.select(S.status_label_match(c("s")).alias("m"), S.status_label_team(c("s")).alias("t"),
                     S.is_finished(c("s")).alias("f")).collect()
    assert [r.m for r in rows] == ["Full-Time", "Full-Time", "Scheduled", "Postponed", "Interrupted", "HT", "—", "—"]
    assert [r.t for r in rows] == ["Full-Time", " aet ", "Scheduled", "Scheduled", "Scheduled", "HT", "—", "—"]
    assert [r.f for r in rows] == [True, True, False, False, False, False, False, False]


def test_iso_utc_and_run_ts_and_time_ago(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 2, 3, 4, 5),), (dt.datetime(2024, 1, 2, 3, 4, 5, 120000),)],
                               "t timestamp_ntz")
    assert [r.x for r in df.select(S.iso_utc(c("t")).alias("x")).collect()] == \
        ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05.120000Z"]
    assert str(_one(spark, S.run_ts_to_timestamp(c("x")), value="2024-05-01T10-20-30")) == "2024-05-01 10:20:30"
    ago = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 0, 0),)], "t timestamp_ntz")
    out = [ago.select(S.time_ago(c("t"), F.lit(a).cast("timestamp_ntz")).alias("x")).collect()[0].x
           for a in ("2024-01-01 00:00:30", "2024-01-01 00:59:59", "2024-01-01 05:00:00", "2024-01-03 01:00:00",
                     "2023-12-31 00:00:00")]
    assert out == ["just now", "59m ago", "5h ago", "2d ago", "just now"]


def test_group_label_cleaning(spark):
    df = spark.createDataFrame([("MLS, Group A 2024/25",), ("East - 2024",), ("",), ("Premier League",)], "g string")
    rows = df.select(S.clean_group_label(c("g")).alias("clean"), S.normalize_group_key(c("g")).alias("key")).collect()
    # "East - 2024": the part after " - " is only a year, so the original label is kept.
    assert [r.clean for r in rows] == ["Group A", "East - 2024", "", "Premier League"]
    assert [r.key for r in rows] == ["group a", "east", "", ""]


def test_lenient_casts_minute_text_chip(spark):
    assert _one(spark, S.to_int_lenient(c("x")), value="6.700000") == 6
    assert _one(spark, S.to_int_lenient(c("x")), value="") is None
    assert _one(spark, S.percent_int(c("x")), value="55%") == 55
    assert _one(spark, S.minute_text(F.lit(45), F.lit(2))) == "45+2′"
    assert _one(spark, S.timeline_chip(F.lit("goal"), F.lit("Penalty"))) == "PEN"
    assert _one(spark, S.event_type_ui(F.lit(" Own Goal "), F.lit(None))) == "goal"


def test_merge_is_idempotent(spark):
    b = Bound(spark, SF_SMALL)
    flagged = V.check_fixtures(b.v_stg_fixtures, b.v_teams).flagged
    empty = spark.createDataFrame([], b.v_fixtures.schema).transform(lambda d: M.with_audit(d, "2024-01-01"))
    first, _ = M.merge_fixtures(empty, flagged, b.v_venues, "2024-01-02")
    again, _ = M.merge_fixtures(first.new_target, flagged, b.v_venues, "2024-01-03")
    counts = {r.action: r.n for r in again.summary.collect()}
    assert counts == {"unchanged": first.new_target.count()}


def test_validation_is_order_independent(spark):
    b = Bound(spark, SF_SMALL)
    order = [c("ord1"), c("ord2"), c("ord3"), c("ord4")]
    a = V.check_match_events(b.v_stg_events, b.v_fixtures, b.v_teams, order=order).flagged
    shuffled = b.v_stg_events.repartition(7, F.rand(3))
    z = V.check_match_events(shuffled, b.v_fixtures, b.v_teams, order=order).flagged
    key = ["ord1", "ord2", "ord3", "ord4", "is_valid", "error_reason"]
    assert a.select(*key).exceptAll(z.select(*key)).count() == 0
    assert z.select(*key).exceptAll(a.select(*key)).count() == 0


def test_first_failure_reasons_subset_of_accumulate(spark):
    b = Bound(spark, SF_SMALL)
    rules = lambda: [V.RowRule("neg", "neg; ", c("shots_on_goal") < 0),
                     V.RowRule("range", "range; ", c("possession") > 100),
                     V.Duplicate("dup", "dup; ", [c("fixture_id"), c("team_id")], keep="max",
                                 order=[c("load_seq")], among="all")]
    ff = V.validate(b.v_stg_stats, rules(), V.FIRST_FAILURE).flagged
    acc = V.validate(b.v_stg_stats, rules(), V.ACCUMULATE).flagged
    j = ff.select("fixture_id", "team_id", "load_seq", c("error_reason").alias("r1")).join(
        acc.select("fixture_id", "team_id", "load_seq", c("error_reason").alias("r2")),
        ["fixture_id", "team_id", "load_seq"])
    bad = j.where(c("r1").isNotNull() & ~F.coalesce(F.instr(c("r2"), c("r1")) == 1, F.lit(False)))
    assert bad.count() == 0
    assert ff.where(c("is_valid")).count() == acc.where(c("is_valid")).count()


def test_set_based_result_filtered_equals_single_id(spark):
    b = Bound(spark, SF_SMALL)
    all_teams = Q.team_fixture_counts(b.v_fixtures).where(c("team_id") == 3)
    one = Q.team_fixture_counts(b.v_fixtures.where((c("home_team_id") == 3) | (c("away_team_id") == 3))) \
        .where(c("team_id") == 3)
    assert sorted(all_teams.collect()) == sorted(one.collect())


def test_form_strings_are_wdl_up_to_five(spark):
    from touchline.operators.form import team_form
    b = Bound(spark, SF_SMALL)
    out = team_form(b.v_fixtures, 5)
    assert out.where(~c("form_compact").rlike("^[WDL]{1,5}$")).count() == 0


def test_partition_scoped_merge_touches_only_source_partitions(spark, tmp_path):
    target = spark.createDataFrame(
        [(1, 2023, "a", None, None), (2, 2023, "b", None, None), (3, 2024, "c", None, None)],
        "id int, season int, v string, load_date timestamp_ntz, upd_date timestamp_ntz")
    source = spark.createDataFrame([(3, 2024, "c2"), (4, 2024, "d")], "id int, season int, v string")
    full = M.merge_upsert(target, source, ["id", "season"], ["v"], "2024-02-01")
    scoped = M.merge_upsert(target, source, ["id", "season"], ["v"], "2024-02-01", partition_cols=["season"])
    assert sorted(scoped.merged.collect()) == sorted(full.merged.where(c("season") == 2024).collect())
    path = str(tmp_path / "t")
    target.write.partitionBy("season").parquet(path)
    M.write_touched_partitions(scoped.merged, path, ["season"])
    after = {(r.id, r.v) for r in spark.read.parquet(path).collect()}
    assert after == {(1, "a"), (2, "b"), (3, "c2"), (4, "d")}


def test_staged_join_sides_give_the_same_flags(spark):
    b = Bound(spark, SF_SMALL)
    order = [c("ord1"), c("ord2"), c("ord3"), c("ord4")]
    lazy = V.check_match_events(b.v_stg_events, b.v_fixtures, b.v_teams, order=order).flagged
    staged = V.check_match_events(b.v_stg_events, b.v_fixtures, b.v_teams, order=order, stage_sides=True).flagged
    key = ["ord1", "ord2", "ord3", "ord4", "is_valid", "error_reason"]
    assert lazy.select(*key).exceptAll(staged.select(*key)).count() == 0
    assert staged.select(*key).exceptAll(lazy.select(*key)).count() == 0
    s1 = V.check_standings(b.v_stg_standings, b.v_teams, order=[c("stg_seq")]).flagged
    s2 = V.check_standings(b.v_stg_standings, b.v_teams, order=[c("stg_seq")], stage_sides=True).flagged
    assert s1.exceptAll(s2).count() == 0 and s2.exceptAll(s1).count() == 0


def test_html_unescape_is_the_standard_librarys(spark):
    import html
    import random
    from html.entities import html5
    rng = random.Random(1)
    texts = ["&" + n for n in html5] + ["&" + n.rstrip(";") + "x;" for n in html5]
    texts += [f"&#{i};" for i in (0, 1, 9, 10, 13, 65, 127, 128, 129, 150, 159, 160, 0xD800, 0xFDD0, 0xFFFE, 0x1F600, 0x10FFFF, 0x110000, 10**30)]
    texts += [f"&#x{i:x}" for i in (0, 0x80, 0x9F, 0x41, 0x1F600, 0x10FFFE, 10**20)]
    texts += ["&#0000000000000065;", "&#x00000000000041z", "&#;", "&#x;", "&", "&&amp;amp;", "&amp;lt;", "a&b;c", "&notit;", "&ampx", "&" + "a" * 40 + ";", "", "&gt&lt"]
    texts += ["".join(rng.choice(["&", "amp", "#", "x", "41", ";", "not", "in", "lt", "é", " ", "<", "1"]) for _ in range(rng.randint(1, 10))) for _ in range(1000)]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    got = df.select("t", S.html_unescape("t").alias("u")).collect()
    assert [(r.t, r.u) for r in got if r.t is not None and r.u != html.unescape(r.t)] == []
    assert [r.u for r in got if r.t is None] == [None]


def test_tags_are_removed_in_linear_time(spark):
    import re
    import time
    texts = ["<" * 10**6, "<a" * 400_000 + ">", "x<>y<b>z</b> 1 < 2 <", "<p> &lt;b&gt; </p>", "<", ">", "<>", "", "<<a>>", None]
    t0 = time.perf_counter()
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", S.strip_html("t").alias("u")).collect()
    assert time.perf_counter() - t0 < 30
    import html
    want = [None if t is None else html.unescape(re.sub(r"<[^>]+>", "", t) if len(t) < 1000 or ">" in t else t).strip(" ") or None for t in texts]
    assert {r.i: r.u for r in got} == dict(enumerate(want))
