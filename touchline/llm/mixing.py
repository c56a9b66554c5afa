"""Mixing sources to target weights, in DataFrame operations only.

Documents form a tree domain - language - source; a leaf's supply is its
tokens (words) times ``epochs``. A budget of tokens is handed down level by
level: each node's budget goes to its children in proportion to their weights,
no child gets more than its supply, and what a child cannot use goes to its
siblings in proportion to theirs. As a node never gets more than its
whole supply, a shortage moves to an ancestor's other children only when all
siblings are used up. Shares are rounded down to whole tokens.

A leaf's budget is spent in epochs. In each epoch its documents stand in an
order of their own, by md5 of seed, epoch and id; a leaf takes whole epochs, and
of the last one a token-prefix: all documents that begin before the budget ends.
``take_tokens`` says how many tokens of the document lie in the prefix.

Scale: the tree is aggregated first and small; documents meet their leaf in a
size-checked broadcast (the aggregated tables are checkpointed, so nothing is derived
twice). The place where a leaf's budget ends is found from
token counts of hash buckets of its order (two-level prefix sums), so only the
documents of that one bucket are sorted, and no text is shuffled for the others.
Bucket widths follow the largest leaf's row count.

Defined cases: null domain, language or source is a value of its own
(weight 1); unknown names weigh 1; documents without tokens (null and empty
texts too) are never taken; repeated rows are documents of their own, equal rows
in any order; an empty table gives no rows; further columns pass through ``row``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.joins import bounded_broadcast
from touchline.llm.common import cut

WORD = r"[^\x20\x09-\x0D]+"
SEED = 17
EPOCHS = 4
BUCKET_ROWS = 2048
WEIGHTS = {
    "domain": {"domain0": 3, "domain1": 2, "domain2": 2, "domain3": 1},
    "lang": {"en": 4, "de": 2, "fr": 2, "es": 1},
    "source": {"src0": 2},
}
LEVELS = ("domain", "lang", "source")


def domain_of(source: str = "source") -> Column:
    """``src7`` belongs to domain3 (its number modulo 4); a source without a number to domain0."""
    digits = F.regexp_extract(F.coalesce(F.col(source), F.lit("")), r"(\d{1,9})$", 1)
    return F.concat(F.lit("domain"), (F.when(digits == "", 0).otherwise(digits.cast("int")) % 4).cast("string"))


def _weight(level: str, weights: dict) -> Column:
    known = [x for k, w in weights.get(level, {}).items() for x in (F.lit(k), F.lit(int(w)))]
    return F.coalesce(F.create_map(*known)[F.col(level)], F.lit(1)).cast("long") if known else F.lit(1).cast("long")


def _hand_down(nodes: DataFrame, parents: list[str], level: str, weights: dict) -> DataFrame:
    """nodes: parents' columns, ``level``, cap, parent_budget. Adds the children's ``budget``."""
    siblings = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    before = siblings.orderBy(F.col("cap") / F.col("w"), level).rowsBetween(Window.unboundedPreceding, -1)
    return (
        nodes.withColumn("w", _weight(level, weights))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("w_left", F.sum("w").over(siblings) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        # full: the child's fair share of what its smaller siblings leave reaches its supply
        .withColumn("full", F.expr("cap * w_left <= w * (parent_budget - cap_before)"))
        .withColumn("used", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(siblings))
        .withColumn("open_w", F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(siblings))
        .withColumn("budget", F.expr("case when full then cap else least(cap, (w * (parent_budget - used)) div open_w) end"))
        .drop("w", "cap_before", "w_left", "full", "used", "open_w"))


def budgets(leaves: DataFrame, budget: int | None = None, epochs: int = EPOCHS, weights: dict = WEIGHTS) -> DataFrame:
    """leaves: domain, lang, source, tokens. Adds ``budget``; the root's is all tokens if not given."""
    leaves = leaves.withColumn("cap", F.col("tokens") * epochs)
    root = F.lit(budget).cast("long") if budget is not None else F.col("_all")
    total = leaves.agg(F.sum("tokens").alias("_all"))
    level1 = leaves.groupBy("domain").agg(F.sum("cap").alias("cap")).crossJoin(F.broadcast(total)).withColumn("parent_budget", root).drop("_all")
    found = _hand_down(level1, [], "domain", weights)
    for depth in (2, 3):
        above, level = list(LEVELS[:depth - 1]), LEVELS[depth - 1]
        nodes = leaves.groupBy(*LEVELS[:depth]).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
        parent = found.select(*(F.col(c).alias(f"_{c}") for c in above), F.col("budget").alias("parent_budget"))
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in above]
        on = same[0] if len(same) == 1 else same[0] & same[1]
        found = _hand_down(nodes.join(parent, on).drop(*(f"_{c}" for c in above)), above, level, weights)
    return found.select(*LEVELS, "tokens", "budget")


def mix(docs: DataFrame, budget: int | None = None, epochs: int = EPOCHS, seed: int = SEED, weights: dict = WEIGHTS, domain: Column | None = None,
        columns: list[str] | None = None) -> DataFrame:
    """row (struct of all columns of ``docs``, or of doc_id and ``columns``), domain, lang, source, tokens, epoch,
    take_tokens: one row each time that a document is taken. Tokens are counted once, into a stored table that all
    further steps read."""
    kept = F.col("_row") if columns is None else F.struct(*dict.fromkeys(["doc_id", *columns]))
    rows = cut(docs.withColumn("_row", F.struct("*")).withColumn("_kept", kept).withColumn("_domain", domain if domain is not None else domain_of())
               .select(F.col("_kept").alias("row"), F.col("_domain").alias("domain"), F.col("_row.lang").alias("lang"), F.col("_row.source").alias("source"),
                       F.coalesce(F.regexp_count("_row.text", F.lit(WORD)), F.lit(0)).cast("long").alias("tokens"), F.xxhash64("_row.text").alias("_tie"))).where("tokens > 0")
    leaves = cut(rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")))
    largest = leaves.agg(F.max("n")).first()[0] or 1
    digits = max(1, min(8, -(-((largest // BUCKET_ROWS).bit_length()) // 4)))
    planned = cut(budgets(leaves.drop("n"), budget, epochs, weights).where("budget > 0")
               .select(*(F.col(c).alias(f"_{c}") for c in LEVELS), F.expr("budget div tokens").alias("whole"), F.expr("budget % tokens").alias("rest")))
    on = F.col("domain").eqNullSafe(F.col("_domain")) & F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    placed = (rows.join(bounded_broadcast(planned), on).drop("_domain", "_lang", "_source")
              .withColumn("_order", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("row.doc_id").cast("string"), F.lit("null"))).cast("binary")))
              .withColumn("_bucket", F.substring("_order", 1, digits)))
    # the bucket of each leaf's last epoch in which its budget ends, and the tokens before it
    leaf = Window.partitionBy(*LEVELS).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = cut(placed.where("rest > 0").groupBy(*LEVELS, "_bucket", "rest").agg(F.sum("tokens").alias("_sum"))
            .withColumn("before", F.coalesce(F.sum("_sum").over(leaf), F.lit(0)))
            .where("before < rest and before + _sum >= rest")
            .select(*(F.col(c).alias(f"_{c}") for c in LEVELS), F.col("_bucket").alias("end_bucket"), "before"))
    located = placed.join(bounded_broadcast(ends), on, "left").drop("_domain", "_lang", "_source")
    out = ["row", *LEVELS, "tokens", "epoch", "take_tokens"]
    times = F.col("whole") + F.when((F.col("rest") > 0) & (F.col("_bucket") < F.col("end_bucket")), 1).otherwise(0)
    plain = (located.withColumn("_times", times.cast("int")).where("_times > 0")
             .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("_times") - 1))).withColumn("take_tokens", F.col("tokens")))
    inner = Window.partitionBy(*LEVELS).orderBy("_order", "row.doc_id", "tokens", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    partial = (located.where("rest > 0 and _bucket = end_bucket")
           .withColumn("_start", F.col("before") + F.coalesce(F.sum("tokens").over(inner), F.lit(0)))
           .where("_start < rest").withColumn("epoch", F.col("whole").cast("int"))
           .withColumn("take_tokens", F.least("tokens", F.expr("rest - _start"))))
    return plain.select(*out).unionByName(partial.select(*out))


def mix_digest(docs: DataFrame) -> DataFrame:
    return mix(docs, columns=[]).select("row.doc_id", *LEVELS, "tokens", "epoch", "take_tokens")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The taken documents with the columns of ``docs``, once for each time taken."""
    return mix(docs, **options).select("row.*")


def _cases(level: str) -> str:
    return "case " + level + " " + " ".join(f"when '{k}' then {w}" for k, w in WEIGHTS[level].items()) + " else 1 end"


def _level_sql(name: str, source: str, parents: list[str], level: str) -> str:
    part = "partition by " + ", ".join(parents) if parents else ""
    order = f"({part} order by cap::double / w, {level} nulls first rows between unbounded preceding and 1 preceding)"
    return f"""{name} as (
  select * exclude (full_, used, open_w), case when full_ then cap else least(cap, (w * (parent_budget - used)) // open_w) end as budget from (
    select *, sum(case when full_ then cap else 0 end) over ({part}) as used, sum(case when full_ then 0 else w end) over ({part}) as open_w from (
      select *, cap * (sum(w) over ({part}) - coalesce(sum(w) over {order}, 0)) <= w * (parent_budget - coalesce(sum(cap) over {order}, 0)) as full_
      from (select *, ({_cases(level)})::hugeint as w from ({source})))))"""


ORACLE = f"""with docs as (
  select *, 'domain' || (coalesce(try_cast(regexp_extract(source, '(\\d{{1,9}})$', 1) as int), 0) % 4) as domain,
    len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) as tokens from documents),
taking as (select doc_id, domain, lang, source, tokens from docs where tokens > 0),
leaves as (select domain, lang, source, sum(tokens)::hugeint as tokens, sum(tokens)::hugeint * {EPOCHS} as cap from taking group by all),
{_level_sql('l1', "select domain, sum(cap) as cap, (select sum(tokens) from leaves) as parent_budget from leaves group by 1", [], "domain")},
{_level_sql('l2', "select a.domain, a.lang, a.cap, l1.budget as parent_budget from (select domain, lang, sum(cap) as cap from leaves group by 1, 2) a join l1 using (domain)", ["domain"], "lang")},
{_level_sql('l3', "select a.domain, a.lang, a.source, a.cap, a.tokens, l2.budget as parent_budget from leaves a join l2 on a.domain = l2.domain and a.lang is not distinct from l2.lang", ["domain", "lang"], "source")},
plan as (select domain, lang, source, budget // tokens as whole, budget % tokens as rest from l3 where budget > 0),
ordered as (
  select t.*, whole, rest, coalesce(sum(t.tokens) over (partition by t.domain, t.lang, t.source order by md5(concat_ws(':', '{SEED}', whole::varchar, coalesce(doc_id::varchar, 'null'))), doc_id
    rows between unbounded preceding and 1 preceding), 0) as start
  from taking t join plan p on t.domain = p.domain and t.lang is not distinct from p.lang and t.source is not distinct from p.source)
select doc_id, domain, lang, source, tokens::bigint as tokens, e::int as epoch, tokens::bigint as take_tokens
from (select *, unnest(range(whole::bigint)) as e from ordered)
union all
select doc_id, domain, lang, source, tokens::bigint, whole::int, least(tokens, rest - start)::bigint from ordered where start < rest"""
