"""Join helpers: broadcast only what is checked to be small.

Static (estimate-based) auto-broadcast is switched off in the session: an
optimizer estimate is not a bound, and a wrong one can put a fact-sized
table on every executor. Two checked paths remain:

* ``bounded_broadcast`` — explicit broadcast of a dimension after counting
  at most ``max_rows + 1`` of its rows (cheap over stored tables and
  projections; over an aggregate the aggregate runs first); beyond the
  bound no hint is given and the join shuffles;
* AQE's runtime conversion, which broadcasts a join side only after its
  shuffle stage has run and its real size is known to be under
  ``spark.sql.adaptive.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from touchline.session import ensure_checkpoint_dir

DIMENSION_MAX_ROWS = 200_000


def is_small(df: DataFrame, max_rows: int = DIMENSION_MAX_ROWS) -> bool:
    """At most ``max_rows`` rows? Reads at most ``max_rows + 1`` rows."""
    return df.limit(max_rows + 1).count() <= max_rows


def bounded_broadcast(df: DataFrame, max_rows: int = DIMENSION_MAX_ROWS, small: bool | None = None) -> DataFrame:
    """``broadcast(df)`` if it has at most ``max_rows`` rows, else ``df``.

    Callers project the dimension to the join key and the few columns they
    need first, so the broadcast rows stay narrow. ``small`` passes a check
    already made (one check for both roles of a dimension, e.g. home / away).
    """
    if small is None:
        small = is_small(df, max_rows)
    return F.broadcast(df) if small else df


DERIVED_MAX_ROWS = 500_000
HEAVY_ROWS = 100_000      # rows of one key from which the key is no group of a shuffle
_SALTS = 1 << 16


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once below the shared ``spark.checkpoint.dir`` and read back: computed once, lineage cut."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/touchline-sides/{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def _on(keys: Sequence[str], null_safe: bool) -> Column:
    on = F.lit(True)
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"__side_{k}")) if null_safe else F.col(k) == F.col(f"__side_{k}")
        on = on & same
    return on


def _left_join(rows: DataFrame, side: DataFrame, keys: Sequence[str], null_safe: bool) -> DataFrame:
    renamed = side.select(*[F.col(k).alias(f"__side_{k}") for k in keys], *[x for x in side.columns if x not in keys])
    return rows.join(renamed, _on(keys, null_safe), "left").drop(*[f"__side_{k}" for k in keys])


def _spread(rows: DataFrame) -> Column:
    """A number of each row, for rows that no key shall gather: of its own columns, not of flags and helpers, whose
    expressions would be dragged into the key."""
    plain = [f.name for f in rows.schema.fields if not isinstance(f.dataType, MapType)
             and f.name not in ("is_valid", "error_reason") and not f.name.startswith("__")]
    return (F.pmod(F.xxhash64(*[F.col(f"`{x}`") for x in plain or rows.columns]), F.lit(_SALTS)) + 1).cast("int")


def lookup(rows: DataFrame, side: DataFrame, keys: Sequence[str], member: Column, null_safe: bool = False,
           staged: bool = False, max_rows: int = DERIVED_MAX_ROWS, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """``rows`` left join ``side`` (one row a key), in which only ``member`` rows can match, without hot tasks.

    Rows that are no members, or lack a key, meet no group: they carry a
    salt that no row of ``side`` has, so they are spread over all tasks (a
    plain left join sends every null key to one). ``staged`` also stores
    ``side``: at most ``max_rows`` rows are broadcast and nothing is
    shuffled; beyond, keys with more than ``heavy_rows`` members are counted
    (a partial aggregate), looked up by a checked broadcast of their few rows,
    and leave the shuffle like non-members.
    """
    keys = list(keys)
    payload = [x for x in side.columns if x not in keys]
    eligible = F.coalesce(member, F.lit(False))
    if not null_safe:
        for k in keys:
            eligible = eligible & F.col(k).isNotNull()
    rows = rows.withColumn("__member", eligible)
    light = F.col("__member")
    if staged:
        side = stored(side)
        if is_small(side, max_rows):
            found = _left_join(rows, F.broadcast(side), keys, null_safe)
            return found.withColumns({x: F.when(F.col("__member"), F.col(x)) for x in payload}).drop("__member")
        hot = rows.where("__member").groupBy(*keys).count().where(F.col("count") > heavy_rows).drop("count").withColumn("__hot", F.lit(True))
        few = _left_join(hot, side, keys, null_safe).withColumnsRenamed({x: f"__hot_{x}" for x in payload})
        rows = _left_join(rows, bounded_broadcast(stored(few)), keys, null_safe)
        light = light & F.col("__hot").isNull()
    rows = rows.withColumn("__salt", F.when(light, F.lit(0)).otherwise(_spread(rows)))
    # 0, but no literal: the optimizer would turn a literal into a filter and join by the key alone
    zero = F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(1)).cast("int")
    out = _left_join(rows, side.withColumn("__salt", zero), [*keys, "__salt"], null_safe)
    if staged:
        out = out.withColumns({x: F.coalesce(F.col(x), F.when(F.col("__member"), F.col(f"__hot_{x}"))) for x in payload})
        out = out.drop("__hot", *[f"__hot_{x}" for x in payload])
    return out.drop("__member", "__salt")


def stored_side(df: DataFrame, max_rows: int = DERIVED_MAX_ROWS) -> DataFrame:
    """A derived join side (distinct reference keys, say), stored; broadcast if the stored table has at
    most ``max_rows`` rows, else left to a shuffle join. Its size is checked on the real data, and when
    it is small the large side of the join is never shuffled."""
    return bounded_broadcast(stored(df), max_rows)
