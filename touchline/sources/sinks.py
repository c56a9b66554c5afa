"""Sinks (K01–K06).

Tables are Parquet folders. A merge never overwrites the folder it reads in
the same plan: the new version is written to a fresh folder and the caller
switches to it (``write_version``), so a failed or retried job leaves the
previous version intact.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col


# K01 / K02 -----------------------------------------------------------------------
def write_staging(df: DataFrame, path: str, mode: str = "overwrite", as_of=None) -> None:
    """Truncate-and-load (``overwrite``) or ``append`` with the audit defaults; the load time is ``as_of``, never the clock."""
    out = df
    if "is_valid" not in out.columns:
        out = out.withColumn("is_valid", F.lit(True))
    if "error_reason" not in out.columns:
        out = out.withColumn("error_reason", F.lit(None).cast("string"))
    if "load_timestamp" not in out.columns:
        if as_of is None:
            raise ValueError("staging rows without load_timestamp need as_of")
        out = out.withColumn("load_timestamp", F.lit(str(as_of)).cast("timestamp_ntz"))
    out.write.mode(mode).parquet(path)


# K03 -----------------------------------------------------------------------------
def append_errors(log: DataFrame | None, rejects: DataFrame, as_of, dedupe: bool = False) -> DataFrame:
    """New error-log rows: with ``dedupe`` only (table, key, reason) triples
    not already logged (distinct); otherwise every reject. Returns the rows to
    append (the caller appends them with ``write_errors``)."""
    r = rejects.withColumn("created_at", F.lit(str(as_of)).cast("timestamp_ntz"))
    if dedupe:
        r = r.dropDuplicates(["staging_table", "record_key", "error_reason"])
        if log is not None:
            # rejects are few, the log is a history: its rows of other tables and keys stay out of the join
            known = (log.join(r.select("staging_table").distinct(), "staging_table", "left_semi")
                     .select("staging_table", "record_key", "error_reason"))
            r = r.join(known, ["staging_table", "record_key", "error_reason"], "left_anti")
    return r


def write_errors(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


# K04 -----------------------------------------------------------------------------
def write_snapshot(df: DataFrame, path: str, if_exists: str = "skip", fmt: str = "json") -> None:
    """Immutable snapshot write: skip if present, overwrite, or error."""
    mode = {"skip": "ignore", "overwrite": "overwrite", "error": "errorifexists"}[if_exists]
    df.write.mode(mode).format(fmt).save(path)


# K05 -----------------------------------------------------------------------------
# ``serve.latest_n_per_group`` (50 a tab) selects the rows; any sink stores them.


# K06 -----------------------------------------------------------------------------
def player_documents(pages: DataFrame, squads: DataFrame | None = None) -> DataFrame:
    """One API-shaped JSON document per player, rebuilt from paged rows
    (``doc.response[]`` of league pages), plus minimal documents for squad
    members absent from the pages. Output: player_id, document (JSON text)."""
    items = pages.select(F.explode("doc.response").alias("r")).where(c("r.player.id").isNotNull())
    from touchline.functions.windows import latest_by
    items = latest_by(items.withColumn("player_id", c("r.player.id")), ["player_id"], [F.to_json(c("r"))])
    docs = items.select("player_id", F.to_json(F.struct(
        F.lit(None).cast("string").alias("errors"), F.lit(1).alias("results"),
        F.array(c("r")).alias("response"))).alias("document"))
    if squads is None:
        return docs
    sq = (squads.select(F.explode("doc.response").alias("r")).select(F.explode("r.players").alias("p"))
          .where(c("p.id").isNotNull()).select(c("p.id").alias("player_id"), "p"))
    sq = latest_by(sq, ["player_id"], [F.to_json(c("p"))])
    extra = sq.join(docs.select("player_id"), "player_id", "left_anti").select(
        "player_id", F.to_json(F.struct(
            F.lit(None).cast("string").alias("errors"), F.lit(1).alias("results"),
            F.array(F.struct(F.struct(c("p.id").alias("id"), c("p.name").alias("name"),
                                      c("p.photo").alias("photo")).alias("player"),
                             F.array().alias("statistics"))).alias("response"))).alias("document"))
    return docs.unionByName(extra)


def write_version(df: DataFrame, base: str) -> str:
    """Write ``df`` to a new version folder below ``base`` and return its path."""
    path = f"{base.rstrip('/')}/v={uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return path
