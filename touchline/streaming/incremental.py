"""Incremental ingest on Structured Streaming.

The source application keeps a ledger of which snapshot files were loaded.
Here the streaming file source's checkpoint plays that role: each trigger
sees only files not processed before; ``foreachBatch`` validates and merges
the micro-batch into versioned tables (``sources.versions``): only the
partitions a batch touches are written, the commit is the last step, and a
batch that is replayed is recognised by its name in the commit log. With
``Trigger.AvailableNow`` the job processes whatever landed since the last
run and stops, so a weekly batch job and a continuous job are the same code.
The checkpoint must live in shared storage (``spark.checkpoint.dir`` on a
cluster), so a restarted driver resumes where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from touchline.operators import flatten as FL
from touchline.operators import merge as M
from touchline.operators import validate as V
from touchline.plans.jobs import last_file_wins, stage, work_dir
from touchline.sources.sinks import append_errors
from touchline.sources.versions import VersionedTable

c = F.col


def incremental_ingest(spark: SparkSession, source_dir: str, schema: StructType,
                       process: Callable[[DataFrame, int], None], checkpoint: str,
                       available_now: bool = True):
    """Stream whole JSON documents from ``source_dir`` into ``process(batch, epoch)``.

    ``batch`` has columns ``file_path`` and ``doc`` (parsed with ``schema``;
    malformed documents give ``doc = NULL``). Returns the started query.
    """
    raw = (spark.readStream.format("text").option("wholetext", "true")
           .option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(source_dir))
    parsed = raw.select(c("_metadata.file_path").alias("file_path"),
                        F.when(F.try_parse_json(c("value")).isNotNull(), F.from_json(c("value"), schema))
                        .alias("doc"))
    writer = parsed.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def fixtures_upsert_batch(fixtures: VersionedTable, venues: VersionedTable, errors: VersionedTable, teams: DataFrame, as_of,
                          stream: str = "fixtures") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` body: flatten fixtures, validate (V01), log rejects,
    add placeholder venues, merge (M01).

    Each of the three tables takes the batch as the run ``<stream>/<epoch>``
    and passes over a run it holds already. The fixtures come last: once
    they hold a run, so do the others, and a batch that is replayed after a
    stop at any point does what is left to do and nothing twice. ``stream``
    names the query's checkpoint: a new checkpoint needs a new name.
    """
    def run(batch: DataFrame, epoch: int) -> None:
        spark, name = batch.sparkSession, f"{stream}/{epoch}"
        if fixtures.has(name):
            return
        scoped = (batch.withColumn("season_year", F.regexp_extract(c("file_path"), r"/(\d{4})_\d{2}/", 1).try_cast("int"))
                  .withColumn("league_id", F.regexp_extract(c("file_path"), r"/(\d+)/\d{4}_\d{2}/", 1).try_cast("int")))
        stg = FL.flatten_fixtures(scoped.where(c("doc").isNotNull()))
        v = V.check_fixtures(stage(last_file_wins(stg), f"{work_dir(spark, 'stream')}/stg_fixtures"), teams)
        flagged = stage(v.flagged, f"{work_dir(spark, 'stream')}/flagged")
        rejects = V.rejects(flagged, "stg_fixtures", F.coalesce(c("fixture_id").cast("string"), F.lit("<NULL>")),
                            F.trim(c("error_reason"), F.lit("; "))).distinct()
        errors.append(append_errors(errors.read(), rejects, as_of, dedupe=True), as_of, name)
        valid = flagged.where("is_valid")
        unknown = M.placeholders(valid, venues.read(), "venue_id", M.VENUE_PLACEHOLDER)
        venues.upsert(unknown, ["venue_id"], lambda target: M.merge_upsert(
            target, unknown, ["venue_id"], list(M.VENUE_PLACEHOLDER), as_of, when=lambda t, s: F.lit(False), unique_source=True), as_of, name)
        fixtures.upsert(valid, ["fixture_id"], lambda target: M.merge_fixtures(target, flagged, venues.read(), as_of)[0], as_of, name)

    return run
