"""SparkSession defaults for touchline jobs.

Cluster deployments pass their own configuration (spark-submit / cluster
defaults); these helpers only fill gaps, never override what is already set.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every touchline job relies on for correct results and bounded memory.
_REQUIRED = {
    # Timestamps are UTC end to end (fixtures, news, as_of).
    "spark.sql.session.timeZone": "UTC",
    # the last duplicate statistic type wins in map_from_entries.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # No broadcast from optimizer *estimates* (not a bound); dimensions are
    # broadcast explicitly after a row-count check (functions.joins) and AQE
    # broadcasts a side only once its materialized size is known.
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}

# Performance defaults, applied only when the caller has not set them.
_DEFAULTS = {
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app_name: str = "touchline",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Return (or create) a session with touchline's settings applied."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**_DEFAULTS, **_REQUIRED}.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    apply_required(spark)
    ensure_checkpoint_dir(spark)
    return spark


def apply_required(spark: SparkSession) -> None:
    """Set the result-affecting session settings on an existing session."""
    for key, value in _REQUIRED.items():
        spark.conf.set(key, value)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is. Only when it is unset (local runs, tests) is a scratch folder
    created, because a machine-local folder is useless to other executors.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    local = tempfile.mkdtemp(prefix="touchline-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(local)
    return local
