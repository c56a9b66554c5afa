"""Tables as committed versions of their partitions.

A commit writes the rows of the partitions it touches to a fresh folder, waits
for the writer's success marker, and last appends its rows to the commit log:
one small file, written by one task, so it is there whole or not at all. A
reader takes for each partition the folder of the newest commit that holds
it. So a failure at any point leaves the previous state; partitions that a
run does not touch keep their files; and a run's name stands in the log with
its commit, so a replayed run (a stream's batch after a restart) is recognised
and changes nothing.

    <path>/data/<version>/part=<value>/...     rows, with the merge's ``action``
    <path>/commits/...                         seq, version, run, part, committed_at

One writer at a time is assumed, as in the source application (advisory
locks); two commits with the same number are found on the next read and raise.
What reaches the driver is one row for each partition.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from touchline.operators.merge import INSERT, UNCHANGED, UPDATE, MergeResult, ts

c = F.col

COMMIT_SCHEMA = "seq long, version string, run string, part string, committed_at timestamp_ntz"


def succeeded(spark: SparkSession, path: str) -> bool:
    """Whether a writer's success marker lies in ``path``, on whatever file system Spark finds it."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


class VersionedTable:
    """``partition``: a column over the table's rows that names their partition; None for a table of one.

    ``key_partition`` says that the partition follows from the merge key alone, so a row never moves between partitions.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, partition: Column | None = None,
                 key_partition: bool = False):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.key_partition = key_partition or partition is None
        value = F.lit("all") if partition is None else F.coalesce(partition.cast("string"), F.lit("null"))
        self.part = F.regexp_replace(value, "[^A-Za-z0-9.-]", "_")     # names of folders; two that coincide share one

    # the log --------------------------------------------------------------------------
    def commits(self) -> DataFrame:
        try:
            return self.spark.read.schema(COMMIT_SCHEMA).parquet(f"{self.path}/commits")
        except AnalysisException as absent:
            if absent.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], COMMIT_SCHEMA)

    def has(self, run: str) -> bool:
        return self.commits().where(c("run") == run).limit(1).count() > 0

    def _newest(self) -> list:
        """(part, version) of every partition's newest commit."""
        log = self.commits()
        clash = log.groupBy("seq").agg(F.count_distinct("version").alias("n")).where("n > 1").limit(1).collect()
        if clash:
            raise RuntimeError(f"two writers committed version {clash[0].seq} of {self.path}")
        last = Window.partitionBy("part").orderBy(F.desc("seq"))
        return log.where("part is not null").withColumn("__n", F.row_number().over(last)).where("__n = 1").select("part", "version").collect()

    # reading ----------------------------------------------------------------------------
    def _folder(self, version: str, part: str) -> str:
        return f"{self.path}/data/{version}/part={part}"

    def read(self, parts: Sequence[str] | None = None, without: Sequence[str] = ()) -> DataFrame:
        """The current rows, of all partitions, of ``parts`` only, or of all but ``without``."""
        paths = [self._folder(r.version, r.part) for r in self._newest()
                 if (parts is None or r.part in parts) and r.part not in without]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def touched(self, rows: DataFrame, keys: Sequence[str]) -> list[str]:
        """Partitions of ``rows``, and those where rows of their keys lie now."""
        parts = {r[0] for r in rows.select(self.part.alias("part")).distinct().collect()}
        if not self.key_partition:
            elsewhere = self.read(without=sorted(parts)).select(*keys, self.part.alias("part"))
            moved = elsewhere.join(rows.select(*keys).distinct(), list(keys), "left_semi").select("part").distinct()
            parts |= {r[0] for r in moved.collect()}
        return sorted(parts)

    # writing ----------------------------------------------------------------------------
    def _write(self, rows: DataFrame, part: Column, run: str, as_of) -> tuple[str, dict]:
        version, seen = uuid.uuid4().hex, Observation()
        folder = f"{self.path}/data/{version}"
        counted = rows.observe(seen, F.count(F.lit(1)).alias("rows"), *(F.count_if(c("action") == a).alias(a) for a in (INSERT, UPDATE, UNCHANGED)))
        counted.withColumn("part", part).write.mode("errorifexists").partitionBy("part").parquet(folder)
        if not succeeded(self.spark, folder):
            raise RuntimeError(f"{folder} has no success marker")
        counts = seen.get
        if counts["rows"]:
            parts = [r.part for r in self.spark.read.schema("part string").parquet(folder).select("part").distinct().collect()]
        else:
            parts = []
        self._commit(version, parts, run, as_of)
        return version, counts

    def _commit(self, version: str, parts: Sequence[str], run: str, as_of) -> None:
        """The switch: nothing of a run is seen before this file is there. A run without rows leaves its name all the same."""
        seq = (self.commits().agg(F.max("seq")).first()[0] or 0) + 1
        rows = [(seq, version, run, p) for p in parts] or [(seq, version, run, None)]
        (self.spark.createDataFrame(rows, "seq long, version string, run string, part string").coalesce(1)
         .withColumn("committed_at", ts(as_of)).write.mode("append").parquet(f"{self.path}/commits"))

    def upsert(self, rows: DataFrame, keys: Sequence[str], merge: Callable[[DataFrame], MergeResult], as_of,
               run: str | None = None) -> MergeResult | None:
        """``merge(target)`` over the partitions that ``rows`` (its valid source rows) touch, committed as ``run``.

        Returns the merged rows of these partitions as written, with their
        counts from the pass that wrote them; None if ``run`` was committed before.
        """
        run = run or uuid.uuid4().hex
        if self.has(run):
            return None
        result = merge(self.read(self.touched(rows, keys)))
        columns = [f.name for f in self.schema]
        version, counts = self._write(result.merged.select(*columns, "action"), self.part, run, as_of)
        return MergeResult(self._written(version), result.keys, counts)

    def append(self, rows: DataFrame, as_of, run: str | None = None) -> bool:
        """Adds ``rows`` (a log, say) as a partition of its own, once for each ``run``."""
        run = run or uuid.uuid4().hex
        if self.has(run):
            return False
        self._write(rows.select(*(f.name for f in self.schema)).withColumn("action", F.lit(INSERT)), F.lit(uuid.uuid4().hex), run, as_of)
        return True

    def _written(self, version: str) -> DataFrame:
        return (self.spark.read.schema(StructType([*self.schema.fields]).add("action", "string")).parquet(f"{self.path}/data/{version}")
                .select(*(f.name for f in self.schema), "action"))
