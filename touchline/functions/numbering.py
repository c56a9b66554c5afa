"""Gapless numbers in a total order without a global sort in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.joins import stored

_ROW_BITS = 33      # monotonically_increasing_id keeps a row's place in its partition in the low 33 bits


def numbered(df: DataFrame, order: Sequence, name: str, start: int = 1) -> DataFrame:
    """``df`` with ``name`` = start, start + 1, ... in ``order`` (no two rows equal in it).

    Rows are range-partitioned and sorted within their partitions, stored once (so that places
    and counts belong to one layout, also after a lost executor), and each
    partition's numbers begin after the rows counted in those before it. Only
    one count for each partition reaches the driver.
    """
    placed = stored(df.repartitionByRange(*order).sortWithinPartitions(*order)
              .withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", _ROW_BITS)
    before, total = [], start
    for p, n in sorted(tuple(r) for r in placed.groupBy(part.alias("p")).count().collect()):
        before.append((p, total))
        total += n
    if not before:
        return placed.withColumn(name, F.lit(None).cast("long")).drop("__at")
    firsts = df.sparkSession.createDataFrame(before, "__part long, __first long")
    at = F.col("__at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    # one row for each partition
    return (placed.withColumn("__part", part).join(F.broadcast(firsts), "__part")
            .withColumn(name, F.col("__first") + at).drop("__at", "__part", "__first"))
