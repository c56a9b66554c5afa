"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import cut, shuffle_partitions

LEAST_TASKS = 8
TASK_EDGES = 100_000     # rows of two longs


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (longs). Returns (id, component) of every node with an edge; component is the smallest id of its part.

    Each round hangs nodes on their smallest neighbour (Kiveris et al., "Connected
    components in MapReduce and beyond"); the number of rounds grows with the logarithm of the
    parts' size. A node with very many neighbours is one group of a partial minimum and one key of
    a join that adaptive execution can split. Loops, null ends and repeated edges add nothing.

    A round is some ten stages, and with many shuffle partitions most of their tasks would have no rows: each
    stage gets a task for ``TASK_EDGES`` edges, ``LEAST_TASKS`` at least, until that reaches the number of shuffle partitions.
    """
    partitions = shuffle_partitions(edges)
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    tasks = max(LEAST_TASKS, -(-now.count() // TASK_EDGES))     # edges never become more

    def few(df: DataFrame) -> DataFrame:
        return df.coalesce(tasks) if tasks < partitions else df

    turned = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    seen = None
    while True:
        both = few(now).select(F.inline(turned))
        least = few(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = few(few(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
        least = few(large.groupBy("u").agg(F.min("v").alias("m")))
        small = few(large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        now = cut(few(small.union(least.select("u", F.col("m").alias("v"))).distinct()))
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(few(now.select("v", "v").distinct()))
