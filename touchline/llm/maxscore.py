"""Exact top-k search by MaxScore over quantised vectors.

Each component is a term; a vector's impact on a query's term d is
``q[d] * v[d]`` less the least such product in the shard, so impacts are never
negative and a term's bound is the width of its range. Vectors lie in
shards of bounded size, each with per-term bounds; a shard is walked in blocks.
Given the k-th best score so far, the terms of least bound that together cannot
lift a vector over it are non-essential: essential terms are summed for the
whole block, then the non-essential ones, widest first, are probed for the
vectors that can still compete. Each shard's best k are merged in Spark.

Queries (a stated set) meet shards as a grid of query blocks and shards, both
of bounded size, so a task holds ``BLOCK_QUERIES`` queries and ``SHARD_ROWS``
vectors at most, whatever the tables' sizes. Arithmetic is exact: float64 while
all sums are below 2**53, else Python integers.

The first shard runs alone: its k-th best scores are floors below which no other
shard need look. Rows equal in id and vector are one row with a number of copies.

Defined cases: vectors that are null or hold a null or non-finite component
take no part; missing components of shorter vectors count as 0; null ids take no
part; rows of one id are rows of their own: each is a query, and a candidate for its
equals (a query passes over its own row only); components and scores beyond a long are held to its range; ties go
to the smaller id; fewer candidates than k give fewer rows; further columns are passed over.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import cut

SHARD_ROWS = 8192
BLOCK_QUERIES = 2048
BLOCK = 1024
K = 10
PROBE = 8
_LONG = 2**63 - 1


def quantised(vectors: DataFrame, vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """vec_id, v array<bigint>: floor(scale * x) of each component as double; copies: equal rows."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return (vectors.where(F.col("vec_id").isNotNull() & F.col(vector).isNotNull() & fine)
            .select("vec_id", F.transform(vector, lambda x: F.floor(x.cast("double") * scale)).alias("v"))
            .groupBy("vec_id", "v").agg(F.count("*").alias("copies")))


def _matrix(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def search_shard(query_ids, queries, ids, vectors, k: int = K, own=None, floors=None):
    """Rows (query_id, vec_id, score): each query's best k of one shard, by MaxScore.

    ``own``: for each query the place of its own row, or -1 (default: all rows of its id); ``floors``: for each
    query a score that k rows elsewhere reach, or None.
    """
    width = max([0, *map(len, queries), *map(len, vectors)])
    q, v, ids = _matrix(queries, width), _matrix(vectors, width), np.asarray(ids)
    largest = int(np.abs(q).max(initial=0)) * int(np.abs(v).max(initial=0)) * max(1, width) * 4
    exact = np.float64 if largest < 2**53 else object
    q, v = q.astype(exact), v.astype(exact)
    order = np.argsort(ids, kind="stable")
    ids, v = ids[order], v[order]
    low, high = v.min(axis=0, initial=None) if len(v) else 0, v.max(axis=0, initial=None) if len(v) else 0
    out = []
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    for n, (query_id, x) in enumerate(zip(query_ids, q)):
        others = np.ones(len(ids), bool)
        if own is None:
            others[ids == query_id] = False
        elif own[n] >= 0:
            others[place[own[n]]] = False
        floor_score = None if floors is None else floors[n]
        a, b = x * low, x * high
        floor, bound = np.minimum(a, b), np.abs(b - a)
        terms = np.argsort(-bound.astype(float), kind="stable")
        suffix = np.append(np.cumsum(bound[terms][::-1])[::-1], 0)      # bounds of the terms from j on
        base = floor.sum()
        best_s, best_i = np.zeros(0, exact), np.zeros(0, np.int64)
        for start in range(0, len(ids), BLOCK):
            rows = np.flatnonzero(others[start:start + BLOCK]) + start
            least = best_s[-1] if len(best_s) == k else None
            if floor_score is not None:
                least = floor_score if least is None else max(least, floor_score)
            full = least is not None
            # essential: up to the first term from which on all bounds together cannot reach the k-th score
            essential = int(np.argmax(base + suffix < least)) if full and base < least else len(terms)
            essential = min(len(terms), max(essential, 1))
            head = terms[:essential]
            sums = v[np.ix_(rows, head)] @ x[head]
            shift = np.append(np.cumsum(floor[terms][::-1])[::-1], 0)   # least products of the terms from j on
            for j in range(essential, len(terms), PROBE):
                alive = sums + shift[j] + suffix[j] >= least
                rows, sums = rows[alive], sums[alive]
                if not len(rows):
                    break
                some = terms[j:j + PROBE]
                sums = sums + v[np.ix_(rows, some)] @ x[some]
            if full:
                keep = sums >= least
                rows, sums = rows[keep], sums[keep]
            if len(rows):
                s, i = np.concatenate([best_s, sums]), np.concatenate([best_i, ids[rows]])
                top = np.lexsort((i, -s))[:k] if exact is np.float64 else np.array(sorted(range(len(s)), key=lambda t: (-s[t], i[t]))[:k])
                best_s, best_i = s[top], i[top]
        out += [(query_id, int(i), int(s)) for i, s in zip(best_i, best_s)]
    return out


def _grid(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """query (row), vec_id, score: the shards' best k; left: row, v, least, block, shard; right: row, copy, vec_id, v, block, shard."""
    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(a) and len(b):
            firsts = {row: i for i, (row, copy) in enumerate(zip(b["row"], b["copy"])) if copy == 0}
            floors = [None if pd.isna(x) else int(x) for x in a.least]
            found = search_shard(a["row"].tolist(), a.v.tolist(), b.vec_id.to_numpy(), b.v.tolist(), k, [firsts.get(r, -1) for r in a["row"]], floors)
        return pd.DataFrame([(q, i, max(-_LONG - 1, min(_LONG, s))) for q, i, s in found], columns=["query", "vec_id", "score"])

    return left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInPandas(search, "query long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(rows: DataFrame, asked: Column, k: int = K) -> DataFrame:
    """rows: vec_id, v, copies. Returns query_id, rank, vec_id, score for the rows that ``asked`` holds for."""
    rows = cut(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v", "copies"))
    queries = cut(rows.where(asked).select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "copies"))
    shards, blocks = max(1, -(-rows.count() // SHARD_ROWS)), max(1, -(-queries.count() // BLOCK_QUERIES))
    part = lambda n, name, salt: F.pmod(F.xxhash64(name, F.lit(salt)), F.lit(n)).cast("int")
    # more than k + 1 copies of a row change no query's best k
    right = (rows.select("row", "vec_id", "v", F.explode(F.sequence(F.lit(0), F.least("copies", F.lit(k + 1)).cast("int") - 1)).alias("copy"))
             .withColumn("shard", part(shards, "row", 2)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    left = queries.select(F.col("query").alias("row"), F.col("q").alias("v"), part(blocks, "query", 1).alias("block"))
    first = cut(_best(_grid(left.withColumns({"least": F.lit(None).cast("long"), "shard": F.lit(0)}), right.where("shard = 0"), k), k))
    found = first
    if shards > 1:
        # a score held to a long's end is no floor
        floors = first.where((F.col("rank") == k) & (F.abs(F.col("score").cast("double")) < 9e18)).select(F.col("query").alias("row"), F.col("score").alias("least"))
        seeded = left.join(floors, "row", "left").withColumn("shard", F.explode(F.sequence(F.lit(1), F.lit(shards - 1))))
        found = _best(first.drop("rank").unionByName(_grid(seeded, right.where("shard > 0"), k)), k)
    return (found.join(queries.select("query", "query_id", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("_copy")), "query")
            .select("query_id", "rank", "vec_id", "score"))


def search_divisible(vectors: DataFrame, divisor: int = 100, k: int = K) -> DataFrame:
    """Queries are the rows whose id is divisible by ``divisor``; every other row is a candidate."""
    return top_k(quantised(vectors), F.col("vec_id") % divisor == 0, k)
