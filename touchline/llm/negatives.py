"""Hard-negative mining with rotated one-bit codes.

A vector is rotated (random signs and Walsh-Hadamard transforms, so orthogonal
at any width) and coded by its signs; with the code goes its alignment, the
inner product of the vector with the unit vector of its code. What the code
leaves is rotated and coded again, ``LEVELS`` times. A query's inner product
with a code is a popcount over the query's bit planes; the rest is bounded by
Cauchy-Schwarz: what a code leaves is orthogonal to the code, so its product
with the query is at most its length times the length of the query's part
orthogonal to the code. The interval (estimate -+ bound, with the query's
rounding added) holds the true product always, not with high probability: a
candidate goes only when its interval cannot reach the k-th best score or the
window asked for. Survivors are scored in integers.

Anchors meet the rows as a grid of anchor blocks and shards of bounded bytes.
The first shard runs alone; its k-th best scores are floors for all other
shards. Rows equal in id, label and vector are one row with a number of copies,
so a hot group of copies is counted before it is dealt; labels deal nothing,
so a hot label is spread like any other.

Defined cases: rows with a null id, label or vector, or a null or non-finite
component, take no part; missing components of shorter vectors count as 0;
repeated ids are rows of their own: each is an anchor, and a candidate of its
equals; 256 * x beyond a double is held to the largest double; scores are exact
(Python integers where doubles are not), and held to the range of a long in the
result; ties go to the smaller id; empty tables give no rows; further columns
are passed over.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import cut, map_arrow

LEVELS = 4               # one-bit codes of a vector, each of what those before leave
PLANES = 8               # bits of a query's components
SHARD_BYTES = 4 << 20    # of a shard's integer vectors
SHARD_ROWS = 1024        # that a shard of long vectors has all the same
BLOCK_ANCHORS = 4096
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90       # hundredths of the positive's score between which a negative's lies
_EXACT = float(2**53)
_LONG = 2**63 - 1

ENCODED = "row long, vec_id long, label long, copies long, v array<double>, code binary, align array<double>, rest array<double>"
FOUND = "anchor long, part int, vec_id long, copies long, score long"


def scaled(vector: str, scale: int) -> Column:
    """floor(scale * x) of each component, as doubles (all integers); held to the largest double."""
    def one(x: Column) -> Column:
        y = x.cast("double") * scale
        whole = F.when(F.abs(y) < _EXACT, F.floor(y).cast("double")).otherwise(y)
        return F.greatest(F.least(whole, F.lit(sys.float_info.max)), F.lit(-sys.float_info.max))
    return F.transform(vector, one)


def prepared(vectors: DataFrame, vector: str = "embedding", scale: int = 256, moved: int = 7) -> DataFrame:
    """vec_id, label, v, copies: rows that take part; labels of ids divisible by ``moved`` go to (label + 1) % 10."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    label = F.col("label").cast("long")
    return (vectors.where(F.col("vec_id").isNotNull() & label.isNotNull() & F.col(vector).isNotNull() & fine)
            .select(F.col("vec_id").cast("long").alias("vec_id"),
                    F.when(F.col("vec_id") % moved == 0, (label + 1) % 10).otherwise(label).alias("label"),
                    scaled(vector, scale).alias("v"))
            .groupBy("vec_id", "label", "v").agg(F.count("*").alias("copies")))


def _signs(level: int, turn: int, width: int) -> np.ndarray:
    return np.random.default_rng([11, level, turn]).integers(0, 2, width).astype(np.float64) * 2 - 1


def rotated(m: np.ndarray, level: int) -> np.ndarray:
    """Rows of ``m`` (their width a power of two) in the basis of a level; keeps lengths and inner products."""
    n, width = m.shape
    for turn in range(2):
        m = m * _signs(level, turn, width)
        step = 1
        while step < width:
            pairs = m.reshape(n, width // (2 * step), 2, step)
            m = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(n, width)
            step *= 2
        m = m / np.sqrt(width)
    return m


def padded(width: int) -> int:
    return max(64, 1 << max(0, width - 1).bit_length())


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of ``width`` doubles; missing components are 0."""
    offsets = np.asarray(column.offsets)
    flat, sizes = np.asarray(column.values), np.diff(offsets)
    out = np.zeros((len(sizes), width))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    out[owner, np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], sizes)] = flat[offsets[0]:offsets[-1]]
    return out


def encode(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (rows x levels x words), alignments and lengths of what each level leaves (rows x levels).

    A row whose length is no moderate number has alignments 0 and leaves infinity: it is never passed over.
    """
    width = m.shape[1]
    with np.errstate(over="ignore", invalid="ignore"):
        wild = ~(np.sqrt((m * m).sum(axis=1)) < 1e150)
    left = np.where(wild[:, None], 0, m)
    codes = np.zeros((len(m), LEVELS, width // 64), np.uint64)
    align, rest = np.zeros((len(m), LEVELS)), np.zeros((len(m), LEVELS))
    for level in range(LEVELS):
        left = rotated(left, level)
        up = left >= 0
        codes[:, level] = np.packbits(up, axis=1).view(np.uint64)
        align[:, level] = np.abs(left).sum(axis=1) / np.sqrt(width)
        left = left - np.where(up, 1.0, -1.0) * (align[:, level] / np.sqrt(width))[:, None]
        rest[:, level] = np.sqrt((left * left).sum(axis=1))
    rest[wild] = np.inf
    return codes, align, rest


def encoded(rows: DataFrame, width: int) -> DataFrame:
    """``rows`` (vec_id, label, v, copies) with a row number, codes, alignments and lengths left; stored."""
    size = padded(width)

    def codes(batch: pa.RecordBatch):
        c, a, r = encode(matrix(batch.column("v"), size))
        blocks = pa.array([x.tobytes() for x in c], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("vec_id"), batch.column("label"), batch.column("copies"), batch.column("v"), blocks,
             pa.array(list(a), pa.list_(pa.float64())), pa.array(list(r), pa.list_(pa.float64()))],
            ["row", "vec_id", "label", "copies", "v", "code", "align", "rest"])

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "copies", "v")
    return cut(map_arrow(numbered, codes, ENCODED))


class Asked:
    """A query's side of the popcounts: for each level the bit planes, their grid, and the rounding's bound."""

    def __init__(self, x: np.ndarray):
        with np.errstate(over="ignore", invalid="ignore"):
            self.square = float((x * x).sum())
        self.levels = []
        if not self.square < 1e300:
            return
        for level in range(LEVELS):
            x = rotated(x[None, :], level)[0]
            low, high = x.min(), x.max()
            step = (high - low) / (2**PLANES - 1) or 1.0
            u = np.clip(np.rint((x - low) / step), 0, 2**PLANES - 1).astype(np.uint8)
            bits = np.unpackbits(u[:, None], axis=1, bitorder="little").T          # plane p: bit p of every component
            planes = np.ascontiguousarray(np.packbits(bits, axis=1)).view(np.uint64)
            self.levels.append((planes, low, step, int(u.sum()), float(np.abs(x - (low + step * u)).sum())))

    def product(self, level: int, codes: np.ndarray, width: int) -> tuple[np.ndarray, float]:
        """Inner products with the codes' unit vectors, and the most by which the query's rounding moves them."""
        planes, low, step, total, error = self.levels[level]
        ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
        inside = np.zeros(len(codes), np.int64)
        for p, plane in enumerate(planes):
            inside += np.bitwise_count(codes & plane).sum(axis=1, dtype=np.int64) << p
        root = np.sqrt(width)
        return (low * (2 * ones - width) + step * (2 * inside - total)) / root, error / root


class Shard:
    """The rows of one shard, as one task holds them."""

    def __init__(self, table: pa.Table, width: int):
        self.width = padded(width)
        table = table.combine_chunks()
        column = lambda name: table.column(name).combine_chunks()
        self.row, self.id, self.label, self.copies = (column(n).to_numpy().copy() for n in ("row", "vec_id", "label", "copies"))
        self.v = matrix(column("v"), width)
        self.code = np.frombuffer(b"".join(column("code").to_pylist()), np.uint64).reshape(len(self.id), LEVELS, -1)
        self.align, self.rest = matrix(column("align"), LEVELS), matrix(column("rest"), LEVELS)
        self.largest = float(np.abs(self.v).max(initial=0))

    def scores(self, x: np.ndarray, at: np.ndarray) -> list[int]:
        """Exact inner products, held to the range of a long."""
        if float(np.abs(x).max(initial=0)) * self.largest * max(1, len(x)) < _EXACT:
            return (self.v[at] @ x).astype(np.int64).tolist()
        whole = [int(c) for c in x]
        return [max(-_LONG - 1, min(_LONG, sum(int(c) * w for c, w in zip(self.v[i], whole) if c))) for i in at]

    def search(self, x: np.ndarray, at: np.ndarray, windows: list[tuple[int | None, int | None, int | None]], k: int):
        """For each window (low, high, floor) the rows of ``at`` with low <= score <= high that can be among the k best.

        ``floor`` is a score that k rows elsewhere reach. Yields (window's place, row, score).
        """
        asked = Asked(np.concatenate([x, np.zeros(self.width - len(x))]))
        lows = np.array([-np.inf if w[0] is None else float(w[0]) for w in windows])
        highs = np.array([np.inf if w[1] is None else float(w[1]) for w in windows])
        floors = np.array([-np.inf if w[2] is None else float(w[2]) for w in windows])
        root = np.sqrt(asked.square)
        estimate, rounding = np.zeros(len(at)), np.zeros(len(at))
        for level in range(LEVELS if asked.levels else 0):
            s, error = asked.product(level, self.code[at, level], self.width)
            align, rest = self.align[at, level], self.rest[at, level]
            estimate, rounding = estimate + align * s, rounding + align * error
            across = np.sqrt(np.maximum(asked.square - np.maximum(np.abs(s) - error, 0) ** 2, 0))
            with np.errstate(invalid="ignore"):
                bound = np.nan_to_num(rest * across, nan=np.inf, posinf=np.inf) + rounding
            # sums in double precision: far more than their rounding
            bound = bound + 1e-9 * (1 + root * (rest + np.abs(self.align[at]).sum(axis=1)))
            least, most = estimate - bound, estimate + bound
            keep = np.zeros(len(at), bool)
            for low, high, floor in zip(lows, highs, floors):
                sure = least[(least >= low) & (most <= high)]
                if len(sure) >= k:
                    floor = max(floor, np.partition(sure, len(sure) - k)[len(sure) - k])
                keep |= (most >= max(low, floor)) & (least <= high)
            at, estimate, rounding = at[keep], estimate[keep], rounding[keep]
            if not len(at):
                return
        scores = self.scores(x, at)
        for place, (low, high, floor) in enumerate(windows):
            low = max((b for b in (low, floor) if b is not None), default=None)
            inside = [(-s, int(self.id[i]), i) for s, i in zip(scores, at) if (low is None or s >= low) and (high is None or s <= high)]
            inside.sort()
            taken = 0
            for s, _, i in inside:
                if taken >= k:
                    break
                taken += int(self.copies[i])
                yield place, i, -s


def window_of(score: int) -> tuple[int, int]:
    """Least and most integer s with LOW * score <= 100 * s <= HIGH * score."""
    return -(-LOW * score // 100), HIGH * score // 100


def grid(anchors: DataFrame, rows: DataFrame, width: int, k: int, same: bool) -> DataFrame:
    """The shards' best k of each anchor's windows, for anchors (row, label, v, windows of (part, score, floor), block, shard).

    A window with a score is the one of that positive's negatives; one without
    is open. Rows of the anchor's label are candidates if ``same``, all others
    if not. The anchor's own row counts one copy less.
    """
    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {n: [] for n in ("anchor", "part", "vec_id", "copies", "score")}
        if left.num_rows and right.num_rows:
            shard = Shard(right, width)
            left = left.combine_chunks()
            xs = matrix(left.column("v").combine_chunks(), width)
            for row, label, x, windows in zip(left["row"].to_pylist(), left["label"].to_pylist(), xs, left["windows"].to_pylist()):
                own = np.flatnonzero(shard.row == row)
                shard.copies[own] -= 1
                at = np.flatnonzero(((shard.label == label) == same) & (shard.copies > 0))
                bounds = [(*(window_of(w["score"]) if w["score"] is not None else (None, None)), w["floor"]) for w in windows]
                for place, i, score in shard.search(x, at, bounds, k) if len(at) else ():
                    for name, value in zip(out, (row, windows[place]["part"], int(shard.id[i]), int(shard.copies[i]), score)):
                        out[name].append(value)
                shard.copies[own] += 1
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.table([pa.array(v, t) for v, t in zip(out.values(), kinds)], names=list(out))

    return anchors.groupBy("block", "shard").cogroup(rows.groupBy("block", "shard")).applyInArrow(search, FOUND)


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each anchor's window, copies counted one by one: anchor, part, rank, vec_id, score."""
    order = Window.partitionBy("anchor", "part").orderBy(F.desc("score"), "vec_id")
    single = found.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k).cast("long")).cast("int"))))
    return (single.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("anchor", "part", "rank", "vec_id", "score"))


def scan(anchors: DataFrame, rows: DataFrame, width: int, k: int, same: bool) -> DataFrame:
    """The k best rows of each anchor's windows over all ``rows`` (of ``encoded``); anchors as for ``grid``."""
    n, asked = rows.count(), anchors.count()
    shards = max(1, -(-n // max(SHARD_ROWS, SHARD_BYTES // (8 * max(1, width)))))
    blocks = max(1, -(-asked // BLOCK_ANCHORS))
    deal = lambda parts, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(parts)).cast("int")
    left = anchors.withColumn("block", deal(blocks, 1))
    right = rows.withColumn("shard", deal(shards, 2)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    first = cut(best(grid(left.withColumn("shard", F.lit(0)), right.where("shard = 0"), width, k, same), k))
    if shards == 1:
        return first
    floors = (first.where(F.col("rank") == k).groupBy(F.col("anchor").alias("row"))
              .agg(F.map_from_entries(F.collect_list(F.struct("part", "score"))).alias("_floors")))
    floor = lambda w: F.try_element_at("_floors", w["part"])
    left = (left.join(floors, "row", "left").withColumn("windows", F.transform(
        "windows", lambda w: F.struct(w["part"].alias("part"), w["score"].alias("score"), floor(w).alias("floor"))))
        .drop("_floors").withColumn("shard", F.explode(F.sequence(F.lit(1), F.lit(shards - 1)))))
    others = grid(left, right.where("shard > 0"), width, k, same)
    return best(first.select("anchor", "part", "vec_id", F.lit(1).cast("long").alias("copies"), "score").unionByName(others), k)


_WINDOW = "array<struct<part:int,score:bigint,floor:bigint>>"


def hard_negatives(vectors: DataFrame, vector: str = "embedding", divisor: int = 100, scale: int = 256,
                   positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """Hard negatives of every anchor (a row whose id is divisible by ``divisor``) and each of its positives.

    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    plain = prepared(vectors, vector, scale)
    width = plain.agg(F.max(F.size("v"))).first()[0] or 0
    rows = encoded(plain, width)
    anchors = cut(rows.where(F.col("vec_id") % divisor == 0).select("row", "vec_id", "label", "copies", "v"))
    anchors = anchors.select(*(F.col(c).alias(c) for c in anchors.columns))      # columns of its own, to meet ``rows`` in a join
    open_window = F.array(F.struct(F.lit(0).alias("part"), F.lit(None).cast("long").alias("score"), F.lit(None).cast("long").alias("floor")))
    near = cut(scan(anchors.withColumn("windows", open_window.cast(_WINDOW)), rows, width, positives, True))
    of_anchor = near.groupBy(F.col("anchor").alias("row")).agg(F.collect_list(
        F.struct(F.col("rank").alias("part"), "score", F.lit(None).cast("long").alias("floor"))).cast(_WINDOW).alias("windows"))
    far = scan(anchors.join(of_anchor, "row"), rows, width, negatives, False)
    return (far.join(near.select("anchor", F.col("rank").alias("part"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")),
                     ["anchor", "part"])
            .join(anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"), F.col("copies").alias("_copies")), "anchor")
            .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
            .select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))


ORACLE = """
with taking_part as (
  select row_number() over () as row_no, vec_id,
    case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.row_no as anchor, a.vec_id as anchor_id, r.vec_id, a.label = r.label as same,
    list_inner_product(a.v, r.v)::bigint as score
  from taking_part a join taking_part r on a.row_no <> r.row_no where a.vec_id % 100 = 0),
positives as (
  select *, row_number() over (partition by anchor order by score desc, vec_id) as place from scored where same
  qualify place <= 5)
select p.anchor_id, p.vec_id as positive_id,
  (row_number() over (partition by p.anchor, p.place order by n.score desc, n.vec_id))::integer as rank,
  n.vec_id as negative_id, p.score as positive_score, n.score as negative_score
from positives p join scored n on n.anchor = p.anchor and not n.same
  and 30 * p.score <= 100 * n.score and 100 * n.score <= 90 * p.score
qualify rank <= 10
"""
