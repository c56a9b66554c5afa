"""Sharding by histogram sort, in DataFrame operations only.

Rows are ordered by a key of fixed-width digits, first of the text's hash, then
of the id's hash. Boundaries between shards are found without sorting: each
round counts the exact bytes in all cells of the next digit inside the cells
that still hold an unmet boundary; a boundary is met when a cell's edge lies
within ``TOLERANCE`` of its target, else its cell is refined by the next digit.
Then the rows are exchanged once, by (shard, cell), and numbered. Law:
``bytes`` (sizes near equal). Equal texts share the first digits and
therefore lie side by side: they are cut apart only where a group of copies is
too large for the tolerance.

A cell too large for one task (many copies of a text) is split by the
id's hash, so no task gets a hot group whole. What reaches the driver is the
cells of one digit, at most ``2**DIGIT_BITS`` for each unmet boundary.

Defined cases: null text has size 1 and the crc32 of no bytes; null ids
are hashed as null; rows equal in text and id lie side by side in any order;
an empty table gives no rows; further columns are passed on, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import whole_text

SHARDS = 8
DIGIT_BITS = 12
DIGITS = 6          # three of the text's hash, three of the id's
TOLERANCE = 0.002   # of a shard's bytes
CELL_ROWS = 4096    # rows that one numbering window aims at


def _digit(level: int) -> Column:
    source = F.col("_hash") if level < DIGITS // 2 else F.col("_id_hash")
    return F.shiftrightunsigned(source, 64 - DIGIT_BITS * (level % (DIGITS // 2) + 1)).bitwiseAND(2**DIGIT_BITS - 1).cast("int")


def size_of(text: str = "text") -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def splitters(keyed: DataFrame, shards: int, tolerance: float) -> list[list[int]]:
    """For each boundary the digits of the first key of the shard above it (missing digits are zero)."""
    def counted(level: int, inside: list[tuple[int, ...]]) -> dict:
        rows, names = keyed, [f"_d{i}" for i in range(level + 1)]
        if level:
            # a few fixed prefixes, one for each unmet boundary at most
            test = F.lit(False)
            for path in inside:
                one = F.lit(True)
                for i, d in enumerate(path):
                    one = one & (_digit(i) == d)
                test = test | one
            rows = rows.where(test)
        cells = rows.select(*(_digit(i).alias(f"_d{i}") for i in range(level + 1)), "_size").groupBy(*names).agg(F.sum("_size"))
        return {tuple(r[:-1]): r[-1] for r in cells.collect()}

    top = counted(0, [])
    total = sum(top.values())
    if not total:
        return [[0] for _ in range(shards - 1)]
    targets = {b: total * b / shards for b in range(1, shards)}
    found: dict[int, list[int]] = {}
    inside: dict[tuple, tuple[float, list[int]]] = {(): (0, list(targets))}
    for level in range(DIGITS):
        if not inside:
            break
        cells = top if not level else counted(level, sorted(inside))
        deeper: dict[tuple, tuple[float, list[int]]] = {}
        for path, (below, wanted) in inside.items():
            edges, run = [], below          # (bytes below the cell, its digits, its bytes)
            for cell in sorted(c for c in cells if c[:level] == path):
                edges.append((run, cell, cells[cell]))
                run += cells[cell]
            for b in wanted:
                at, cell, size = next((e for e in reversed(edges) if e[0] <= targets[b]), edges[0])
                lower, upper = targets[b] - at, at + size - targets[b]
                if min(lower, upper) <= tolerance * total / shards or level == DIGITS - 1:
                    found[b] = list(cell) if lower <= upper else [*cell[:-1], cell[-1] + 1]
                else:
                    deeper.setdefault(cell, (at, []))[1].append(b)
        inside = deeper
    return [found[b] for b in range(1, shards)]


def _at_or_above(split: list[int]) -> Column:
    """Is the row's key at or above the splitter?"""
    test = F.lit(True)
    for i in reversed(range(len(split))):
        test = (_digit(i) > split[i]) | ((_digit(i) == split[i]) & test)
    return test


def shard(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """All columns of ``docs`` as struct ``row``, with size, shard and slot."""
    keyed = (docs.select(F.struct("*").alias("row"))
             .select("row", size_of("row.text").alias("_size"),
                     F.xxhash64(F.coalesce("row.text", F.lit(""))).alias("_hash"), F.xxhash64("row.doc_id").alias("_id_hash")))
    slim = keyed.select("_size", "_hash", "_id_hash")
    splits = splitters(slim, shards, tolerance)
    number = F.lit(0)
    for s in splits:
        number = number + F.when(_at_or_above(s), 1).otherwise(0)

    # cells to number in: the first digit, split by the id's hash where it holds many rows
    cell = slim.select(number.alias("shard"), _digit(0).alias("cell"), _digit(DIGITS // 2).alias("_sub"))
    counts = (cell.groupBy("shard", "cell", "_sub").count()
              .withColumn("_all", F.sum("count").over(Window.partitionBy("shard", "cell")))
              .withColumn("pieces", F.least(F.ceil(F.col("_all") / CELL_ROWS), F.lit(2**DIGIT_BITS)).cast("int"))
              .withColumn("piece", F.floor(F.col("_sub") * F.col("pieces") / 2**DIGIT_BITS).cast("int"))
              .groupBy("shard", "cell", "pieces", "piece").agg(F.sum("count").alias("rows")))
    # at most 2**DIGIT_BITS cells and the pieces of the large ones, about rows / CELL_ROWS: the offsets run in shard-sized windows of this small table
    offsets = counts.withColumn("start", F.sum("rows").over(Window.partitionBy("shard").orderBy("cell", "piece").rowsBetween(Window.unboundedPreceding, -1)))
    offsets = offsets.select("shard", "cell", "pieces", "piece", F.coalesce("start", F.lit(0)).alias("start"))
    pieces = counts.where("pieces > 1").select("shard", "cell", "pieces").distinct()
    placed = (keyed.withColumns({"shard": number, "cell": _digit(0), "_sub": _digit(DIGITS // 2)}))
    return _numbered(placed, pieces, offsets)


def _numbered(placed: DataFrame, pieces: DataFrame, offsets: DataFrame) -> DataFrame:
    """One exchange by (shard, cell, piece); the row's place in its piece plus the piece's start is its slot."""
    # cells with more than CELL_ROWS rows: 2**DIGIT_BITS + SHARDS at most
    placed = placed.join(F.broadcast(pieces), ["shard", "cell"], "left")
    placed = placed.withColumn("piece", F.when(F.col("pieces").isNull(), 0).otherwise(F.floor(F.col("_sub") * F.col("pieces") / 2**DIGIT_BITS)).cast("int"))
    inner = Window.partitionBy("shard", "cell", "piece").orderBy("_hash", "_id_hash")
    numbered = placed.withColumn("_nth", F.row_number().over(inner))
    return (numbered.join(offsets.drop("pieces"), ["shard", "cell", "piece"])
            .select("row", F.col("_size").alias("size"), "shard", (F.col("start") + F.col("_nth") - 1).alias("slot")))


def shard_digest(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    placed = shard(docs, shards)
    return placed.select("row.doc_id", "size", F.crc32(F.encode(whole_text("row.text"), "utf-8")).alias("text_crc32"), F.lit("bytes").alias("law"),
                         F.col("shard").cast("int"), F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))
