"""Pages of an ordered table, any of them at once.

``paged`` gives every row its page in one range-partitioned pass (no sort in
one task, no OFFSET); ``first_cursors`` is the directory: the row each page begins with,
from which a keyset query goes on. ``write_pages`` stores the rows by
blocks of pages, so that ``read_page`` scans the one folder that holds the page.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.joins import bounded_broadcast
from touchline.functions.numbering import numbered

c = F.col
BLOCK_PAGES = 100      # pages that share a folder


def paged(df: DataFrame, groups: Sequence[str], order: Sequence[Column], size: int) -> DataFrame:
    """``df`` with ``page_no`` and ``page_rank`` (from 1) of each row in its group's ``order`` (total within the group)."""
    if size < 1:
        raise ValueError("a page has at least one row")
    rows = numbered(df, [*map(c, groups), *order], "__n", 0)
    if groups:
        first = rows.groupBy(*groups).agg(F.min("__n").alias("__first"))
        names = [f"__g{i}" for i in range(len(groups))]
        first = first.withColumnsRenamed(dict(zip(groups, names)))
        same = F.lit(True)
        for g, name in zip(groups, names):
            same = same & c(g).eqNullSafe(c(name))
        rows = rows.join(bounded_broadcast(first), same).drop(*names)
    else:
        rows = rows.withColumn("__first", F.lit(0))
    at = c("__n") - c("__first")
    return (rows.withColumn("page_no", F.floor(at / size) + 1).withColumn("page_rank", (at % size + 1).cast("int"))
            .drop("__n", "__first"))


def first_cursors(pages: DataFrame, groups: Sequence[str], cursor: Sequence[str]) -> DataFrame:
    """The directory: for each page its first row's cursor columns."""
    return pages.where("page_rank = 1").select(*groups, "page_no", *cursor)


def _name(groups: Sequence[str]) -> Column:
    text = F.concat_ws("~", *[F.coalesce(c(g).cast("string"), F.lit("null")) for g in groups]) if groups else F.lit("all")
    return F.regexp_replace(text, "[^A-Za-z0-9~.-]", "_")


def write_pages(pages: DataFrame, path: str, groups: Sequence[str]) -> None:
    """Rows of ``paged``, in folders of a group's ``BLOCK_PAGES`` pages."""
    (pages.withColumn("part", _name(groups)).withColumn("block", F.floor((c("page_no") - 1) / BLOCK_PAGES))
     .write.mode("errorifexists").partitionBy("part", "block").parquet(path))


def read_page(spark: SparkSession, path: str, group: dict, page_no: int) -> DataFrame:
    """One page, in order; of the table only its folder is read."""
    row = spark.range(1).select(*[F.lit(v).alias(g) for g, v in group.items()])
    part = row.select(_name(list(group))).first()[0]
    page = (spark.read.parquet(path).where((c("part") == part) & (c("block") == (page_no - 1) // BLOCK_PAGES) & (c("page_no") == page_no)))
    for g, v in group.items():
        page = page.where(c(g).eqNullSafe(F.lit(v)))
    return page.drop("part", "block").orderBy("page_rank")
