"""Pages at once and one page from one folder."""

import re

import pytest
from pyspark.sql import functions as F

from touchline.functions import paging as P

c = F.col


def rows_of(spark):
    tab = F.when(c("id") % 3 == 0, "a").when(c("id") % 3 == 1, "b/ü c").otherwise(None)
    return spark.range(1000).select(c("id"), tab.alias("tab"), F.pmod(c("id") * 37, F.lit(50)).alias("t"))


def test_pages_of_each_group(spark):
    order = [c("t").desc(), c("id").asc()]
    got = P.paged(rows_of(spark), ["tab"], order, 7).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.tab, []).append(r)
    assert set(groups) == {"a", "b/ü c", None} and len(got) == 1000
    for some in groups.values():
        some.sort(key=lambda r: (-r.t, r.id))
        assert [(r.page_no, r.page_rank) for r in some] == [(i // 7 + 1, i % 7 + 1) for i in range(len(some))]
    with pytest.raises(ValueError):
        P.paged(rows_of(spark), ["tab"], order, 0)


def test_a_page_is_read_from_one_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_PAGES", 5)
    order = [c("t").desc(), c("id").asc()]
    pages = P.paged(rows_of(spark), ["tab"], order, 7)
    path = str(tmp_path / "pages")
    P.write_pages(pages, path, ["tab"])
    cursors = {(r.tab, r.page_no): r.id for r in P.first_cursors(pages, ["tab"], ["t", "id"]).collect()}
    for tab in ("a", "b/ü c", None):
        whole = [r.id for r in rows_of(spark).where(c("tab").eqNullSafe(F.lit(tab))).orderBy(*order).collect()]
        page = P.read_page(spark, path, {"tab": tab}, 8)
        assert [r.id for r in page.collect()] == whole[49:56] and cursors[tab, 8] == whole[49]
        plan = page._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(part" in plan or re.search(r"PartitionFilters: \[.*block", plan)
    assert P.read_page(spark, path, {"tab": "a"}, 999).count() == 0
    assert P.paged(rows_of(spark).limit(0), ["tab"], order, 7).count() == 0
