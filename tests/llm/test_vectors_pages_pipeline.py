"""Top-k search, language ID, the pipeline and the registered queries."""

import numpy as np

import __spark_entry__ as entry
import corpus_pipeline
from touchline.llm import langid, maxscore

SF = "/root/testdata/sf0.01"


def _brute(vectors, k):
    out = []
    for q in sorted(vectors):
        if q % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(vectors[q], v)), i) for i, v in vectors.items() if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return out


def _brute_rows(rows, k):
    """Every row a query or candidate of its own; rows: (id, integers)."""
    out = []
    for n, (q, x) in enumerate(rows):
        if q % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(x, v)), i) for m, (i, v) in enumerate(rows) if m != n)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_top_k_with_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6) / 8], "x") for i in range(330)]
    rows += [(400, None, "x"), (500, [1.0, None], "x"), (600, [float("nan")], "x"), (700, [float("inf")], "x"), (None, [1.0], "x"), rows[3], (5, [9.0] * 6, "x"), (800, [], "x")]
    got = maxscore.search_divisible(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string"))
    fine = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    assert sorted(map(tuple, got.collect())) == _brute_rows(fine, 10)
    assert maxscore.search_divisible(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_top_k_in_blocks_and_shards(spark, monkeypatch):
    monkeypatch.setattr(maxscore, "SHARD_ROWS", 100)
    monkeypatch.setattr(maxscore, "BLOCK_QUERIES", 2)
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    vectors = {r.vec_id: [int(np.floor(1024 * float(x))) for x in r.embedding] for r in table.collect()}
    assert sorted(map(tuple, maxscore.search_divisible(table).collect())) == _brute(vectors, 10)


def test_repeated_ids_are_rows_of_their_own(spark, monkeypatch):
    rows = [(0, [1.0, 0.0]), (5, [1.0, 0.0]), (5, [9.0, 0.0]), (6, [2.0, 0.0]), (100, [1.0, 1.0]), (100, [1.0, 1.0]), (100, [0.5, 0.0])]
    rows += [(7, [3.0, 3.0])] * 30 + [(200 + i, [i / 64, -i / 64]) for i in range(1, 60)]
    fine = [(i, [int(1024 * x) if x >= 0 else int(np.floor(1024 * x)) for x in v]) for i, v in rows]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, maxscore.search_divisible(table).collect())) == _brute_rows(fine, 10)
    monkeypatch.setattr(maxscore, "SHARD_ROWS", 16)           # floors of the first shard meet the others
    assert sorted(map(tuple, maxscore.search_divisible(table).collect())) == _brute_rows(fine, 10)


def test_huge_components_have_a_result(spark):
    rows = [(0, [1e300, 1.0]), (1, [1e300, 1.0]), (2, [-1e300, 1.0]), (3, [1.0, 1.0])]
    got = maxscore.search_divisible(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(1, 2**63 - 1), (3, 2**63 - 1), (2, -2**63)]


def test_large_components_stay_exact():
    q, v = [2**40, -(2**40)], {1: [2**40, 1], 2: [2**40 - 1, 0], 3: [1, -(2**40)], 4: [2**40, 1]}
    want = sorted((-sum(a * b for a, b in zip(q, x)), i) for i, x in v.items())
    got = maxscore.search_shard([0], [q], list(v), list(v.values()), 3)
    assert [(-s, i) for _, i, s in got] == want[:3]


def test_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    extra = [(9001, None, None), (9002, "not an address", ""), (9003, "https://u@h.example.de:8/x", "<html lang='de'><p></p>"), (None, None, "<p>x")]
    odd = spark.createDataFrame(extra, "page_id long, url string, html string")
    got = {r.page_id: r for r in langid.identify(pages.unionByName(odd), docs).collect()}
    assert len(got) == pages.count() + len(extra) and all(0 < r.confidence <= 1 + 1e-9 for r in got.values())
    assert got[9003].suffix == "de" and got[9003].declared == "de" and got[9003].lang == "de"
    assert sum(r.lang == r.declared for r in got.values()) > 0.95 * pages.count()
    assert langid.identify(odd.where("page_id < 0"), docs).count() == 0


def test_declaration_and_host_decide_without_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {lang: docs.where(f"lang = '{lang}' and n_chars > 800").first().text for lang in ("de", "fr")}
    rows = [(i, f"http://h{i % 2}.example.org/{i}", f"<html lang=\"{lang}\"><p>{text[lang]}</p>") for i, lang in enumerate(["de", "fr"] * 20)]
    rows += [(100, "http://h0.example.org/none", "<p></p>"), (101, "http://h1.example.org/none", "<p></p>"), (102, "http://x.example.net/", "<html lang=fr><p></p>")]
    got = {r.page_id: r.lang for r in langid.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), docs).collect()}
    assert (got[100], got[101], got[102]) == ("de", "fr", "fr")


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts, now = [], docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF).checkpoint()
        counts.append(now.count())
        if name != "packing":
            assert now.schema.simpleString() == docs.schema.simpleString()
    good, unlike, whole = counts[:3]
    assert good < docs.count() and unlike < good and whole == unlike
    assert {"doc_id", "start", "length", "ids", "sequence_id", "offset"} <= set(now.columns)


def test_pipeline_on_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_mixing_query_matches_sql(spark):
    import duckdb
    sql = entry.oracle_sql()["op5_mixing"]
    duckdb_rows = duckdb.connect().execute(f"with documents as (select * from read_parquet('{SF}/documents.parquet')) select * from ({sql})").fetchall()
    assert sorted(map(tuple, entry.queries()["op5_mixing"](spark, SF).collect())) == sorted(duckdb_rows)


def test_queries_are_registered():
    names = entry.queries()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names
