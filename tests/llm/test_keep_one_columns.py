"""One document of each component stays, whatever further columns the rows have."""

from touchline.llm import jaccard_tree


def test_clashing_column_names(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, "a"), (2, text, "b"), (3, "other words stand here for once", "c"), (4, None, "d"), (2, text, "b"), (5, text + " x", "e"), (3, "other words stand here for once", "c")]
    names = ["_id", "_hash", "_key", "_row", "row", "component", "text_hash", "stays", "head", "count", "class_id", "n_shingles"]
    ddl = "doc_id long, text string, lang string, " + ", ".join(f"{n} string" for n in names)
    docs = spark.createDataFrame([(*r, *[f"{n}{r[0]}" for n in names]) for r in rows], ddl)
    got = jaccard_tree.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r._id, r.lang) for r in got.collect()) == [(1, "_id1", "a"), (3, "_id3", "c"), (4, "_id4", "d")]
    assert jaccard_tree.keep_one(docs.limit(0)).count() == 0
