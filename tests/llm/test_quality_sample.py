"""The training sample holds one row for each id."""

from touchline.llm import quality


def test_repeated_ids_do_not_weigh_the_sample(spark, monkeypatch):
    seen = []
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append((x.tolist(), y.tolist())) or fit(x, y))
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    once = [(i, f"text {i} " * (i + 1)) for i in range(60)]
    schema = "doc_id long, text string"
    quality.train(spark.createDataFrame(once, schema), labels)
    quality.train(spark.createDataFrame(once + [once[7]] * 500 + [once[8]] * 300, schema).repartition(4), labels)
    quality.train(spark.createDataFrame(once + [(7, f"other {i}") for i in range(200)], schema).repartition(3), labels)
    assert seen[0] == seen[1] and len(seen[0][1]) == len(seen[2][1]) > 30
