"""The declared language is found wherever the html tag stands."""

from touchline.llm import langid


def test_tag_beyond_the_first_bytes():
    banner = b"<!-- " + b"licence <html lang='fr'> " * 400 + b"-->"
    for ahead in (banner, b" \n" * 5000, b"<?xml version='1.0'?>" + banner * 2, b"<script>x = \"<html lang='fr'>\"</script>" * 200):
        assert len(ahead) > 4096 and langid.declared(ahead + b"<HTML class='>' LANG=\"DE-at\"><p>x") == "de"
    assert langid.declared(b"<html>" + b"x" * 9000 + b"<p lang=en>") is None
    assert langid.declared(banner) is None and langid.declared(b"<!-- <html lang=en>") is None and langid.declared(b"") is None


def test_pages_with_late_tags(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(i, f"http://h{i}.example.org/", f"<!-- {'banner ' * 900}--><html lang={lang}><p></p>") for i, lang in enumerate(["de", "fr"] * 5)]
    got = langid.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), docs).collect()
    assert {(r.page_id, r.declared) for r in got} == {(i, ["de", "fr"][i % 2]) for i in range(10)}
