"""Notices with other punctuation, whole licenses and pieces of them."""

import pytest

from touchline.llm import licenses

FILLER = " ".join(f"word{i}" for i in range(120))


def _found(spark, texts):
    rows = [(i, f"{FILLER} {t} {FILLER}") for i, t in enumerate(texts)]
    out = [set() for _ in texts]
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r.matched >= licenses.CONTAINMENT and 0 <= r.containment <= 1
        out[r.doc_id].add(r.license)
    return out


def test_notices_with_changed_punctuation(spark):
    got = _found(spark, ["Released under the MIT License", "released under the MIT License, see", "(Released under the \u201cMIT License\u201d)",
                         "// Released under\n// the MIT License", "Licensed under the Apache License, Version 2.0, see", "Licensed under CC BY-NC 4.0!",
                         "Licensed under CC BY-SA 4.0.", "Licensed under CC BY 4.0;", "under the MIT License"])
    assert all("MIT-notice" in x for x in got[:4])
    assert "Apache-2.0-notice" in got[4] and "CC-BY-NC-4.0-notice" in got[5] and "CC-BY-SA-4.0-notice" in got[6] and "CC-BY-4.0-notice" in got[7]
    assert not got[8]


def test_whole_licenses_and_pieces(spark):
    whole = {k: v for k, v in licenses.WHOLE.items() if k.endswith("-whole")}
    assert {f"{x}-whole" for x in ("MIT", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "ISC", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0")} <= set(whole)
    for name, got in zip(whole, _found(spark, [v.replace(",", "").replace('"', "") for v in whole.values()])):
        assert name in got
    pieces = {k: v.split() for k, v in whole.items() if len(v.split()) > 3 * licenses.PART_WORDS}
    # the rest of a license, without its opening half
    for name, got in zip(pieces, _found(spark, [" ".join(v[len(v) // 2:]) for v in pieces.values()])):
        assert any(x.startswith(name.removesuffix("-whole") + "-part") for x in got)


def test_first_and_end_word_count_all_words(spark):
    row = licenses.scan(spark.createDataFrame([(1, "- one * Released under - the MIT License. two")], "doc_id long, text string")).where("license = 'MIT-notice'").first()
    assert (row.first_word, row.end_word, row.matched) == (3, 9, 1.0) and row.containment == pytest.approx(0.0)
