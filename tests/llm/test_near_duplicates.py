"""Near duplicates against brute force: recall, not precision alone."""

import os
import random
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
from brute import shingles  # noqa: E402

from touchline.llm import fingerprints, jaccard_tree  # noqa: E402


@pytest.fixture(scope="module")
def family():
    """Variants of one text, many of them just under or over the threshold, and copies."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(604)]
    rows = []
    for i in range(160):
        t = list(base)
        for j in rng.sample(range(604), rng.choice([2, 8, 14, 18, 22])):
            t[j] = f"r{i}_{j}"
        rows.append((1000 - i, " ".join(t)))
    return rows + [(5, rows[3][1]), (6, rows[3][1].upper()), (7, ""), (8, None), (9, "few words")]


def _truth(rows):
    """Similarities of all pairs that link, and which rows chains of shared bands connect."""
    sets = [shingles(t) for _, t in rows]
    s, f = fingerprints.signatures([(t or "").encode() for _, t in rows])
    bands = s.reshape(len(rows), fingerprints.BANDS, fingerprints.ROWS)
    links, shared, group = {}, set(), list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if f[i] and f[j]:
                if (bands[i] == bands[j]).all(axis=1).any():
                    shared.add((i, j))
                    a, b = group[i], group[j]
                    group = [a if g == b else g for g in group]
                n = len(sets[i] & sets[j])
                if 100 * n >= 75 * (len(sets[i] | sets[j])):
                    links[i, j] = n / len(sets[i] | sets[j])
    return links, shared, group


@pytest.mark.parametrize("block", [1024, 16])
def test_no_link_of_a_dense_family_is_lost(spark, family, monkeypatch, block):
    monkeypatch.setattr(jaccard_tree, "BLOCK", block)
    links, shared, group = _truth(family)
    docs = spark.createDataFrame(family, "doc_id long, text string").repartition(3)
    at = {d: i for i, (d, _) in enumerate(family)}
    copies = {at[5]: at[5], at[6]: at[5], 3: at[5]}          # a class goes by its smallest document
    want = {}
    for (i, j), x in links.items():
        a, b = sorted((family[copies.get(i, i)][0], family[copies.get(j, j)][0]))
        if group[i] == group[j] and a != b:
            want[b, a] = x
    want |= {(6, 5): 1.0, (family[3][0], 5): 1.0}
    got = {(r.doc_id, r.other_id): r.similarity for r in fingerprints.near_duplicates(docs).collect()}
    assert got == pytest.approx(want) and len(want) > 300 and (set(links) & shared) and len(set(links) & shared) > 300

    part = list(range(len(family)))
    for i, j in links:
        if group[i] == group[j]:
            a, b = part[i], part[j]
            part = [a if p == b else p for p in part]
    least = {p: min(family[i][0] for i in range(len(family)) if part[i] == p) for p in part}
    rows = fingerprints.fingerprints(docs).collect()
    assert {r.doc_id: r.near_id for r in rows} == {d: least[part[i]] for d, i in at.items()}
    plain = fingerprints.fingerprint_neighbours(docs)
    assert sorted(tuple(r)[:-1] for r in rows) == sorted(map(tuple, plain.collect()))


def test_query_reaches_the_links(spark):
    import __spark_entry__ as entry
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r.near_id for r in entry.queries()["op3_fingerprints"](spark, sf).collect()}
    exact = {r.doc_id: r.component_id for r in entry.queries()["op9_jaccard_join"](spark, sf).collect()}
    assert got.keys() == exact.keys() and all(exact[d] == exact[n] for d, n in got.items())
    assert np.mean([got[d] == exact[d] for d in got]) > 0.99


def test_odd_rows(spark, odd, empty, same):
    assert fingerprints.fingerprints(empty).count() == 0 and fingerprints.near_duplicates(empty).count() == 0
    assert {r.near_id for r in fingerprints.fingerprints(same).collect()} == {6}
    assert fingerprints.fingerprints(odd).count() == odd.count()
    with pytest.raises(ValueError):
        fingerprints.near_duplicates(odd, 0.5)
