"""Operators over documents against brute force, on the odd documents, on empty tables and on repeated rows."""

import hashlib
import math
import os
import sys
import zlib
from collections import Counter

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
from brute import components, covered, shingles  # noqa: E402

from touchline.llm import fingerprints, jaccard_tree, licenses, mixing, packing, quality, sharding, suffix_dedup  # noqa: E402
from touchline.llm.components import components as spark_components  # noqa: E402

key = lambda r: (r[0] is not None, r[0] or 0, r[1] or "")


def test_quality(spark, odd, empty, odd_rows):
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(20)] + [(3, None), (None, 1), (5, 1)], "doc_id long, quality int")
    got = quality.classify(odd, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in odd_rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert quality.classify(empty, labels).count() == 0
    none = quality.classify(odd, labels.where("doc_id < 0")).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.keep_good(odd, quality.train(odd, labels)).schema == odd.schema


def test_quality_learns_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").selectExpr("avg(int(predicted = quality))", "count(*)").first()
    assert got[1] > 500 and got[0] > 0.98


def test_trees_walk_like_nodes():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality.fit(x, y)

    def walk(row):
        total = m.base
        for at in m.roots:
            while m.feature[at] >= 0:
                at = m.left[at] if row[m.feature[at]] <= m.cut[at] else m.right[at]
            total += m.value[at]
        return 1 / (1 + math.exp(-total))

    assert np.allclose(m.score(x), [walk(r) for r in x])
    assert ((m.score(x) > 0.5) == y).mean() > 0.95


def test_fingerprints(odd, empty, same, odd_rows):
    for frame, rows in ((odd, odd_rows), (same, [odd_rows[6]] * 50)):
        for parts in (1, 7):
            got = fingerprints.fingerprint_neighbours(frame, parts).collect()
            order = sorted(rows, key=key)
            want = Counter()
            for i, r in enumerate(order):
                t, n = r[1] or "", order[(i + 1) % len(order)][1] or ""
                k = len(t) // 4
                want[r[0], len(t), hashlib.sha256((t[:len(t) - k] + n[:k]).encode()).hexdigest()] += 1
            assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    assert fingerprints.fingerprint_neighbours(empty).count() == 0


def test_fingerprint_likeness():
    a = [("w%d " % i * 1 + " ".join(f"t{i}_{j}" for j in range(200))).encode() for i in range(3)] + [b"", b" "]
    s, f = fingerprints.signatures(a)
    assert fingerprints.likeness(s[:1], f[:1], s[:1], f[:1])[0] == 1 and fingerprints.likeness(s[:1], f[:1], s[1:2], f[1:2])[0] < 0.1
    assert fingerprints.likeness(s[3:4], f[3:4], s[4:5], f[4:5])[0] == 1 and fingerprints.likeness(s[:1], f[:1], s[4:5], f[4:5])[0] == 0


def test_near_duplicates_are_verified(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[:200 - i])) for i in range(0, 60, 10)] + [(100, "other words " * 9), (101, None), (102, "")]
    got = fingerprints.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    text = dict(rows)
    assert got
    for r in got:
        a, b = shingles(text[r.doc_id]), shingles(text[r.other_id])
        assert r.similarity == pytest.approx(len(a & b) / len(a | b)) and r.similarity >= 0.75


def test_sharding(odd, empty, same, odd_rows):
    for frame, rows in ((odd, odd_rows), (same, [odd_rows[6]] * 50)):
        for shards in (1, 3, 8):
            got = sharding.shard_digest(frame, shards).collect()
            assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
            for s in range(shards):
                assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.shard_digest(empty).count() == 0


def test_shards_are_near_equal(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    sizes = [r[0] for r in sharding.shard_digest(docs).groupBy("shard").sum("size").select("sum(size)").collect()]
    assert len(sizes) == 8 and max(sizes) < 1.01 * min(sizes)


def _mixing_by_hand(rows, epochs=mixing.EPOCHS):
    import re
    taken, leaves = [], {}
    for i, t, lang, source, *_ in rows:
        n = len(re.findall(mixing.WORD, t or ""))
        if n:
            digits = re.search(r"(\d{1,9})$", source or "")
            leaves.setdefault((f"domain{int(digits[1]) % 4 if digits else 0}", lang, source), []).append((i, n))

    def share(children, budget, level):
        """children: name -> supply."""
        weight = lambda k: mixing.WEIGHTS[level].get(k, 1)
        left, open_, got = budget, dict(children), {}
        while True:
            total = sum(map(weight, open_))
            full = [k for k, cap in open_.items() if cap * total <= weight(k) * left]
            if not full:
                break
            k = min(full, key=lambda x: (open_[x] / weight(x), x or ""))
            got[k] = open_.pop(k)
            left -= got[k]
        return got | {k: min(cap, weight(k) * left // sum(map(weight, open_))) for k, cap in open_.items()}

    supply = lambda *at: sum(n for k, v in leaves.items() if k[:len(at)] == at for _, n in v) * epochs
    names = lambda *at: {k[len(at)]: supply(*at, k[len(at)]) for k in leaves if k[:len(at)] == at}
    for d, b1 in share(names(), supply() // epochs, "domain").items():
        for lang, b2 in share(names(d), b1, "lang").items():
            for s, b3 in share(names(d, lang), b2, "source").items():
                docs = leaves[d, lang, s]
                total = sum(n for _, n in docs)
                whole, rest = divmod(b3, total)
                taken += [(i, n, e, n) for i, n in docs for e in range(whole)]
                at = 0
                order = lambda x: (hashlib.md5(f"{mixing.SEED}:{whole}:{'null' if x[0] is None else x[0]}".encode()).hexdigest(), x[0] or 0, x[1])  # noqa: E731, B023
                for i, n in sorted(docs, key=order):
                    if at < rest:
                        taken.append((i, n, whole, min(n, rest - at)))
                    at += n
    return Counter(taken)


def test_mixing(odd, empty, same, odd_rows):
    for frame, rows in ((odd, odd_rows), (same, [odd_rows[6]] * 50)):
        got = mixing.mix(frame).select("row.doc_id", "tokens", "epoch", "take_tokens").collect()
        assert Counter(map(tuple, got)) == _mixing_by_hand(rows)
    assert mixing.mix(empty).count() == 0
    assert mixing.mixed_documents(odd).schema.simpleString() == odd.schema.simpleString()


def test_shortages_go_to_siblings_first(spark):
    leaves = spark.createDataFrame([("domain1", "en", "src1", 10), ("domain1", "en", "src5", 1000), ("domain2", "en", "src2", 1000)],
                                   "domain string, lang string, source string, tokens long")
    got = {r.source: r.budget for r in mixing.budgets(leaves, budget=400, epochs=1).collect()}
    assert got == {"src1": 10, "src5": 190, "src2": 200}


def test_license_scan(spark, odd, empty):
    filler = " ".join(f"word{i}" for i in range(300))
    rows = [(i, f"{filler}\n{t}\n{filler}") for i, t in enumerate(licenses.TEMPLATES.values())]
    changed = licenses.TEMPLATES["MIT"].split()
    changed[30] = "sell"
    rows += [(50, filler), (51, None), (52, " ".join(changed)), (53, " ".join(changed[:25])), (54, licenses.TEMPLATES["BSD"].upper() + " x " + licenses.TEMPLATES["BSD"])]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    names = list(licenses.TEMPLATES)
    found = {(r.doc_id, r.license) for r in got}
    assert {(i, n) for i, n in enumerate(names)} <= found
    assert {d for d, _ in found}.isdisjoint({50, 51, 53}) and (52, "MIT") in found and (54, "BSD") in found
    for i, t in rows:      # every containment is exact
        for r in (r for r in got if r.doc_id == i):
            template = shingles(licenses.TEMPLATES[r.license])
            inside = shingles(" ".join(t.split()[r.first_word:r.end_word]))
            assert r.containment == pytest.approx(len(template & inside) / len(template))
    assert licenses.scan(odd).count() == 0 and licenses.scan(empty).count() == 0
    assert licenses.collision_probability(licenses.SIMILARITY) > 0.999
    with pytest.raises(ValueError):
        licenses.scan(odd, {"short": "two words"})


def test_suffix_dedup(odd, empty, same, odd_rows):
    for frame, rows in ((odd, odd_rows), (same, [odd_rows[6]] * 50)):
        texts = [(r[1] or "").encode() for r in rows]
        want = Counter()
        for r, t, mask in zip(rows, texts, covered(texts)):
            kept = np.frombuffer(t, np.uint8)[~mask].tobytes()
            spans = int((np.diff(np.concatenate(([0], mask.astype(int)))) == 1).sum())
            want[r[0], len(t), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
        assert Counter(map(tuple, suffix_dedup.removed(frame).collect())) == want
    assert suffix_dedup.removed(empty).count() == 0
    kept = suffix_dedup.deduplicated(odd)
    assert kept.schema.simpleString() == odd.schema.simpleString() and kept.count() == len(odd_rows)
    assert kept.where("n_chars <> length(text)").count() == 0


def test_long_texts_are_cut_without_losing_windows(monkeypatch):
    rng = np.random.default_rng(3)
    t = rng.integers(97, 101, 9000, dtype=np.uint8).tobytes()
    whole = suffix_dedup.anchors([t])
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    cut = suffix_dedup.anchors([t])
    at = lambda a: {s: p for f, l, p in zip(a[1].tolist(), a[2].tolist(), a[3].tolist()) for s in range(f, l + 1)}  # noqa: E731, E741
    assert at(whole) == at(cut) and len(at(whole)) == 9000 - 199


def test_jaccard_components(odd, empty, same, odd_rows):
    for frame, rows in ((odd, odd_rows), (same, [odd_rows[6]] * 50)):
        sets = [shingles(r[1]) for r in rows]
        roots = components(sets)
        least = {}
        for r, c in zip(rows, roots):
            if r[0] is not None:
                least[c] = min(least.get(c, r[0]), r[0])
        want = Counter((r[0], len(s), least.get(c) if s else r[0]) for r, s, c in zip(rows, sets, roots))
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_tree.jaccard_components(frame).collect()) == want
        kept = jaccard_tree.keep_one(frame).collect()
        groups = Counter(c for s, c in zip(sets, roots) if s)
        assert len(kept) == len(groups) + sum(not s for s in sets)
    assert jaccard_tree.jaccard_components(empty).count() == 0 and jaccard_tree.keep_one(empty).count() == 0


def test_components_of_many_blocks(spark, monkeypatch):
    import random
    rng = random.Random(2)
    base = [f"b{i}" for i in range(400)]
    rows = []
    for i in range(160):          # near copies of two texts that themselves do not link, and bridges to some of them
        t = list(base) if i % 2 else base[:200] + [f"c{j}" for j in range(200)]
        for j in rng.sample(range(400), rng.choice([1, 5, 20])):
            t[j] = f"r{i}_{j}"
        rows.append((i, " ".join(t)))
    monkeypatch.setattr(jaccard_tree, "BLOCK", 16)
    sets = [shingles(t) for _, t in rows]
    want = components(sets)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_tree.jaccard_components(docs).collect()}
    assert [got[i] for i in range(160)] == want


def test_all_links_without_spanning():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.choice(60, 40, replace=False)).astype(np.uint64) for _ in range(90)]
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    tree = jaccard_tree.Tree([sets[i] for i in order], sizes[order])
    links = jaccard_tree.join_trees(tree, tree, np.arange(90), spanning=False)
    want = {(i, j) for i in range(90) for j in range(i + 1, 90)
            if 100 * (c := len(np.intersect1d(sets[order[i]], sets[order[j]]))) >= 75 * (2 * 40 - c)}
    assert {(a, b) for a, b, _ in links} == want


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7), (200, 150), (150, 170), (None, 3)]
    got = {r.id: r.component for r in spark_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100, 150: 150, 170: 150, 200: 150}
    assert spark_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_packing(odd, empty, same, odd_rows):
    import public_tokenizers
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    for frame, rows in ((odd, odd_rows), (same, [odd_rows[6]] * 50)):
        pieces = packing.packed_sequences(frame).collect()
        wanted = Counter((r[0], tuple(plain.encode(r[1] or "", add_special_tokens=False).ids) + (2,)) for r in rows)
        # pieces of rows with one id and length are told apart by their ids
        have = Counter()
        for (i, ids), n in wanted.items():
            have.update({(i, len(ids)): n})
        covered_ids = Counter()
        for p in pieces:
            covered_ids[p.doc_id, p.doc_tokens] += p.length
            assert len(p.ids) == p.length and any(i == p.doc_id and tuple(p.ids) == ids[p.start:p.start + p.length] for i, ids in wanted)
        assert covered_ids == Counter({k: k[1] * n for k, n in have.items()})
        sequences = {}
        for p in pieces:
            sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
        for parts in sequences.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            assert at <= packing.CAPACITY
        total = sum(p.length for p in pieces)
        assert len(sequences) == math.ceil(total / packing.CAPACITY)
    assert packing.pack_digest(empty).count() == 0


def test_word_tokenizer_equals_tokenizer():
    import random

    import public_tokenizers
    rng = random.Random(1)
    alphabet = ["a", "b", "é", "ß", "Σ", "ς", ".", ",", "!", "***", "|", "<", "'s", "'", "’", "1", "½", " ", "\t", "\n", " ", "́", "日", "<|endoftext|>", "İ", "K", "-", "€", "😀", "A", "\x85"]
    own = packing.WordTokenizer(public_tokenizers.path(packing.TOKENIZER))
    for _ in range(60):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(20)]
        for t, ids in zip(texts, own.encode([t.encode() for t in texts])):
            assert ids.tolist() == own.tokenizer.encode(t, add_special_tokens=False).ids
