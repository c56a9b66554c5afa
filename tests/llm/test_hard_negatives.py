"""Hard negatives against all inner products in Python integers; the codes' intervals against true products."""

import math
import sys

import numpy as np
import pytest

from touchline.llm import negatives

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<double>, label int, row string, copies long, score double"


def plain(rows):
    """rows: (vec_id, embedding, label, ...)."""
    part = []
    for i, v, label, *_ in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            part.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(max(-sys.float_info.max, min(sys.float_info.max, 256 * x))) for x in v]))
    held = lambda s: max(-2**63, min(2**63 - 1, s))
    dot = lambda a, b: held(sum(x * y for x, y in zip(a, b)))
    out = []
    for a, (i, label, v) in enumerate(part):
        if i % 100:
            continue
        scored = sorted((-dot(v, w), j, l == label) for b, (j, l, w) in enumerate(part) if b != a)
        for s, j, _ in [x for x in scored if x[2]][:5]:
            fit = [(t, n) for t, n, same in scored if not same and 30 * -s <= 100 * -t <= 90 * -s][:10]
            out += [(i, j, r + 1, n, -s, -t) for r, (t, n) in enumerate(fit)]
    return sorted(out)


@pytest.fixture(scope="module")
def odd_vectors():
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)], int(rng.integers(0, 4))) for i in range(260)]
    rows += [(300 + i, [float(x) for x in rng.integers(-2, 3, rng.integers(0, 9)) / 4], 1) for i in range(120)]        # ties, short vectors
    rows += [(400, None, 1), (500, [1.0, None], 1), (600, [float("nan")], 1), (700, [float("inf")], 1), (None, [1.0], 1), (800, [1.0] * 8, None), (900, [], 2)]
    rows += [rows[100], rows[100], (100, [0.5] * 8, 3), (200, [0.5] * 8, 1), (201, [0.5] * 8, 1), (201, [0.5] * 8, 1), rows[50], rows[50]]
    return [(*r, "x", 5, 0.5) for r in rows]


def test_against_all_products(spark, odd_vectors, monkeypatch):
    want = plain(odd_vectors)
    assert len(want) > 100
    table = spark.createDataFrame(odd_vectors, SCHEMA)
    assert sorted(map(tuple, negatives.hard_negatives(table).collect())) == want
    monkeypatch.setattr(negatives, "BLOCK_ANCHORS", 2)                   # a grid of several blocks and shards
    monkeypatch.setattr(negatives, "SHARD_ROWS", 64)
    monkeypatch.setattr(negatives, "SHARD_BYTES", 0)
    assert sorted(map(tuple, negatives.hard_negatives(table).collect())) == want


def test_given_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, [float(x) for x in r.embedding], r.label) for r in table.collect()]
    assert sorted(map(tuple, negatives.hard_negatives(table).collect())) == plain(rows)


def test_hot_label_and_copies(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=5)], 0 if i % 3 else int(i % 10)) for i in range(400)]
    rows += [(300, [1.0, 0.0, 0.0, 0.0, 0.0], 0)] * 40 + [(401, [0.9, 0.0, 0.0, 0.0, 0.0], 5)] * 30
    rows = [(*r, "", 1, 1.0) for r in rows]
    assert sorted(map(tuple, negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA)).collect())) == plain(rows)


def test_empty_and_no_positives(spark):
    assert negatives.hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0
    lone = [(100, [1.0], 1, "", 1, 1.0), (3, [0.5], 2, "", 1, 1.0)]
    assert negatives.hard_negatives(spark.createDataFrame(lone, SCHEMA)).count() == 0


def test_huge_components_end_in_a_result(spark):
    rows = [(100, [1e300, 2.0], 1), (101, [1e300, 1.0], 1), (102, [1e-290, 0.0], 2), (103, [3e10, 1.0], 2), (104, [1e308, -1e308], 2), (200, [2e9, 3.0], 1)]
    got = negatives.hard_negatives(spark.createDataFrame([(*r, "", 1, 1.0) for r in rows], SCHEMA)).collect()
    assert sorted(map(tuple, got)) == plain(rows)


@pytest.mark.parametrize("width", [1, 8, 64, 100])
def test_intervals_hold_every_product(width):
    rng = np.random.default_rng(width)
    v = np.rint(rng.normal(size=(500, width)) * 256)
    q = np.rint(rng.normal(size=width) * 256)
    size = negatives.padded(width)
    m, x = np.zeros((500, size)), np.zeros(size)
    m[:, :width], x[:width] = v, q
    codes, align, rest = negatives.encode(m)
    asked = negatives.Asked(x)
    estimate = slack = np.zeros(500)
    for level in range(negatives.LEVELS):
        s, error = asked.product(level, codes[:, level], size)
        true = rng_product(m, x, level, codes)
        assert (np.abs(s - true) <= error + 1e-6).all()
        estimate, slack = estimate + align[:, level] * s, slack + align[:, level] * error
        bound = rest[:, level] * np.sqrt(np.maximum(asked.square - np.maximum(np.abs(s) - error, 0) ** 2, 0)) + slack
        assert (np.abs(v @ q - estimate) <= bound + 1e-6 * asked.square).all()
    assert np.allclose((align**2).sum(axis=1) + rest[:, -1] ** 2, (v * v).sum(axis=1))
    if width == 64:                      # the last level's interval is a small part of the first's
        assert rest[:, -1].mean() < 0.3 * rest[:, 0].mean()


def rng_product(m, x, level, codes):
    for j in range(level + 1):
        x = negatives.rotated(x[None, :], j)[0]
    signs = np.unpackbits(codes[:, level].view(np.uint8), axis=1).astype(float) * 2 - 1
    return signs @ x / np.sqrt(len(x))
