"""Small documents with every odd case: nulls in each column, empty and long texts, repeated rows, ties, clashing extra columns."""

import random

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, score double, row string, tokens long, "
          "class_id long, part int, size long, shard int, component long")


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    rng = random.Random(5)
    texts = [words(rng, n) for n in (1, 4, 5, 6, 40, 200, 900)]
    passage = words(rng, 70)
    texts += [t + "\n" + passage + "\n" + words(rng, 30) for t in texts[2:6]]
    near = words(rng, 300).split()
    for k in range(6):                                   # a chain of near copies
        texts.append(" ".join(near))
        near[k * 40] = f"x{k}"
    texts += ["", "   \n\t", "é" * 500, "ab " * 400, passage, passage, "Zß—日本 " * 60, words(rng, 20_000)]
    rows = [(i, t, rng.choice(["en", "de", "fr", None]), rng.choice(["src0", "src0", "src3", "odd", None]), len(t)) for i, t in enumerate(texts)]
    rows += [(200, None, "en", "src0", None), (None, texts[5], "en", "src0", 3), (None, None, None, None, None)]
    rows += [rows[4], rows[4], (4, texts[6], "es", "src1", 9)]      # repeated row, repeated id
    return rows


def frame(spark, rows):
    extra = (0.5, "r", 7, 8, 9, 10, 11, 12)
    return spark.createDataFrame([(*r, *extra) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return frame(spark, odd_rows).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def same(spark, odd_rows):
    """One row many times."""
    return frame(spark, [odd_rows[6]] * 50)
