"""Connected components against union-find, with a round's few tasks and with all shuffle partitions."""

import random

import pytest

from touchline.llm import components as stars

_RNG = random.Random(1)
GRAPHS = {
    "empty": [],
    "loops and nulls": [(1, 1), (None, 2)],
    "star": [(7, i) for i in range(-50, 200)],
    "random": [(_RNG.randint(-300, 300), _RNG.randint(-300, 300)) for _ in range(300)],
}


def brute(edges):
    parent = {}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("task_edges, least", [(100_000, 2), (1, 1000)])
@pytest.mark.parametrize("name", GRAPHS)
def test_components(spark, monkeypatch, name, task_edges, least):
    monkeypatch.setattr(stars, "TASK_EDGES", task_edges)
    monkeypatch.setattr(stars, "LEAST_TASKS", least)
    found = [tuple(r) for r in stars.components(spark.createDataFrame(GRAPHS[name], "a long, b long")).collect()]
    assert len(found) == len(set(found)) and dict(found) == brute(GRAPHS[name])
