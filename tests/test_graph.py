"""Components against a plain union-find."""
import random

import pytest

from shelfline.operators.graph import components


def plain(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in root}


def check(spark, edges, chunk=400_000):
    out = components(spark.createDataFrame(edges, "a long, b long"), chunk=chunk).collect()
    assert len(out) == len({r.node for r in out})
    assert {r.node: r.component for r in out} == plain([(a, b) for a, b in edges if a is not None and b is not None])


def test_long_path_and_hub(spark):
    check(spark, [(i, i + 1) for i in range(150)] + [(500, i) for i in range(501, 560)] + [(7, 7), (900, 900), (None, 3), (500, 501)])


@pytest.mark.parametrize("chunk", [9, 60, 400_000])
def test_random_graph(spark, chunk):
    rng = random.Random(4)
    check(spark, [(rng.randrange(300), rng.randrange(300)) for _ in range(230)], chunk)


def test_path_in_many_chunks(spark):
    check(spark, [(i, i + 1) for i in range(150)], 20)


def test_empty(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
