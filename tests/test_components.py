import random

from callscope.operators.components import connected_components


def plain(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root}


def test_equals_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + k, 1001 + k) for k in range(60)] + [(-5, k) for k in range(2000, 2200)] + [(7000, 7000)]
    out = connected_components(spark.createDataFrame(edges, "x long, y long"))
    assert {r.node: r.component for r in out.collect()} == plain(edges)


def test_empty_and_null(spark):
    assert connected_components(spark.createDataFrame([(None, 1)], "x long, y long")).count() == 0
