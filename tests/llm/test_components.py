import random

from tickgraph.llm.components import connected_components
from tickgraph.sources.scratch import Scratch


def test_equals_union_find(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(1000, 1060)] + [(5, k) for k in range(200, 500)] + [(499, k) for k in range(500, 700)]
    edges += [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)] + [(7, 7), (3, 9), (9, 3)]
    rng.shuffle(edges)
    group = {}

    def find(x):
        while group.setdefault(x, x) != x:
            x = group[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        if a != b:
            group[y] = x
    want = {x: find(x) for x in group if any(x in e and e[0] != e[1] for e in edges)}
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test"))
    assert {r["id"]: r["component"] for r in got.collect()} == want
    assert got.count() == len(want)


def test_empty(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test")).collect() == []
