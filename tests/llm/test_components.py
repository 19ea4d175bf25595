import random

from tidemark.llm.components import components


def test_random_graphs_match_union_find(spark):
    source = random.Random(2)
    for nodes, links in ((40, 25), (60, 80), (30, 0)):
        edges = [(source.randrange(nodes), source.randrange(nodes)) for _ in range(links)]
        edges += [(i, i + 1) for i in range(1000, 1040)]  # a path
        group = {}

        def root(x):
            while group.setdefault(x, x) != x:
                x = group[x]
            return x
        for a, b in edges:
            if a != b:
                low, high = sorted((root(a), root(b)))
                group[high] = low
        found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
        assert found == {x: root(x) for x in group}


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
