import random

from careledger.llm.components import components


def brute(edges):
    parent = {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is None or b is None or a == b:
            continue
        parent.setdefault(a, a)
        parent.setdefault(b, b)
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_like_union_find(spark):
    draw = random.Random(5)
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(500, i) for i in range(200, 260)]
    sparse = [(draw.randrange(1000, 1200), draw.randrange(1000, 1200)) for _ in range(120)]
    edges = [*chain, *star, *sparse, (1, 1), (None, 2), (7, 8), (7, 8), (8, 7)]
    found = components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {r.node: r.component for r in found} == brute(edges)
    assert len(found) == len(brute(edges))


def test_texts_and_no_edges(spark):
    found = components(spark.createDataFrame([("b", "a"), ("c", "b")], "x string, y string"), "x", "y")
    assert {(r.node, r.component) for r in found.collect()} == {("a", "a"), ("b", "a"), ("c", "a")}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
