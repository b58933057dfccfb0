import random

from lexmill.llm.components import components


def brute(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u is not None and v is not None and u != v:
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
    return {(x, root(x)) for x in parent if root(x) != x}


def solve(spark, edges):
    return {(r["id"], r["root"]) for r in components(spark.createDataFrame(edges, "u long, v long").repartition(4)).collect()}


def test_random_graphs_and_long_paths(spark):
    r = random.Random(1)
    path = list(range(200))
    r.shuffle(path)
    edges = [*zip(path, path[1:]), *((1000 + r.randrange(300), 1000 + r.randrange(300)) for _ in range(180)), (5000, 5000), (7, 7), (None, 3), (4, None), (-9, 8000), (8000, -9)]
    assert solve(spark, edges) == brute(edges)


def test_empty(spark):
    assert solve(spark, []) == set()
    assert solve(spark, [(3, 3)]) == set()
