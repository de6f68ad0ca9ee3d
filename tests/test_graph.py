import random

from repolith.operators import graph


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def starts(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "start long")


def test_chain_and_cap(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 4), (3, 4), (None, 1)])
    assert sorted(map(tuple, graph.reach(e, starts(spark, [1]), 2).collect())) == [(1, 2, 1), (1, 3, 2)]
    back = graph.reversed_edges(e)
    assert {r.node for r in graph.reach(back, starts(spark, [4]), 1).collect()} == {3}


def test_modes(spark):
    e = edges(spark, [(1, 2), (2, 1), (2, 3)])
    get = lambda m: sorted(map(tuple, graph.layers(e, starts(spark, [1]), 2, m).collect()))
    assert get("first") == [(0, 1), (1, 2), (2, 3)]
    assert get("cumulative") == [(0, 1), (1, 2), (2, 1), (2, 2), (2, 3)]
    assert get("layered") == [(0, 1), (1, 2), (2, 1), (2, 3)]


def test_components_like_brute_force(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(18), rng.randrange(18)) for _ in range(30)]
    reach = {(a, b) for a, b in pairs}
    while True:
        more = reach | {(a, d) for a, b in reach for c, d in reach if b == c}
        if more == reach:
            break
        reach = more
    want = {(a, max(b for b in range(18) if (a, b) in reach and (b, a) in reach)) for a in range(18) if (a, a) in reach}
    assert {tuple(r) for r in graph.strong_components(edges(spark, pairs)).collect()} == want


def test_depth_and_paths(spark):
    n = spark.createDataFrame([(i,) for i in range(1, 6)], "id long")
    e = edges(spark, [(1, 2), (2, 3), (1, 3), (4, 4)])
    assert dict(map(tuple, graph.depth_from_roots(n, e).collect())) == {1: 0, 2: 1, 3: 1, 4: 0, 5: 0}
    x = spark.createDataFrame([(3,)], "node long")
    assert [tuple(r) for r in graph.traced_paths(e, starts(spark, [1, 5]), x).collect()] == [(1, [1, 3])]


def test_empty(spark):
    e = edges(spark, [])
    assert graph.reach(e, starts(spark, [1]), 3).count() == 0
    assert graph.strong_components(e).count() == 0


def test_no_limit_of_depth_or_rounds(spark):
    """A chain of 100 has depth 100; cycles that come one after another are all found."""
    n = 100
    chain = [(i, i + 1) for i in range(n)]
    nodes = spark.createDataFrame([(i,) for i in range(n + 1)], "id long")
    assert {(r.id, r.depth) for r in graph.depth_from_roots(nodes, edges(spark, chain)).collect()} == {(i, i) for i in range(n + 1)}
    # ten pairs, each leading to the next by a chain of nine
    rows = [e for k in range(0, 100, 10) for e in [(k, k + 1), (k + 1, k), *[(k + j, k + j + 1) for j in range(1, 10)]]]
    assert {(r.node, r.component) for r in graph.strong_components(edges(spark, rows)).collect()} == {(k + j, k + 1) for k in range(0, 100, 10) for j in (0, 1)}
