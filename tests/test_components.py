import random

import pytest

from tests.helpers import column, graph, partition
from weftgraph.operators.components import connected_components, min_reachable, strongly_connected_components, topological_levels, verify_topological_levels

DIGRAPH = [(1, 2), (2, 7), (7, 1), (2, 3), (5, 3), (6, 4)]


def test_weak_labels_and_mask(spark):
    g = graph(spark, DIGRAPH, directed=True)
    assert column(connected_components(g), "id", "label") == [1, 1, 1, 2, 1, 2, 1]
    assert column(connected_components(g, vertices="id <> 3"), "id", "label") == [1, 1, 0, 2, 3, 2, 1]


def test_long_path_and_random(spark):
    links = spark.range(400).selectExpr("id + 1 as src", "id as dst")
    assert {r.component for r in min_reachable(links).collect()} == {0}
    random.seed(2)
    pairs = [(random.randrange(200), random.randrange(200)) for _ in range(130)]
    root = list(range(200))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.id: r.component for r in min_reachable(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == {x: find(x) for p in pairs for x in p}


SCC = {
    "chain": ([(1, 2), (2, 3), (3, 4), (4, 5), (5, 6)], [[1], [2], [3], [4], [5], [6]], [1, 2, 3, 4, 5, 6]),
    "cycle": ([(1, 2), (2, 3), (3, 4), (4, 5), (5, 1)], [[1, 2, 3, 4, 5]], [1] * 5),
    "two": ([(1, 2), (2, 1), (2, 3), (3, 4), (4, 3)], [[1, 2], [3, 4]], [1, 1, 2, 2]),
    "diamond": ([(1, 2), (1, 3), (2, 4), (3, 4)], [[1], [2], [3], [4]], [1, 2, 2, 3]),
    "three": ([(1, 2), (2, 1), (2, 3), (3, 4), (4, 3), (4, 5), (5, 6), (6, 5)], [[1, 2], [3, 4], [5, 6]], [1, 1, 2, 2, 3, 3]),
    "apart": ([(3, 4), (4, 3)], [[1], [2], [3, 4]], [1, 1, 1, 1]),
    "case 1": ([(5, 4), (4, 1), (1, 6), (1, 2), (2, 3), (3, 4)], [[1, 2, 3, 4], [5], [6]], [2, 2, 2, 2, 1, 3]),
    "case 2": ([(1, 2), (3, 2), (3, 4), (2, 4)], [[1], [2], [3], [4]], [1, 2, 1, 3]),
    "case 3": ([(1, 2), (3, 1), (4, 3), (2, 4), (5, 6), (6, 5)], [[1, 2, 3, 4], [5, 6]], [1] * 6),
    "both ways": ([(1, 2), (1, 3), (2, 3), (3, 2)], [[1], [2, 3]], [1, 2, 2]),
}


@pytest.mark.parametrize("name", SCC)
def test_strong_components_and_levels(spark, name):
    edges, groups, levels = SCC[name]
    g = graph(spark, edges, directed=True)
    found = strongly_connected_components(g)
    assert partition(found) == groups
    assert all(r.component == min(m) for r in found.collect() for m in groups if r.id in m)
    got = topological_levels(g, found)
    assert column(got, "id", "level") == levels
    assert verify_topological_levels(g, got, found)
    assert not verify_topological_levels(g, got.selectExpr("id", "5 - level as level"), found) or max(levels) == 1


@pytest.mark.parametrize("name", ["two", "case 1", "both ways"])
def test_strong_components_by_rounds(spark, name):
    edges, groups, _ = SCC[name]
    assert partition(strongly_connected_components(graph(spark, edges, directed=True), strategy="bsp")) == groups


def test_cycles_and_direction(spark):
    with pytest.raises(ValueError):
        topological_levels(graph(spark, [(1, 2), (2, 1)], directed=True))
    with pytest.raises(ValueError):
        strongly_connected_components(graph(spark, [(1, 2)]))
    loop = graph(spark, [(1, 1), (1, 2)], directed=True)
    assert column(topological_levels(loop), "id", "level") == [1, 2]
    assert column(topological_levels(loop, vertices="id = 2"), "id", "level") == [0, 1]


def test_empty(spark):
    g = graph(spark, [], directed=True)
    assert connected_components(g).count() == strongly_connected_components(g).count() == topological_levels(g).count() == 0
    one = graph(spark, [], directed=True, n=1)
    assert column(connected_components(one), "id", "label") == [1]
    assert column(strongly_connected_components(one), "id", "component") == [1]
