import random
from collections import defaultdict

import numpy as np
import pytest

from tests.helpers import column, graph
from weftgraph.operators import kernels
from weftgraph.operators.centrality import betweenness
from weftgraph.operators.traversal import bfs_levels, distances, path, shortest_paths

W = [(1, 2, 5), (1, 3, 2), (3, 2, 1), (2, 4, 1), (3, 4, 9), (5, 6, 1)]


def test_bfs(spark):
    g = graph(spark, W, directed=True)
    got = {(r.source, r.id): r.level for r in bfs_levels(g, spark.createDataFrame([(1,), (3,)], "id long")).collect()}
    assert got == {(1, 1): 0, (1, 2): 1, (1, 3): 1, (1, 4): 2, (3, 3): 0, (3, 2): 1, (3, 4): 1}
    assert {r.id for r in bfs_levels(g, spark.createDataFrame([(1,)], "id long"), vertices="id <> 3", max_level=1).collect()} == {1, 2}


def test_shortest(spark):
    g = graph(spark, W, directed=True)
    assert column(distances(g, "weight", 1), "id", "distance") == [0, 3, 2, 4, None, None]
    assert column(distances(g, "weight", 1, unreached=-1.0), "id", "distance") == [0, 3, 2, 4, -1, -1]
    paths = shortest_paths(g, "weight", spark.createDataFrame([(1,)], "id long"))
    assert column(path(paths, 4), "step", "id") == [1, 3, 2, 4]
    assert column(path(paths, 1), "step", "id") == [1]
    assert path(paths, 6).count() == 0
    assert shortest_paths(g, "weight", spark.createDataFrame([(1,)], "id long"), vertices="id > 1").count() == 0
    zero = graph(spark, [(1, 2, 0), (2, 3, 0), (1, 3, 0), (3, 4, 0)])
    assert column(path(shortest_paths(zero, "weight", spark.createDataFrame([(1,)], "id long")), 4), "step", "id") == [1, 3, 4]
    with pytest.raises(ValueError):
        shortest_paths(graph(spark, [(1, 2, -1)]), "weight", spark.createDataFrame([(1,)], "id long"))


CENTRAL = [
    (False, [(1, 2), (2, 3), (3, 4), (1, 4), (3, 5)], [0.5, 1, 3.5, 1, 0], [2.5, 3.5, 3.5, 2.5, 4]),
    (False, [(1, 2), (1, 3), (2, 3), (2, 4), (3, 4), (4, 5), (5, 6)], [0, 1.5, 1.5, 6, 4, 0], [2.5, 2.5, 1, 4.5, 4.5, 8, 5]),
    (True, [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5)], [0, 1, 1, 3, 0], [2, 2, 3, 3, 4]),
    (False, [(2, 7), (2, 10), (1, 2), (1, 6), (1, 3), (3, 11), (3, 15), (3, 4), (3, 5), (5, 12), (4, 8), (8, 9), (8, 13), (8, 14)], [43, 25, 70, 40, 13, 0, 0, 36, 0, 0, 0, 0, 0, 0, 0], [14, 14, 36, 14, 50, 14, 14, 50, 26, 14, 44, 14, 14, 14]),
]


@pytest.mark.parametrize("directed, edges, vb, eb", CENTRAL)
def test_betweenness(spark, directed, edges, vb, eb):
    v, e = betweenness(graph(spark, edges, directed))
    assert column(v, "id", "betweenness") == pytest.approx(vb)
    assert column(e, "eid", "betweenness") == pytest.approx(eb)


@pytest.mark.parametrize("directed, edges, vb, eb", CENTRAL[:3])
def test_betweenness_by_rounds(spark, directed, edges, vb, eb):
    v, e = betweenness(graph(spark, edges, directed), strategy="bsp")
    assert column(v, "id", "betweenness") == pytest.approx(vb)
    assert column(e, "eid", "betweenness") == pytest.approx(eb)


def test_weighted_and_normalized(spark):
    edges = [(1, 2, 1), (2, 3, 1), (1, 3, 2), (3, 4, 1)]
    for strategy in ("local", "bsp"):
        v, e = betweenness(graph(spark, edges), cost="weight", strategy=strategy)
        assert column(v, "id", "betweenness") == pytest.approx([0, 1, 2, 0])
        assert column(e, "eid", "betweenness") == pytest.approx([2, 3, 1, 3])
    v, e = betweenness(graph(spark, edges), cost="weight", normalized=True)
    assert column(v, "id", "betweenness") == pytest.approx([0, 1 / 3, 2 / 3, 0])
    assert column(e, "eid", "betweenness") == pytest.approx([2 / 6, 3 / 6, 1 / 6, 3 / 6])
    v, e = betweenness(graph(spark, edges), vertices="id <> 2")
    assert column(v, "id", "betweenness") == pytest.approx([0, 1, 0])


@pytest.mark.parametrize("directed", [True, False])
def test_betweenness_by_steps_equals_by_cost(monkeypatch, directed):
    """Sums of batches of sources, loops and parallel edges included, against one source at a time with a heap."""
    rng = random.Random(5)
    for n, m, cells in ((1, 1, 10), (9, 14, 20), (30, 80, 100), (60, 150, 1 << 20)):
        monkeypatch.setattr(kernels, "BATCH_CELLS", cells)
        arcs = [(rng.randrange(n) * 5 - 7, rng.randrange(n) * 5 - 7, 3 * i) for i in range(m)]
        if not directed:
            arcs += [(b, a, e) for a, b, e in arcs]
        by = defaultdict(list)
        for a, b, e in arcs:
            by[a].append((b, e, 1.0))
        g = kernels.Compact(*(np.array(x) for x in zip(*arcs)))
        v, e = kernels.dependencies_by_steps(g, np.arange(len(g.ids)))
        vertices, edges = kernels.dependencies(by, g.ids.tolist())
        assert v == pytest.approx([vertices.get(i, 0) for i in g.ids.tolist()])
        assert e == pytest.approx([edges.get(i, 0) for i in g.eids.tolist()])


def test_betweenness_without_edges(spark):
    v, e = betweenness(graph(spark, [(1, 2)], n=3).remove_edges(spark.createDataFrame([(1,)], "eid long")))
    assert column(v, "id", "betweenness") == [0, 0, 0] and e.count() == 0


@pytest.mark.parametrize("directed", [True, False])
def test_levels_of_several_sources(spark, directed):
    rng = random.Random(8)
    edges = [(rng.randint(1, 40), rng.randint(1, 40)) for _ in range(50)] + [(i, i + 1) for i in range(41, 70)] + [(41, 41)]
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)
        if not directed:
            out[b].add(a)
    want = set()
    for s in (1, 7, 41, 70):
        at, front, level = {s}, {s}, 0
        while front:
            want |= {(s, v, level) for v in front}
            front, level = {b for a in front for b in out[a]} - at, level + 1
            at |= front
    sources = spark.createDataFrame([(1,), (7,), (41,), (70,), (7,)], "id long")
    assert {tuple(r) for r in bfs_levels(graph(spark, edges, directed), sources).collect()} == want
