import pytest
from pyspark.sql import functions as F

from tests.helpers import column, graph
from weftgraph.operators.conductance import conductance
from weftgraph.operators.flow import max_flow, min_cut

FLOWS = {
    "A": ([(1, 2, 5), (1, 3, 4), (3, 2, 3), (2, 4, 4), (3, 5, 3), (4, 5, 1), (4, 6, 2), (5, 6, 8)], 6, 6),
    "B": ([(1, 2, 7), (1, 3, 4), (3, 2, 3), (2, 4, 5), (2, 5, 3), (3, 5, 2), (5, 4, 3), (5, 6, 5), (4, 6, 8)], 10, 10),
    "C": ([(1, 2, 10), (3, 2, 5), (3, 4, 11), (1, 3, 2)], 2, 7),
    "D": ([(1, 2, 10), (1, 3, 10), (2, 3, 2), (2, 4, 4), (2, 5, 8), (3, 5, 9), (4, 5, 6), (4, 6, 10), (5, 6, 10)], 14, 20),
}


def checked(g, flow, source, sink):
    edges = {r.eid: r for r in g.edges.collect()}
    flows = {r.eid: r.flow for r in flow.flows.collect()}
    labels = {r.id: r.label for r in flow.labels.collect()}
    net = dict.fromkeys(labels, 0.0)
    for eid, f in flows.items():
        e = edges[eid]
        assert (-1e-9 if g.directed else -e.weight - 1e-9) <= f <= e.weight + 1e-9
        net[e.src] -= f
        net[e.dst] += f
    assert net[sink] == pytest.approx(flow.value) == -net[source]
    assert all(abs(x) < 1e-9 for v, x in net.items() if v not in (source, sink))
    across = sum(abs(f) for eid, f in flows.items() if {labels[edges[eid].src], labels[edges[eid].dst]} == {1, 2})
    assert across == pytest.approx(flow.value)
    assert labels[source] == 1 and labels[sink] != 1


@pytest.mark.parametrize("name", FLOWS)
@pytest.mark.parametrize("directed", [True, False])
def test_max_flow(spark, name, directed):
    edges, one_way, both = FLOWS[name]
    g = graph(spark, edges, directed)
    sink = max(e[1] for e in edges)
    flow = max_flow(g, 1, sink, "weight")
    assert flow.value == pytest.approx(one_way if directed else both)
    checked(g, flow, 1, sink)


def test_max_flow_by_rounds(spark):
    for directed, value in ((True, 2), (False, 7)):
        g = graph(spark, FLOWS["C"][0], directed)
        flow = max_flow(g, 1, 4, "weight", strategy="bsp")
        assert flow.value == pytest.approx(value)
        checked(g, flow, 1, 4)


def test_terminals(spark):
    g = graph(spark, [(1, 3, 2), (2, 3, 3), (3, 4, 4), (3, 5, 9), (4, 1, 1), (6, 7, 1)], True)
    flow = max_flow(g, [1, 2], [4, 5], "weight")
    assert flow.value == pytest.approx(5)
    assert column(flow.labels, "id", "label") == [1, 1, 2, 2, 2, 3, 3]
    closed = max_flow(g, [1, 2], [4, 5], "weight", vertices="id <> 2")
    assert closed.value == pytest.approx(2) and column(closed.labels, "id", "label")[1] == 0
    anti = graph(spark, [(1, 2, 3), (2, 1, 5), (2, 2, 4), (2, 3, 2)], True)
    assert max_flow(anti, 1, 3, "weight").value == pytest.approx(2)
    for bad in (lambda: max_flow(g, 1, 1, "weight"), lambda: max_flow(g, [1, 1], [4], "weight"), lambda: max_flow(g, 1, 4, "weight", vertices="id <> 1")):
        with pytest.raises(ValueError):
            bad()


CUTS = {
    "apart": ([(1, 2, 1), (3, 4, 1)], 0, [[1, 2], [3, 4]]),
    "pair": ([(1, 2, 5)], 5, [[1], [2]]),
    "cycle": ([(1, 2, 0.98), (2, 3, 1), (3, 4, 0.99), (4, 1, 1)], 1.97, [[1, 4], [2, 3]]),
    "bridge": ([(1, 2, 10), (1, 3, 10), (2, 3, 10), (4, 5, 10), (4, 6, 10), (5, 6, 10), (3, 4, 2.1)], 2.1, [[1, 2, 3], [4, 5, 6]]),
    "loops": ([(1, 2, 10), (2, 3, 10), (3, 4, 10), (4, 1, 10), (5, 6, 10), (6, 7, 10), (7, 5, 10), (2, 5, 1), (4, 7, 1)], 2, [[1, 2, 3, 4], [5, 6, 7]]),
    "triangle": ([(1, 2, 1), (2, 3, 10), (3, 1, 100)], 11, [[1, 3], [2]]),
    "K6": ([(1, 2, 1.01), (1, 3, 1.021), (1, 4, 1.03), (1, 5, 1.041), (1, 6, 1.05), (2, 3, 1.5), (2, 4, 1.5), (2, 5, 1.5), (2, 6, 1.5), (3, 4, 1.5), (3, 5, 1.7), (3, 6, 1.8), (4, 5, 1.3), (4, 6, 1.4), (5, 6, 1.6)], 5.152, [[1], [2, 3, 4, 5, 6]]),
    "star": ([(1, 2, 1), (1, 3, 1), (1, 4, 0.9), (1, 5, 1), (1, 6, 1)], 0.9, [[1, 2, 3, 5, 6], [4]]),
    "no weight": ([(1, 2, 0), (2, 3, 4)], 0, [[1], [2, 3]]),
}


@pytest.mark.parametrize("name", CUTS)
def test_min_cut(spark, name):
    edges, value, sides = CUTS[name]
    cut = min_cut(graph(spark, edges), "weight")
    assert cut.value == pytest.approx(value)
    got = {1: [], 2: []}
    for r in cut.labels.orderBy("id").collect():
        got[r.label].append(r.id)
    assert sorted(got.values()) == sides


def test_min_cut_limits(spark):
    with pytest.raises(ValueError):
        min_cut(graph(spark, [], n=1), "weight")
    assert min_cut(graph(spark, [], n=3), "weight").value == 0


@pytest.mark.parametrize("name, limit", [("loops", 0), ("K6", 0), ("triangle", 1)])
def test_min_cut_by_contraction(spark, name, limit):
    edges, value, sides = CUTS[name]
    cut = min_cut(graph(spark, edges), "weight", limit=limit)
    assert cut.value == pytest.approx(value)
    got = {1: [], 2: []}
    for r in cut.labels.collect():
        got[r.label].append(r.id)
    assert sorted(map(sorted, got.values())) == sides


NET = [(1, 2, 1), (1, 3, 2), (2, 4, 0.5), (3, 5, 1.5), (4, 6, 0.1), (5, 6, 4)]


@pytest.mark.parametrize("strategy", ["local", "bsp"])
def test_conductance(spark, strategy):
    g = graph(spark, [*NET, (7, 8, 3)])
    g = type(g)(g.vertices.withColumn("bc", F.when(F.col("id") == 1, 2).when(F.col("id") == 6, 1).otherwise(0)), g.edges)
    got = conductance(g, "weight", "bc", 0.0, 100.0, strategy=strategy)
    assert got.flow == pytest.approx(100 * (1 / 13 + 12 / 17))
    assert got.conductance == pytest.approx(1 / 13 + 12 / 17)
    x = column(got.potentials, "id", "x")
    assert x[0] == 100 and x[5] == 0 and x[6] is None and x[7] is None
    flows = column(got.flows, "eid", "flow")
    assert flows[0] == pytest.approx(100 / 13) and flows[6] == 0
    assert max_flow(g, 1, 6, "weight").value == pytest.approx(1.6)


def test_conductance_of_boundaries_alone(spark):
    g = graph(spark, [(1, 2, 3)])
    g = type(g)(g.vertices.withColumn("bc", F.col("id").cast("int")), g.edges)
    assert conductance(g, "weight", "bc", 0.0, 2.0).flow == pytest.approx(6)
