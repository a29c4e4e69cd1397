"""What keeps large graphs, and graphs that look small, on the right path."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tests.helpers import graph
from tests.test_flow import FLOWS, checked
from weftgraph import PropertyGraph
from weftgraph.operators import components, traversal
from weftgraph.operators.components import completion_labels, strongly_connected_components
from weftgraph.operators.conductance import conductance
from weftgraph.operators.flow import cut_edges, max_flow
from weftgraph.operators.mesh import Mesh
from weftgraph.operators.traversal import distances, shortest_paths
from weftgraph.plans import derived, durable, local, queries
from weftgraph.sources import text, vtu


def test_kernels_get_no_vertex_without_an_edge(spark):
    edges = spark.createDataFrame([(1, 5, 7, 2.0)], "eid long, src long, dst long, weight double")
    many = PropertyGraph(spark.range(0, 200_000), edges, True)
    assert local.on_edges(many.vertices, many.edges).count() == 2
    found = strongly_connected_components(many)
    assert found.count() == 200_000 and found.where("id <> component").isEmpty()
    flow = max_flow(many, 5, 7, "weight")
    assert flow.value == 2 and {r.label: r["count"] for r in flow.labels.groupBy("label").count().collect()} == {1: 1, 2: 1, 3: 199_998}
    net = PropertyGraph(many.vertices.withColumn("bc", F.when(F.col("id") == 5, 1).when(F.col("id").isin(7, 9), 2)), edges, False)
    got = conductance(net, "weight", "bc", 0.0, 3.0)
    assert got.flow == pytest.approx(6) and got.imbalance < 1e-9
    assert {r.id: r.x for r in got.potentials.where("x is not null").collect()} == {5: 0, 7: 3, 9: 3}


@pytest.mark.parametrize("directed", [True, False])
def test_flow_rounds_and_kernel_agree(spark, directed):
    rng = random.Random(2 + directed)
    pairs = rng.sample([(a, b) for a in range(1, 9) for b in range(1, 9) if (a != b if directed else a < b)], 18)
    g = graph(spark, [(a, b, rng.randint(1, 9)) for a, b in pairs], directed, 8)
    flow, plain = max_flow(g, 1, 8, "weight", strategy="bsp"), max_flow(g, 1, 8, "weight")
    assert flow.value == pytest.approx(plain.value)
    checked(g, flow, 1, 8)
    assert sorted(map(tuple, flow.labels.collect())) == sorted(map(tuple, plain.labels.collect()))


def test_cut_edges(spark):
    g = graph(spark, FLOWS["A"][0], True)
    flow = max_flow(g, 1, 6, "weight")
    assert sum(r.weight for r in cut_edges(g, flow.labels).where("src < dst").collect()) >= flow.value
    assert cut_edges(g, g.vertices.select("id", F.lit(3).alias("label"))).isEmpty()


def test_completion_labels(spark):
    edges = [(1, 2), (2, 1), (2, 3), (3, 4), (4, 3), (4, 5), (6, 5), (7, 7)]
    g = graph(spark, edges, True, 8)
    found = strongly_connected_components(g, vertices="id <> 6")
    label = {r.id: r.label for r in completion_labels(g, found, vertices="id <> 6").collect()}
    assert label[6] == 0 and sorted(set(label.values())) == list(range(6))
    assert label[1] == label[2] > label[3] == label[4] > label[5]


def test_paths_to_a_target(spark):
    g = graph(spark, [(1, 2, 1), (2, 3, 1), (1, 3, 5), (3, 4, 0), (4, 5, 1), (5, 6, 1)], True)
    every = {r.id: (r.distance, r.predecessor) for r in shortest_paths(g, "weight", g.vertices.where("id = 1")).collect()}
    found = {r.id: (r.distance, r.predecessor) for r in shortest_paths(g, "weight", g.vertices.where("id = 1"), target=4).collect()}
    assert found == {i: every[i] for i in (1, 2, 3, 4)}
    assert {r.id: r.distance for r in distances(g, "weight", 1, target=2).collect()} == {1: 0, 2: 1, 3: None, 4: None, 5: None, 6: None}
    assert shortest_paths(g, "weight", g.vertices.where("id = 5"), target=1).count() == 2  # out of reach


def test_checks_of_new_edges(spark):
    for directed in (True, False):
        g = graph(spark, [(1, 2), (2, 3)], directed)
        new = lambda *e: spark.createDataFrame([(10 + i, a, b, 1.0) for i, (a, b) in enumerate(e)], "eid long, src long, dst long, weight double")
        assert g.add_edges(new((3, 1)), check=True).edges.count() == 3
        for bad in [[(1, 9)], [(1, 2)], [(3, 1), (3, 1)], *([] if directed else [[(2, 1)], [(3, 3)]])]:
            with pytest.raises(ValueError):
                g.add_edges(new(*bad), check=True)
    assert g.points_per_cell == 2
    assert {r.id: r.found for r in g.index_of(spark.createDataFrame([(1,), (7,)], "id long")).collect()} == {1: True, 7: False}


def test_parallel_edges_are_numbered_apart(spark):
    rows = spark.createDataFrame([(1, 2, "a"), (1, 2, "b"), (2, 3, "c")], "src long, dst long, what string")
    assert sorted((r.eid, r.what) for r in PropertyGraph.from_edges(rows).edges.collect())[2] == (3, "c")
    assert sorted(r.eid for r in PropertyGraph.from_edges(rows).edges.collect()) == [1, 2, 3]


def test_unbalanced_and_unsolved_conductance(spark):
    chain = [(i, i + 1, 10.0**e) for i, e in enumerate((-6, -3, 0, 3, 6), 1)]
    g = graph(spark, chain)
    g = PropertyGraph(g.vertices.withColumn("bc", F.when(F.col("id") == 1, 1).when(F.col("id") == 6, 2)), g.edges)
    for strategy in ("local", "bsp"):
        with pytest.raises(ArithmeticError):
            conductance(g, "weight", "bc", 0.0, 1.0, strategy=strategy)
    tight = conductance(g, "weight", "bc", 0.0, 1.0, rtol_l2=1e-15, rtol_linf=1e-15)
    assert math.isclose(tight.flow, 1 / sum(10.0**-e for e in (-6, -3, 0, 3, 6)), rel_tol=1e-3)


def test_lines_and_blocks(spark, tmp_path):
    (tmp_path / "t.txt").write_text("a\nb\n\nc\n\n\nd\n")
    path = str(tmp_path / "t.txt")
    assert text.count_lines(spark, path) == 7
    assert sorted(map(tuple, text.count_lines_block(spark, path).collect())) == [(1, 2), (2, 1), (3, 0), (4, 1)]


def test_one_file_at_a_time(spark, tmp_path):
    g = graph(spark, [(1, 2)])
    g = PropertyGraph(g.vertices.select("id", *(F.col("id").cast("double").alias(c) for c in "xyz")), g.edges)
    for name in ("a", "b"):
        vtu.write_graph(g, str(tmp_path / name))
    with pytest.raises(ValueError):
        vtu.read_graph(spark, str(tmp_path))
    mesh = Mesh(spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 1.0, 0.0, 0.0), (3, 0.0, 1.0, 0.0)], "id long, x double, y double, z double"), spark.createDataFrame([(1, [1, 2, 3])], "id long, point_ids array<long>"))
    assert mesh.describe().count() == 1


def watch(monkeypatch, *modules):
    """What the modules write from now on: (label, optimized plan)."""
    seen, write = [], durable.durable

    def noted(df, label="step"):
        seen.append((label, df._jdf.queryExecution().optimizedPlan().toString()))
        return write(df, label)

    for m in modules:
        monkeypatch.setattr(m, "durable", noted)
    return seen


def test_levels_make_the_edges_distinct_once(spark, monkeypatch):
    seen = watch(monkeypatch, derived, traversal)
    g = graph(spark, [(1, 2), (1, 2), (2, 1), (2, 3), (3, 4), (5, 6)])
    found = traversal.bfs_levels(g, spark.createDataFrame([(1,), (1,), (5,), (99,)], "id long"))
    assert sorted(map(tuple, found.collect())) == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (1, 4, 3), (5, 5, 0), (5, 6, 1)]
    assert [plan for label, plan in seen if label == "arcs" and "Aggregate" in plan] == []
    del seen[:]
    queries.bfs_levels_bipartite(spark, "/root/testdata/sf0.001")
    assert [label for label, plan in seen if "l_partkey" in plan] == ["pairs"]


def test_completion_labels_join_the_line_items_once(spark, monkeypatch):
    seen = watch(monkeypatch, derived, components)
    found = queries.completion_labels(spark, "/root/testdata/sf0.001")
    assert [label for label, plan in seen if "l_quantity" in plan] == ["nations"]
    assert "l_quantity" not in found._jdf.queryExecution().optimizedPlan().toString() and found.count() == 25


def test_masked_components_read_the_edges_once_and_join_no_vertices(spark, monkeypatch):
    seen = watch(monkeypatch, derived, components)
    queries.connected_components_masked(spark, "/root/testdata/sf0.001")
    assert [label for label, plan in seen if "l_partkey" in plan] == ["pairs"]
    assert [plan for label, plan in seen if label == "links" and "LeftSemi" in plan] == []
    rng = random.Random(5)
    pairs = [(rng.randint(1, 60), rng.randint(1, 60)) for _ in range(55)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate([*pairs, *pairs[:9]])], "eid long, src long, dst long")
    g = PropertyGraph.from_edges(rows)
    for masked in ("id % 4 <> 0", "id % 4 <> 0 and p <> 3", F.col("id") % 4 != 0, None):
        shown = PropertyGraph(g.vertices.withColumn("p", F.col("id") % 7), g.edges, False, True)
        kept = {r.id for r in (shown.vertices if masked is None else shown.vertices.where(masked)).collect()}
        least = {v: v for v in kept}
        for _ in kept:
            for a, b in pairs:
                if a in kept and b in kept:
                    least[a] = least[b] = min(least[a], least[b])
        order = {c: k for k, c in enumerate(sorted(set(least.values())), 1)}
        found = components.connected_components(shown, vertices=masked).collect()
        assert sorted(map(tuple, found)) == sorted((v, order[least[v]] if v in kept else 0) for v in {e for p in pairs for e in p})
