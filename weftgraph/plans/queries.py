"""The graph operators on graphs derived from the tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.numeric import compared, count_matches, cross, dot, mean_variance, near, unique_sorted
from weftgraph.functions.strings import split_all, split_nonempty, to_int, to_long
from weftgraph.operators import centrality, components, conductance, flow, traversal
from weftgraph.operators.graph import PropertyGraph
from weftgraph.operators.mesh import Mesh
from weftgraph.plans import derived
from weftgraph.plans.derived import SUPPLIER_BASE, table
from weftgraph.plans.durable import shared_dir
from weftgraph.sources import text, vtu


def g_vertices(spark, sf):
    return derived.part_supplier(spark, sf).vertices.select("id")


def g_edges(spark, sf):
    return derived.part_supplier(spark, sf).edges.select("src", "dst")


def degrees(spark, sf):
    return derived.part_supplier(spark, sf).degrees()


def neighbours(spark, sf):
    return derived.part_supplier(spark, sf).neighbours().select("id", F.array_join("neighbours", ",").alias("neighbours"), F.size("outgoing").alias("n_outgoing"))


def subgraph_edges(spark, sf):
    g = derived.part_supplier(spark, sf)
    return g.subgraph("id % 3 = 0", "src % 2 = 0 or dst % 2 = 0").edges.select("src", "dst")


def select_vertices(spark, sf):
    return derived.part_supplier(spark, sf).select_vertices("id % 7 = 0")


def select_edges(spark, sf):
    return derived.part_supplier(spark, sf).select_edges("src % 7 = 0")


def remove_vertices(spark, sf):
    g = derived.nations(spark, sf, directed=True)
    return g.remove_vertices(g.vertices.where("region = 1")).edges.select("src", "dst")


def remove_orphaned_edges(spark, sf):
    g = derived.nations(spark, sf, directed=True)
    return g.remove_vertices(g.vertices.where("region = 1")).remove_orphaned_edges()[0].edges.select("src", "dst")


def orphan_edges(spark, sf):
    g = derived.nations(spark, sf, directed=True)
    return g.remove_vertices(g.vertices.where("region = 1")).orphaned_edges().select("src", "dst")


def remove_edges(spark, sf):
    g = derived.part_supplier(spark, sf)
    return g.remove_edges(g.edges.where("src % 2 = 1")).edges.select("src", "dst")


def add_edges(spark, sf):
    g = derived.nations(spark, sf, directed=True)
    more = g.vertices.where("id < 24").select((F.col("id") + 100000).alias("eid"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1.0).alias("weight"))
    return g.add_edges(more).duplicate_edges().select("a", "b", "n_edges")


def add_vertices(spark, sf):
    g = derived.nations(spark, sf, directed=True)
    return g.add_vertices(g.vertices.select((F.col("id") + 100).alias("id"))).vertices.select("id", "region")


def index_of(spark, sf):
    g = derived.nations(spark, sf, directed=True)
    return g.index_of(g.vertices.select((F.col("id") * 2).alias("id")))


def duplicate_edges(spark, sf):
    line = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + SUPPLIER_BASE).alias("dst"), F.lit(0).cast("long").alias("eid"))
    return PropertyGraph.from_edges(line).duplicate_edges()


def copy_renumbered(spark, sf):
    part, vertices, _ = derived.part_supplier(spark, sf).copy(edges="src % 2 = 0")
    return part.edges.select("eid", "src", "dst")


def find_edges(spark, sf):
    g = derived.nations(spark, sf, directed=True)
    pairs = g.vertices.select(F.col("id").alias("a"), ((F.col("id") * 7 + 3) % 25).alias("b"))
    return g.find_edges(pairs).select("a", "b", "eid")


def other_ends(spark, sf):
    g = derived.part_supplier(spark, sf)
    return g.other_ends(g.edges.select("eid", F.col("dst").alias("id"))).select("eid", "other")


def bfs_levels(spark, sf):
    g = derived.nations(spark, sf, directed=True)
    return traversal.bfs_levels(g, g.vertices).select("source", "id", "level")


def bfs_levels_bipartite(spark, sf):
    g = derived.part_supplier(spark, sf, held=True)
    return traversal.bfs_levels(g, spark.createDataFrame([(1,)], "id long")).select("id", "level")


def sssp_distance(spark, sf):
    return traversal.distances(derived.nations(spark, sf, directed=True), "weight", 0)


def sssp_to_target(spark, sf):
    """Distances no longer than the one to nation 6."""
    return traversal.distances(derived.nations(spark, sf, directed=True), "weight", 0, target=6)


def sssp_path(spark, sf):
    g = derived.nations(spark, sf, directed=True)
    paths = traversal.shortest_paths(g, "weight", g.vertices.where("id = 0"))
    return traversal.path(paths, 6).select("step", "distance")


def connected_components(spark, sf):
    return components.connected_components(derived.part_supplier(spark, sf, held=True))


def connected_components_masked(spark, sf):
    return components.connected_components(derived.part_supplier(spark, sf, held=True), vertices="id % 5 <> 0")


def component_sizes(spark, sf):
    return components.connected_components(derived.part_supplier(spark, sf, held=True)).groupBy("label").agg(F.count("*").alias("n"))


def weak_components_directed(spark, sf):
    return components.connected_components(derived.users(spark, sf))


def strong_components(spark, sf):
    return components.strongly_connected_components(derived.nations(spark, sf, directed=True))


def strong_components_users(spark, sf):
    return components.strongly_connected_components(derived.users(spark, sf))


def completion_labels(spark, sf):
    g = derived.nations(spark, sf, directed=True)
    return components.completion_labels(g, components.strongly_connected_components(g))


def topological_levels(spark, sf):
    return components.topological_levels(derived.conversation_turns(spark, sf))


def topological_levels_contracted(spark, sf):
    g = derived.nations(spark, sf, directed=True)
    return components.topological_levels(g, components.strongly_connected_components(g))


def level_violations(spark, sf):
    g = derived.nations(spark, sf, directed=True)
    return components.level_violations(g, g.vertices.select("id", (F.col("id") + 1).alias("level"))).where("kind = 'order'").select("id", "other")


def betweenness_vertices(spark, sf):
    return centrality.betweenness(derived.nations(spark, sf, directed=False))[0].select("id", F.round("betweenness", 6).alias("betweenness"))


def betweenness_edges(spark, sf):
    return centrality.betweenness(derived.nations(spark, sf, directed=True))[1].select("eid", F.round("betweenness", 6).alias("betweenness"))


def betweenness_normalized(spark, sf):
    return centrality.betweenness(derived.nations(spark, sf, directed=True), normalized=True)[0].select("id", F.round("betweenness", 6).alias("betweenness"))


def betweenness_weighted(spark, sf):
    return centrality.betweenness(derived.nations(spark, sf, directed=True), cost="weight")[0].select("id", F.round("betweenness", 6).alias("betweenness"))


def _value(spark: SparkSession, x: float) -> DataFrame:
    return spark.createDataFrame([(round(float(x), 6),)], "value double")


def maxflow_value(spark, sf):
    return _value(spark, flow.max_flow(derived.nations(spark, sf, directed=True), 2, 11, "weight").value)


def maxflow_value_undirected(spark, sf):
    return _value(spark, flow.max_flow(derived.nations(spark, sf, directed=False), 2, 6, "weight").value)


def cut_labels(spark, sf):
    return flow.max_flow(derived.nations(spark, sf, directed=False), 2, 6, "weight").labels


def maxflow_multiple(spark, sf):
    return _value(spark, flow.max_flow(derived.nations(spark, sf, directed=True), [0, 1], [11, 12], "weight").value)


def mincut_value(spark, sf):
    return _value(spark, flow.min_cut(derived.nations(spark, sf, directed=False), "weight").value)


def maxflow_rounds(spark, sf):
    return _value(spark, flow.max_flow(derived.nations(spark, sf, directed=True), 2, 11, "weight", strategy="bsp").value)


def mincut_rounds(spark, sf):
    return _value(spark, flow.min_cut(derived.nations(spark, sf, directed=False), "weight", limit=0).value)


def strong_components_rounds(spark, sf):
    return components.strongly_connected_components(derived.nations(spark, sf, directed=True), strategy="bsp")


def betweenness_rounds(spark, sf):
    return centrality.betweenness(derived.nations(spark, sf, directed=True), strategy="bsp")[1].select("eid", F.round("betweenness", 6).alias("betweenness"))


def vtu_round_trip(spark, sf):
    """The nation graph written to a file and read back: ids are places from 1."""
    fields = [vtu.FieldSpec("region", ("region",), "Int32", "point"), vtu.FieldSpec("weight", ("weight",), "Float64", "cell")]
    g = derived.nations(spark, sf, directed=True)
    path = f"{shared_dir(spark)}/nations-{uuid.uuid4().hex}.vtu"
    vtu.write_graph(PropertyGraph(g.vertices.select("*", *(F.col("id").cast("double").alias(c) for c in "xyz")), g.edges, True), path, fields=fields)
    back = vtu.read_graph(spark, path, fields, directed=True)
    ends = back.vertices.select(F.col("id").alias("src"), F.col("x").cast("long").alias("place"), "region")
    return back.edges.join(ends, "src").select("eid", "src", "dst", "weight", "place", F.col("region").cast("long").alias("region"))


def vtu_mesh_round_trip(spark, sf):
    """The customers' mesh written to a file and read back."""
    path = f"{shared_dir(spark)}/customers-{uuid.uuid4().hex}.vtu"
    vtu.write_mesh(_mesh(spark, sf), path, [vtu.FieldSpec("height", ("y",), "Float64", "point"), vtu.FieldSpec("number", ("id",), "Int64", "cell")])
    back = vtu.read_mesh(spark, path, [vtu.FieldSpec("height", ("height",), "Float64", "point"), vtu.FieldSpec("number", ("number",), "Int64", "cell")])
    spots = back.points.select(F.col("id").alias("point"), F.concat_ws("/", F.col("x").cast("int"), F.col("height").cast("int")).alias("spot"))
    corner = back.cells.select("id", "number", F.posexplode("point_ids").alias("k", "point")).join(spots, "point")
    return corner.groupBy("id", "number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "spot"))), lambda c: c["spot"]), ",").alias("corners"))


def _written(lines: DataFrame, order: list[str]) -> str:
    """The path of one text file with the ``value`` of the lines in order."""
    path = f"{shared_dir(lines.sparkSession)}/lines-{uuid.uuid4().hex}"
    lines.repartition(1).sortWithinPartitions(*order).select("value").write.text(path)
    return path


def numbers_round_trip(spark, sf):
    lines = table(spark, sf, "nation").select("n_nationkey", F.concat(F.lit(" "), F.when(F.col("n_nationkey") == 3, "three").otherwise((F.col("n_nationkey") * -1000003).cast("string"))).alias("value"))
    return text.read_numbers(spark, _written(lines, ["n_nationkey"])).select(F.col("line").cast("long").alias("line"), "value")


def pattern_round_trip(spark, sf):
    lines = table(spark, sf, "nation").select("n_nationkey", F.lpad(F.col("n_nationkey").cast("string"), 4, ".").alias("value"))
    return text.read_pattern(spark, _written(lines, ["n_nationkey"])).select(F.col("row").cast("long").alias("row"), F.col("column").cast("long").alias("column"), "value")


def line_blocks(spark, sf):
    """Nations of each region, a blank line after every region."""
    regions = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_append(F.collect_list("n_name"), F.lit("")).alias("names"))
    path = _written(regions.select("n_regionkey", F.posexplode("names").alias("k", "value")), ["n_regionkey", "k"])
    return text.count_lines_block(spark, path).withColumn("all_lines", F.lit(text.count_lines(spark, path)).cast("long"))


def text_round_trip(spark, sf):
    """Names of nations written a line each and read back."""
    path = f"{shared_dir(spark)}/names-{uuid.uuid4().hex}"
    table(spark, sf, "nation").orderBy("n_nationkey").coalesce(1).select("n_name").write.text(path)
    return text.read_strings(spark, path).select(F.col("line").cast("long").alias("line"), "value")


def _network(spark: SparkSession, sf: str, strategy: str = "auto") -> conductance.Conductance:
    g = derived.nations(spark, sf, directed=False)
    g = PropertyGraph(g.vertices.withColumn("bc", F.when(F.col("id") == 0, 2).when(F.col("id") == 24, 1).otherwise(0)), g.edges)
    return conductance.conductance(g, "weight", "bc", 0.0, 1.0, rtol_l2=1e-13, rtol_linf=1e-13, strategy=strategy)


def conductance_flow(spark, sf):
    return spark.createDataFrame([(round(_network(spark, sf).flow, 6),)], "value double")


def conductance_rounds(spark, sf):
    return spark.createDataFrame([(round(_network(spark, sf, "bsp").flow, 6),)], "value double")


def conductance_potentials(spark, sf):
    return _network(spark, sf).potentials.select("id", F.round("x", 9).alias("x"))


def conductance_edge_flow(spark, sf):
    return _network(spark, sf).flows.select("eid", F.round("flow", 6).alias("flow"))


def _mesh(spark: SparkSession, sf: str) -> Mesh:
    """A triangle for each customer: three points of a grid around the customer's number."""
    side = 40
    key = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    x, y = F.expr(f"k div 2 % {side}"), F.expr(f"k div 2 div {side}")
    corner = lambda dx, dy: ((y + dy) * (side + 1) + x + dx).cast("long")
    cells = key.select(F.col("k").alias("id"), F.when(F.col("k") % 2 == 0, F.array(corner(0, 0), corner(1, 0), corner(0, 1))).otherwise(F.array(corner(1, 1), corner(1, 0), corner(0, 1))).alias("point_ids"))
    ids = cells.select(F.explode("point_ids").alias("id")).distinct()
    points = ids.select("id", (F.col("id") % (side + 1)).cast("double").alias("x"), F.expr(f"cast(id div {side + 1} as double)").alias("y"), F.lit(0.0).alias("z"))
    return Mesh(points, cells)


def mesh_dual(spark, sf):
    return _mesh(spark, sf).dual_edges().select("src", "dst")


def mesh_oriented(spark, sf):
    return _mesh(spark, sf).oriented().select("id", F.array_join("point_ids", ",").alias("points"))


def mesh_find_cells(spark, sf):
    m = _mesh(spark, sf)
    asked = m.points.select(F.col("id").alias("query"), F.array("id", F.col("id") + 1).alias("point_ids"))
    return m.find_cells(asked)


def mesh_depending_cells(spark, sf):
    return _mesh(spark, sf).depending_cells().select("id", F.array_join("cells", ",").alias("cells"))


def string_functions(spark, sf):
    name = F.col("n_name")
    return table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.size(split_all(name, " ")).alias("parts"), F.array_join(split_nonempty(name, " "), "|").alias("words"), to_int(F.col("n_nationkey").cast("string")).alias("number"))


def number_functions(spark, sf):
    per = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_suppkey")).alias("s"), F.avg("l_quantity").alias("a"), F.max("l_quantity").alias("b"))
    return per.select("l_orderkey", F.array_join(unique_sorted("s"), ",").alias("suppliers"), near(F.col("a"), F.col("b"), 0.1).alias("alike"))


def value_functions(spark, sf):
    digits = lambda c: F.split(F.lpad(F.col(c).cast("string"), 6, "0"), "")
    customer, balance = table(spark, sf, "customer"), F.col("c_acctbal").cast("double")
    return customer.select(
        F.col("c_custkey").cast("long").alias("id"),
        to_long(F.concat(F.col("c_custkey").cast("string"), F.lit("0000000000"))).alias("large"),
        to_long(F.concat(F.col("c_custkey").cast("string"), F.lit("x"))).alias("no_number"),
        compared(balance, F.lit(5000.0), 0.25).alias("beside"),
        count_matches(digits("c_custkey"), digits("c_nationkey")).alias("same_digits"),
    )


def vector_functions(spark, sf):
    rest = lambda *by: F.struct(*((F.col("c_custkey") % m).cast("double").alias(n) for m, n in zip(by, "xyz")))
    a, b = rest(7, 5, 3), rest(2, 11, 13)
    both = table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("id"), cross(a, b).alias("c"), dot(a, b).alias("inner"))
    return both.select("id", "c.x", "c.y", "c.z", "inner")


def masked_statistics(spark, sf):
    mean, variance = mean_variance(F.col("l_quantity").cast("double"), F.col("l_partkey") % 3 == 0)
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(mean, 6).alias("mean"), F.round(variance, 6).alias("variance"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {k: f for k, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and not k.startswith("_")}
    return {k: f for k, f in own.items() if k != "queries"}
