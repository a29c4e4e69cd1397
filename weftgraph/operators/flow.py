"""Maximum flow with its cut, and the smallest global cut.

Graphs of few edges go to a kernel in one task. Beyond that, flow is found by
rounds of sweeps over layers of the residual arcs, and a global cut by
contracting the graph until it is small.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators import kernels
from weftgraph.operators.components import connected_components, min_reachable
from weftgraph.operators.graph import Predicate, PropertyGraph, column_check
from weftgraph.plans.durable import Scratch, drop_durable, durable
from weftgraph.plans.local import LOCAL_EDGES, in_one_task, is_local, on_edges


@dataclass(frozen=True)
class Flow:
    """``value``; (id, label) of all vertices: 0 not selected, 1 source side, 2 sink side, 3 never in reach of a
    source; (eid, flow) of all edges: positive from src to dst, 0 where not selected."""

    value: float
    labels: DataFrame
    flows: DataFrame


def max_flow(graph: PropertyGraph, sources: int | list[int], sinks: int | list[int], capacity: str, vertices: Predicate = None, edges: Predicate = None, strategy: str = "auto") -> Flow:
    """Largest flow from the sources to the sinks; each edge carries at most its ``capacity`` (either way if undirected).

    Of several terminals those outside the selection are skipped, a lone one must be selected.
    """
    lone = isinstance(sources, int), isinstance(sinks, int)
    sources, sinks = ([x] if isinstance(x, int) else list(x) for x in (sources, sinks))
    if set(sources) & set(sinks):
        raise ValueError("a vertex is source and sink")
    if len(set(sources)) < len(sources) or len(set(sinks)) < len(sinks):
        raise ValueError("a terminal is named twice")
    column_check(graph.edges, [capacity])
    part = graph.subgraph(vertices, edges)
    if not part.edges.where(F.col(capacity).isNull() | (F.col(capacity) < 0)).isEmpty():
        raise ValueError("capacities must not be negative or null")
    open_ = {r.id for r in part.vertices.where(F.col("id").isin(sources + sinks)).select("id").collect()}
    for is_lone, ends in zip(lone, (sources, sinks)):
        if is_lone and ends[0] not in open_:
            raise ValueError("source and sink must be selected")
    sources, sinks = [s for s in sources if s in open_], [t for t in sinks if t in open_]
    net = part.edges.select("eid", "src", "dst", F.col(capacity).cast("double").alias("capacity"))
    if is_local(net, strategy):
        directed = graph.directed

        def kernel(v: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
            value, labels, flows = kernels.max_flow(v, e, sources, sinks, directed)
            return pd.DataFrame([("value", 0, value)] + [("label", k, float(x)) for k, x in labels.items()] + [("flow", k, x) for k, x in flows.items()], columns=["kind", "key", "x"])

        # terminals come along; any other vertex without an edge is out of a source's reach
        ids = part.vertices.select("id")
        inner = on_edges(ids, net).unionByName(ids.where(F.col("id").isin(sources + sinks))).distinct()
        found = durable(in_one_task(inner, net, kernel, "kind string, key long, x double"), "flow")
        value = next((r.x for r in found.where("kind = 'value'").collect()), 0.0)
        alone = ids.join(inner, "id", "left_anti").select("id", F.lit(3).alias("label"))
        labels, flows = found.where("kind = 'label'").select(F.col("key").alias("id"), F.col("x").cast("int").alias("label")).unionByName(alone), found.where("kind = 'flow'").select(F.col("key").alias("eid"), F.col("x").alias("flow"))
    else:
        value, labels, flows = _rounds(part, net, sources, sinks)
    all_labels = graph.vertices.select("id").join(labels, "id", "left").select("id", F.coalesce("label", F.lit(0)).alias("label"))
    all_flows = graph.edges.select("eid").join(flows, "eid", "left").select("eid", F.coalesce("flow", F.lit(0.0)).alias("flow"))
    return Flow(value, all_labels, all_flows)


def _rounds(part: PropertyGraph, net: DataFrame, sources: list[int], sinks: list[int]) -> tuple[float, DataFrame, DataFrame]:
    """Flow by rounds of three sweeps over the arcs that lead a step nearer to the sinks.

    A search back from the sinks finds the layers up to the nearest source. Forward, every vertex deals what it
    received over its arcs; backward, what got stuck is taken back from those who sent it. A round either uses up the
    arcs of a source or those of some vertex, so rounds end; each carries all paths of its length at once.
    """
    back = F.lit(0.0) if part.directed else F.col("capacity")
    ways = F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(1).alias("way"), F.col("capacity").alias("room")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b"), F.lit(-1).alias("way"), back.alias("room"))))
    arcs = durable(net.where("src <> dst").select("eid", ways.alias("x")).select("eid", "x.*"), "residual")
    # what is left of a capacity after rounding counts as used up
    least = 1e-12 * (arcs.agg(F.max("room")).first()[0] or 0.0)
    begin, end = (part.vertices.where(F.col("id").isin(x)).select("id") for x in (sources, sinks))

    def layers(arcs: DataFrame, scratch: Scratch, seeds: DataFrame, tail: str, head: str, until: list[int] | None) -> tuple[list[DataFrame], bool]:
        """Vertices by their number of steps from the seeds, over arcs taken from ``tail`` to ``head``, and whether one is in ``until``."""
        use = arcs.where(F.col("room") > least)
        found = [scratch(seeds, "layer")]
        known = found[0]
        while True:
            step = use.join(found[-1].withColumnRenamed("id", tail), tail, "left_semi").select(F.col(head).alias("id")).distinct()
            found.append(scratch(step.join(known, "id", "left_anti"), "layer"))
            known = scratch(known.unionByName(found[-1]), "known")
            if until is not None and not found[-1].where(F.col("id").isin(until)).isEmpty():
                return found, True
            if found[-1].isEmpty():
                return found, False

    def reach(arcs: DataFrame) -> DataFrame:
        with Scratch() as scratch:
            return durable(reduce(DataFrame.unionByName, layers(arcs, scratch, begin, "a", "b", None)[0]), "reach")

    def dealt(rows: DataFrame, by: str, share: Column) -> Column:
        """What of ``share`` falls on each row of a vertex, in order, up to the row's ``most``."""
        before = F.coalesce(F.sum("most").over(Window.partitionBy(by).orderBy("eid", "way").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        return F.greatest(F.lit(0.0), F.least(F.col("most"), share - before))

    first, value = reach(arcs), 0.0
    while True:
        with Scratch() as scratch:
            steps, near = layers(arcs, scratch, end, "b", "a", sources)
            if not near:
                break
            top, use = len(steps) - 1, arcs.where(F.col("room") > least).select("eid", "way", "a", "b", F.col("room").alias("most"))
            sent: dict[int, DataFrame] = {}
            holds = begin.join(steps[top], "id", "left_semi").select("id", F.lit(float("inf")).alias("held"))
            for i in range(top, 0, -1):  # ``sent[i]`` leaves layer i
                rows = use.join(steps[i - 1].withColumnRenamed("id", "b"), "b", "left_semi").join(holds.withColumnRenamed("id", "a"), "a")
                sent[i] = scratch(rows.withColumn("push", dealt(rows, "a", F.col("held"))).where("push > 0").select("eid", "way", "a", "b", "push"), "sent")
                holds = sent[i].groupBy(F.col("b").alias("id")).agg(F.sum("push").alias("held"))
            for i in range(1, top):
                got = sent[i + 1].groupBy(F.col("b").alias("id")).agg(F.sum("push").alias("got"))
                gave = sent[i].groupBy(F.col("a").alias("id")).agg(F.sum("push").alias("gave"))
                stuck = got.join(gave, "id", "left").select(F.col("id").alias("b"), (F.col("got") - F.coalesce("gave", F.lit(0.0))).alias("stuck"))
                rows = sent[i + 1].withColumnRenamed("push", "most").join(stuck, "b")
                kept = F.col("most") - dealt(rows, "b", F.col("stuck"))
                sent[i + 1] = scratch(rows.withColumn("push", kept).where("push > 0").select("eid", "way", "a", "b", "push"), "sent")
            value += sent[1].agg(F.sum("push")).first()[0] or 0.0
            moved = reduce(DataFrame.unionByName, sent.values())
            change = moved.select("eid", F.explode(F.array(F.struct("way", (-F.col("push")).alias("change")), F.struct((-F.col("way")).alias("way"), F.col("push").alias("change")))).alias("x")).select("eid", "x.*").groupBy("eid", "way").agg(F.sum("change").alias("change"))
            after = durable(arcs.join(change, ["eid", "way"], "left").withColumn("room", F.col("room") + F.coalesce("change", F.lit(0.0))).drop("change"), "residual")
            drop_durable(arcs)
            arcs = after
    last = reach(arcs)
    labels = part.vertices.select("id").join(last.withColumn("near", F.lit(True)), "id", "left").join(first.withColumn("once", F.lit(True)), "id", "left").select("id", F.when(F.col("near"), 1).when(F.col("once"), 2).otherwise(3).alias("label"))
    room = arcs.groupBy("eid").agg(F.sum(F.when(F.col("way") == 1, F.col("room"))).alias("forth"), F.sum(F.when(F.col("way") == -1, F.col("room"))).alias("back"))
    flow = (F.col("capacity") - F.col("forth")) if part.directed else (F.col("back") - F.col("forth")) / 2
    return value, labels, net.join(room, "eid").select("eid", flow.alias("flow"))


def cut_edges(graph: PropertyGraph, labels: DataFrame) -> DataFrame:
    """Edges of ``graph`` that a cut parts: one end has label 1 and the other 2 in ``labels`` (id, label)."""
    at = lambda end, name: labels.select(F.col("id").alias(end), F.col("label").alias(name))
    both = graph.edges.join(at("src", "__a"), "src").join(at("dst", "__b"), "dst")
    return both.where("least(__a, __b) = 1 and greatest(__a, __b) = 2").select(*graph.edges.columns)


@dataclass(frozen=True)
class Cut:
    """``value``; (id, label) of all vertices: 0 not selected, 1 and 2 the sides (1 holds the smallest id)."""

    value: float
    labels: DataFrame


def min_cut(graph: PropertyGraph, weight: str, vertices: Predicate = None, edges: Predicate = None, limit: int = LOCAL_EDGES) -> Cut:
    """Smallest total weight of edges whose removal parts the selected vertices; undirected graphs only.

    Several components cost nothing to part: the first against the others. One
    component is contracted until at most ``limit`` edges are left for a kernel,
    or to its end.
    """
    if graph.directed:
        raise ValueError("global cuts need an undirected graph")
    column_check(graph.edges, [weight])
    part = graph.subgraph(vertices, edges)
    if part.vertices.limit(2).count() < 2:
        raise ValueError("a cut needs two vertices")
    if not part.edges.where(F.col(weight).isNull() | (F.col(weight) < 0)).isEmpty():
        raise ValueError("weights must not be negative or null")
    labels = durable(connected_components(part), "components")
    if not labels.where("label > 1").isEmpty():
        value, sides = 0.0, labels.select("id", F.least("label", F.lit(2)).cast("int").alias("label"))
    else:
        value, side = _contracted(part.vertices.select("id"), part.edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col(weight).cast("double").alias("w")), limit)
        smallest = part.vertices.agg(F.min("id")).first()[0]
        one = 1 if not side.where(F.col("id") == smallest).isEmpty() else 2
        inside = side.withColumn("inside", F.lit(True))
        sides = part.vertices.select("id").join(inside, "id", "left").select("id", F.when(F.col("inside"), one).otherwise(3 - one).alias("label"))
    return Cut(value, graph.vertices.select("id").join(sides, "id", "left").select("id", F.coalesce("label", F.lit(0)).alias("label")))


def _merged(net: DataFrame) -> DataFrame:
    """Edges (a, b, w) without loops, parallel ones as one."""
    return durable(net.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("w").alias("w")), "contracted")


def _contracted(ids: DataFrame, net: DataFrame, limit: int) -> tuple[float, DataFrame]:
    """Value and one side (id) of the smallest cut of a connected graph, by contractions that lose no smaller cut.

    Two vertices become one if the edge between them weighs as much as the best cut known, or half of all that one of
    them is tied by (then it can change sides at no cost; such pairs must not touch); else a flow between the ends of
    the heaviest edge shows the best cut that parts them, and they become one after that.
    """
    member, net, best, side = durable(ids.select("id", F.col("id").alias("cluster")), "clusters"), _merged(net), float("inf"), None
    while True:
        ends = F.explode(F.array(F.struct(F.col("a").alias("cluster"), "w"), F.struct(F.col("b").alias("cluster"), "w")))
        tied = durable(net.select(ends.alias("x")).select("x.*").groupBy("cluster").agg(F.sum("w").alias("tied")), "tied")
        low = tied.orderBy("tied", "cluster").first()
        if low is None:
            return best, side
        if low.tied < best:
            best, side = low.tied, durable(member.where(F.col("cluster") == low.cluster).select("id"), "side")
        if net.limit(limit + 1).count() <= limit:

            def kernel(v: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
                value, own = kernels.min_cut(v, e)
                return pd.DataFrame([(i, value) for i in own], columns=["cluster", "value"])

            found = durable(in_one_task(tied.select(F.col("cluster").alias("id")), net.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("w").alias("weight")), kernel, "cluster long, value double"), "cut")
            value = found.first().value
            return (value, member.join(found, "cluster", "left_semi").select("id")) if value < best else (best, side)
        of = lambda x: tied.select(F.col("cluster").alias(x), F.col("tied").alias(f"tied_{x}"))
        movable = net.join(of("a"), "a").join(of("b"), "b").where("2 * w >= least(tied_a, tied_b)").select("a", "b", F.struct("w", F.xxhash64("a", "b").alias("h"), "a", "b").alias("rank"))
        chosen = movable.select("rank", F.explode(F.array("a", "b")).alias("end")).groupBy("end").agg(F.max("rank").alias("rank"))
        pairs = chosen.groupBy("rank").agg(F.count("*").alias("n")).where("n = 2").select("rank.a", "rank.b")
        links = durable(net.where(F.col("w") >= best).select("a", "b").unionByName(pairs), "links")
        if links.isEmpty():
            far = net.orderBy(F.desc("w"), "a", "b").first()
            numbered = durable(net.select(F.monotonically_increasing_id().alias("eid"), F.col("a").alias("src"), F.col("b").alias("dst"), "w"), "net")
            flow = max_flow(PropertyGraph(tied.select(F.col("cluster").alias("id")), numbered, False, True), far.a, far.b, "w")
            if flow.value < best:
                own = flow.labels.where("label = 1").select(F.col("id").alias("cluster"))
                best, side = flow.value, durable(member.join(own, "cluster", "left_semi").select("id"), "side")
            links = net.where((F.col("a") == far.a) & (F.col("b") == far.b)).select("a", "b")
        into = durable(min_reachable(links, "a", "b"), "into")
        to = lambda x, y: into.select(F.col("id").alias(x), F.col("component").alias(y))
        old = member, net, tied
        member = durable(member.join(to("cluster", "to"), "cluster", "left").select("id", F.coalesce("to", "cluster").alias("cluster")), "clusters")
        net = _merged(net.join(to("a", "ta"), "a", "left").join(to("b", "tb"), "b", "left").select(F.coalesce("ta", "a").alias("a"), F.coalesce("tb", "b").alias("b"), "w"))
        for t in old:
            drop_durable(t)
