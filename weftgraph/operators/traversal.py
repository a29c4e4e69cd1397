"""Breadth-first levels and shortest paths, a round of joins per step from all sources at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.graph import Predicate, PropertyGraph, column_check
from weftgraph.plans.durable import drop_durable, durable


def bfs_levels(graph: PropertyGraph, sources: DataFrame, vertices: Predicate = None, edges: Predicate = None, max_level: int | None = None) -> DataFrame:
    """source, id, level: number of edges from each source (rows ``id``) to what it reaches; direction counts.

    Undirected, a step from a level ends in it, the one before or the next, so
    that only two levels are compared with what a round finds. Parallel arcs
    are merged by the steps over them. The sources are written first: few of
    them are then looked for among the vertices before those are made distinct.
    """
    part = graph.subgraph(vertices, edges)
    arcs = durable(part.arcs().select(F.col("src").alias("a"), F.col("dst").alias("b")), "arcs")
    wanted = durable(sources.select("id").distinct(), "sources")
    front = durable(part.vertices.select("id").join(wanted, "id", "left_semi").distinct().select(F.col("id").alias("source"), "id", F.lit(0).alias("level")), "front")
    drop_durable(wanted)
    seen, near, level = [front], [front], 0
    while max_level is None or level < max_level:
        level += 1
        known = reduce(DataFrame.unionByName, seen if part.directed else near).select("source", "id")
        step = front.join(arcs, front["id"] == arcs["a"]).select("source", F.col("b").alias("id")).distinct()
        front = durable(step.join(known, ["source", "id"], "left_anti").withColumn("level", F.lit(level)), "front")
        if front.isEmpty():
            break
        seen.append(front)
        near = [near[-1], front]
        if len(seen) > 16:  # keep the plan short on deep graphs
            seen = [durable(reduce(DataFrame.unionByName, seen), "front")]  # the last front is still read
    return reduce(DataFrame.unionByName, seen)


def shortest_paths(graph: PropertyGraph, cost: str | None, sources: DataFrame, vertices: Predicate = None, edges: Predicate = None, target: int | None = None) -> DataFrame:
    """source, id, distance, hops, predecessor for what each source reaches; with ``target``, of what lies no farther
    than the target from the source, and nothing beyond is looked at once it is reached.

    Costs (column ``cost``; 1 each if None) must not be negative or null. Of the
    shortest paths the one with the fewest edges counts, of those the
    predecessor with the smallest id; the source has none. Only those vertices
    are extended in a round whose distance has just become smaller.
    """
    part = graph.subgraph(vertices, edges)
    if cost is not None:
        column_check(part.edges, [cost])
        if not part.edges.where(F.col(cost).isNull() | (F.col(cost) < 0)).isEmpty():
            raise ValueError("costs must not be negative or null")
    weight = F.lit(1.0) if cost is None else F.col(cost).cast("double")
    arcs = durable(part.arcs().select(F.col("src").alias("a"), F.col("dst").alias("b"), weight.alias("c")), "arcs")
    state = durable(sources.select("id").distinct().join(part.vertices.select("id"), "id", "left_semi").select(F.col("id").alias("source"), "id", F.struct(F.lit(0.0).alias("distance"), F.lit(0).alias("hops")).alias("best")), "paths")
    front, held = state, None

    def reached(state: DataFrame) -> DataFrame:
        return state.where(F.col("id") == target).select("source", F.col("best.distance").alias("limit"))

    while True:
        way = F.struct((F.col("best.distance") + F.col("c")).alias("distance"), (F.col("best.hops") + 1).alias("hops"))
        tried = front.join(arcs, front["id"] == arcs["a"]).select("source", F.col("b").alias("id"), way.alias("best"))
        merged = state.withColumn("new", F.lit(False)).unionByName(tried.withColumn("new", F.lit(True)))
        # the old state wins ties: false sorts before true
        nxt = durable(merged.groupBy("source", "id").agg(F.min(F.struct("best", "new")).alias("m")).select("source", "id", "m.best", "m.new"), "paths")
        if held is not None:
            drop_durable(held)
        front, state, held = nxt.where("new").drop("new"), nxt.drop("new"), nxt
        if target is not None:
            front = front.join(reached(state), "source", "left").where("best.distance <= coalesce(limit, best.distance)").drop("limit")
        if front.isEmpty():
            break
    if target is not None:
        state = state.join(reached(state), "source", "left").where("best.distance <= coalesce(limit, best.distance)")
    flat = state.select("source", "id", "best.distance", "best.hops")
    left = flat.select("source", F.col("id").alias("a"), F.col("distance").alias("da"), F.col("hops").alias("ha"))
    via = flat.join(arcs, flat["id"] == arcs["b"]).join(left, ["source", "a"]).where("da + c = distance and ha + 1 = hops")
    pred = via.groupBy("source", "id").agg(F.min("a").alias("predecessor"))
    return flat.join(pred, ["source", "id"], "left")


def distances(graph: PropertyGraph, cost: str | None, start: int, vertices: Predicate = None, edges: Predicate = None, unreached: float | None = None, target: int | None = None) -> DataFrame:
    """id, distance from ``start`` for every vertex; ``unreached`` (null) where there is no path, or none as short as
    the one to ``target``."""
    sources = graph.vertices.where(F.col("id") == start)
    found = shortest_paths(graph, cost, sources, vertices, edges, target).select("id", "distance")
    return graph.vertices.select("id").join(found, "id", "left").select("id", F.coalesce("distance", F.lit(unreached).cast("double")).alias("distance"))


def path(paths: DataFrame, target: int) -> DataFrame:
    """source, step (0 at the source), id, distance: the path to ``target`` for each source, empty if there is none.

    ``paths`` as ``shortest_paths`` gives; a round per edge of the longest path.
    """
    paths = durable(paths, "preds")
    at = durable(paths.where(F.col("id") == target), "path")
    rows = [at]
    while not at.where("hops > 0").isEmpty():
        up = at.select("source", F.col("predecessor").alias("id")).where("id is not null")
        at = durable(paths.join(up, ["source", "id"], "left_semi"), "path")
        rows.append(at)
    return reduce(DataFrame.unionByName, rows).select("source", F.col("hops").alias("step"), "id", "distance")
