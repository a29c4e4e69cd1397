"""Betweenness of vertices and edges."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators import kernels
from weftgraph.operators.graph import Predicate, PropertyGraph, column_check
from weftgraph.operators.traversal import shortest_paths
from weftgraph.plans.durable import durable
from weftgraph.plans.local import LOCAL_EDGES, is_local

#: Rounding of path lengths up to which two paths are equally short.
TOLERANCE = 1e5 * 2.220446049250313e-16


def betweenness(graph: PropertyGraph, cost: str | None = None, normalized: bool = False, vertices: Predicate = None, edges: Predicate = None, strategy: str = "auto", sources: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, betweenness) of the selected vertices and (eid, betweenness) of the selected edges.

    Over all pairs of selected vertices the share of shortest paths that pass,
    ends excluded for vertices; a pair counts once if undirected. ``cost`` must
    be positive. ``normalized`` divides by the number of pairs. A graph whose
    edges are proven few goes to every task, and the sources are dealt over
    tasks; else all sources advance together, keyed by source. ``sources``
    (rows id) restricts the sums to paths that begin there.
    """
    part = graph.subgraph(vertices, edges)
    if cost is not None:
        column_check(part.edges, [cost])
        if not part.edges.where(F.col(cost).isNull() | (F.col(cost) <= 0)).isEmpty():
            raise ValueError("costs must be positive")
    begin = part.vertices.select("id") if sources is None else sources.select("id").join(part.vertices.select("id"), "id", "left_semi")
    sums = _replicated(part, cost, begin) if is_local(part.edges, strategy, LOCAL_EDGES) else _keyed(part, cost, begin)
    half = 1.0 if graph.directed else 0.5
    vertex_by = edge_by = 1.0
    if normalized:
        n = float(part.vertices.count())
        vertex_by = (n - 1) * (n - 2) * half if n >= 3 else 1.0
        edge_by = n * (n - 1) * half if n >= 2 else 1.0
    sums = durable(sums, "betweenness")
    of = lambda kind, key, by: sums.where(F.col("kind") == kind).select(F.col("key").alias(key), (F.col("part") * half / by).alias("betweenness"))
    zero = lambda all_, found, key: all_.select(key).join(found, key, "left").select(key, F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"))
    return zero(part.vertices, of("v", "id", vertex_by), "id"), zero(part.edges, of("e", "eid", edge_by), "eid")


def _replicated(part: PropertyGraph, cost: str | None, begin: DataFrame) -> DataFrame:
    spark = part.vertices.sparkSession
    weight = [] if cost is None else [F.col(cost).cast("double").alias("c")]
    rows = part.arcs().select("src", "dst", "eid", *weight).toPandas()  # at most LOCAL_EDGES edges
    shared = spark.sparkContext.broadcast({c: rows[c].to_numpy() for c in rows.columns})

    def by_steps() -> Callable[[list[int]], Iterator[tuple]]:
        g = kernels.Compact(*(shared.value[c] for c in ("src", "dst", "eid")))

        def sums(sources: list[int]) -> Iterator[tuple]:
            at = np.searchsorted(g.ids, sources)
            known = (at < len(g.ids)) & (np.append(g.ids, -1)[at] == sources)  # others have no arcs
            v, e = kernels.dependencies_by_steps(g, at[known])
            yield from zip(["v"] * len(v), g.ids.tolist(), v.tolist())
            yield from zip(["e"] * len(e), g.eids.tolist(), e.tolist())

        return sums

    def by_cost() -> Callable[[list[int]], Iterator[tuple]]:
        arcs: dict[int, list] = defaultdict(list)
        for a, b, e, c in zip(*(shared.value[c].tolist() for c in ("src", "dst", "eid", "c"))):
            arcs[a].append((b, e, c))

        def sums(sources: list[int]) -> Iterator[tuple]:
            v, e = kernels.dependencies(arcs, sources)
            yield from (("v", k, x) for k, x in v.items())
            yield from (("e", k, x) for k, x in e.items())

        return sums

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = None
        for b in batches:
            sums = sums or (by_steps if cost is None else by_cost)()
            found = pd.DataFrame(sums(b["id"].tolist()), columns=["kind", "key", "part"])
            yield found[found["part"] != 0]

    # few bytes, much work: an explicit number of parts, or they would be joined to one
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return begin.repartition(parts, "id").mapInPandas(run, "kind string, key long, part double").groupBy("kind", "key").agg(F.sum("part").alias("part"))


def _keyed(part: PropertyGraph, cost: str | None, begin: DataFrame) -> DataFrame:
    weight = F.lit(1.0) if cost is None else F.col(cost).cast("double")
    dist = durable(shortest_paths(part, cost, begin).select("source", "id", "distance"), "dist")
    arcs = part.arcs().select(F.col("src").alias("a"), F.col("dst").alias("b"), "eid", weight.alias("c"))
    left, right = dist.select("source", F.col("id").alias("a"), F.col("distance").alias("da")), dist.select("source", F.col("id").alias("b"), F.col("distance").alias("db"))
    close = F.abs(F.col("da") + F.col("c") - F.col("db")) <= TOLERANCE * F.greatest(F.lit(1.0), F.abs("db"))
    dag = durable(left.join(arcs, "a").join(right, ["source", "b"]).where(close & (F.col("da") < F.col("db"))).select("source", "a", "b", "eid"), "dag")
    # peel the acyclic graph from the source: a vertex is ready when all its predecessors are
    waits = lambda d, end: d.select("source", F.col(end).alias("id"))
    todo, rounds = dag, []
    paths = durable(dist.where("source = id").select("source", "id", F.lit(1.0).alias("paths")), "paths")
    rest = dist.where("source <> id").select("source", "id")
    known = [paths]
    while True:
        ready = durable(rest.join(waits(todo.join(reduce(DataFrame.unionByName, known).select("source", F.col("id").alias("a")), ["source", "a"], "left_anti"), "b"), ["source", "id"], "left_anti"), "ready")
        if ready.isEmpty():
            break
        have = reduce(DataFrame.unionByName, known)
        new = durable(dag.join(ready.withColumnRenamed("id", "b"), ["source", "b"], "left_semi").join(have.withColumnRenamed("id", "a"), ["source", "a"]).groupBy("source", F.col("b").alias("id")).agg(F.sum("paths").alias("paths")), "paths")
        rest = durable(rest.join(ready, ["source", "id"], "left_anti"), "rest")
        rounds.append(ready)
        known.append(new)
    paths = durable(reduce(DataFrame.unionByName, known), "paths")
    ratio = durable(dag.join(paths.select("source", F.col("id").alias("a"), F.col("paths").alias("pa")), ["source", "a"]).join(paths.select("source", F.col("id").alias("b"), F.col("paths").alias("pb")), ["source", "b"]).select("source", "a", "b", "eid", (F.col("pa") / F.col("pb")).alias("r")), "ratio")
    # back from the far end: what a vertex passes to its predecessors is complete when its round comes
    shares, parts = None, []
    for ready in reversed(rounds):
        got = ready if shares is None else ready.join(shares, ["source", "id"], "left")
        value = F.lit(0.0) if shares is None else F.coalesce("share", F.lit(0.0))
        own = got.select("source", F.col("id").alias("b"), value.alias("share"))
        sent = durable(ratio.join(own, ["source", "b"]).select("source", "a", "eid", (F.col("r") * (1 + F.col("share"))).alias("part")), "sent")
        parts.append(sent)
        up = sent.select("source", F.col("a").alias("id"), F.col("part").alias("share"))
        shares = durable((up if shares is None else shares.unionByName(up)).groupBy("source", "id").agg(F.sum("share").alias("share")), "shares")
    if not parts:
        return dist.select(F.lit("v").alias("kind"), F.col("id").alias("key"), F.lit(0.0).alias("part")).groupBy("kind", "key").agg(F.sum("part").alias("part"))
    on_edges = reduce(DataFrame.unionByName, parts).select(F.lit("e").alias("kind"), F.col("eid").alias("key"), "part")
    on_vertices = shares.where("source <> id").select(F.lit("v").alias("kind"), F.col("id").alias("key"), F.col("share").alias("part"))
    return on_edges.unionByName(on_vertices).groupBy("kind", "key").agg(F.sum("part").alias("part"))
