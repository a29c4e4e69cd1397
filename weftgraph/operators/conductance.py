"""Steady flow through a network of conductors between two fixed potentials.

Inner vertices satisfy Kirchhoff's law: sum of g * (x_i - x_j) = 0. The system
is solved by conjugate gradients. Each step is one join of the search direction
with the arcs, one aggregation by vertex, and two sums; only numbers come to
the driver. Small networks run the same steps in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.graph import Predicate, PropertyGraph, column_check
from weftgraph.plans.durable import drop_durable, durable
from weftgraph.plans.local import in_one_task, is_local, on_edges

REFRESH = 15
#: Share of the flow up to which its two ends may differ.
MOST_IMBALANCE = 1e-3


@dataclass(frozen=True)
class Conductance:
    """``flow`` from high to low; ``imbalance``: by how much what leaves high and what enters low differ; ``conductance`` flow by potential difference; (id, x) of all vertices, null outside
    the selection or out of reach of a boundary; (eid, flow) of all edges, g * (x_src - x_dst), 0 where not selected."""

    flow: float
    conductance: float | None
    potentials: DataFrame
    flows: DataFrame
    imbalance: float = 0.0


def conductance(graph: PropertyGraph, weight: str, boundary: str, x_low: float, x_high: float, vertices: Predicate = None, edges: Predicate = None, rtol_l2: float = 1e-8, rtol_linf: float = 1e-8, rtol_bounds: float = 1e-7, strategy: str = "auto") -> Conductance:
    """``weight``: conductances of the edges (>= 0); ``boundary``: 1 at low, 2 at high potential, else inner (or null)."""
    if graph.directed:
        raise ValueError("conductance needs an undirected graph")
    column_check(graph.edges, [weight])
    column_check(graph.vertices, [boundary])
    part = graph.subgraph(vertices, edges)
    if not part.edges.where(F.col(weight).isNull() | (F.col(weight) < 0)).isEmpty():
        raise ValueError("conductances must not be negative or null")
    fixed = F.when(F.col(boundary) == 1, F.lit(float(x_low))).when(F.col(boundary) == 2, F.lit(float(x_high)))
    nodes = durable(part.vertices.select("id", fixed.alias("fixed"), F.coalesce(F.col(boundary).cast("int"), F.lit(0)).alias("side")), "nodes")
    net = durable(part.edges.where("src <> dst").select("eid", "src", "dst", F.col(weight).cast("double").alias("g")).where("g > 0"), "net")
    if is_local(net, strategy):
        inner = on_edges(nodes, net)
        alone = nodes.join(inner, "id", "left_anti").select("id", F.col("fixed").alias("x"))
        found = durable(in_one_task(inner, net, lambda v, e: _solve_local(v, e, rtol_l2, rtol_linf), "id long, x double").unionByName(alone), "x")
    else:
        found = durable(_solve_rounds(nodes, net, rtol_l2, rtol_linf), "x")
    lo, hi = min(x_low, x_high), max(x_low, x_high)
    span = found.agg(F.min("x"), F.max("x")).first()
    if span[0] is not None and (span[0] < lo - rtol_bounds * (hi - lo) - 1e-300 or span[1] > hi + rtol_bounds * (hi - lo) + 1e-300):
        raise ArithmeticError("a potential lies outside the boundary values")
    at = lambda end, name: found.select(F.col("id").alias(end), F.col("x").alias(name))
    carried = net.join(at("src", "xa"), "src").join(at("dst", "xb"), "dst").select("eid", "src", "dst", (F.col("g") * (F.col("xa") - F.col("xb"))).alias("flow"))
    out = carried.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("flow").alias("f")), F.struct(F.col("dst").alias("id"), (-F.col("flow")).alias("f")))).alias("p")).select("p.*")
    sums = {r.side: r.f or 0.0 for r in out.join(nodes, "id").where("side in (1, 2)").groupBy("side").agg(F.sum("f").alias("f")).collect()}
    flow, imbalance = (abs(sums.get(1, 0.0)) + abs(sums.get(2, 0.0))) / 2, abs(abs(sums.get(1, 0.0)) - abs(sums.get(2, 0.0)))
    if imbalance > MOST_IMBALANCE * flow:
        raise ArithmeticError(f"the flow is not balanced: {flow} with a difference of {imbalance} between its ends; ask for smaller tolerances")
    potentials = graph.vertices.select("id").join(found, "id", "left")
    flows = graph.edges.select("eid").join(carried.select("eid", "flow"), "eid", "left").select("eid", F.coalesce("flow", F.lit(0.0)).alias("flow"))
    return Conductance(flow, flow / abs(x_high - x_low) if x_high != x_low else None, potentials, flows, imbalance)


def _solve_local(v: pd.DataFrame, e: pd.DataFrame, l2: float, linf: float) -> pd.DataFrame:
    ids, fixed = v["id"].to_numpy(), v["fixed"].to_numpy(float)
    at = {i: k for k, i in enumerate(ids)}
    a, b, g = np.array([at[i] for i in e["src"]], int), np.array([at[i] for i in e["dst"]], int), e["g"].to_numpy(float)
    n, inner = len(ids), np.isnan(fixed)
    base = np.where(inner, 0.0, fixed)

    def times(x: np.ndarray) -> np.ndarray:
        d = g * (x[a] - x[b])
        return np.where(inner, np.bincount(a, d, n) - np.bincount(b, d, n), 0.0)

    b_vec = -times(base)
    x, r = np.zeros(n), b_vec.copy()
    p, rr = r.copy(), float(r @ r)
    goal2, goalmax = l2 * np.sqrt(rr), linf * np.abs(b_vec).max(initial=0.0)
    for k in range(max(100, 2 * int(inner.sum()))):
        if np.sqrt(rr) <= goal2 and np.abs(r).max(initial=0.0) <= goalmax:
            break
        ap = times(p)
        curve = float(p @ ap)
        if curve <= 0:
            raise ArithmeticError("the system is not positive definite")
        x += rr / curve * p
        r = b_vec - times(x) if k % REFRESH == REFRESH - 1 else r - rr / curve * ap
        new = float(r @ r)
        p, rr = r + new / rr * p, new
    else:
        if np.sqrt(rr) > goal2 or np.abs(r).max(initial=0.0) > goalmax:
            raise ArithmeticError("no convergence")
    # what no boundary reaches has no potential
    seen = ~inner
    while True:
        more = seen.copy()
        np.logical_or.at(more, a, seen[b])
        np.logical_or.at(more, b, seen[a])
        if (more == seen).all():
            break
        seen = more
    return pd.DataFrame({"id": ids, "x": np.where(seen, base + x, np.nan)}).astype({"id": "int64"}).replace({np.nan: None}).astype({"x": "float64"})


def _solve_rounds(nodes: DataFrame, net: DataFrame, l2: float, linf: float) -> DataFrame:
    arcs = durable(net.select("g", F.explode(F.array(F.struct(F.col("src").alias("i"), F.col("dst").alias("j")), F.struct(F.col("dst").alias("i"), F.col("src").alias("j")))).alias("p")).select("g", "p.*"), "arcs")
    inner = nodes.where("fixed is null").select("id")
    weights = arcs.groupBy(F.col("i").alias("id")).agg(F.sum("g").alias("d"))

    def times(x: DataFrame, col: str) -> DataFrame:
        """(id, ax) of the inner vertices for (id, col); missing ids count as 0."""
        pulled = arcs.join(x.select(F.col("id").alias("j"), F.col(col).alias("v")), "j").groupBy(F.col("i").alias("id")).agg(F.sum(F.col("g") * F.col("v")).alias("s"))
        return inner.join(weights, "id").join(x.select("id", F.col(col).alias("v")), "id", "left").join(pulled, "id", "left").select("id", (F.col("d") * F.coalesce("v", F.lit(0.0)) - F.coalesce("s", F.lit(0.0))).alias("ax"))

    pulled = times(nodes.where("fixed is not null").select("id", "fixed"), "fixed")
    state = durable(pulled.select("id", F.lit(0.0).alias("x"), (-F.col("ax")).alias("b")).withColumn("r", F.col("b")).withColumn("p", F.col("b")), "cg")
    s = state.agg(F.sum(F.col("r") * F.col("r")), F.max(F.abs("b")), F.count("*")).first()
    rr, n = s[0] or 0.0, s[2]
    goal2, goalmax, top = l2 * rr**0.5, linf * (s[1] or 0.0), s[1] or 0.0
    held = state
    for k in range(max(100, 2 * n) + 1):
        if rr**0.5 <= goal2 and top <= goalmax:
            break
        if k == max(100, 2 * n):
            raise ArithmeticError("no convergence")
        step = durable(state.join(times(state, "p"), "id"), "cg")
        curve = step.agg(F.sum(F.col("p") * F.col("ax"))).first()[0]
        if curve <= 0:
            raise ArithmeticError("the system is not positive definite")
        alpha = rr / curve
        moved = step.withColumn("x", F.col("x") + alpha * F.col("p")).withColumn("r", F.col("r") - alpha * F.col("ax")).drop("ax")
        if k % REFRESH == REFRESH - 1:
            moved = durable(moved, "cg")
            moved = durable(moved.join(times(moved, "x"), "id").withColumn("r", F.col("b") - F.col("ax")).drop("ax"), "cg")
        moved = durable(moved, "cg")
        drop_durable(held)
        drop_durable(step)
        held = moved
        new, top = moved.agg(F.sum(F.col("r") * F.col("r")), F.max(F.abs("r"))).first()
        state = moved.withColumn("p", F.col("r") + (new / rr) * F.col("p"))
        rr = new
    # what no boundary reaches has no potential
    seen = durable(nodes.where("fixed is not null").select("id"), "seen")
    while True:
        more = durable(seen.unionByName(arcs.join(seen, arcs["i"] == seen["id"]).select(F.col("j").alias("id"))).distinct(), "seen")
        if more.count() == seen.count():
            break
        seen = more
    both = nodes.where("fixed is not null").select("id", F.col("fixed").alias("x")).unionByName(state.select("id", "x").join(seen, "id", "left_semi"))
    return nodes.select("id").join(both, "id", "left")
