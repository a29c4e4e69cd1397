"""Connected components: alternating large-star and small-star rounds.

Each round replaces the links by links to the smallest neighbour (Kiveris et
al., "Connected components in MapReduce and beyond", 2014). The number of
links never grows, a hub is reduced by a map-side combined ``min``, and the
rounds needed grow with the logarithm of the size, so that a path of a million
vertices does not need a million rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators import kernels
from weftgraph.operators.graph import Predicate, PropertyGraph
from weftgraph.plans.durable import Scratch, drop_durable, durable
from weftgraph.plans.local import in_one_task, is_local, on_edges
from weftgraph.plans.ranking import dense_index


def _star(links: DataFrame, large: bool, hold: Scratch) -> DataFrame:
    """One star round over links (a, b), a > b; the links of the large one may repeat, and are no more than before.

    The smallest neighbours are written before they are joined: a join of two
    tables is dealt anew where a hub crowds a task, one with a sum is not.
    """
    if large:
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = hold(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low")
        return links.select(F.col("b").alias("a"), F.col("a").alias("b")).join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    low = hold(links.groupBy("a").agg(F.min("b").alias("m")), "low")
    joined = links.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.*")
    return joined.where("a > b").distinct()


def min_reachable(links: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, dense: bool = False) -> DataFrame:
    """(id, component) for every id on a link: the smallest id it reaches, direction ignored.

    Null ends and self links carry nothing; ids on no link are not returned.
    With ``dense``, for links that are many more than their ends, a small star
    comes first: it leaves few links for the rounds, and merges repeated ones.
    """
    ends = links.select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b")).where(F.col(src).isNotNull() & F.col(dst).isNotNull())
    alone = ends.where("a = b").select(F.col("a").alias("id"), F.col("a").alias("component"))
    if dense:
        with Scratch() as hold:
            now = durable(_star(hold(ends.where("a > b"), "links"), False, hold), "links")
    else:
        now = durable(ends.where("a > b").distinct(), "links")
    mark = None
    for _ in range(max_rounds):
        with Scratch() as hold:
            nxt = durable(_star(hold(_star(now, True, hold), "links"), False, hold), "links")
        seen = _mark(nxt)
        if seen == mark:
            break
        drop_durable(now)
        now, mark = nxt, seen
    else:
        raise RuntimeError("components did not settle")
    found = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("component"))
    return found.unionByName(roots).unionByName(alone).groupBy("id").agg(F.min("component").alias("component"))


def _mark(links: DataFrame) -> tuple:
    h: Column = F.xxhash64("a", "b")
    return tuple(links.agg(F.count("*"), F.sum(F.shiftright(h, 20)), F.bit_xor(h)).first())


def connected_components(graph: PropertyGraph, vertices: Predicate = None, edges: Predicate = None) -> DataFrame:
    """id, label of every vertex: components of the selection, direction ignored; 0 for vertices outside it.

    Labels are 1, 2, ... in order of the smallest member.
    """
    inside = F.lit(True) if vertices is None else F.expr(vertices) if isinstance(vertices, str) else vertices
    known = durable(graph.vertices.select("id", F.coalesce(inside, F.lit(False)).alias("inside")), "vertices")
    reach = min_reachable(graph.subgraph(vertices, edges).edges, dense=True)
    roots = durable(known.where("inside").join(reach, "id", "left").select("id", F.coalesce("component", "id").alias("component")), "components")
    labels = dense_index(roots.select("component"), ["component"], "label")
    outside = known.where("not inside").select("id", F.lit(0).cast("long").alias("label"))
    return roots.join(labels, "component").select("id", "label").unionByName(outside)


def strongly_connected_components(graph: PropertyGraph, vertices: Predicate = None, edges: Predicate = None, strategy: str = "auto") -> DataFrame:
    """id, component (smallest id in the component; null outside the selection). Directed graphs only."""
    if not graph.directed:
        raise ValueError("strong components need a directed graph")
    part = graph.subgraph(vertices, edges)
    if is_local(part.edges, strategy):
        ids = part.vertices.select("id")
        inner = on_edges(ids, part.edges)
        found = in_one_task(inner, part.edges.select("src", "dst"), kernels.strong_components, "id long, component long")
        found = found.unionByName(ids.join(inner, "id", "left_anti").select("id", F.col("id").alias("component")))
    else:
        found = _strong_by_colour(part)
    return graph.vertices.select("id").join(found, "id", "left")


def completion_labels(graph: PropertyGraph, components: DataFrame, vertices: Predicate = None, edges: Predicate = None) -> DataFrame:
    """id, label of every vertex: strong components (rows id, component) numbered from 1 so that an edge between
    two of them leads from the higher label to the lower; 0 outside the selection."""
    part = graph.subgraph(vertices, edges)
    components = durable(components.select("id", "component"), "components")
    turned = part.edges.select("eid", F.col("dst").alias("src"), F.col("src").alias("dst"))
    depth = topological_levels(PropertyGraph(part.vertices, turned, True, True), components).join(components, "id")
    placed = durable(depth.select("id", "level", "component"), "depth")
    labels = dense_index(placed, ["level", "component"], "label")
    found = placed.join(labels, ["level", "component"]).select("id", "label")
    return graph.vertices.select("id").join(found, "id", "left").select("id", F.coalesce("label", F.lit(0)).cast("long").alias("label"))


def _spread(start: DataFrame, arcs: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """(id, colour): the smallest colour that reaches an id along arcs, from its own colour on."""
    now = durable(start, "colour")
    while True:
        sent = arcs.join(now, arcs["a"] == now["id"]).select(F.col("b").alias("id"), "colour")
        nxt = durable(now.unionByName(sent).groupBy("id").agg(F.min("colour").alias("colour")), "colour")
        changed = nxt.join(now.withColumnRenamed("colour", "was"), "id").where("colour < was")
        ended = changed.isEmpty()
        drop_durable(now)
        if ended:
            return nxt
        now = nxt


def _strong_by_colour(part: PropertyGraph) -> DataFrame:
    """Forward colouring by the smallest id, then backward within each colour from the vertex that gave it."""
    rest = durable(part.vertices.select("id"), "scc")
    arcs = durable(part.edges.where("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct(), "scc")
    done = None
    while not rest.isEmpty():
        # vertices without arcs on one side are components of their own
        inner = arcs.select(F.col("a").alias("id")).distinct().join(arcs.select(F.col("b").alias("id")).distinct(), "id", "left_semi")
        alone = durable(rest.join(inner, "id", "left_anti").select("id", F.col("id").alias("component")), "scc")
        colour = _spread(rest.join(inner, "id", "left_semi").select("id", F.col("id").alias("colour")), arcs.join(inner.withColumnRenamed("id", "a"), "a", "left_semi").join(inner.withColumnRenamed("id", "b"), "b", "left_semi"))
        tinted = arcs.join(colour.select(F.col("id").alias("a"), F.col("colour").alias("ca")), "a").join(colour.select(F.col("id").alias("b"), F.col("colour").alias("cb")), "b").where("ca = cb")
        back = durable(tinted.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("ca").alias("c")), "scc")
        # backward from each root: a vertex is in the component if its colour's root reaches it backwards
        hit = durable(colour.where("id = colour").select("id"), "scc")
        while True:
            more = durable(hit.unionByName(back.join(hit, back["a"] == hit["id"]).select(F.col("b").alias("id"))).distinct(), "scc")
            ended = more.count() == hit.count()
            drop_durable(hit)
            hit = more
            if ended:
                break
        found = durable(alone.unionByName(colour.join(hit, "id", "left_semi").select("id", F.col("colour").alias("component"))), "scc")
        done = found if done is None else done.unionByName(found)
        gone = found.select("id")
        old = rest, arcs, back, alone, hit
        rest = durable(rest.join(gone, "id", "left_anti"), "scc")
        arcs = durable(arcs.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti"), "scc")
        for t in old:
            drop_durable(t)
    return done if done is not None else rest.select("id", F.col("id").alias("component"))


def topological_levels(graph: PropertyGraph, components: DataFrame | None = None, vertices: Predicate = None, edges: Predicate = None) -> DataFrame:
    """id, level of every vertex: 1 without predecessors, else one more than the highest predecessor; 0 outside.

    With ``components`` (id, component) members of a component share a level and edges within it don't count.
    Loops don't count either. A cycle is a ValueError. A round per level.
    """
    if not graph.directed:
        raise ValueError("levels need a directed graph")
    part = graph.subgraph(vertices, edges)
    group = part.vertices.select("id", F.col("id").alias("component")) if components is None else part.vertices.select("id").join(components.where("component is not null").select("id", "component"), "id")
    if components is not None and not part.vertices.select("id").join(group, "id", "left_anti").isEmpty():
        raise ValueError("a selected vertex has no component")
    group = durable(group, "levels")
    of = lambda end, name: group.select(F.col("id").alias(end), F.col("component").alias(name))
    arcs = durable(part.edges.select("src", "dst").join(of("src", "a"), "src").join(of("dst", "b"), "dst").where("a <> b").select("a", "b").distinct(), "levels")
    rest, level, done = durable(group.select("component").distinct(), "levels"), 0, None
    while not rest.isEmpty():
        level += 1
        top = durable(rest.join(arcs.select(F.col("b").alias("component")), "component", "left_anti").select("component", F.lit(level).cast("long").alias("level")), "levels")
        if top.isEmpty():
            raise ValueError("a cycle has no topological levels")
        done = top if done is None else done.unionByName(top)
        old = rest, arcs
        rest = durable(rest.join(top, "component", "left_anti"), "levels")
        arcs = durable(arcs.join(top.select(F.col("component").alias("a")), "a", "left_anti"), "levels")
        for t in old:
            drop_durable(t)
    if done is None:
        return graph.vertices.select("id", F.lit(0).cast("long").alias("level"))
    found = group.join(done, "component").select("id", "level")
    return graph.vertices.select("id").join(found, "id", "left").select("id", F.coalesce("level", F.lit(0)).alias("level"))


def level_violations(graph: PropertyGraph, levels: DataFrame, components: DataFrame | None = None, vertices: Predicate = None, edges: Predicate = None) -> DataFrame:
    """Rows (kind, id, other) that contradict ``levels`` (id, level): none if they are topological levels."""
    part = graph.subgraph(vertices, edges)
    inside = part.vertices.select("id", F.lit(True).alias("inside"))
    all_levels = graph.vertices.select("id").join(levels, "id", "left").join(inside, "id", "left")
    wrong = all_levels.where("(coalesce(level, 0) > 0) <> coalesce(inside, false)").select(F.lit("selection").alias("kind"), "id", F.lit(None).cast("long").alias("other"))
    group = levels.select("id", "level", F.col("id").alias("component")) if components is None else levels.join(components, "id").select("id", "level", "component")
    side = lambda n: group.select(*(F.col(c).alias(f"{c}_{n}") for c in ("id", "level", "component")))
    both = part.edges.select("src", "dst").where("src <> dst").join(side("a"), F.col("src") == F.col("id_a")).join(side("b"), F.col("dst") == F.col("id_b"))
    order = both.where("component_a <> component_b and level_a >= level_b").select(F.lit("order").alias("kind"), F.col("src").alias("id"), F.col("dst").alias("other"))
    mixed = group.join(part.vertices.select("id"), "id", "left_semi").groupBy("component").agg(F.min("level").alias("lo"), F.max("level").alias("hi")).where("lo <> hi").select(F.lit("component").alias("kind"), F.col("component").alias("id"), F.lit(None).cast("long").alias("other"))
    return wrong.unionByName(order).unionByName(mixed)


def verify_topological_levels(graph: PropertyGraph, levels: DataFrame, components: DataFrame | None = None, vertices: Predicate = None, edges: Predicate = None) -> bool:
    return level_violations(graph, levels, components, vertices, edges).isEmpty()
