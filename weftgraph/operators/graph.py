"""The property graph: two DataFrames and a direction flag.

``vertices`` has a key ``id`` (long), ``edges`` has ``eid``, ``src`` and
``dst`` (long); all further columns are properties of any type. A graph is
immutable: every change returns a new one, and nothing runs before an action.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.plans.ranking import dense_index, numbered

Predicate = Column | str | None


def _chosen(df: DataFrame, predicate: Predicate) -> DataFrame:
    return df if predicate is None else df.where(predicate)


def _by_ends(edges: DataFrame, predicate: Predicate) -> DataFrame | None:
    """The ``edges`` both of whose ends satisfy a predicate on vertices, without a join: for one in SQL on the id
    alone, where every edge ends at vertices. None for other predicates."""
    if not isinstance(predicate, str) or "id" in map(str.lower, edges.columns):
        return None
    try:
        tried = edges.sparkSession.range(0).where(predicate)._jdf.queryExecution().analyzed()
        if not tried.condition().deterministic() or not tried.subqueries().isEmpty():
            return None
        for end in ("src", "dst"):
            edges = edges.withColumn("id", F.col(end)).where(predicate).drop("id")
    except AnalysisException:  # it is on properties
        return None
    return edges


@dataclass(frozen=True)
class PropertyGraph:
    vertices: DataFrame
    edges: DataFrame
    directed: bool = False
    #: Whether every edge is known to end at vertices of the graph.
    whole: bool = False

    # construction

    @staticmethod
    def empty(spark: SparkSession, vertex_properties: str = "", edge_properties: str = "", directed: bool = False) -> PropertyGraph:
        """A graph without vertices; properties as in a DDL column list."""
        tail = lambda x: f", {x}" if x else ""
        return PropertyGraph(spark.createDataFrame([], "id long" + tail(vertex_properties)), spark.createDataFrame([], "eid long, src long, dst long" + tail(edge_properties)), directed)

    @staticmethod
    def from_edges(edges: DataFrame, directed: bool = False, vertices: DataFrame | None = None, fill_ids: bool = False) -> PropertyGraph:
        """From rows (src, dst, ...). Without ``vertices`` the ends are the vertices; with ``fill_ids`` all
        numbers from 1 to the largest end are. Without ``eid`` edges are numbered in order of (src, dst),
        parallel ones too; their order among each other is open."""
        edges = edges.withColumns({c: F.col(c).cast("long") for c in ("src", "dst")})
        if "eid" not in edges.columns:
            edges = numbered(edges, ["src", "dst"], "eid")
        own = vertices is None
        if vertices is None and fill_ids:
            top = edges.agg(F.max(F.greatest("src", "dst"))).first()[0] or 0
            vertices = edges.sparkSession.range(1, top + 1)
        elif vertices is None:
            vertices = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        rest = [c for c in edges.columns if c not in ("eid", "src", "dst")]
        edges = edges.select("eid", "src", "dst", *rest)
        return PropertyGraph(vertices, edges.where("src is not null and dst is not null") if own else edges, directed, own and not fill_ids)

    # views

    def arcs(self) -> DataFrame:
        """src, dst, eid, orientation (1 along the edge, -1 against it) and properties; both ways if undirected."""
        rest = [c for c in self.edges.columns if c not in ("eid", "src", "dst")]
        ways = [F.struct("src", "dst", F.lit(1).alias("orientation"))]
        if not self.directed:
            ways.append(F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(-1).alias("orientation")))
        return self.edges.select("eid", *rest, F.explode(F.array(*ways)).alias("way")).select("way.src", "way.dst", "eid", "way.orientation", *rest)

    def degrees(self) -> DataFrame:
        """id, out_degree, in_degree, degree for every vertex; an undirected edge counts as one for either end."""
        ends = self.edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")).select("x.*")
        if not self.directed:
            ends = ends.select("id", F.lit(1).alias("o"), F.lit(1).alias("i"))
        count = ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
        zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        both = self.vertices.select("id").join(count, "id", "left").select("id", zero("out_degree"), zero("in_degree"))
        return both.withColumn("degree", F.col("out_degree") + F.col("in_degree") if self.directed else F.col("out_degree"))

    def neighbours(self) -> DataFrame:
        """id, neighbours (sorted ids at the other end of outgoing edges), outgoing (sorted edge ids)."""
        return self.arcs().groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_set("dst")).alias("neighbours"), F.sort_array(F.collect_list("eid")).alias("outgoing"))

    def find_edges(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` (a, b) with eid, null where no edge leads from a to b (or between them if undirected)."""
        ways = self.arcs().select(F.col("src").alias("a"), F.col("dst").alias("b"), "eid")
        return pairs.join(ways, ["a", "b"], "left")

    def other_ends(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` (eid, id) with ``other``: the opposite end of the edge; null if the vertex is not on it."""
        e = self.edges.select("eid", "src", "dst")
        other = F.when(F.col("src") == F.col("id"), F.col("dst")).when(F.col("dst") == F.col("id"), F.col("src"))
        return pairs.join(e, "eid", "left").withColumn("other", other).select(*pairs.columns, "other")

    # selection

    def select_vertices(self, predicate: Predicate = None) -> DataFrame:
        return _chosen(self.vertices, predicate).select("id").orderBy("id")

    def select_edges(self, predicate: Predicate = None) -> DataFrame:
        """Ids of edges that satisfy the predicate, whatever their ends."""
        return _chosen(self.edges, predicate).select("eid").orderBy("eid")

    def subgraph(self, vertices: Predicate = None, edges: Predicate = None) -> PropertyGraph:
        """Selected vertices, and selected edges both of whose ends are selected."""
        keep, kept = _chosen(self.vertices, vertices), _chosen(self.edges, edges)
        if self.whole and vertices is None:
            return PropertyGraph(keep, kept, self.directed, True)
        if self.whole and (inner := _by_ends(kept, vertices)) is not None:
            return PropertyGraph(keep, inner, self.directed, True)
        ids = keep.select("id")
        for end in ("src", "dst"):
            kept = kept.join(ids.withColumnRenamed("id", "__end"), kept[end] == F.col("__end"), "left_semi")
        return PropertyGraph(keep, kept, self.directed, True)

    def copy(self, vertices: Predicate = None, edges: Predicate = None) -> tuple[PropertyGraph, DataFrame, DataFrame]:
        """The subgraph with ids renumbered from 1 in order, and the maps (old, new) of vertices and edges."""
        part = self.subgraph(vertices, edges)
        v = dense_index(part.vertices.select("id"), ["id"], "new").withColumnRenamed("id", "old")
        e = dense_index(part.edges.select("eid"), ["eid"], "new").withColumnRenamed("eid", "old")
        new_v = part.vertices.join(v, F.col("id") == F.col("old")).withColumn("id", F.col("new")).drop("old", "new")
        new_e = part.edges.join(e, F.col("eid") == F.col("old")).withColumn("eid", F.col("new")).drop("old", "new")
        for end in ("src", "dst"):
            new_e = new_e.join(v, F.col(end) == F.col("old")).withColumn(end, F.col("new")).drop("old", "new")
        return PropertyGraph(new_v, new_e, self.directed), v, e

    # changes

    def add_vertices(self, rows: DataFrame) -> PropertyGraph:
        return PropertyGraph(self.vertices.unionByName(rows, allowMissingColumns=True), self.edges, self.directed)

    def add_edges(self, rows: DataFrame, check: bool = False) -> PropertyGraph:
        """With more edges; with ``check``, a ValueError if one of them ends at no vertex, is an undirected loop or
        runs beside another edge."""
        grown = PropertyGraph(self.vertices, self.edges.unionByName(rows, allowMissingColumns=True), self.directed)
        if check:
            new = PropertyGraph(self.vertices, rows, self.directed)
            ends = lambda e: e.select(*(f("src", "dst").alias(n) for f, n in ((F.least, "a"), (F.greatest, "b"))))
            beside = grown.duplicate_edges()
            if not self.directed:
                _refuse("an undirected edge is a loop", rows.where("src = dst"))
                beside = beside.join(ends(rows), ["a", "b"], "left_semi")
            else:
                beside = beside.join(rows.select(F.col("src").alias("a"), F.col("dst").alias("b")), ["a", "b"], "left_semi")
            _refuse("an edge ends at no vertex", new.orphaned_edges())
            _refuse("two edges are parallel", beside)
        return grown

    def index_of(self, ids: DataFrame, kind: str = "vertex") -> DataFrame:
        """``ids`` (rows id) with ``found``: whether the graph has such a vertex, or edge if ``kind`` is "edge"."""
        own = self.vertices.select("id") if kind == "vertex" else self.edges.select(F.col("eid").alias("id"))
        return ids.join(own.withColumn("found", F.lit(True)), "id", "left").withColumn("found", F.coalesce("found", F.lit(False)))

    @property
    def points_per_cell(self) -> int:
        """Ends of an edge, which takes the place of a mesh's cell."""
        return 2

    def remove_vertices(self, ids: DataFrame) -> PropertyGraph:
        """Without these vertices and their edges; if directed, only outgoing ones go and incoming ones dangle."""
        gone = ids.select(F.col("id").alias("__gone")).distinct()
        edges = self.edges
        for end in ("src",) if self.directed else ("src", "dst"):
            edges = edges.join(gone, edges[end] == F.col("__gone"), "left_anti")
        return PropertyGraph(self.vertices.join(gone, self.vertices["id"] == F.col("__gone"), "left_anti"), edges, self.directed)

    def remove_edges(self, eids: DataFrame) -> PropertyGraph:
        return PropertyGraph(self.vertices, self.edges.join(eids.select("eid"), "eid", "left_anti"), self.directed)

    def orphaned_edges(self) -> DataFrame:
        """Edges with an end that is no vertex."""
        marked = self.edges
        for end in ("src", "dst"):
            ids = self.vertices.select(F.col("id").alias(f"__{end}"))
            marked = marked.join(ids, marked[end] == F.col(f"__{end}"), "left")
        return marked.where("__src is null or __dst is null").drop("__src", "__dst")

    def remove_orphaned_edges(self) -> tuple[PropertyGraph, int]:
        gone = self.orphaned_edges().select("eid")
        return self.remove_edges(gone), gone.count()

    # checks

    def duplicate_edges(self) -> DataFrame:
        """Pairs (a, b) with more than one edge, and the number; ends in any order if undirected."""
        a, b = (F.col("src"), F.col("dst")) if self.directed else (F.least("src", "dst"), F.greatest("src", "dst"))
        return self.edges.groupBy(a.alias("a"), b.alias("b")).agg(F.count("*").alias("n_edges")).where("n_edges > 1")

    def validate(self) -> None:
        """ValueError unless ids are unique, ends exist, no two edges are parallel and no undirected edge is a loop."""
        faults = {
            "a vertex id occurs twice": self.vertices.groupBy("id").count().where("count > 1 or id is null"),
            "an edge id occurs twice": self.edges.groupBy("eid").count().where("count > 1 or eid is null"),
            "an edge ends at no vertex": self.orphaned_edges(),
            "two edges are parallel": self.duplicate_edges(),
        }
        if not self.directed:
            faults["an undirected edge is a loop"] = self.edges.where("src = dst")
        for what, rows in faults.items():
            _refuse(what, rows)

    def describe(self) -> DataFrame:
        """Every vertex with its properties, neighbours and outgoing edges."""
        return self.vertices.join(self.neighbours(), "id", "left").orderBy("id")


def _refuse(what: str, rows: DataFrame) -> None:
    if not rows.isEmpty():
        raise ValueError(what)


def column_check(df: DataFrame, names: Sequence[str]) -> None:
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)}")
