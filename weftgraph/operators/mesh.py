"""Triangle and tetrahedron meshes and their dual graphs.

``points``: id, x, y, z; ``cells``: id, point_ids (three or four ids). Further
columns are properties. A cell's dual vertex has the cell's id; cells that
share a face are joined by a dual edge.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.numeric import cross, dot, minus
from weftgraph.operators.graph import PropertyGraph
from weftgraph.plans.ranking import dense_index

#: A flat mesh is looked at from here, and its points lie below.
EYE_HEIGHT = 10.0


@dataclass(frozen=True)
class Mesh:
    points: DataFrame
    cells: DataFrame
    is_3d: bool = False

    @property
    def points_per_cell(self) -> int:
        return 4 if self.is_3d else 3

    def add_points(self, rows: DataFrame) -> Mesh:
        return Mesh(self.points.unionByName(rows, allowMissingColumns=True), self.cells, self.is_3d)

    def add_cells(self, rows: DataFrame) -> Mesh:
        return Mesh(self.points, self.cells.unionByName(rows, allowMissingColumns=True), self.is_3d)

    def faces(self) -> DataFrame:
        """cell, face (sorted ids of all points of the cell but one)."""
        at = F.explode(F.sequence(F.lit(1), F.lit(self.points_per_cell))).alias("k")
        each = self.cells.select(F.col("id").alias("cell"), "point_ids", at)
        return each.select("cell", F.array_sort(F.array_except("point_ids", F.array(F.element_at("point_ids", F.col("k"))))).alias("face"))

    def dual_edges(self) -> DataFrame:
        """eid, src, dst: pairs of cells that share a face, smaller id first; numbered from 1 in that order."""
        pairs = self.faces().groupBy("face").agg(F.min("cell").alias("src"), F.max("cell").alias("dst"), F.count("*").alias("n")).where("n > 1 and src < dst").select("src", "dst").distinct()
        return pairs.join(dense_index(pairs, ["src", "dst"], "eid"), ["src", "dst"]).select("eid", "src", "dst")

    def dual_graph(self) -> PropertyGraph:
        rest = [c for c in self.cells.columns if c not in ("id", "point_ids")]
        return PropertyGraph(self.cells.select("id", *rest), self.dual_edges(), directed=False)

    def neighbours(self) -> DataFrame:
        """id, neighbours: sorted ids of the cells that share a face."""
        return self.dual_graph().neighbours().select("id", "neighbours")

    def depending_cells(self) -> DataFrame:
        """id (of a point), cells: sorted ids of the cells that have it."""
        return self.cells.select(F.explode("point_ids").alias("id"), F.col("id").alias("cell")).groupBy("id").agg(F.sort_array(F.collect_set("cell")).alias("cells"))

    def describe(self) -> DataFrame:
        """Every cell with its points, properties and neighbours."""
        return self.cells.join(self.neighbours(), "id", "left").orderBy("id")

    def find_cells(self, queries: DataFrame) -> DataFrame:
        """query, cell: cells that have all points of a query, from rows (query, point_ids); none for no points.

        Cells meet a query at its first point and are compared there, so that nothing is counted over what met.
        """
        owned = self.cells.select(F.explode(F.array_distinct("point_ids")).alias("point"), F.col("id").alias("cell"), F.col("point_ids").alias("corners"))
        asked = queries.select("query", "point_ids", F.get("point_ids", F.lit(0)).alias("point"))
        has_all = F.forall("point_ids", lambda p: F.array_contains("corners", p))
        return asked.join(owned, "point").where(has_all).select("query", "cell")

    def oriented(self) -> DataFrame:
        """``cells`` with point_ids in order: the two smallest ids first, then turned for a positive volume.

        Null where the points lie in one plane with the fourth (3D) or the eye (2D).
        """
        n = self.points_per_cell
        p = F.col("point_ids")
        # exchange the smallest into the first place, then the smallest of the rest into the second
        first = _exchanged(p, F.lit(1), F.array_position(p, F.array_min(p)))
        cells = self.cells.withColumn("__p", first)
        rest = F.slice("__p", 2, n - 1)
        cells = cells.withColumn("__p", _exchanged(F.col("__p"), F.lit(2), F.array_position(rest, F.array_min(rest)) + 1))
        spot = self.points.select(F.col("id").alias("__pid"), F.struct("x", "y", "z").alias("xyz"))
        placed = cells.select("id", F.posexplode("__p").alias("k", "__pid")).join(spot, "__pid").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "xyz"))).alias("__xyz"))
        at = lambda i: F.get("__xyz", F.lit(i))["xyz"]
        eye = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(EYE_HEIGHT).alias("z"))
        a, b, c = minus(at(1), at(0)), minus(at(2), at(0)), minus(at(3) if self.is_3d else eye, at(0))
        most = lambda v: F.greatest(*(F.abs(v[k]) for k in "xyz"))
        volume = dot(cross(a, b), c)
        least = 10 * 2.220446049250313e-16 * F.greatest(F.lit(1.0), most(a) * most(b) * most(c))
        turned = F.when(volume >= least, F.col("__p")).when(volume <= -least, _exchanged(F.col("__p"), F.lit(2), F.lit(3)))
        rest_cols = [c for c in self.cells.columns if c not in ("id", "point_ids")]
        return cells.join(placed, "id").select("id", turned.alias("point_ids"), *rest_cols)

    def validate(self) -> None:
        n = self.points_per_cell
        ids = self.points.select(F.col("id").alias("point"))
        faults = {
            "a point id occurs twice": self.points.groupBy("id").count().where("count > 1 or id is null"),
            "a point of a flat mesh lies too high": self.points.where(F.lit(not self.is_3d) & (F.col("z") >= EYE_HEIGHT)),
            "a cell has not its number of different points": self.cells.where((F.size("point_ids") != n) | (F.size(F.array_distinct("point_ids")) != n)),
            "a cell has an unknown point": self.cells.select(F.explode("point_ids").alias("point")).join(ids, "point", "left_anti"),
            "a cell occurs twice": self.cells.groupBy(F.array_sort("point_ids")).count().where("count > 1"),
            "a face joins more than two cells": self.faces().groupBy("face").count().where("count > 2"),
            "a cell is degenerate": self.oriented().where("point_ids is null"),
        }
        for what, rows in faults.items():
            if not rows.isEmpty():
                raise ValueError(what)


def _exchanged(array: Column, i: Column, j: Column) -> Column:
    """``array`` with the elements at places ``i`` and ``j`` (from 1) exchanged."""
    return F.transform(array, lambda x, k: F.when(k + 1 == i, F.element_at(array, j.cast("int"))).when(k + 1 == j, F.element_at(array, i.cast("int"))).otherwise(x))
