"""VTK unstructured grids (``.vtu``): one piece, appended raw data, little-endian.

A graph is written as points (its vertices) and line cells (its edges); a mesh
as points and triangles or tetrahedra, its dual vertices' fields as cell data.
A file is one piece, so one value: it is coded by one process, and reading
hands each file to one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators.graph import PropertyGraph
from weftgraph.operators.mesh import Mesh
from weftgraph.plans.ranking import dense_index

# Fixed values of the format: names of number types, and codes of cells by their number of points.
TYPES = {"Int8": "<i1", "UInt8": "<u1", "Int16": "<i2", "UInt16": "<u2", "Int32": "<i4", "UInt32": "<u4", "Int64": "<i8", "UInt64": "<u8", "Float32": "<f4", "Float64": "<f8"}
CELL_CODES = {2: 3, 3: 5, 4: 10}


@dataclass(frozen=True)
class FieldSpec:
    """A data array: its name, the columns that are its components, its number type, and on points or cells."""

    name: str
    columns: Sequence[str]
    type: str = "Float64"
    on: str = "point"

    def __post_init__(self) -> None:
        if self.type not in TYPES or self.on not in ("point", "cell") or not self.columns:
            raise ValueError(f"field {self.name} is not one of point or cell data of a known type")


def encode(points: np.ndarray, cells: np.ndarray, point_data: dict[str, tuple[str, np.ndarray]], cell_data: dict[str, tuple[str, np.ndarray]], time: float | None = None) -> bytes:
    """The bytes of a file; ``cells``: one row a cell, places of its points from 0."""
    blocks, at = [], 0

    def array(name: str, kind: str, values: np.ndarray) -> str:
        nonlocal at
        data = np.ascontiguousarray(values, TYPES[kind]).tobytes()
        blocks.append(len(data).to_bytes(8, "little") + data)
        many = values.shape[1] if values.ndim > 1 else 1
        text = f'<DataArray type="{kind}" Name="{name}" NumberOfComponents="{many}" format="appended" offset="{at}"/>\n'
        at += len(blocks[-1])
        return text

    size = cells.shape[1] if cells.ndim == 2 and cells.size else 2
    parts = ['<?xml version="1.0"?>\n<VTKFile type="UnstructuredGrid" version="1.0" byte_order="LittleEndian" header_type="UInt64">\n<UnstructuredGrid>\n']
    if time is not None:
        parts.append(f'<FieldData>\n<DataArray type="Float32" Name="TimeValue" NumberOfTuples="1" format="ascii">\n{np.float32(time)}\n</DataArray>\n</FieldData>\n')
    parts.append(f'<Piece NumberOfPoints="{len(points)}" NumberOfCells="{len(cells)}">\n')
    for tag, data in (("PointData", point_data), ("CellData", cell_data)):
        parts.append(f"<{tag}>\n" + "".join(array(n, k, x) for n, (k, x) in data.items()) + f"</{tag}>\n")
    parts.append("<Points>\n" + array("Points", "Float32", points) + "</Points>\n<Cells>\n")
    parts.append(array("connectivity", "Int32", cells.ravel()) + array("offsets", "Int32", np.arange(1, len(cells) + 1) * size) + array("types", "UInt8", np.full(len(cells), CELL_CODES[size])))
    parts.append('</Cells>\n</Piece>\n</UnstructuredGrid>\n<AppendedData encoding="raw">\n_')
    return "".join(parts).encode() + b"".join(blocks) + b"\n</AppendedData>\n</VTKFile>\n"


def decode(raw: bytes) -> dict:
    """points, cells, point_data, cell_data, time of a file; blocks are found by their declared offsets and sizes."""
    mark = re.search(rb"<AppendedData[^>]*>\s*_", raw)
    if not mark:
        raise ValueError("no appended data")
    root = ElementTree.fromstring(raw[: mark.start()] + b"</VTKFile>")
    if root.get("type") != "UnstructuredGrid" or root.get("byte_order", "LittleEndian") != "LittleEndian":
        raise ValueError("not a little-endian unstructured grid")
    head = {"UInt64": 8, "UInt32": 4}[root.get("header_type", "UInt32")]

    def values(node: ElementTree.Element) -> np.ndarray:
        if node.get("format") == "ascii":
            return np.array((node.text or "").split(), TYPES[node.get("type")])
        if node.get("format") != "appended":
            raise ValueError("only appended and ascii arrays can be read")
        at = mark.end() + int(node.get("offset"))
        size = int.from_bytes(raw[at : at + head], "little")
        got = np.frombuffer(raw, TYPES[node.get("type")], size // np.dtype(TYPES[node.get("type")]).itemsize, at + head)
        many = int(node.get("NumberOfComponents", "1"))
        return got.reshape(-1, many) if many > 1 else got

    grid = root.find("UnstructuredGrid")
    piece = grid.find("Piece")
    n_points, n_cells = int(piece.get("NumberOfPoints")), int(piece.get("NumberOfCells"))
    own = {x.get("Name"): values(x) for x in piece.find("Cells")}
    points = values(piece.find("Points")[0])
    ends = own["offsets"].astype(int)
    sizes = np.diff(ends, prepend=0)
    if len(points) != n_points or len(ends) != n_cells or len(set(sizes.tolist())) > 1 or n_cells and ends[-1] != len(own["connectivity"]):
        raise ValueError("sizes in the file disagree")
    size = int(sizes[0]) if n_cells else 2
    if size not in CELL_CODES or n_cells and (own["types"] != CELL_CODES[size]).any():
        raise ValueError("cells are not all lines, triangles or tetrahedra")
    arrays = lambda tag: {x.get("Name"): values(x) for x in (piece.find(tag) if piece.find(tag) is not None else ())}
    time = next((float(values(x)[0]) for x in grid.iterfind("FieldData/DataArray") if x.get("Name") == "TimeValue"), None)
    return {"points": points, "cells": own["connectivity"].reshape(-1, size), "point_data": arrays("PointData"), "cell_data": arrays("CellData"), "time": time}


def _data(frame: pd.DataFrame, fields: Sequence[FieldSpec], on: str) -> dict[str, tuple[str, np.ndarray]]:
    take = lambda f: frame[list(f.columns)].to_numpy() if len(f.columns) > 1 else frame[f.columns[0]].to_numpy()
    return {f.name: (f.type, take(f)) for f in fields if f.on == on}


def _write(spark: SparkSession, path: str, data: bytes) -> None:
    path = path if path.endswith(".vtu") else path + ".vtu"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def write_graph(graph: PropertyGraph, path: str, position: Sequence[str] = ("x", "y", "z"), fields: Sequence[FieldSpec] = (), time: float | None = None) -> None:
    """Vertices in order of id as points, edges in order of eid as line cells."""
    place = dense_index(graph.vertices.select("id"), ["id"], "at", start=0)
    v = graph.vertices.join(place, "id").orderBy("at").toPandas()
    ends = graph.edges.join(place.select(F.col("id").alias("src"), F.col("at").alias("__a")), "src").join(place.select(F.col("id").alias("dst"), F.col("at").alias("__b")), "dst").orderBy("eid").toPandas()
    _write(graph.vertices.sparkSession, path, encode(v[list(position)].to_numpy().reshape(-1, 3), ends[["__a", "__b"]].to_numpy(), _data(v, fields, "point"), _data(ends, fields, "cell"), time))


def write_mesh(mesh: Mesh, path: str, fields: Sequence[FieldSpec] = (), time: float | None = None) -> None:
    """Points and cells in order of id; cell fields are columns of ``cells``."""
    place = dense_index(mesh.points.select("id"), ["id"], "at", start=0)
    p = mesh.points.join(place, "id").orderBy("at").toPandas()
    ids = mesh.cells.select(F.col("id"), F.posexplode("point_ids").alias("k", "pid")).join(place.select(F.col("id").alias("pid"), "at"), "pid").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "at"))), lambda x: x["at"]).alias("__at"))
    c = mesh.cells.join(ids, "id").orderBy("id").toPandas()
    _write(mesh.points.sparkSession, path, encode(p[["x", "y", "z"]].to_numpy().reshape(-1, 3), np.array(c["__at"].tolist(), int).reshape(-1, mesh.points_per_cell), _data(p, fields, "point"), _data(c, fields, "cell"), time))


def read_tables(spark: SparkSession, path: str, fields: Sequence[FieldSpec] = ()) -> tuple[DataFrame, DataFrame]:
    """Points (file, id, x, y, z, fields) and cells (file, id, point_ids, fields) of the files at ``path``, ids from 1.

    Fields that a file lacks, or has with another number of components, are null.
    """

    def reader(on: str):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for name, raw in zip(b["path"], b["content"]):
                    got = decode(bytes(raw))
                    base = got["points"] if on == "point" else got["cells"]
                    frame = {"file": name, "id": np.arange(1, len(base) + 1)}
                    if on == "point":
                        frame |= {c: base[:, i].astype(float) for i, c in enumerate("xyz")}
                    else:
                        frame["point_ids"] = (base.astype(np.int64) + 1).tolist()
                    for f in (f for f in fields if f.on == on):
                        data = got[f"{on}_data"].get(f.name)
                        fits = data is not None and (data.shape[1] if data.ndim > 1 else 1) == len(f.columns)
                        for i, c in enumerate(f.columns):
                            column = (data[:, i] if data.ndim > 1 else data) if fits else np.full(len(base), np.nan)
                            frame[c] = column.astype(float) if f.type.startswith("Float") or not fits else column.astype(np.int64)
                    yield pd.DataFrame(frame, columns=["file", "id", *(["x", "y", "z"] if on == "point" else ["point_ids"]), *(c for f in fields if f.on == on for c in f.columns)])

        extra = "".join(f", `{c}` {'double' if f.type.startswith('Float') else 'long'}" for f in fields if f.on == on for c in f.columns)
        own = "x double, y double, z double" if on == "point" else "point_ids array<long>"
        return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, f"file string, id long, {own}{extra}")

    return reader("point"), reader("cell")


def _one_file(points: DataFrame, path: str) -> None:
    if points.select("file").distinct().limit(2).count() > 1:
        raise ValueError(f"several files at {path}: their ids would collide; use read_tables")


def read_graph(spark: SparkSession, path: str, fields: Sequence[FieldSpec] = (), directed: bool = False) -> PropertyGraph:
    """A file of line cells. The format does not keep the direction flag."""
    points, cells = read_tables(spark, path, fields)
    _one_file(points, path)
    rest = [c for f in fields if f.on == "cell" for c in f.columns]
    edges = cells.select(F.col("id").alias("eid"), F.get("point_ids", F.lit(0)).alias("src"), F.get("point_ids", F.lit(1)).alias("dst"), *rest)
    return PropertyGraph(points.drop("file"), edges, directed)


def read_mesh(spark: SparkSession, path: str, fields: Sequence[FieldSpec] = ()) -> Mesh:
    points, cells = read_tables(spark, path, fields)
    _one_file(points, path)
    first = cells.select(F.size("point_ids").alias("n")).first()
    return Mesh(points.drop("file"), cells.drop("file"), is_3d=first is not None and first.n == 4)


def read_time(spark: SparkSession, path: str) -> float | None:
    row = spark.read.format("binaryFile").load(path).select("content").first()
    return decode(bytes(row.content))["time"]
