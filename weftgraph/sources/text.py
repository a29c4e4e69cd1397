"""Plain text sources: lines, numbers, character matrices and graph fixtures."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.strings import to_long
from weftgraph.operators.graph import PropertyGraph
from weftgraph.plans.durable import durable
from weftgraph.plans.ranking import numbered


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """line (from 1), value, in the order of the file; several files follow each other in order of their paths.

    Tasks read blocks of a file; a line's number comes from its place within its
    block and a prefix sum over the blocks, of which only counts reach the driver.
    """
    block = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    read = spark.read.option("lineSep", "\n").text(path).select(F.regexp_replace("value", r"\r\z", "").alias("value"), *block)
    placed = durable(read.withColumn("at", F.monotonically_increasing_id()), "lines")
    sizes = sorted(placed.groupBy("file", "start").agg(F.count("*"), F.min("at")).collect())
    before = accumulate((n for _, _, n, _ in sizes), initial=1)
    bases = spark.createDataFrame([(file, start, base - first) for (file, start, _, first), base in zip(sizes, before)], "file string, start long, base long")
    return placed.join(bases, ["file", "start"]).select((F.col("base") + F.col("at")).alias("line"), "value")


def count_lines(spark: SparkSession, path: str) -> int:
    """Lines of a file, empty ones too."""
    return spark.read.option("lineSep", "\n").text(path).count()


def count_lines_block(spark: SparkSession, path: str) -> DataFrame:
    """block (from 1), lines: how many lines each block has; every blank line ends a block, so blocks can be empty."""
    rows = _lines(spark, path)
    ends = numbered(rows.where(F.trim("value") == "").select("line"), ["line"], "block")
    last = spark.createDataFrame([((rows.agg(F.max("line")).first()[0] or 0) + 1, ends.count() + 1)], "line long, block long")
    bounds = durable(ends.unionByName(last), "ends")
    begun = bounds.select((F.col("block") + 1).alias("block"), F.col("line").alias("begin"))
    return bounds.join(begun, "block", "left").select("block", (F.col("line") - F.coalesce("begin", F.lit(0)) - 1).alias("lines"))


def read_strings(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark, path)


def read_numbers(spark: SparkSession, path: str) -> DataFrame:
    """line, value: one integer a line; null where a line is none. Blank lines are left out."""
    return _lines(spark, path).where(F.trim("value") != "").select("line", to_long(F.trim("value")).alias("value"))


def read_pattern(spark: SparkSession, path: str, trailing_spaces: bool = True) -> DataFrame:
    """row, column (from 1), value: the characters of a matrix. Rows of different lengths are an error."""
    rows = _lines(spark, path)
    if not trailing_spaces:
        rows = rows.withColumn("value", F.rtrim("value"))
    if rows.select(F.length("value")).distinct().count() > 1:
        raise ValueError("rows have different lengths")
    chars = rows.where("value <> ''").select(F.col("line").alias("row"), F.posexplode(F.split("value", "")).alias("column", "value"))
    return chars.select("row", (F.col("column") + 1).alias("column"), "value")


@dataclass
class Fixture:
    """One graph of a fixture file and what its file expects of it."""

    title: str = ""
    directed: bool = False
    vertices: list[tuple[float, float, float]] = field(default_factory=list)
    edges: list[tuple[int, int, float]] = field(default_factory=list)
    values: dict[str, list[float]] = field(default_factory=dict)

    def graph(self, spark: SparkSession, directed: bool | None = None) -> PropertyGraph:
        """Vertices 1 to the number listed, or to the largest end where none are."""
        n = max([len(self.vertices), *(max(a, b) for a, b, _ in self.edges)])
        spots = self.vertices + [(0.0, 0.0, 0.0)] * (n - len(self.vertices))
        v = spark.createDataFrame([(i, *xyz) for i, xyz in enumerate(spots, 1)], "id long, x double, y double, z double")
        e = spark.createDataFrame([(i, *abw) for i, abw in enumerate(self.edges, 1)], "eid long, src long, dst long, weight double")
        return PropertyGraph(v, e, self.directed if directed is None else directed)


LISTS = ("SOURCES", "SINKS", "EXPECTED_VB", "EXPECTED_EB", "EXPECTED_MAXFLOW", "EXPECTED_MINCUT", "EXPECTED_SET_A", "EXPECTED_SET_B", "EXPECTED_SCC")


def parse_fixtures(text: str) -> list[Fixture]:
    """The graphs of a fixture text: keyword lines, then ``VERTICES`` and ``EDGES`` blocks that a blank line ends."""
    out, now, block = [], Fixture(), ""
    for raw in [*text.splitlines(), ""]:
        words = raw.split()
        if not words:
            if block == "EDGES":
                out.append(now)
                now = Fixture()
            block = ""
        elif words[0].startswith("#"):
            now.title = raw.strip().lstrip("#").strip()
        elif words[0] in ("VERTICES", "EDGES"):
            block = words[0]
        elif words[0] == "DIRECTED":
            now.directed = True
        elif words[0] in LISTS:
            now.values[words[0]] = [float(x) for x in words[1:]]
        elif block == "VERTICES":
            now.vertices.append(tuple(map(float, words[:3])))
        elif block == "EDGES":
            now.edges.append((int(words[0]), int(words[1]), float(words[2]) if len(words) > 2 else 1.0))
        else:
            raise ValueError(f"unknown keyword {words[0]}")
    return out


def read_fixtures(spark: SparkSession, path: str) -> list[Fixture]:
    return parse_fixtures("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
