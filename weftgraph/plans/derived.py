"""Graphs derived from the tables, as (src, dst, weight) edges and a direction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.operators.graph import PropertyGraph
from weftgraph.plans.durable import durable

#: Suppliers follow parts in one id range.
SUPPLIER_BASE = 1_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_supplier(spark: SparkSession, sf_dir: str, where: str = "true", held: bool = False) -> PropertyGraph:
    """Parts and suppliers joined by a line item; the edge id is a function of its ends.

    With ``held`` the edges are written once, for operators that read the graph in several jobs.
    """
    pairs = table(spark, sf_dir, "lineitem").where(where).select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + SUPPLIER_BASE).alias("dst")).distinct()
    return PropertyGraph.from_edges((durable(pairs, "pairs") if held else pairs).withColumn("eid", F.col("src") * SUPPLIER_BASE + F.col("dst")), directed=False)


def nations(spark: SparkSession, sf_dir: str, directed: bool, top: int = 3) -> PropertyGraph:
    """Nations that trade: the ``top`` partners of each by quantity; as undirected edges a < b, or arcs between different ones.

    The edges are written: all that reads the graph would join the line items anew each time. Orders meet their
    customers before line items meet orders, so that line items are dealt out once less.
    """
    of = lambda t, key, nation, name: table(spark, sf_dir, t).select(key, F.col(nation).cast("long").alias(name))
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    ordered = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(of("customer", "c_custkey", "c_nationkey", "src"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "src")
    trade = line.join(ordered, F.col("l_orderkey") == F.col("o_orderkey")).join(of("supplier", "s_suppkey", "s_nationkey", "dst"), F.col("l_suppkey") == F.col("s_suppkey"))
    sums = trade.where("src <> dst" if directed else "src < dst").groupBy("src", "dst").agg(F.sum("l_quantity").alias("weight"))
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst"))
    edges = sums.withColumn("r", rank).where(F.col("r") <= top).select((F.col("src") * 100 + F.col("dst")).alias("eid"), "src", "dst", "weight")
    vertices = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").cast("int").alias("region"))
    return PropertyGraph(vertices, durable(edges, "nations"), directed)


def users(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """A user leads to the user of the next purchase of the day."""
    bought = table(spark, sf_dir, "events").where(F.col("event_type") == "purchase").select("user_id", "ts", "event_id")
    order = Window.partitionBy(F.to_date("ts")).orderBy("ts", "event_id")
    nxt = bought.withColumn("dst", F.lead("user_id").over(order)).where("dst is not null and dst <> user_id")
    pairs = nxt.select(F.col("user_id").alias("src"), "dst").distinct()
    return PropertyGraph.from_edges(pairs.withColumn("eid", F.col("src") * SUPPLIER_BASE + F.col("dst")), directed=True)


def conversation_turns(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Turns, each leading to the next of its conversation."""
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 10000 + F.col("turn")).alias("id"), "conv_id", "turn")
    nxt = rows.select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).join(rows.select(F.col("id").alias("dst")), "dst", "left_semi")
    return PropertyGraph(rows.select("id", "conv_id"), nxt.select(F.col("src").alias("eid"), "src", "dst"), directed=True)
