"""Sharding over a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns many points of a ring of 64-bit hashes; a key belongs to the
shard of the next point clockwise from its own hash. A shard takes keys up to
its capacity. The keys of an arc that overflow a full shard continue clockwise
to the next shard with room, arc by arc, in rounds: all arcs fill their first
shard, what is left asks the second shard of its arc, and so on. With
``slack`` 0 the capacities add up to the number of rows, so that counts are at
most one apart; with more slack fewer keys leave their home.

Only counts by arc and partition reach the driver: an arc lies in consecutive
partitions, so these are at most as many as arcs (shards x virtual nodes) and
partitions together. A row finds its place from its rank within its arc, which
comes from one range sort and a prefix sum over partition totals.

Defined results: a null text counts as no bytes; a null id hashes like any
other value; repeated rows get slots of their own; an empty table gives an
empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.plans.durable import durable

VIRTUAL_NODES = 64


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> tuple[np.ndarray, np.ndarray]:
    """Sorted points and the shard that owns each; a shard's points don't depend on the number of shards."""
    marks = sorted((xxhash.xxh64_intdigest(f"shard {s} node {v}") - (1 << 63), s) for s in range(shards) for v in range(virtual_nodes))
    return np.array([p for p, _ in marks], np.int64), np.array([s for _, s in marks], np.int64)


def clockwise(owners: np.ndarray) -> list[list[int]]:
    """For each arc the distinct shards in the order in which its keys ask them."""
    out = []
    for a in range(len(owners)):
        out.append(list(dict.fromkeys([*owners[a:].tolist(), *owners[:a].tolist()])))
    return out


def allot(counts: dict[int, int], owners: np.ndarray, capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot): which ranks of an arc go where."""
    orders, left, used, begun, pieces = clockwise(owners), dict(counts), [0] * len(capacity), defaultdict(int), []
    for turn in range(len(capacity)):
        for arc in sorted(left):
            if left[arc]:
                shard = orders[arc][turn]
                take = min(left[arc], capacity[shard] - used[shard])
                if take:
                    pieces.append((arc, begun[arc], begun[arc] + take, shard, used[shard]))
                    used[shard] += take
                    begun[arc] += take
                    left[arc] -= take
    if any(left.values()):
        raise ValueError("capacities are below the number of rows")
    return pieces


def capacities(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    if slack <= 0:
        return [rows // shards + (s < rows % shards) for s in range(shards)]
    return [-int(-(1 + slack) * rows // shards)] * shards


def assign(rows: DataFrame, key: str, shards: int, virtual_nodes: int = VIRTUAL_NODES, slack: float = 0.0) -> DataFrame:
    """``rows`` with shard int and slot long (gapless from 0 within a shard), in place of columns of these names."""
    spark, (points, owners) = rows.sparkSession, ring(shards, virtual_nodes)

    @F.pandas_udf("int")
    def arc_of(point: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(points, point.to_numpy()) % len(points)).astype("int32")

    rows = rows.drop("shard", "slot")
    own = rows.columns
    placed = rows.withColumn("__point", F.xxhash64(F.col(key))).withColumn("__arc", arc_of("__point"))
    by = ["__arc", "__point", *own]
    placed = durable(placed.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()), "ring")
    part, within = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    # totals by arc and partition: an arc lies in few partitions, a partition holds few arcs
    totals = sorted(placed.groupBy("__arc", part.alias("p")).agg(F.count("*"), F.min(within)).collect())
    starts, counts = [], defaultdict(int)
    for arc, p, n, first in totals:
        starts.append((arc, p, counts[arc] - first))
        counts[arc] += n
    pieces = allot(counts, owners, capacities(sum(counts.values()), shards, slack))
    start = spark.createDataFrame(starts, "__arc int, __p long, __shift long")
    piece = spark.createDataFrame(pieces, "__arc int, __lo long, __hi long, shard int, __base long")
    ranked = placed.withColumn("__p", part).join(F.broadcast(start), ["__arc", "__p"]).withColumn("__rank", within + F.col("__shift"))
    found = ranked.join(F.broadcast(piece), (ranked["__arc"] == piece["__arc"]) & (ranked["__rank"] >= piece["__lo"]) & (ranked["__rank"] < piece["__hi"]))
    return found.select(*own, "shard", (F.col("__base") + F.col("__rank") - F.col("__lo")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 8, slack: float = 0.0, virtual_nodes: int = VIRTUAL_NODES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size (UTF-8 bytes and 1), text_crc32, shard, slot for every row."""
    data = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    thin = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    return assign(thin, "doc_id", shards, virtual_nodes, slack)
