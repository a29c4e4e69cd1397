"""Dense numbers in global order, without a window over one partition."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.plans.durable import durable


def numbered(rows: DataFrame, by: list[str], name: str, start: int = 1) -> DataFrame:
    """``rows`` numbered from ``start`` in the order of ``by``: a range sort, then a prefix sum over partitions."""
    at = F.monotonically_increasing_id()
    placed = durable(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", at), "rank")
    part = F.shiftright("__at", 33)
    sizes = sorted(placed.groupBy(part.alias("p")).agg(F.count("*")).collect())
    first = [*accumulate((n for _, n in sizes), initial=start)]
    bases = rows.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, first)], "__p long, __base long")
    found = placed.withColumn("__p", part).join(F.broadcast(bases), "__p")
    return found.select(*rows.columns, (F.col("__base") + F.col("__at").bitwiseAND((1 << 33) - 1)).alias(name))


def dense_index(values: DataFrame, cols: list[str], name: str, start: int = 1) -> DataFrame:
    """Distinct ``cols`` numbered from ``start`` in their order."""
    return numbered(values.select(*cols).distinct(), cols, name, start)
