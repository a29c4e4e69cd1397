"""Small graphs in one task.

Sequential algorithms run as a kernel over a whole graph when that is proven
small: the edges are counted first, and only up to ``LOCAL_EDGES`` of them go
to a task. Vertices go with them only if they are on an edge, at most two for
each; callers add the others to the result. The kernel runs on an executor, not
on the driver.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOCAL_EDGES = 500_000


def is_local(edges: DataFrame, strategy: str, limit: int = LOCAL_EDGES) -> bool:
    if strategy not in ("auto", "local", "bsp"):
        raise ValueError("strategy is auto, local or bsp")
    if strategy == "bsp":
        return False
    small = edges.limit(limit + 1).count() <= limit
    if strategy == "local" and not small:
        raise ValueError(f"more than {limit} edges; use another strategy")
    return small


def on_edges(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """The ``vertices`` (id, ...) that are an end of the ``edges`` (src, dst)."""
    return vertices.join(edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), "id", "left_semi")


def in_one_task(vertices: DataFrame, edges: DataFrame, kernel: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    one = F.lit(1).alias("__all")
    keyed = lambda df: df.select("*", one).groupBy("__all")
    return keyed(vertices).cogroup(keyed(edges)).applyInPandas(lambda v, e: kernel(v.drop(columns="__all", errors="ignore"), e.drop(columns="__all", errors="ignore")), schema)
