"""Intermediates that outlive an executor.

Iterative operators cut their lineage by writing a Parquet table below the
folder that the session names in ``spark.checkpoint.dir``; every executor can
read it again whoever wrote it.
"""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
#: Spark's setting that drops an execution's shuffle files at its end; the written table replaces them.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_PATH = "_weftgraph_path"
_fallback: dict[str, str] = {}
_writing = threading.RLock()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one where none is set (local mode)."""
    named = spark.conf.get(_SETTING, None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError(f"set {_SETTING} to a folder that all executors share")
        _fallback[app] = tempfile.mkdtemp(prefix="weftgraph-")
    return _fallback[app]


def durable(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of what was written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with _writing:  # the setting belongs to the session: threads that share one take turns
        before = spark.conf.get(_CLEANUP, "false")
        spark.conf.set(_CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__[_PATH] = path
    return out


def drop_durable(df: DataFrame) -> None:
    """Delete the table behind a frame that ``durable`` returned and that no plan needs any more."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.__dict__[_PATH])
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """``durable`` for tables that are needed within a ``with`` block only, and dropped at its end."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def __call__(self, df: DataFrame, label: str = "step") -> DataFrame:
        self.tables.append(durable(df, label))
        return self.tables[-1]

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        for t in self.tables:
            drop_durable(t)
        self.tables = []
