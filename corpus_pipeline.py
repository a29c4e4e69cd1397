"""From documents to packed training sequences, in four stages.

Each stage takes what its predecessor kept and returns the columns of
``documents`` (the last one the pieces of the packed sequences).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import line_dedup, near_dedup, packing, quality
from weftgraph.llm.common import table
from weftgraph.llm.queries import byte_vocabulary
from weftgraph.plans.durable import durable

LEAST_QUALITY = 0.5
#: Stages on word shingles take five words and this similarity.
SHINGLE_WORDS, LEAST_JACCARD = 5, 0.8


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    model = quality.train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    scored = quality.score(docs, model, score_col="__quality")
    return scored.where(F.col("__quality") >= LEAST_QUALITY).select(*docs.columns)


def new_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that occur before, or nearly, go; a document of which nothing is new stays with an empty text."""
    left = line_dedup.dedup_lines(docs).select(*docs.columns)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are nearly alike the one with the smallest id stays."""
    found = near_dedup.near_documents(docs, LEAST_JACCARD, SHINGLE_WORDS)
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(first, docs["doc_id"].eqNullSafe(first["__kept"]), "left_semi")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    return packing.pack(docs, byte_vocabulary())


STAGES = [("quality classifier", good_documents), ("line dedup", new_lines), ("near dedup", one_of_each), ("packing", packed)]

#: No SQL: the stages score, compare and tokenize beyond what it expresses.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = durable(docs, name.replace(" ", "-"))
    return docs
