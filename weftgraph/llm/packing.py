"""Packing by concatenating and cutting.

Pass one tokenizes each partition and writes, beside the ids, where a document
starts within its partition. The totals of the partitions give, by a prefix
sum, where each partition starts in the whole stream. Pass two cuts the stream
into windows of fixed length: a document gives one piece for each window it
touches, so a boundary inside a document leaves a record on either side.
Only the last sequence is not full; it is padded.

The order of the stream is the order of the input's partitions. The token
table is written once, so repeated tasks see the same positions. One number
for each partition reaches the driver.

Defined results: a null text counts as empty and gives the end id alone;
repeated rows are packed each; a very long text is held by one task while its
ids and pieces are made, at a cost in proportion to its length (up to 2^29 ids);
an empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import slices
from weftgraph.llm.tokens import Ids
from weftgraph.plans.durable import durable

WINDOW = 2048
END_ID = 1


@dataclass(frozen=True)
class Vocabulary:
    """A byte-level BPE vocabulary: file for ``tokenizers``, the same as ranks, and the pattern that splits text."""

    tokenizer_path: str
    ranks_path: str
    pattern: str


def tokenized(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit, end id included), part, start within the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, at = Ids(vocabulary.tokenizer_path, vocabulary.ranks_path, vocabulary.pattern), TaskContext.get().partitionId(), 0
        for batch in slices(batches, "text", 3 << 20):
            ids, ends = coder.encode(batch.column("text").to_pylist())
            ends = ends + np.arange(1, len(ends) + 1)
            out, own = np.full(ends[-1], END_ID, "<u4"), np.ones(ends[-1], bool)
            own[ends - 1] = False
            out[own] = ids
            offsets = np.concatenate([[0], ends * 4]).astype(np.int32)
            data = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(out)])
            yield pa.record_batch([batch.column("doc_id"), data, pa.array(np.full(len(ends), part)), pa.array(np.concatenate([[0], ends[:-1]]) + at)], ["doc_id", "ids", "part", "local_start"])
            at += int(ends[-1])

    thin = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = thin.schema["doc_id"].dataType.simpleString()
    return thin.mapInArrow(run, f"doc_id {kind}, ids binary, part long, local_start long")


def pack(docs: DataFrame, vocabulary: Vocabulary, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces: doc_id, start, length, ids (binary), doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    tokens = durable(tokenized(docs, vocabulary, id_col, text_col), "tokens")
    count = F.expr("octet_length(ids) div 4")
    totals = sorted(tokens.groupBy("part").agg(F.sum(count)).collect())
    base = [*accumulate((n for _, n in totals), initial=0)]
    bases = spark.createDataFrame([(p, b) for (p, _), b in zip(totals, base)], "part long, base long")
    placed = tokens.join(F.broadcast(bases), "part").select("doc_id", "ids", count.alias("doc_tokens"), (F.col("base") + F.col("local_start")).alias("begin"))
    # sequences that the document touches; each gives one piece, cut before rows are made, so that a row has its own ids only
    touched = F.expr(f"sequence(begin div {window}, (begin + doc_tokens - 1) div {window})")

    def piece(sequence: Column) -> Column:
        lo = F.greatest(F.col("begin"), sequence * window)
        start, length = lo - F.col("begin"), F.least(F.col("begin") + F.col("doc_tokens"), (sequence + 1) * window) - lo
        ids = F.substring(F.col("ids"), (start * 4 + 1).cast("int"), (length * 4).cast("int"))
        return F.struct(start.alias("start"), length.alias("length"), ids.alias("ids"), sequence.alias("sequence_id"), (lo - sequence * window).alias("offset"))

    pieces = placed.select("doc_id", "doc_tokens", F.explode(F.transform(touched, piece)).alias("piece"))
    return pieces.select("doc_id", "piece.start", "piece.length", "piece.ids", "doc_tokens", "piece.sequence_id", "piece.offset")
