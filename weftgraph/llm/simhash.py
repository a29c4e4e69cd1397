"""SimHash near-dedup by anchor-point covering.

A fingerprint has 64 bits by majority over the hashes of a text's word
shingles. To find all fingerprints within ``THRESHOLD`` bits of each other
without comparing everything, the words of a covering code serve as anchors:
the product of two perfect binary Golay codes over 46 of the bits, whose
covering radius is 3 in either block of 23 bits. Two fingerprints within the
threshold have a midpoint that half the threshold separates from each; the
anchor that covers the midpoint is within the covering radius plus half the
threshold of both, the excess over the radius counted over both blocks
together. Each distinct fingerprint is sent to every such anchor (about 61 of
16.8 million) and compared, on all 64 bits, with what else has come there.

Equal fingerprints are one from the start, so copies cost nothing. An anchor
reports a spanning set of its links, never all pairs. An anchor with more than
``most_held`` fingerprints is dealt over tasks by pairs of chunks, so that no
task holds more than two chunks and no link is lost. Groups are the connected
components of the links.

Defined results: a text without words has fingerprint zero and is linked like
any other; a null text counts as empty; rows that share an id are one document
in the groups; a null id cannot name a group unless no member has one. An empty
table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from weftgraph.llm.common import slices
from weftgraph.operators.components import min_reachable
from weftgraph.plans.durable import durable

SHINGLE_WORDS, THRESHOLD, SEED = 4, 4, 42
# The binary Golay code of length 23 and its generator x^11+x^10+x^6+x^5+x^4+x^2+1.
LENGTH, CHECKS, RADIUS, GENERATOR = 23, 11, 3, 0b110001110101
MOST_HELD = 4096


def fingerprint(text: str, shingle_words: int = SHINGLE_WORDS) -> int:
    words = text.encode().lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    line, n = b" ".join(words), max(1, len(words) - shingle_words + 1)
    ends = [*accumulate(len(w) + 1 for w in words)]
    starts = [0, *ends[: n - 1]]
    last = ends[-n:]
    hashes = np.fromiter((xxh64_intdigest(line[a : b - 1], SEED) for a, b in zip(starts, last)), np.uint64, n)
    ones = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            fps = np.array([fingerprint(t, shingle_words) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.record_batch([b.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    thin = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return thin.mapInArrow(run, f"doc_id {thin.schema['doc_id'].dataType.simpleString()}, fp long")


class Anchors:
    """For a block of 23 bits: the code words within the radius plus an excess, by syndrome."""

    def __init__(self, most_excess: int):
        self.most = most_excess
        bits = [1]
        for _ in range(LENGTH - 1):
            x = bits[-1] << 1
            bits.append(x ^ GENERATOR if x >> CHECKS else x)
        self.byte = np.zeros((3, 256), np.int64)
        for k in range(3):
            for v in range(256):
                for j in range(8):
                    if v >> j & 1 and 8 * k + j < LENGTH:
                        self.byte[k, v] ^= bits[8 * k + j]
        rows = []
        for weight in range(RADIUS + most_excess + 1):
            for places in combinations(range(LENGTH), weight):
                error = syndrome = 0
                for i in places:
                    error |= 1 << i
                    syndrome ^= bits[i]
                rows.append((syndrome, max(0, weight - RADIUS), error))
        rows.sort()
        self.error = np.array([r[2] for r in rows], np.int64)
        count = np.zeros((1 << CHECKS, most_excess + 1), np.int64)
        np.add.at(count, ([r[0] for r in rows], [r[1] for r in rows]), 1)
        flat = np.concatenate([[0], np.cumsum(count.ravel())])
        self.count, self.first = count, flat[:-1].reshape(count.shape)
        self.upto = np.cumsum(count, axis=1)

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        return self.byte[0][words & 255] ^ self.byte[1][words >> 8 & 255] ^ self.byte[2][words >> 16 & 255]

    def of(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``fps``, anchor) of every anchor that each fingerprint goes to."""
        mask = (1 << LENGTH) - 1
        w1, w2 = (fps & np.uint64(mask)).astype(np.int64), (fps >> np.uint64(LENGTH) & np.uint64(mask)).astype(np.int64)
        s1, s2 = self.syndrome(w1), self.syndrome(w2)
        who, anchors = [], []
        for excess in range(self.most + 1):
            c1, c2 = self.count[s1, excess], self.upto[s2, self.most - excess]
            n = c1 * c2
            i = np.repeat(np.arange(len(fps)), n)
            k = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
            e1 = self.error[self.first[s1, excess][i] + k // c2[i]]
            e2 = self.error[self.first[s2, 0][i] + k % c2[i]]
            who.append(i)
            anchors.append((w1[i] ^ e1) >> CHECKS | (w2[i] ^ e2) >> CHECKS << (LENGTH - CHECKS))
        return np.concatenate(who), np.concatenate(anchors)


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same values as (a, b) do, fewer than there are values."""
    values, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    if len(a) < len(values):
        return a, b
    i, j = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(values))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    own = np.flatnonzero(label != np.arange(len(values)))
    return values[own], values[label[own]]


def _compared(keys: np.ndarray, fps: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among equal keys (sorted), compared at distance 1, 2, ... in the order."""
    a, b, at, lag = [], [], np.arange(len(keys)), 0
    while len(at):
        lag += 1
        at = at[at + lag < len(keys)]
        at = at[keys[at] == keys[at + lag]]
        near = at[np.bitwise_count(fps[at] ^ fps[at + lag]) <= threshold]
        a.append(near)
        b.append(near + lag)
        if lag % 256 == 0 and sum(map(len, a)) > 1 << 18:
            x, y = spanning(np.concatenate(a), np.concatenate(b))
            a, b = [x], [y]
    if not a:
        return fps[:0], fps[:0]
    return spanning(fps[np.concatenate(a)], fps[np.concatenate(b)])


def _links(placed: DataFrame, keys: list[str], threshold: int, most_held: int | None) -> DataFrame:
    """a, b: linked fingerprints; or a fingerprint, its chunk and its key where more than ``most_held`` meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f, hot, sent = np.empty((0, len(keys)), np.int64), np.empty(0, np.uint64), None, 0

        def out(a: np.ndarray, b: np.ndarray, key: int | None) -> pa.RecordBatch:
            return pa.record_batch([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array([key] * len(a), pa.int64())], ["a", "b", "hot"])

        def groups(k: np.ndarray) -> np.ndarray:
            return np.concatenate([[0], np.cumsum((k[1:] != k[:-1]).any(1))]) if len(k) else np.empty(0, np.int64)

        for batch in batches:
            if not batch.num_rows:
                continue
            k = np.column_stack([batch.column(c).to_numpy().astype(np.int64) for c in keys])
            f = batch.column("fp").to_numpy().view(np.uint64)
            if hot is not None:
                same = int(np.argmin(np.append((k[:, 0] == hot), False)))
                if same:
                    yield out(f[:same].view(np.int64), (sent + np.arange(same)) // most_held, hot)
                    sent, k, f = sent + same, k[same:], f[same:]
                if not len(k):
                    continue
                hot = None
            k, f = np.concatenate([held_k, k]), np.concatenate([held_f, f])
            g = groups(k)
            cut = int(np.searchsorted(g, g[-1]))
            a, b = _compared(g[:cut], f[:cut], threshold)
            if len(a):
                yield out(a.view(np.int64), b.view(np.int64), None)
            held_k, held_f = k[cut:], f[cut:]
            if most_held and len(held_f) > most_held:
                hot, sent = int(held_k[0, 0]), len(held_f)
                yield out(held_f.view(np.int64), np.arange(sent) // most_held, hot)
                held_k, held_f = held_k[:0], held_f[:0]
        a, b = _compared(groups(held_k), held_f, threshold)
        if len(a):
            yield out(a.view(np.int64), b.view(np.int64), None)

    together = placed.select(*keys, "fp").repartition(*keys).sortWithinPartitions(*keys)
    return together.mapInArrow(run, "a long, b long, hot long")


def near_links(nodes: DataFrame, threshold: int = THRESHOLD, most_held: int = MOST_HELD) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints (fp) within ``threshold`` bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors((threshold + 1) // 2)
        for whole in batches:
            for at in range(0, whole.num_rows, 4000):
                fps = whole.column("fp").slice(at, 4000).to_numpy().view(np.uint64)
                i, anchor = anchors.of(fps)
                yield pa.record_batch([pa.array(anchor.astype(np.int32)), pa.array(fps[i].view(np.int64))], ["anchor", "fp"])

    placed = nodes.select("fp").mapInArrow(run, "anchor int, fp long")
    found = durable(_links(placed, ["anchor"], threshold, most_held), "near")
    crowded = found.where("hot is not null").select(F.col("a").alias("fp"), F.col("b").alias("chunk"), F.col("hot").alias("anchor"))
    chunks = crowded.groupBy("anchor").agg((F.max("chunk") + 1).alias("n"))
    both = crowded.join(chunks, "anchor").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    paired = both.select("anchor", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "fp")
    rest = _links(paired, ["anchor", "i", "j"], threshold, None)
    return found.where("hot is null").select("a", "b").unionByName(rest.select("a", "b"))


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, shingle_words: int = SHINGLE_WORDS, most_held: int = MOST_HELD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id (smallest id in the group) for every row."""
    fps = durable(fingerprints(docs, id_col, text_col, shingle_words), "fingerprints")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    reach = min_reachable(near_links(nodes, threshold, most_held), "a", "b")
    classed = durable(nodes.join(reach.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("class")), "classes")
    # names are written first: a join of two tables is dealt anew where a class or a fingerprint is crowded, one with a sum is not
    names = durable(classed.groupBy("class").agg(F.min("least").alias("component_id")), "names")
    named = durable(classed.join(names, "class").select("fp", "component_id"), "named")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
