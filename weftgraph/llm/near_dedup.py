"""Documents whose sets of word shingles are alike, by SimHash, anchors of a covering code and exact comparison.

A text has ``FINGERPRINTS`` SimHash fingerprints of 64 bits, each by majority
over other hashes of its different shingles. Sets of Jaccard similarity s have a
cosine of at least 2s / (1 + s), so that at 0.8 a bit differs with probability
0.15: some 7 of the 46 bits that the anchors of ``simhash`` look at. One
fingerprint within 4 bits would miss most such texts, and anchors for all of 46
bits at that distance would be thousands. So each fingerprint goes to its anchors
within the covering radius and ``EXCESS`` bits (some 10): within twice the excess
two always meet, at 0.8 with probability 0.18, and in at least one of the
fingerprints with 0.9997. What meets at an anchor is compared by ``CHECKS`` more
fingerprints: more than ``MOST_BITS`` different bits of 128 have probability
1e-4 at 0.8, and fewer 1e-6 for unrelated texts.

Texts of the same words are one from the start. What so hangs together is a
cluster, within which the exact similarity of the shingle sets decides: first
with ``DRAWN`` of its texts, drawn by hash. Clusters where this leaves texts in
different groups are dealt into parts of bounded size, every two of which are
compared within one task by matrix products over their shingles; only links that
join something leave the task, so no pairs are written out and no link is lost.

Defined results are those of ``simhash``: a text of fewer words than a shingle
has is one shingle; texts without words are alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from weftgraph.llm.common import slices
from weftgraph.llm.simhash import Anchors, spanning
from weftgraph.operators.components import min_reachable
from weftgraph.plans.durable import durable

SHINGLE_WORDS, LEAST_JACCARD, SEED = 5, 0.8, 42
FINGERPRINTS, CHECKS, EXCESS, MOST_BITS = 40, 2, 1, 36
#: Fingerprints whose anchors are dealt over the tasks at once. Before all else as many go to their nearest anchor
#: alone: that joins most of a large group by a few links, and its links need not be found again at every anchor.
PER_ROUND = 8
#: Texts of a cluster that all others are compared with first.
DRAWN = 4
#: Bytes of text in a part of a crowded cluster; two parts are in memory at once.
MOST_BYTES = 2 << 20
#: Texts in a part, as far as ``SPREAD`` parts will do: short texts are dealt over tasks as well.
MOST_TEXTS, SPREAD = 128, 16
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, FINGERPRINTS + CHECKS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX, _HALF, _LANES = np.uint64(0x9E3779B97F4A7C15), np.uint64(32), np.uint64(0x0101010101010101)


def _words(text: str) -> list[bytes]:
    return text.encode().lower().split()  # as in simhash


def shingles(text: str, shingle_words: int = SHINGLE_WORDS) -> set[bytes]:
    words = _words(text)
    return {b" ".join(words[i : i + shingle_words]) for i in range(max(1, len(words) - shingle_words + 1))} if words else set()


def alike(a: set[bytes], b: set[bytes], least: float) -> bool:
    both = len(a & b)
    return both >= least * (len(a) + len(b) - both) - 1e-9


def votes(hashes: np.ndarray) -> np.ndarray:
    """64 bits for each hash (rows) and fingerprint (columns)."""
    x = hashes[:, None] * _FACTORS
    x ^= x >> _HALF
    x *= _MIX
    x ^= x >> _HALF
    return x


def majority(hashes: np.ndarray) -> np.ndarray:
    """The fingerprints: bits that are set in over half the votes."""
    ones = np.zeros((len(_FACTORS), 8, 8), np.int64)  # fingerprint, byte, bit
    for at in range(0, len(hashes), 255):  # sums of bits fit in bytes
        cast = votes(hashes[at : at + 255])
        for bit in range(8):
            ones[:, :, bit] += (cast >> np.uint64(bit) & _LANES).sum(0, dtype=np.uint64).view(np.uint8).reshape(-1, 8)
    return np.packbits(ones * 2 > len(hashes), axis=2, bitorder="little").reshape(-1, 8).view(np.uint64).ravel()


def sketch(text: str, shingle_words: int = SHINGLE_WORDS) -> tuple[int, int, np.ndarray]:
    """(hash of the words, number of different shingles, fingerprints)."""
    found = shingles(text, shingle_words)
    node = xxh64_intdigest(b" ".join(_words(text)), SEED)
    if not found:
        return node, 0, np.empty(0, np.uint64)
    return node, len(found), majority(np.fromiter((xxh64_intdigest(s, SEED) for s in found), np.uint64, len(found)))


def sketches(docs: DataFrame, id_col: str, text_col: str, shingle_words: int) -> DataFrame:
    """doc_id, node, size, fps, text for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            got = [sketch(t, shingle_words) for t in b.column("text").to_pylist()]
            node = pa.array(np.array([g[0] for g in got], np.uint64).view(np.int64))
            fps = pa.array([g[2].view(np.int64) for g in got], pa.list_(pa.int64()))
            yield pa.record_batch([b.column("doc_id"), node, pa.array([g[1] for g in got], pa.int32()), fps, b.column("text")], ["doc_id", "node", "size", "fps", "text"])

    thin = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return thin.mapInArrow(run, f"doc_id {thin.schema['doc_id'].dataType.simpleString()}, node long, size int, fps array<long>, text string")


def met(keys: np.ndarray, names: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between different names that join the names of equal keys (sorted) whose checks (rows) are within ``MOST_BITS``."""
    near = lambda x, y: np.bitwise_count(checks[x] ^ checks[y]).sum(-1, dtype=np.int64) <= MOST_BITS
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    size = np.diff(np.append(first, len(keys)))
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    at, end = np.arange(len(keys)), np.repeat(first + size, size)
    at, lag = at[np.repeat(size <= 64, size)], 0
    while len(at):
        lag += 1
        at = at[at + lag < end[at]]
        a.append(at[near(at, at + lag)])
        b.append(a[-1] + lag)
    for start, n in zip(first[size > 64], size[size > 64]):  # what is joined already is not compared again
        left, reached = np.arange(start, start + n), []
        while len(left):
            if not reached:
                reached, left = [left[0]], left[1:]
            one = reached.pop()
            hit = near(left, one)
            a.append(np.full(int(hit.sum()), one))
            b.append(left[hit])
            reached.extend(left[hit])
            left = left[~hit]
    x, y = names[np.concatenate(a)], names[np.concatenate(b)]
    return spanning(x[x != y], y[x != y])


def meetings(marks: DataFrame, first: int, last: int, excess: int = EXCESS) -> DataFrame:
    """Links (a, b) that join the names of all rows near by their checks which meet at an anchor of fingerprints ``first`` to ``last - 1``; marks: name, fps."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, n = Anchors(excess), last - first
        for whole in batches:
            for at in range(0, whole.num_rows, 4000 // n):
                b = whole.slice(at, 4000 // n)
                fps = b.column("fps").flatten().to_numpy().view(np.uint64).reshape(b.num_rows, -1)
                i, anchor = anchors.of(fps[:, first:last].ravel())
                who, key = i // n, (i % n << 24 | anchor).astype(np.int32)
                checks = fps[:, FINGERPRINTS:].view(np.int64)[who]
                yield pa.record_batch([pa.array(key), pa.array(b.column("name").to_numpy()[who]), pa.array(checks[:, 0].copy()), pa.array(checks[:, 1].copy())], ["key", "name", "c0", "c1"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of keys that may go on
        a, b = np.empty(0, np.int64), np.empty(0, np.int64)

        def joined(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            k, n, c0, c1 = (rows.column(c).to_numpy() for c in ("key", "name", "c0", "c1"))
            x, y = met(k, n, np.column_stack([c0, c1]).view(np.uint64))
            return np.concatenate([a, x]), np.concatenate([b, y])

        for batch in batches:
            if not batch.num_rows:
                continue
            same = held and held[-1].column("key")[0].as_py() == batch.column("key")[batch.num_rows - 1].as_py()
            held.append(batch)
            if same:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            keys = rows.column("key").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            a, b = joined(rows.slice(0, cut))
            held = rows.slice(cut).to_batches()
            if len(a) > 1 << 18:
                yield pa.record_batch([*map(pa.array, spanning(a, b))], ["a", "b"])
                a, b = a[:0], b[:0]
        if held:
            a, b = joined(pa.Table.from_batches(held).combine_chunks())
        if len(a):
            yield pa.record_batch([*map(pa.array, spanning(a, b))], ["a", "b"])

    placed = marks.select("name", "fps").mapInArrow(place, "key int, name long, c0 long, c1 long")
    return placed.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def _alike_pairs(pairs: DataFrame, texts: Callable[[DataFrame], DataFrame], least: float, shingle_words: int) -> DataFrame:
    """Of pairs (a, b) of nodes those that are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = zip(b.column("text_a").to_pylist(), b.column("text_b").to_pylist())
            yield b.select(["a", "b"]).filter(pa.array([alike(shingles(x, shingle_words), shingles(y, shingle_words), least) for x, y in both], pa.bool_()))

    pairs = durable(pairs, "pairs")
    text = texts(pairs.select(F.explode(F.array("a", "b")).alias("node")))
    both = pairs.join(text.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(text.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return durable(both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long"), "alike")


def links_within(texts: list[str], least: float, shingle_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) that join what alike texts join, fewer than there are texts; counts common shingles by matrix products."""
    ids: dict[bytes, int] = {}
    sets = [np.fromiter((ids.setdefault(s, len(ids)) for s in shingles(t, shingle_words)), np.int64) for t in texts]
    size, both = np.array([len(x) for x in sets], np.float32), np.zeros((len(sets), len(sets)), np.float32)
    who, what = np.repeat(np.arange(len(sets)), size.astype(np.int64)), np.concatenate(sets)
    times = np.bincount(what, minlength=len(ids))
    shared = times[what] > 1
    who, what = who[shared], np.cumsum(times > 1)[what[shared]] - 1
    order = np.argsort(what, kind="stable")
    who, what = who[order], what[order]
    for first in range(0, int(what[-1]) + 1 if len(what) else 0, 2048):
        x, y = np.searchsorted(what, [first, first + 2048])
        held = np.zeros((len(sets), 2048), np.float32)
        held[who[x:y], what[x:y] - first] = 1
        both += held @ held.T
    i, j = np.nonzero(np.triu(both >= least * (size[:, None] + size[None, :] - both) - 1e-4, 1))
    return spanning(i, j)


def _crowded_links(rows: DataFrame, least: float, shingle_words: int, most_bytes: int) -> DataFrame:
    """Links (a, b) that join all alike nodes of each band, from rows (band, node, text).

    A band's texts are dealt into parts of about ``most_bytes`` or less; every two parts meet in one group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, texts = None, [], []

        def found() -> pa.RecordBatch:
            i, j = links_within(texts, least, shingle_words)
            own = np.array(nodes, np.int64)
            return pa.record_batch([pa.array(own[i]), pa.array(own[j])], ["a", "b"])

        for batch in batches:
            for band, i, j, node, text in zip(*(batch.column(c).to_pylist() for c in ("band", "i", "j", "node", "text"))):
                if (band, i, j) != key:
                    if len(nodes) > 1:
                        yield found()
                    key, nodes, texts = (band, i, j), [], []
                nodes.append(node)
                texts.append(text)
        if len(nodes) > 1:
            yield found()

    parts = durable(rows.groupBy("band").agg(F.greatest(F.ceil(F.sum(F.octet_length("text") + 1) / most_bytes), F.least(F.ceil(F.count("*") / MOST_TEXTS), F.lit(SPREAD))).alias("n")), "parts")
    dealt = rows.join(parts, "band").withColumn("part", F.pmod(F.xxhash64("node", "band"), "n"))
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).select("band", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "node", "text")
    together = paired.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    return together.mapInArrow(run, "a long, b long")


def near_documents(docs: DataFrame, least: float = LEAST_JACCARD, shingle_words: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = MOST_BYTES) -> DataFrame:
    """doc_id, component_id (smallest id in the group) for every row."""
    sketched = durable(sketches(docs, id_col, text_col, shingle_words), "sketches")
    nodes = durable(sketched.groupBy("node").agg(F.min("doc_id").alias("least")), "nodes")
    own = F.col("doc_id").eqNullSafe(F.col("least")) & (sketched["node"] == nodes["node"])
    marks = sketched.where("size > 0").join(nodes, own).select(sketched["node"], "size", "fps").dropDuplicates(["node"])
    marks = durable(marks, "marks")

    def renamed(some: DataFrame, links: DataFrame) -> DataFrame:
        reach = durable(min_reachable(links, "a", "b").withColumnRenamed("id", "name"), "reach")
        return durable(some.join(reach, "name", "left").withColumn("name", F.coalesce("component", "name")).drop("component"), "marks")

    marks = renamed(marks.withColumn("name", F.col("node")), durable(meetings(marks.withColumn("name", F.col("node")), 0, PER_ROUND, 0), "meetings"))
    meeting = [durable(meetings(marks, at, min(at + PER_ROUND, FINGERPRINTS)), "meetings") for at in range(0, FINGERPRINTS, PER_ROUND)]
    clusters = renamed(marks.select("node", "size", "name"), reduce(DataFrame.unionByName, meeting).distinct()).withColumnRenamed("name", "band")
    several = durable(clusters.groupBy("band").count().where("count > 1").select("band"), "several")
    placed = durable(clusters.join(several, "band"), "placed")
    draws = [F.min(F.struct(F.xxhash64("node", F.lit(i)).alias("draw"), "node", "size")) for i in range(DRAWN)]
    drawn = durable(placed.groupBy("band").agg(F.array_distinct(F.transform(F.array(*draws), lambda x: F.struct(x["node"].alias("node"), x["size"].alias("size")))).alias("reps")), "drawn")
    beside = durable(placed.join(drawn, "band"), "beside")

    def texts(some: DataFrame) -> DataFrame:
        """node, text once: that of the document which names the node, so that copies don't come together."""
        named = nodes.join(some.distinct(), "node", "left_semi")
        own = (F.col("doc_id").eqNullSafe(F.col("least"))) & (sketched["node"] == named["node"])
        return durable(sketched.join(named, own).select(sketched["node"], "text").dropDuplicates(["node"]), "texts")

    # sets of too different sizes cannot be alike
    may = (F.col("node") != F.col("rep")) & (F.least("size", "rep_size") >= F.greatest("size", "rep_size") * least - 1e-9)
    tried = beside.select("node", "size", F.explode("reps").alias("rep")).select("node", "size", F.col("rep.node").alias("rep"), F.col("rep.size").alias("rep_size"))
    links = _alike_pairs(tried.where(may).select(F.least("node", "rep").alias("a"), F.greatest("node", "rep").alias("b")).distinct(), texts, least, shingle_words)
    reach = durable(min_reachable(links, "a", "b"), "reach")
    of = lambda c: reach.select(F.col("id").alias(c), F.col("component").alias(f"{c}_in"))
    grouped = durable(beside.select("band", "node", F.col("reps")[0]["node"].alias("rep")).join(of("node"), "node", "left").join(of("rep"), "rep", "left").select("band", "node", (F.coalesce("node_in", "node") != F.coalesce("rep_in", "rep")).alias("open")), "grouped")
    left = grouped.join(grouped.where("open").select("band").distinct(), "band", "left_semi").select("band", "node")
    more = _crowded_links(left.join(texts(left.select("node")), "node").select("band", "node", "text"), least, shingle_words, most_bytes)
    both = min_reachable(links.unionByName(more), "a", "b").withColumnRenamed("id", "node")
    classed = durable(nodes.join(both, "node", "left").select("node", "least", F.coalesce("component", "node").alias("class")), "classes")
    # names are written first: a join of two tables is dealt anew where a class is crowded, one with a sum is not
    names = durable(classed.groupBy("class").agg(F.min("least").alias("component_id")), "names")
    named = durable(classed.join(names, "class").select("node", "component_id"), "named")
    return sketched.select("doc_id", "node").join(named, "node").select("doc_id", "component_id")
