"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into quantile bins. Boosting visits the features in turn
and fits a tree of three leaves over the bins of one feature at a time, with a
small step, so that a feature's trees add up to a lookup table. The pairs that
lower the remaining loss most get tables of their own, learnt the same way with
trees of four leaves. A score is the logistic of an intercept plus one number
out of each table: array look-ups and additions.

Features come from the whole text alone. The model is fitted on the driver
from at most ``most_labels`` labelled rows (those with the smallest hash of the
id, so the same ones at every run); its tables have a fixed size whatever the
size of the data. Scoring takes one pass without a shuffle.

Defined results: a null text counts as empty and is scored like any other;
labels that are null are not used; an id with several labels counts as good
only if all say so; with no labels, or one kind only, all scores are the share
of good labels (0.5 without any). Repeated rows get equal scores; other columns
of the input stay; a very long text is held by one task, at a cost in
proportion to its length; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.common import slices

MOST_LABELS = 20_000
NAMES = (
    "log_bytes", "log_words", "bytes_a_word", "upper", "digit", "space", "high", "letter", "sign", "full_stop", "comma", "bar", "exclamation", "byte_entropy",
    "distinct_words", "top_word", "same_as_before", "same_as_two_before", "log_lines", "bytes_a_line", "distinct_lines", "lines_ended", "long_words", "capital_words",
)
_ENDS = (".", "!", "?", '"', "'", ")", ":", ";")


def features(text: str) -> list[float]:
    raw = text.encode()
    n = max(len(raw), 1)
    by = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, digit, lower, high, space = by[65:91].sum(), by[48:58].sum(), by[97:123].sum(), by[128:].sum(), by[9:14].sum() + by[32]
    seen = by[by > 0] / n
    words = text.split()
    w = max(len(words), 1)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    k = max(len(lines), 1)
    return [
        float(np.log1p(len(raw))), float(np.log1p(len(words))), n / w, upper / n, digit / n, space / n, high / n, (upper + lower + high) / n, (n - upper - digit - lower - high - space) / n,
        by[46] / w, by[44] / w, by[124] / w, by[33] / w, float(-(seen * np.log2(seen)).sum()),
        len(counts) / w, max(counts.values(), default=0) / w, sum(map(str.__eq__, words, words[1:])) / w, sum(map(str.__eq__, words, words[2:])) / w,
        float(np.log1p(len(lines))), n / k, len(set(lines)) / k, sum(x.endswith(_ENDS) for x in lines) / k, sum(len(x) > 14 for x in words) / w, sum(x[0].isupper() for x in words) / w,
    ]


@dataclass
class Model:
    edges: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(self.edges)])

    def raw(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for i, t in enumerate(self.tables):
            out += t[bins[:, i]]
        for (a, b), g in zip(self.pairs, self.grids):
            out += g[self.coarse[a][bins[:, a]], self.coarse[b][bins[:, b]]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(self.bins(x)), -30, 30)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Best gain of one cut over ordered bins, and the first bin of its right side."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gains = _gain(gl, hl) + _gain(g.sum() - gl, h.sum() - hl) - _gain(g.sum(), h.sum())
    best = int(np.argmax(gains))
    return float(gains[best]), best + 1


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values of a tree with up to three leaves over the bins of one feature."""
    _, first = _cut(g, h)
    cuts = [0, first, len(g)] if first else [0, len(g)]
    if first:
        left, right = _cut(g[:first], h[:first]), _cut(g[first:], h[first:])
        if max(left[0], right[0]) > 0:
            cuts = sorted({*cuts, left[1] if left[0] >= right[0] else first + right[1]})
    out = np.empty(len(g))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree with one cut on either axis of a grid."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    total = 0.0
    for c, d in (
        (cg[:-1, :-1], ch[:-1, :-1]),
        (cg[:-1, -1:] - cg[:-1, :-1], ch[:-1, -1:] - ch[:-1, :-1]),
        (cg[-1:, :-1] - cg[:-1, :-1], ch[-1:, :-1] - ch[:-1, :-1]),
        (cg[-1, -1] - cg[:-1, -1:] - cg[-1:, :-1] + cg[:-1, :-1], ch[-1, -1] - ch[:-1, -1:] - ch[-1:, :-1] + ch[:-1, :-1]),
    ):
        total = total + _gain(c, d)
    if np.size(total) == 0:
        return 0.0, np.zeros_like(g)
    a, b = (int(i) + 1 for i in np.unravel_index(int(np.argmax(total)), total.shape))
    out = np.empty_like(g)
    for rows in (slice(0, a), slice(a, None)):
        for cols in (slice(0, b), slice(b, None)):
            out[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + 1.0)
    return float(np.max(total)), out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 64, coarse: int = 8, pairs: int = 6, rounds: int = 60, step: float = 0.15) -> Model:
    n, k = x.shape
    p = float(y.mean()) if n else 0.5
    edges = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.empty(0) for i in range(k)]
    sizes = [len(e) + 1 for e in edges]
    base = float(np.log(p / (1 - p))) if 0 < p < 1 else (0.0 if not n else 4.0 * (2 * p - 1))
    model = Model(edges, base, [np.zeros(s) for s in sizes], [np.arange(s) * coarse // max(s, coarse) for s in sizes])
    if not n or p in (0.0, 1.0):
        return model
    own = model.bins(x)
    now = np.full(n, base)
    for _ in range(rounds):
        for i in range(k):
            q = 1 / (1 + np.exp(-now))
            change = step * _tree(np.bincount(own[:, i], y - q, sizes[i]), np.bincount(own[:, i], q * (1 - q), sizes[i]))
            model.tables[i] += change
            now += change[own[:, i]]
    rough = np.column_stack([model.coarse[i][own[:, i]] for i in range(k)])

    def grid(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cell, q = rough[:, a] * coarse + rough[:, b], 1 / (1 + np.exp(-now))
        return cell, np.bincount(cell, y - q, coarse * coarse).reshape(coarse, coarse), np.bincount(cell, q * (1 - q), coarse * coarse).reshape(coarse, coarse)

    ranked = sorted(((-_quadrants(*grid(a, b)[1:])[0], a, b) for a in range(k) for b in range(a)))
    model.pairs = [(a, b) for _, a, b in ranked[:pairs]]
    model.grids = [np.zeros((coarse, coarse)) for _ in model.pairs]
    for _ in range(rounds // 2):
        for (a, b), g in zip(model.pairs, model.grids):
            cell, grad, hess = grid(a, b)
            change = step * _quadrants(grad, hess)[1]
            g += change
            now += change.ravel()[cell]
    return model


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3


def train(docs: DataFrame, labels: DataFrame, most_labels: int = MOST_LABELS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on documents with labels (doc_id, quality) outside the held-out third."""
    use = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (remainder(F.col("doc_id")) != 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = use.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labels)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [features(t) for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), b.column("quality"), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    joined = texts.join(F.broadcast(sample), "doc_id").select("doc_id", F.col("quality").cast("int").alias("quality"), "text")
    kind = joined.schema["doc_id"].dataType.simpleString()
    got = joined.mapInArrow(run, f"doc_id {kind}, quality int, x array<double>").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("x").alias("x")).orderBy("doc_id").toArrow()
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, len(NAMES))
    return fit(x, np.array(got.column("quality").to_pylist(), float))


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "quality_score") -> DataFrame:
    """``docs`` with a column ``score_col`` between 0 and 1 (higher: good is likelier), in place of one of that name."""
    docs = docs.drop(score_col)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text_col)
        for whole in batches:
            for b in slices(iter([whole]), text_col):
                x = np.array([features(t or "") for t in b.column(at).to_pylist()], float)
                yield pa.record_batch([*b.columns, pa.array(model.score(x), pa.float64())], [*names, score_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))
