"""SentencePiece encoding and decoding by suffix-array matching.

The new words of a batch are concatenated and their suffixes sorted. A binary
search finds for every piece of the vocabulary the range of suffixes that it
begins: its occurrences. These are the edges (position, length, piece) of the
batch, sorted by position. The edges are then relaxed: starting from single
characters, every word contracts in each round the adjacent pair whose joint
span is the edge of best score (the leftmost of equals), until no pair spans
an edge. That is the order in which a BPE model merges, so the ids are those
of the library; a shortest path by summed scores would not give them.

No piece continues behind a space that it does not begin with, and characters
that occur in no longer piece never join; words end there, and each distinct
word is encoded once. Characters without a piece become their bytes' pieces.

Defined results: a null text counts as empty and has no ids; repeated rows get
equal ids; an empty table gives an empty result; columns of the input other
than id and text are ignored. Rows pass in slices of bounded size; a very long
text is held by one task, at a cost of n log n for its longest word of n
characters, and its suffixes are sorted a stretch at a time.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import slices
from weftgraph.llm.lexicon import Lexicon, joined

SPACE = "▁"
#: Longer words are relaxed one by one with a heap, shorter ones together in rounds; the ids are the same.
LONG_WORD = 64


class Model:
    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        kinds = [lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i) for i in range(n)]
        texts = [lib.id_to_piece(i) for i in range(n)]
        self.id_of = {t: i for i, (t, k) in enumerate(zip(texts, kinds)) if not k}
        self.byte_id = np.array([lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.unknown, self.size = lib.unk_id(), n
        if any(SPACE in t.lstrip(SPACE) for t in self.id_of):
            raise ValueError("a piece goes on behind a space; words can't be told apart")
        self.longest = max(map(len, self.id_of))
        # pieces of two characters or more, sorted as the suffixes are; 0 pads
        many = sorted(t for t in self.id_of if len(t) > 1)
        if any("\0" in t for t in many):
            raise ValueError("a piece holds the character that parts words")
        score = {t: lib.get_score(self.id_of[t]) for t in many}
        order = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.piece_id = np.array([self.id_of[t] for t in many], np.int32)
        self.piece_rank = np.array([order[score[t]] for t in many], np.int64)
        self.piece_len = np.array([len(t) for t in many], np.int64)
        self.piece_key = np.array([self._key(t) for t in many], f"S{4 * self.longest}")
        # the key behind all that begin with the piece
        self.piece_end = np.array([self._key(t) + b"\xff" for t in many], f"S{4 * self.longest + 1}")
        inside = {c for t in many for c in t}
        self.alone = [c for c in "\n\t\r" if c not in inside]
        self.bytes_of = [bytes([int(t[3:5], 16)]) if lib.is_byte(i) else b"" if lib.is_control(i) else b" \xe2\x81\x87 " if lib.is_unknown(i) else t.replace(SPACE, " ").encode() for i, t in enumerate(texts)]

    @staticmethod
    def _key(t: str) -> bytes:
        return t.encode("utf-32-be").replace(b"\0\0\0\0", b"")


def relax_by_heap(first: int, size: int, spans: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the symbols of one word, relaxed with a heap of its pairs by (rank, place).

    The same contractions in the same order as the rounds make, at n log n steps for a word of n characters.
    """
    a, b = np.searchsorted(spans, [first * 64, (first + size) * 64])
    spans, ranks = spans[a:b], ranks[a:b]
    length, before = np.ones(size, np.int64), np.arange(-1, size - 1)
    two = (first + np.arange(size)) * 64 + 2
    at = np.minimum(np.searchsorted(spans, two), max(len(spans) - 1, 0))
    hits = np.flatnonzero(spans[at] == two) if len(spans) else np.empty(0, np.int64)
    heap = [(r, i, 2) for r, i in zip(ranks[at[hits]].tolist(), hits.tolist()) if i + 1 < size]
    heapq.heapify(heap)
    length, before = length.tolist(), before.tolist()

    def offer(i: int) -> None:
        """The pair of the symbol at ``i`` and its right neighbour, if an edge spans it."""
        j = i + length[i]
        if i >= 0 and j < size:
            n = length[i] + length[j]
            span = (first + i) * 64 + n
            k = int(spans.searchsorted(span)) if n < 64 else len(spans)
            if k < len(spans) and spans[k] == span:
                heapq.heappush(heap, (int(ranks[k]), i, n))

    while heap:
        _, i, n = heapq.heappop(heap)
        j = i + length[i]
        if not length[i] or j >= size or length[i] + length[j] != n:
            continue  # one of the two has changed since
        length[i], length[j] = n, 0
        if i + n < size:
            before[i + n] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    length = np.array(length, np.int64)
    left = np.flatnonzero(length)
    return first + left, length[left]


@lru_cache(maxsize=1)
def _model(path: str) -> Model:
    """The vocabulary, once in a worker however many tasks that serves."""
    return Model(path)


class Pieces:
    def __init__(self, path: str, most_words: int = 1 << 20, index_chars: int = 1 << 17):
        self.model, self.index_chars = _model(path), index_chars
        self.lexicon = Lexicon(self._encode_words, np.int32, most_words)

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start * 64 + length) sorted, id and rank of every occurrence of a piece in the code points."""
        m, depth, found = self.model, self.model.longest, []
        padded = np.concatenate([codes, np.zeros(depth, np.uint32)]).astype(">u4")
        # no piece is longer than a key, so suffixes can be sorted a stretch of them at a time
        for first in range(0, len(codes), self.index_chars):
            own = padded[first : min(first + self.index_chars, len(codes)) + depth]
            windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(own, depth)[: len(own) - depth])
            keys = windows.view(f"S{4 * depth}").ravel()
            suffixes = np.argsort(keys, kind="stable")
            keys = keys[suffixes]
            lo = np.searchsorted(keys, m.piece_key)
            hi = np.searchsorted(keys, m.piece_end)
            n = hi - lo
            which = np.repeat(np.arange(len(n)), n)
            at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            spans = (suffixes[at] + first) * 64 + m.piece_len[which]
            order = np.argsort(spans)
            found.append((spans[order], m.piece_id[which[order]], m.piece_rank[which[order]]))
        return tuple(np.concatenate(x) for x in zip(*found))

    def _relax(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        m = self.model
        text = "\0".join(words) + "\0"
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        spans, ids, ranks = self.edges(codes)
        lengths = np.array([len(w) for w in words])
        word = np.repeat(np.arange(len(words)), lengths + 1)
        inside = np.repeat(lengths <= LONG_WORD, lengths + 1)
        inside[np.cumsum(lengths + 1) - 1] = False
        start, word = np.flatnonzero(inside), word[inside]
        length = np.ones(len(start), np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []  # start and length of what no longer changes
        for i in np.flatnonzero(lengths > LONG_WORD).tolist():
            at = int(lengths[:i].sum()) + i
            done.append(relax_by_heap(at, len(words[i]), spans, ranks))
        far = np.iinfo(np.int64).max
        while len(start):
            # the edge over each symbol and its right neighbour
            span = start[:-1] * 64 + np.minimum(length[:-1] + length[1:], 63)
            at = np.minimum(np.searchsorted(spans, span), max(len(spans) - 1, 0))
            near = (word[:-1] == word[1:]) & (spans[at] == span) if len(spans) else np.zeros(len(span), bool)
            rank = np.append(np.where(near, ranks[at], far) if len(spans) else np.full(len(span), far), far)
            firsts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, firsts)
            per = np.diff(firsts, append=len(word))
            stays = np.repeat(best == far, per)
            if stays.any():
                done.append((start[stays], length[stays]))
            hit = (rank == np.repeat(best, per)) & ~stays
            place = np.flatnonzero(hit)
            left = place[np.append(True, word[place][1:] != word[place][:-1])] if len(place) else place
            length = length.copy()
            length[left] += length[left + 1]
            keep = ~stays
            keep[left + 1] = False
            start, length, word = start[keep], length[keep], word[keep]
        start, length = (np.concatenate(x) for x in zip(*done)) if done else (np.empty(0, np.int64), np.empty(0, np.int64))
        order = np.argsort(start)
        start, length = start[order], length[order]
        long = length > 1
        out = np.empty(len(start), np.int64)
        out[long] = ids[np.searchsorted(spans, start[long] * 64 + length[long])]
        single, inverse = np.unique(codes[start[~long]], return_inverse=True)
        out[~long] = np.array([m.id_of.get(chr(c), -1 - c) for c in single.tolist()], np.int64)[inverse] if len(single) else []
        owner = np.searchsorted(np.cumsum(lengths + 1), start, side="right")
        lost = np.flatnonzero(out < 0)
        if len(lost):
            # characters without a piece: their bytes, or the unknown id
            raw = [[m.unknown] if m.byte_id[0] == m.unknown else m.byte_id[list(chr(-1 - c).encode())].tolist() for c in out[lost].tolist()]
            n = np.ones(len(out), np.int64)
            n[lost] = [len(r) for r in raw]
            wide, owner = np.repeat(out, n), np.repeat(owner, n)
            wide[np.repeat(out < 0, n)] = np.concatenate(raw)
            out = wide
        return out.astype(np.int32), np.bincount(owner, minlength=len(words)).astype(np.int64)

    def _encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [w.decode().replace(" ", SPACE) for w in words]
        ids, counts = [], []
        size, a = 0, 0
        for b, t in enumerate(texts, 1):
            size += len(t) + 1
            if size >= self.index_chars or b == len(texts):
                i, n = self._relax_any(texts[a:b])
                ids.append(i)
                counts.append(n)
                size, a = 0, b
        return np.concatenate(ids), np.concatenate(counts)

    def _relax_any(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words that hold the parting character are cut there: it joins nothing."""
        if not any("\0" in w for w in words):
            return self._relax(words)
        cut, owner = [], []
        for i, w in enumerate(words):
            for k, part in enumerate(w.split("\0")):
                cut += (["\1"] if k else []) + [part]
                owner += [i] * (1 + bool(k))
        # a stand-in takes the place of each parting character; it becomes that character's ids
        flat, n = self._relax([c for c in cut if c != "\1"])
        rest, counts, out = iter(np.split(flat, np.cumsum(n)[:-1])), np.zeros(len(words), np.int64), []
        zero = np.array([self.model.byte_id[0]], np.int32)
        for i, c in zip(owner, cut):
            got = zero if c == "\1" else next(rest)
            out.append(got)
            counts[i] += len(got)
        return np.concatenate(out), counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the place of each text's end."""
        raw = [b" " + t.replace(SPACE, " ").encode() if t else b"" for t in texts]
        data, ends = joined(raw)
        if not len(data):
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        cut = np.empty(len(data), bool)
        cut[0] = True
        space = data == 32
        cut[1:] = space[1:] & ~space[:-1]
        for c in self.model.alone:
            lone = data == ord(c)
            cut |= lone
            cut[1:] |= lone[:-1]
        cut[ends[ends < len(data)]] = True
        starts = np.flatnonzero(cut)
        ids, word_ends = self.lexicon.values_of(data, starts)
        return ids, np.concatenate([[0], word_ends])[np.searchsorted(starts, ends)]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        table, a, out = self.model.bytes_of, 0, []
        for b in ends.tolist():
            text = b"".join(map(table.__getitem__, ids[a:b].tolist())).decode("utf-8", "replace")
            out.append(text[1:] if text[:1] == " " else text)
            a = b
        return out


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Pieces(model_path)
        for b in slices(batches, "text", 3 << 20):
            ids, ends = coder.encode(b.column("text").to_pylist())
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            yield pa.record_batch([b.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.array(ids))], ["doc_id", "ids"])

    thin = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return thin.mapInArrow(run, f"doc_id {thin.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, text: ``encode``, and ``decode`` of its ids, in one worker, which holds one batch's ids at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Pieces(model_path)
        for b in slices(batches, "text", 3 << 20):
            ids, ends = coder.encode(b.column("text").to_pylist())
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            texts = pa.array(coder.decode(ids, ends), pa.string())
            yield pa.record_batch([b.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.array(ids)), texts], ["doc_id", "ids", "text"])

    thin = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return thin.mapInArrow(run, f"doc_id {thin.schema['doc_id'].dataType.simpleString()}, ids array<int>, text string")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids, text: from rows (doc_id, ids). Null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Pieces(model_path)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                lists = b.column("ids").fill_null([]) if b.column("ids").null_count else b.column("ids")
                ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                yield pa.record_batch([b.column("doc_id"), b.column("ids"), pa.array(coder.decode(lists.flatten().to_numpy(), ends), pa.string())], ["doc_id", "ids", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids array<int>, text string")
