"""Exact integer codes for the words of a batch, without a Python object for each word.

Words are runs of bytes that cover a buffer. They are hashed in array
operations, each distinct hash is looked up once, and every word is then
compared byte by byte with the word its code stands for, so that equal codes
mean equal words. Values that belong to a word (its token ids) are kept in one
flat array and gathered for the whole batch at once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

_RANDOM = np.random.default_rng(20)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = _RANDOM.integers(1, 1 << 63, 1 << 12, dtype=np.uint64) | np.uint64(1)


class _Flat:
    """A growing array of ragged values."""

    def __init__(self, dtype):
        self.values, self.start, self.length, self.used = np.empty(1 << 16, dtype), np.empty(0, np.int64), np.empty(0, np.int64), 0

    def add(self, values: np.ndarray, lengths: np.ndarray) -> None:
        need = self.used + len(values)
        if need > len(self.values):
            grown = np.empty(max(need, 2 * len(self.values)), self.values.dtype)
            grown[: self.used] = self.values[: self.used]
            self.values = grown
        self.values[self.used : need] = values
        self.start = np.concatenate([self.start, self.used + np.cumsum(lengths) - lengths])
        self.length = np.concatenate([self.length, lengths])
        self.used = need

    def gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = self.length[codes]
        ends = np.cumsum(lengths)
        at = np.repeat(self.start[codes] - ends + lengths, lengths)
        at += np.arange(len(at))
        return self.values[at], ends


class Lexicon:
    """``value_of(words)`` gives, for new words, their flat values and the number of values of each."""

    def __init__(self, value_of: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], dtype, most_words: int = 1 << 20):
        self.value_of, self.dtype, self.most_words = value_of, dtype, most_words
        self._clear()

    def _clear(self) -> None:
        self.known: dict[int, int] = {}
        self.bytes, self.values = _Flat(np.uint8), _Flat(self.dtype)

    def values_of(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat values of the words of ``data`` that begin at ``starts`` (the first at 0), and where each word's end."""
        if not len(starts):
            return np.empty(0, self.dtype), np.empty(0, np.int64)
        if len(self.known) > self.most_words:
            self._clear()
        lengths = np.diff(starts, append=len(data))
        place = np.arange(len(data)) - np.repeat(starts, lengths)
        hashes = np.add.reduceat(_BYTE[data] * _PLACE[place & 4095], starts)
        kinds, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        keys = kinds.tolist()
        codes = np.array(list(map(self.known.get, keys, [-1] * len(keys))), np.int64)
        new = np.flatnonzero(codes < 0)
        if len(new):
            a, n = starts[first[new]], lengths[first[new]]
            words = [data[i : i + k].tobytes() for i, k in zip(a.tolist(), n.tolist())]
            codes[new] = np.arange(len(self.known), len(self.known) + len(new))
            self.known.update(zip(kinds[new].tolist(), codes[new].tolist()))
            self.bytes.add(np.frombuffer(b"".join(words), np.uint8), n)
            self.values.add(*self.value_of(words))
        codes = codes[inverse]
        if not np.array_equal(self.bytes.length[codes], lengths) or not np.array_equal(self.bytes.gather(codes)[0], data):
            # two words share a hash: leave the memory aside for this batch
            own = [data[i : i + k].tobytes() for i, k in zip(starts.tolist(), lengths.tolist())]
            values, counts = self.value_of(own)
            return values, np.cumsum(counts)
        return self.values.gather(codes)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts as one byte array, and the places of their ends."""
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts], dtype=np.int64)
