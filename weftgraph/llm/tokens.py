"""Token ids of a byte-level BPE vocabulary, encoding each distinct word once.

The pattern that splits text before the merges never joins a letter and a
following ASCII character that is no letter, nor any character and white space
that follows it. Cutting at such places gives the same ids. Distinct words are
encoded by ``tiktoken`` from the vocabulary's ranks, many in one call; texts
with rarer white space, control characters or strings that the vocabulary adds
(such as its end mark) go whole to ``tokenizers``, whose ids the results equal
everywhere.
"""

from __future__ import annotations

import base64

import numpy as np

from weftgraph.llm.lexicon import Lexicon, joined

_SPACE, _LETTER, _OTHER, _HIGH, _CONTROL = 1, 2, 3, 4, 5
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[*range(0x20), 0x7F]] = _CONTROL
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[128:] = _HIGH


def _word_starts(data: np.ndarray, kind: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where a text begins, or white space or an ASCII sign after a letter."""
    before = kind[:-1]
    letter = before == _LETTER
    if (kind == _HIGH).any():
        # letters of two bytes: U+00C0 to U+023F but for the two signs among them
        lead, last = data[:-2], data[1:-1]
        two = (lead >= 0xC3) & (lead <= 0xC8) & ~((lead == 0xC3) & ((last == 0x97) | (last == 0xB7)))
        letter[1:] |= two & (last >= 0x80)
    cut = np.empty(len(data), bool)
    cut[0] = True
    cut[1:] = (kind[1:] == _SPACE) & (before != _SPACE) | (kind[1:] == _OTHER) & letter
    cut[ends[:-1][ends[:-1] < len(data)]] = True
    return np.flatnonzero(cut)


def _odd(data: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Places of control characters and of white space beyond ASCII (or what might be)."""
    odd = kind == _CONTROL
    if (kind == _HIGH).any():
        after = np.append(data[1:], 0)
        odd |= (data == 0xC2) & ((after == 0x85) | (after == 0xA0))
        if (data >= 0xE1).any():
            odd |= (data == 0xE1) & (after == 0x9A) | (data == 0xE2) & (after == 0x81) | (data == 0xE3) & (after == 0x80) | (data == 0xEF) & (after == 0xBB)
            third = np.append(after[1:], 0)
            odd |= (data == 0xE2) & (after == 0x80) & ((third < 0x90) | (third >= 0xA8))
    return np.flatnonzero(odd)


class Ids:
    """Ids of texts, as one array and the place of each text's end in it."""

    def __init__(self, tokenizer_path: str, ranks_path: str, pattern: str, most_words: int = 1 << 20):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer_path)
        #: strings that the library turns into ids of their own wherever they stand in a text
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.words = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        self.size[list(ranks.values())] = [len(x) for x in ranks]
        self.lexicon = Lexicon(self._encode_words, np.uint32, most_words)

    def _encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Words that begin with white space and end without are encoded in one string: no token spans two."""
        apart = [i for i, w in enumerate(words) if w[0] not in b" \t\n\r\f\v" or w[-1] in b" \t\n\r\f\v"]
        lone = set(apart)
        together = [i for i in range(len(words)) if i not in lone]
        counts = np.zeros(len(words), np.int64)
        ids = np.array(self.words.encode_ordinary(b"".join(words[i] for i in together).decode()), np.uint32)
        ends = np.searchsorted(np.cumsum(self.size[ids]), np.cumsum([len(words[i]) for i in together])) + 1 if together else np.empty(0, np.int64)
        counts[together] = np.diff(ends, prepend=0)
        singles = [np.array(self.words.encode_ordinary(words[i].decode()), np.uint32) for i in apart]
        counts[apart] = [len(x) for x in singles]
        out, place = np.empty(int(counts.sum()), np.uint32), np.repeat(np.isin(np.arange(len(words)), apart), counts)
        out[~place] = ids
        out[place] = np.concatenate(singles) if singles else []
        return out, counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        data, ends = joined([t.encode() for t in texts])
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        kind = _CLASS[data]
        added = [i for i, t in enumerate(texts) if any(x in t for x in self.added)]
        odd = np.unique(np.concatenate([np.searchsorted(ends, _odd(data, kind), side="right"), np.array(added, np.int64)]))
        if len(odd):
            plain = [t for i, t in enumerate(texts) if i not in set(odd.tolist())]
            ids, stops = self.encode(plain) if plain else (np.empty(0, np.uint32), np.empty(0, np.int64))
            parts = np.split(ids, stops[:-1]) if plain else []
            whole = dict(zip(odd.tolist(), self.library.encode_batch_fast([texts[i] for i in odd], add_special_tokens=False)))
            rest = iter(parts)
            out = [np.array(whole[i].ids, np.uint32) if i in whole else next(rest) for i in range(len(texts))]
            return np.concatenate(out), np.cumsum([len(x) for x in out])
        starts = _word_starts(data, kind, ends)
        ids, word_ends = self.lexicon.values_of(data, starts)
        words_before = np.searchsorted(starts, ends)
        return ids, np.concatenate([[0], word_ends])[words_before]
