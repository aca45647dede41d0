"""Token ids of the lower-case word BPE (``word_bpe_49k.json``) for whole slices of texts.

That tokenizer works word by word, so a worker keeps the ids of the words it has met and assembles texts
by numpy. Words of ASCII and Latin-1 letters, digits and punctuation are split here by the tokenizer's own
pattern (letter runs, single digits, other runs). A blank-delimited piece with anything else in it (other
scripts, apostrophes, ``<|``) goes to the tokenizer whole, so the ids are always those of the tokenizer.
"""

from __future__ import annotations

import os

import numpy as np

from motefield.llm.common import Texts, expand, hash_spans, mix

_SPACE, _LETTER, _DIGIT, _OTHER = 0, 1, 2, 3


def _classes() -> np.ndarray:
    def kind(b: int) -> int:
        if b == 0x20 or 0x09 <= b <= 0x0D:
            return _SPACE
        if 65 <= b <= 90 or 97 <= b <= 122 or b >= 0x80:
            return _LETTER
        return _DIGIT if 48 <= b <= 57 else _OTHER

    return np.array([kind(b) for b in range(256)], np.int8)


class WordTokenizer:
    """``encode(texts)`` gives all ids in one array and the number of ids of each text."""

    MOST = 250_000  # words kept; then the memory is emptied, which costs time only

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.path, self.full = path, None
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)
        self.kinds = _classes()
        self._empty()

    @property
    def whole(self):
        """The tokenizer as it is, loaded when the first odd piece turns up."""
        if self.full is None:
            from tokenizers import Tokenizer

            self.full = Tokenizer.from_file(self.path)
        return self.full

    def _empty(self) -> None:
        self.known: dict[int, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.begin, self.length, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0

    def _learn(self, keys: np.ndarray, spans: list[bytes], odd: np.ndarray) -> None:
        got = [[]] * len(keys)
        for where, odd_ones in ((np.flatnonzero(~odd), False), (np.flatnonzero(odd), True)):
            coder = self.whole if odd_ones and len(where) else self.bare
            for at in range(0, len(where), 2000):  # encodings are large objects: few at a time
                part = where[at: at + 2000]
                for i, e in zip(part, coder.encode_batch_fast([spans[i].decode() for i in part], add_special_tokens=False)):
                    got[i] = e.ids
        sizes = np.array([len(g) for g in got], np.int64)
        n, k = len(self.known), len(keys)
        while n + k > len(self.begin):
            self.begin, self.length = np.concatenate([self.begin, self.begin]), np.concatenate([self.length, self.length])
        while self.used + sizes.sum() > len(self.ids):
            self.ids = np.concatenate([self.ids, self.ids])
        self.begin[n: n + k] = self.used + np.cumsum(sizes) - sizes
        self.length[n: n + k] = sizes
        flat = np.array([i for g in got for i in g], np.uint32)
        self.ids[self.used: self.used + len(flat)] = flat
        self.used += len(flat)
        self.known.update(zip(keys.tolist(), range(n, n + k)))

    def _split(self, texts: Texts):
        """Bounds of pretokens, which of them go whole, and the lower-cased bytes."""
        raw, n = texts.buf, len(texts.buf)
        edge = np.zeros(n + 1, bool)
        edge[texts.offs] = True
        edge = edge[:n]
        kind = self.kinds[raw]
        lead = raw == 0xC3
        tail = np.zeros(n, bool)
        tail[1:] = lead[:-1] & ~edge[1:]
        latin = lead.copy()
        latin[:-1] &= tail[1:]
        latin_tail = tail & (raw >= 0x80) & (raw <= 0xBF) & (raw != 0x97) & (raw != 0xB7)
        latin[:-1] &= latin_tail[1:]
        odd = ((raw >= 0x80) & ~latin & ~latin_tail) | (raw == 0x27)
        odd[:-1] |= (raw[:-1] == 0x3C) & (raw[1:] == 0x7C)
        lower = raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)
        lower += (latin_tail & (raw >= 0x80) & (raw <= 0x9E)).astype(np.uint8) * np.uint8(32)
        solid = kind != _SPACE
        before = np.zeros(n, np.int8)
        before[1:] = kind[:-1]
        before[edge] = _SPACE
        chunk = solid & (before == _SPACE)
        chunk_at = np.flatnonzero(chunk)
        if not len(chunk_at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), lower
        bad = np.logical_or.reduceat(odd, chunk_at)
        start = solid & ((before != kind) | (kind == _DIGIT))
        if bad.any():
            here = np.repeat(bad, np.diff(np.append(chunk_at, n))) if chunk_at[0] == 0 else np.concatenate(
                [np.zeros(chunk_at[0], bool), np.repeat(bad, np.diff(np.append(chunk_at, n)))])
            start &= ~here | chunk
            lower = np.where(here, raw, lower)
        else:
            here = np.zeros(n, bool)
        s = np.flatnonzero(start)
        stop = np.ones(n + 1, bool)  # a pretoken ends where the next starts, at a blank or at the end of its text
        stop[:n] = start | ~solid | edge
        ends = np.flatnonzero(stop)
        e = ends[np.searchsorted(ends, s, "right")]
        return s, e, here[s], lower

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        if not len(texts.buf):
            return np.zeros(0, np.uint32), np.zeros(texts.n, np.int64)
        s, e, odd, lower = self._split(texts)
        h = hash_spans(lower, s, e)
        h = np.where(odd, mix(h ^ np.uint64(0x5851F42D4C957F2D)), h)
        keys, at, back = np.unique(h, return_index=True, return_inverse=True)
        found = [self.known.get(k, -1) for k in keys.tolist()]
        slot = np.array(found, np.int64)
        new = np.flatnonzero(slot < 0)
        if len(new):
            if len(self.known) + len(new) > self.MOST and self.known:
                self._empty()
                new = np.arange(len(keys))
            where = at[new]
            data = lower.tobytes()
            self._learn(keys[new], [data[a:b] for a, b in zip(s[where].tolist(), e[where].tolist())], odd[where])
            slot[new] = np.arange(len(self.known) - len(new), len(self.known))
        word = slot[back]
        size = self.length[word]
        ids = self.ids[expand(self.begin[word], size)]
        sums = np.concatenate([[0], np.cumsum(size)])
        first = np.searchsorted(s, texts.offs)
        return ids, sums[first[1:]] - sums[first[:-1]]
