"""Exact SentencePiece encoding (models of the merge type) by backtracking, and decoding.

A sequence of pieces is what merging gives for a text if and only if merging leaves every two neighbours of it apart.
So the encoder goes from left to right: the longest piece at a place (Aho-Corasick), then its shorter prefixes, until
one fits its left neighbour, that is until merging the characters of both gives just these two again. Where none fits,
the place is marked in a bitfield and the last piece is taken back. What stands before a place is always the encoding
of the text before it, of which there is one, so a place that failed once has failed for good.

No merge joins two characters that stand side by side in no piece. Texts are cut between such (a letter and the
blank or the full stop after it, say), and a worker remembers the ids of the stretches it has met.

Null texts have no ids, as empty ones. Rows that repeat, ids that repeat or are null: every row is encoded for itself.
A column of the input that is called like an added one is replaced. Empty tables give empty tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from motefield.llm.common import Texts, expand, lists, per_text, release, worker_cache

BLANK = "▁"  # how pieces write a space


class Vocabulary:
    """Pieces of a model: texts, scores, and what ids stand for. Characters without a piece become byte pieces."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != model.trainer_spec.BPE or not model.trainer_spec.byte_fallback:
            raise ValueError("a model of the merge type with byte pieces is needed")
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces:
            raise ValueError("a model that changes nothing in a text but its blanks is needed")
        if model.trainer_spec.treat_whitespace_as_suffix or any(p.type in (4, 5) for p in model.pieces):
            raise ValueError("pieces of the user and blanks as endings are not known here")
        self.size = len(model.pieces)
        normal = [(p.piece, i, p.score) for i, p in enumerate(model.pieces) if p.type == 1]
        self.ids = {piece: i for piece, i, _ in normal}
        self.scores = {piece: score for piece, _, score in normal}
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        unknown = next(p.piece for p in model.pieces if p.type == 2)
        self.unknown = model.trainer_spec.unk_surface or unknown
        self.kinds = np.array([p.type for p in model.pieces], np.int8)
        self.pieces = [p.piece for p in model.pieces]

    def merged(self, text: str) -> list[str]:
        """Merging by its definition: the best neighbours first, of equal ones the leftmost, until none is a piece."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                break
            parts[at: at + 2] = [parts[at] + parts[at + 1]]
        return parts


class Encoder:
    """Ids of texts as bytes of little-endian 32-bit numbers."""

    MOST = 300_000  # stretches and pairs remembered; then the memory is emptied, which costs time only

    def __init__(self, path: str):
        import ahocorasick

        self.vocab = vocab = Vocabulary(path)
        # a token is a piece that merging can make, or any single character
        self.texts = [p for p in vocab.ids if len(p) > 1 and vocab.merged(p) == [p]]
        self.texts += sorted({c for p in vocab.ids for c in p})
        self.token = {t: k for k, t in enumerate(self.texts)}
        self.machine = ahocorasick.Automaton()
        for text, k in self.token.items():
            self.machine.add_word(text, k)
        self.machine.make_automaton()
        self.length = [len(t) for t in self.texts]
        self.shorter = [self._prefix(t) for t in self.texts]
        self.coded = [self._coded(t) for t in self.texts]
        self.fit: dict[int, bool] = {}
        self.known = _Memory(self)
        pairs = sorted({(ord(a), ord(b)) for p in vocab.ids for a, b in zip(p, p[1:])})
        used = np.unique(np.array(pairs, np.int64).reshape(-1, 2))
        self.number = np.zeros(0x110000, np.int16)  # characters of longer pieces are numbered from 1
        self.number[used] = np.arange(1, len(used) + 1)
        self.beside = np.zeros((len(used) + 1, len(used) + 1), bool)
        for a, b in pairs:
            self.beside[self.number[a], self.number[b]] = True

    def _prefix(self, text: str) -> int:
        """The next shorter token that the text starts with, or -1."""
        return next((self.token[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in self.token), -1)

    def _coded(self, text: str) -> bytes:
        ids = [self.vocab.ids[text]] if text in self.vocab.ids else [self.vocab.bytes[b] for b in text.encode()]
        return np.array(ids, "<i4").tobytes()

    def _fits(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.fit.get(key)
        if known is None:
            a, b = self.texts[left], self.texts[right]
            known = self.fit[key] = self.vocab.merged(a + b) == [a, b]
        return known

    def backtracked(self, text: str) -> bytes:
        """Ids of a stretch. Characters of no piece stand apart from all others."""
        n = len(text)
        longest = [-1] * n
        for end, token in self.machine.iter(text):
            longest[end + 1 - self.length[token]] = token  # ends ascend, so the longest comes last
        failed = bytearray(n // 8 + 1)
        out: list[bytes] = []
        at = 0
        while at < n:
            if longest[at] < 0:
                out += [np.array([self.vocab.bytes[b] for b in text[at].encode()], "<i4").tobytes()]
                at += 1
                continue
            stop = at + 1  # a run of characters that pieces know
            while stop < n and longest[stop] >= 0:
                stop += 1
            path: list[int] = []
            token = longest[at]
            while True:
                last = path[-1] if path else -1
                while token >= 0:
                    end = at + self.length[token]
                    if not failed[end >> 3] >> (end & 7) & 1 and (last < 0 or self._fits(last, token)):
                        break
                    token = self.shorter[token]
                if token >= 0:
                    path.append(token)
                    at = end
                    if at == stop:
                        break
                    token = longest[at]
                else:
                    failed[at >> 3] |= 1 << (at & 7)
                    back = path.pop()
                    at -= self.length[back]
                    token = self.shorter[back]
            out += [self.coded[t] for t in path]
        return b"".join(out)

    def ids(self, texts: list[str]) -> tuple[bytes, np.ndarray]:
        """Ids of all texts in one row, and the number of ids of each."""
        marked = [BLANK + t.replace(" ", BLANK) if t else "" for t in texts]
        whole = "".join(marked)
        ends = np.cumsum([len(t) for t in marked])
        number = self.number[np.frombuffer(whole.encode("utf-32-le"), "<u4")]
        cut = np.ones(len(number), bool)  # before which characters a stretch starts
        cut[1:] = ~self.beside[number[:-1], number[1:]]
        cut[ends[:-1][ends[:-1] < len(number)]] = True
        at = np.flatnonzero(cut)
        last = np.searchsorted(at, ends)
        at = [*at.tolist(), len(number)]
        parts = [self.known[whole[a:b]] for a, b in zip(at, at[1:])]
        upto = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))]) // 4
        self._tidy()
        return b"".join(parts), np.diff(upto[last], prepend=0)

    def _tidy(self) -> None:
        for memory in (self.known, self.fit):
            if len(memory) > self.MOST:
                memory.clear()


class _Memory(dict):
    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, stretch: str) -> bytes:
        ids = self[stretch] = self.encoder.backtracked(stretch)
        return ids


class Decoder:
    """Texts of ids, for whole slices at once: pieces are gathered as bytes, one blank at the start is left out."""

    def __init__(self, path: str):
        vocab = Vocabulary(path)
        raw = [b""] * vocab.size
        for i, piece in enumerate(vocab.pieces):
            if vocab.kinds[i] == 1:
                raw[i] = piece.replace(BLANK, " ").encode()
            elif vocab.kinds[i] == 2:
                raw[i] = vocab.unknown.encode()
            elif vocab.kinds[i] == 6:
                raw[i] = bytes([int(piece[1:-1], 16)])
        self.raw, self.kinds = raw, vocab.kinds
        self.data = np.frombuffer(b"".join(raw), np.uint8)
        self.size = np.array([len(r) for r in raw], np.int64)
        self.begin = np.cumsum(self.size) - self.size

    def texts(self, ids: np.ndarray, count: np.ndarray) -> pa.Array:
        size = self.size[ids]
        data = self.data[expand(self.begin[ids], size)]
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(count)])]
        first = ends[:-1]  # a text that starts with a blank of a piece loses it
        full = np.diff(ends) > 0
        drop = first[full][data[first[full]] == 0x20]
        opened = np.cumsum(count) - count
        drop = drop[self.kinds[ids[opened[full][data[first[full]] == 0x20]]] == 1] if len(drop) else drop
        keep = np.ones(len(data), bool)
        keep[drop] = False
        ends = np.concatenate([[0], np.cumsum(keep)])[ends]
        data = data[keep]
        found = pa.Array.from_buffers(pa.large_binary(), len(count), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])
        try:
            found = found.cast(pa.large_string())
        except pa.ArrowInvalid:  # byte pieces that are no UTF-8, which no encoding gives
            found = pa.array([_repaired(b) for b in found.to_pylist()], pa.large_string())
        return found.cast(pa.string())


def _repaired(data: bytes) -> str:
    """Each byte that starts no character becomes U+FFFD."""
    out, at = [], 0
    while at < len(data):
        for n in (1, 2, 3, 4):
            try:
                out.append(data[at: at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def encoded(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``ids``: the ids of the whole text, as the library gives them, without begin or end ids.

    ``path`` is the model's place on every executor. ``keep`` names the columns that stay (default: all).
    """
    key = f"pieces {path}"

    def make():
        coder = worker_cache(key, lambda: Encoder(path))

        def fn(texts: Texts, batch: pa.RecordBatch) -> dict:
            ids, count = coder.ids([t or "" for t in batch.column(text).to_pylist()])
            return {"ids": lists(np.frombuffer(ids, "<i4"), count, pa.int32())}

        return fn

    return per_text(df, make, "ids array<int>", text, keep, holds=(key,))


def decoded(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded``: the text that the ids of a row stand for (empty for no ids or null). All columns stay."""
    kept = [f for f in df.schema if f.name != "decoded"]
    schema = T.StructType([*kept, T.StructField("decoded", T.StringType())])
    names = [f.name for f in kept]

    def run(batches):
        release()
        coder = Decoder(path)
        for whole in batches:
            sizes = whole.column(ids).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            at, upto = 0, np.cumsum(sizes)
            while at < whole.num_rows:  # rows of about 250 000 ids at a time
                to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + 250_000, "right")))
                batch = whole.slice(at, to - at)
                flat = batch.column(ids).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                text = coder.texts(flat, sizes[at:to].astype(np.int64))
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), text], [*names, "decoded"])
                at = to

    return df.mapInArrow(run, schema)
