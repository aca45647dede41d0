"""Language ID by segmentation-marginalised unigrams.

Each language is a probability per piece of a fixed public vocabulary (a sentencepiece model with byte
pieces, so that any text has a segmentation). The probability of a word is the sum over *all* its segmentations,
by the forward algorithm; a text is the product of its words, a word being a run of letters, lower-cased, with
the blank before it. Piece probabilities are fitted by expectation-maximisation: forward-backward gives
expected counts per piece and language, which are summed over tasks.

The fit may use a bounded, hashed sample of the labelled rows: ``train_docs`` per language (default 4 000).
Everything else runs over all rows and whole texts. Distinct words of a slice are scored together, and a worker
remembers words it has met (a bounded memory, for speed only). Words of any length are scored whole: beyond ``SHORT``
bytes the forward values are rescaled on the way and pieces are looked up block by block, which gives the same sums.
Words of over ``FIT_BYTES`` bytes take no part in the fit (part of its bounded sample).

Null texts and texts without a letter are ``und`` with score 0, as is every text when nothing could be learned.
Rows with a null language take no part in the fit. Ties go to the first language in alphabetical order.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motefield.llm.common import Texts, _powers, byte_class, expand, hash_spans, mix, per_text, release, staged, worker_cache

#: letters once lower-cased; every non-ASCII byte counts as part of one
ALPHA = byte_class(lambda b: 97 <= b <= 122 or b >= 0x80)
SHORT = 64
FIT_BYTES = 4096
#: a piece of n bytes weighs p * SCALE^n: the same factor for all languages, it keeps products in range
SCALE = 40.0


class Vocabulary:
    """Piece bytes of a sentencepiece model (blank for its word mark), looked up by hash."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = {}
        for i in range(model.get_piece_size()):
            if model.is_byte(i):
                pieces.setdefault(bytes([int(model.id_to_piece(i)[3:5], 16)]), i)
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
                b = model.id_to_piece(i).replace("▁", " ").encode()
                if b" " not in b[1:]:
                    pieces[b] = i
        self.size = model.get_piece_size()
        self.longest = max(map(len, pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum([len(p) for p in pieces])
        starts = ends - np.array([len(p) for p in pieces])
        keys = hash_spans(data, starts, ends)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(list(pieces.values()))[order]
        self.coarse = np.zeros(1 << 20, bool)
        self.coarse[self.keys >> np.uint64(44)] = True
        self.lengths = np.ones(self.size)
        self.lengths[self.ids] = np.array([len(p) for p in pieces])[order]

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece ids, -1 where there is none."""
        out = np.full(h.shape, -1, np.int64)
        maybe = np.flatnonzero(self.coarse[h >> np.uint64(44)])
        at = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
        hit = self.keys[at] == h[maybe]
        out[maybe[hit]] = self.ids[at[hit]]
        return out


def lattice(words: np.ndarray, vocab: Vocabulary):
    """(start, end, rows, piece ids) of every piece occurrence in equally long words (a byte matrix)."""
    n = words.shape[1]
    pw, inv = _powers(n + 1)
    sums = np.zeros((len(words), n + 1), np.uint64)
    np.cumsum((words.astype(np.uint64) + np.uint64(1)) * pw[:n], axis=1, out=sums[:, 1:])
    for e in range(1, n + 1):
        for s in range(max(0, e - vocab.longest), e):
            ids = vocab.find(mix((sums[:, e] - sums[:, s]) * inv[s]))
            rows = np.flatnonzero(ids >= 0)
            if len(rows):
                yield s, e, rows, ids[rows]


def forward(words: np.ndarray, vocab: Vocabulary, weights: np.ndarray) -> np.ndarray:
    """Log of the summed weight of all segmentations, per word and language."""
    alpha = np.zeros((words.shape[1] + 1, len(words), weights.shape[1]))
    alpha[0] = 1
    for s, e, rows, ids in lattice(words, vocab):
        alpha[e, rows] += alpha[s, rows] * weights[ids]
    return np.log(np.maximum(alpha[-1], 1e-300))


def expected(words: np.ndarray, counts: np.ndarray, vocab: Vocabulary, weights: np.ndarray, total: np.ndarray) -> None:
    """Adds expected piece counts to ``total`` (pieces, languages); ``counts``: (words, languages)."""
    n, languages = words.shape[1], weights.shape[1]
    arcs = list(lattice(words, vocab))
    alpha = np.zeros((n + 1, len(words), languages))
    alpha[0] = 1
    for s, e, rows, ids in arcs:
        alpha[e, rows] += alpha[s, rows] * weights[ids]
    beta = np.zeros_like(alpha)
    beta[n] = 1
    for s, e, rows, ids in reversed(arcs):  # arcs are sorted by end, and all arcs into e come before those out of it
        beta[s, rows] += beta[e, rows] * weights[ids]
    scale = counts / np.maximum(alpha[n], 1e-300)
    for s, e, rows, ids in arcs:
        share = alpha[s, rows] * weights[ids] * beta[e, rows] * scale[rows]
        for k in range(languages):
            total[:, k] += np.bincount(ids, share[:, k], minlength=len(total))


def arcs(buf: np.ndarray, start: np.ndarray, size: np.ndarray, vocab: Vocabulary, lo: int, hi: int):
    """(word, start, end, piece id), by end, of the pieces that end after bytes lo+1..hi of words; a word is a blank and
    the bytes of ``buf`` from ``start`` on, ``size`` bytes with the blank."""
    live = np.flatnonzero(size > lo)
    begin = max(0, lo - vocab.longest)
    count = np.minimum(size[live], hi) - begin
    own, off = np.repeat(live, count), expand(np.full(len(live), begin), count)
    data = buf[np.maximum(start[own] + off - 1, 0)]
    data[off == 0] = 0x20
    pw, inv = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * pw[: len(data)], out=sums[1:])
    last, found = np.minimum(size, hi)[own], []
    for n in range(1, vocab.longest + 1):
        at = np.flatnonzero((off + n <= last) & (off + n > lo))
        ids = vocab.find(mix((sums[at + n] - sums[at]) * inv[at]))
        hit = ids >= 0
        found.append((own[at[hit]], off[at[hit]], off[at[hit]] + n, ids[hit]))
    own, s, e, ids = (np.concatenate(c) for c in zip(*found))
    order = np.argsort(e, kind="stable")
    return own[order], s[order], e[order], ids[order]


def _scaled(blocks, size: np.ndarray, longest: int, weights: np.ndarray, stored: bool = False):
    """Log of the summed weight of all ways through each word; with ``stored`` also the sums at each byte and the logs of
    their scales. ``blocks``: (last byte, arcs up to there), in order."""
    words, languages = len(size), weights.shape[1]
    ring = np.zeros((longest + 1, words, languages))
    ring[0] = 1
    log, out, j = np.zeros((words, languages)), np.zeros((words, languages)), 0
    sums = [(ring[0].copy(), log.copy())]
    for hi, (own, s, e, ids) in blocks:
        bounds = np.searchsorted(e, np.arange(j + 1, hi + 2))
        for k in range(hi - j):
            at, x, y = j + k + 1, bounds[k], bounds[k + 1]
            now = ring[at % (longest + 1)]
            now[:] = 0
            np.add.at(now, own[x:y], ring[s[x:y] % (longest + 1), own[x:y]] * weights[ids[x:y]])
            if stored:
                sums.append((now.copy(), log.copy()))
            done = size == at
            if done.any():
                out[done] = np.log(np.maximum(now[done], 1e-300)) + log[done]
            if at % 8 == 0:
                scale = np.where(now > 0, now, 1)
                log += np.log(scale)
                ring /= scale
        j = hi
    return out, sums


def forward_long(buf: np.ndarray, start: np.ndarray, end: np.ndarray, vocab: Vocabulary, weights: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """`forward` for words of any length, given by their bounds in ``buf`` (without the blank)."""
    out = np.zeros((len(start), weights.shape[1]))
    order = np.argsort(end - start, kind="stable")
    for part in _dealt(order, end - start + 1, block):
        size = (end - start + 1)[part]
        tops = [min(x + block, int(size.max())) for x in range(0, int(size.max()), block)]
        blocks = ((hi, arcs(buf, start[part], size, vocab, hi - (hi - 1) % block - 1, hi)) for hi in tops)
        out[part] = _scaled(blocks, size, vocab.longest, weights)[0]
    return out


def expected_long(buf: np.ndarray, start: np.ndarray, end: np.ndarray, counts: np.ndarray, vocab: Vocabulary, weights: np.ndarray, total: np.ndarray) -> None:
    """`expected` for words of any length; their sums at each byte are held at once."""
    order = np.argsort(end - start, kind="stable")
    for part in _dealt(order, end - start + 1, 1 << 15):
        size = (end - start + 1)[part]
        most = int(size.max())
        own, s, e, ids = arcs(buf, start[part], size, vocab, 0, most)
        whole, up = _scaled([(most, (own, s, e, ids))], size, vocab.longest, weights, True)
        turn = np.argsort((size[own] - s), kind="stable")
        _, down = _scaled([(most, (own[turn], (size[own] - e)[turn], (size[own] - s)[turn], ids[turn]))], size, vocab.longest, weights, True)
        up, up_log, down, down_log = (np.stack(c) for both in (up, down) for c in zip(*both))
        at = size[own] - e
        share = up[s, own] * weights[ids] * down[at, own] * np.exp(up_log[s, own] + down_log[at, own] - whole[own]) * counts[part][own]
        for k in range(weights.shape[1]):
            total[:, k] += np.bincount(ids, share[:, k], minlength=len(total))


def _dealt(order: np.ndarray, size: np.ndarray, most: int):
    """Words in groups of at most ``most`` bytes, or one word."""
    group = []
    for k in order.tolist():
        if group and (len(group) + 1) * size[k] > most:
            yield np.array(group)
            group = []
        group.append(k)
    if group:
        yield np.array(group)


def _matrices(data: np.ndarray, s: np.ndarray, e: np.ndarray):
    """Words of up to SHORT bytes grouped by length, as byte matrices with the blank before each."""
    size = e - s + 1
    for n in np.unique(size[size <= SHORT + 1]).tolist():
        own = np.flatnonzero(size == n)
        for part in np.array_split(own, max(1, len(own) * n // 400_000)):
            m = data[np.maximum(s[part][:, None] - 1 + np.arange(n), 0)]
            m[:, 0] = 0x20
            yield part, m


def _lowered(column: pa.Array) -> Texts:
    return Texts(pc.utf8_lower(column.cast(pa.string()).fill_null("")))


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # (pieces, languages), scaled
    key: str = ""


def _distinct(texts: Texts):
    w = texts.words(ALPHA)
    keys, at, back = np.unique(w.hashes(), return_index=True, return_inverse=True)
    return w.start, w.end, w.text_of(), keys, at, back


def learn(rows: DataFrame, vocabulary: str, lang: str = "lang", text: str = "text", rounds: int = 2) -> LanguageModel:
    """Fits piece probabilities; ``rows``: labelled texts."""
    languages = sorted(r[0] for r in rows.select(lang).where(F.col(lang).isNotNull()).distinct().collect())
    vocab = Vocabulary(vocabulary)
    v, n = vocab.size, len(languages)
    if not n:
        return LanguageModel([], np.zeros((v, 0)))
    index = {x: i for i, x in enumerate(languages)}
    p = np.full((v, n), 1.0 / v)
    for _ in range(rounds):
        shared = rows.sparkSession.sparkContext.broadcast(p * SCALE ** vocab.lengths[:, None])

        def count(batches):
            release(("pieces:" + vocabulary,))
            vocab, total = worker_cache("pieces:" + vocabulary, lambda: Vocabulary(vocabulary)), np.zeros((v, n))
            weights = shared.value
            for batch in batches:
                own = [index.get(x, -1) for x in batch.column(lang).to_pylist()]
                for at in range(0, batch.num_rows, 500):
                    texts = _lowered(batch.column(text).slice(at, 500))
                    s, e, doc, keys, first, back = _distinct(texts)
                    kind = np.array(own[at: at + 500])[doc] if len(doc) else doc
                    counts = np.zeros((len(keys), n))
                    np.add.at(counts, (back[kind >= 0], kind[kind >= 0]), 1)
                    s, e = s[first], e[first]
                    for part, m in _matrices(texts.buf, s, e):
                        expected(m, counts[part], vocab, weights, total)
                    far = np.flatnonzero((e - s > SHORT) & (e - s <= FIT_BYTES))
                    expected_long(texts.buf, s[far], e[far], counts[far], vocab, weights, total)
            piece, kind = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(kind.astype(np.int32)), pa.array(total[piece, kind])], ["piece", "kind", "c"])

        # at most pieces x languages rows, whatever the data
        got = rows.select(lang, text).mapInArrow(count, "piece int, kind int, c double").groupBy("piece", "kind").agg(F.sum("c").alias("c")).toPandas()
        c = np.full((v, n), 0.02)
        c[got["piece"], got["kind"]] += got["c"]
        p = c / c.sum(0)
    return LanguageModel(languages, p * SCALE ** vocab.lengths[:, None], uuid.uuid4().hex)


class _Memory:
    """Scores of words a worker has met."""

    MOST = 250_000

    def __init__(self, languages: int):
        self.known: dict[int, int] = {}
        self.rows = np.zeros((1 << 12, languages))

    def scores(self, keys: np.ndarray, make) -> np.ndarray:
        slot = np.array([self.known.get(k, -1) for k in keys.tolist()], np.int64)
        new = np.flatnonzero(slot < 0)
        if len(new):
            if len(self.known) + len(new) > self.MOST and self.known:
                self.known.clear()
                new = np.arange(len(keys))
            n = len(self.known)
            while n + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, self.rows])
            self.rows[n: n + len(new)] = make(new)
            slot[new] = np.arange(n, n + len(new))
            self.known.update(zip(keys[new].tolist(), range(n, n + len(new))))
        return self.rows[slot]


def predicted(docs: DataFrame, model: LanguageModel, vocabulary: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``lang_pred, score`` to each row."""
    n, names, key = len(model.languages), np.array(model.languages, object), model.key
    shared = docs.sparkSession.sparkContext.broadcast(model.weights)

    def make():
        vocab = worker_cache("pieces:" + vocabulary, lambda: Vocabulary(vocabulary))
        memory = worker_cache("scores:" + key, lambda: _Memory(n))

        def fn(_, batch):
            texts = _lowered(batch.column(text))
            s, e, doc, keys, first, back = _distinct(texts)

            def score(new):
                out = np.zeros((len(new), n))
                at, to = s[first[new]], e[first[new]]
                for part, m in _matrices(texts.buf, at, to):
                    out[part] = forward(m, vocab, shared.value)
                far = np.flatnonzero(to - at > SHORT)
                out[far] = forward_long(texts.buf, at[far], to[far], vocab, shared.value)
                return out

            total = np.zeros((texts.n, n))
            if len(keys) and n:
                word = memory.scores(keys, score)[back]
                for k in range(n):
                    total[:, k] = np.bincount(doc, word[:, k], minlength=texts.n)
            best = total.argmax(1) if n else np.zeros(texts.n, int)
            share = np.exp(total - total.max(1, keepdims=True)) if n else np.ones((texts.n, 1))
            return {"lang_pred": pa.array([names[b] for b in best] if n else ["und"] * texts.n, pa.string()),
                    "score": pa.array((1 / share.sum(1)) if n else np.zeros(texts.n))}

        return fn

    got = per_text(docs.withColumn("__letter", F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))), make, "lang_pred string, score double",
                   text, None if keep is None else [*keep, "__letter"], holds=("pieces:" + vocabulary, "scores:" + key))
    return got.withColumn("lang_pred", F.when(F.col("__letter"), F.col("lang_pred")).otherwise("und")).withColumn(
        "score", F.when(F.col("__letter"), F.col("score")).otherwise(0.0)).drop("__letter")


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def sample(rows: DataFrame, lang: str, id_col: str, train_docs: int) -> DataFrame:
    """About ``train_docs`` rows per language, picked by a hash of the id; all where there are fewer."""
    sizes = rows.groupBy(lang).count().collect()  # one row per language
    if not sizes:
        return rows
    rates = F.create_map(*[x for r in sizes for x in (F.lit(r[0]), F.lit(min(1.0, train_docs / r["count"])))])
    return rows.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 31)) < rates[F.col(lang)] * float(1 << 31))


def identified(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text: str = "text", lang: str = "lang",
               train_docs: int = 4000) -> DataFrame:
    """``id_col, held_out, lang_pred, score`` per row; learned from the labelled rows that are not held out."""
    known = docs.select(id_col, F.col(text).cast("string").alias(text), lang).where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    model = learn(staged(sample(known, lang, id_col, train_docs).select(lang, text), "language-sample"), vocabulary, lang, text)
    texts = docs.select(id_col, F.col(text).cast("string").alias(text))
    return predicted(texts, model, vocabulary, text, [id_col]).withColumn("held_out", held_out(id_col))
