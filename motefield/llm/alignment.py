"""Alignment of the tokens of two tokenizers by their byte ends, over merge-path pieces.

Both tokenizers cut the same bytes, so a text has two ascending lists of token ends. Their merge is a path through a
grid, and the point at which the path crosses a diagonal is found by binary search (equal ends: A first). Diagonals at
equal distances cut the merge into pieces of equal work that know nothing of each other but the last A token before
them. Each piece finds the ends that both lists share: a link between the two tokens that end there, and the border of
two groups. The groups at the borders of pieces are put together in the end, per document. A document of less than
`WORK` tokens is one piece, and needs no exchange.

Links are counted over the corpus per pair of ids (partial sums per piece, then one hash aggregate). The counts come back
to the documents in two ways at once: the most frequent pairs, at most `HOT` of them by construction, are broadcast;
any other pair holds less than 2 / `HOT` of all links and is joined by shuffle, so no key of that join is hot.

Null and empty texts have no tokens, and neither have texts whose joined token bytes of one side differ from space + text.
Every input row is a document of its own, whether ids or texts repeat or are null. Columns of the input that are called
like a result are left out. Empty tables give empty tables.
"""

from __future__ import annotations

import hashlib
import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motefield.llm.common import Texts, expand, lists, per_text, release, staged, worker_cache
from motefield.llm.sentencepieces import BLANK, Encoder

WORK = 1 << 14
HOT = 1 << 19

_WHITE, _LETTER, _SIGN, _ODD = 1, 2, 4, 8


class Spans:
    """Bytes of each id of a vocabulary."""

    def __init__(self, raw: list[bytes]):
        self.data = np.frombuffer(b"".join(raw), np.uint8)
        self.size = np.array([len(r) for r in raw], np.int64)
        self.begin = np.cumsum(self.size) - self.size

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.data[expand(self.begin[ids], self.size[ids])]


class ByteCoder:
    """A byte-level tokenizer that keeps the ids of the stretches it has met.

    Its pattern never joins a character with the white space after it, nor a Latin letter with the sign after it, and looks at
    nothing before a token: texts are cut there. Texts with rare white space are given to the tokenizer uncut.
    """

    MOST = 300_000  # stretches remembered; then the memory is emptied, which costs time only
    LONG = 64  # longer stretches are not remembered

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(path)
        self.coder.encode_special_tokens = True
        self.known: dict[str, bytes] = {}
        kind = np.zeros(0x110000, np.uint8)
        kind[[0x20, *range(0x09, 0x0E)]] = _WHITE
        kind[[*range(65, 91), *range(97, 123), *range(0xC0, 0x250)]] = _LETTER
        kind[[0xD7, 0xF7]] = 0
        kind[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = _SIGN
        kind[[c for c in range(0x110000) if c > 13 and c != 32 and chr(c).isspace()]] = _ODD
        self.kind = kind

    def spans(self) -> Spans:
        """Bytes of the ids; printable bytes stand for themselves, the others for the characters from 256 on."""
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        other = [b for b in range(256) if b not in set(own)]
        of = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(other)}
        raw = [b""] * self.coder.get_vocab_size(with_added_tokens=True)
        for token, i in self.coder.get_vocab(with_added_tokens=True).items():
            raw[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
        return Spans(raw)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one row, and the number of ids of each."""
        whole = "".join(texts)
        ends = np.cumsum([len(t) for t in texts])
        kind = self.kind[np.frombuffer(whole.encode("utf-32-le"), "<u4")]
        cut = np.zeros(len(kind), bool)
        white = (kind & _WHITE) > 0
        cut[1:] = (white[1:] & ~white[:-1]) | ((kind[1:] == _SIGN) & (kind[:-1] == _LETTER))
        for k in np.unique(np.searchsorted(ends, np.flatnonzero(kind == _ODD), "right")):
            cut[ends[k] - len(texts[k]): ends[k]] = False
        starts = np.concatenate([[0], ends[:-1]])
        cut[starts[starts < len(kind)]] = True
        at = np.flatnonzero(cut)
        last = np.searchsorted(at, ends)
        at = [*at.tolist(), len(kind)]
        parts = [whole[a:b] for a, b in zip(at, at[1:])]
        if len(self.known) > self.MOST:
            self.known.clear()
        new = [p for p in dict.fromkeys(parts) if p not in self.known]
        long = {}
        for k in range(0, len(new), 2000):  # encodings are large objects: few at a time
            for part, e in zip(new[k: k + 2000], self.coder.encode_batch_fast(new[k: k + 2000], add_special_tokens=False)):
                (self.known if len(part) <= self.LONG else long)[part] = np.array(e.ids, "<i4").tobytes()
        known = self.known
        found = [known[p] if p in known else long[p] for p in parts] if long else [known[p] for p in parts]
        upto = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))]) // 4
        return np.frombuffer(b"".join(found), "<i4"), np.diff(upto[last], prepend=0)


class Pair:
    """Both tokenizers, and the tokens of a slice of texts."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteCoder(path_a), Encoder(path_b)
        self.spans_a = self.a.spans()
        vocab = self.b.vocab
        self.spans_b = Spans([bytes([int(p[1:-1], 16)]) if kind == 6 else p.replace(BLANK, " ").encode()
                              for p, kind in zip(vocab.pieces, vocab.kinds)])

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """``a, count_a, b, count_b`` of texts; those without tokens have counts of zero."""
        marked = [" " + t if t else "" for t in texts]
        a, count_a = self.a.ids(marked)
        flat, count_b = self.b.ids(texts)
        b = np.frombuffer(flat, "<i4")
        raw = [t.encode() for t in marked]
        size = np.array([len(r) for r in raw], np.int64)
        want = np.frombuffer(b"".join(raw), np.uint8)
        good = _same(self.spans_a, a, count_a, want, size) & _same(self.spans_b, b, count_b, want, size)
        if not good.all():
            a, b = a[np.repeat(good, count_a)], b[np.repeat(good, count_b)]
            count_a, count_b = np.where(good, count_a, 0), np.where(good, count_b, 0)
        return a, count_a, b, count_b


def _same(spans: Spans, ids: np.ndarray, count: np.ndarray, want: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of each text: whether the bytes of its ids are the wanted ones."""
    upto = np.concatenate([[0], np.cumsum(spans.size[ids])])
    to = upto[np.cumsum(count)]
    mine = np.diff(to, prepend=0)
    got = spans.joined(ids)
    if np.array_equal(mine, size) and np.array_equal(got, want):
        return np.ones(len(size), bool)
    at, at_want = to - mine, np.cumsum(size) - size
    return np.array([m == s and np.array_equal(got[x: x + m], want[y: y + s]) for m, s, x, y in zip(mine, size, at, at_want)], bool)


def crossing(a: np.ndarray, b: np.ndarray, diagonal: int) -> int:
    """How many of the first ``diagonal`` steps of the merge of two ascending lists come from ``a`` (equal: ``a`` first)."""
    low, high = max(0, diagonal - len(b)), min(diagonal, len(a))
    while low < high:
        mid = (low + high) // 2
        if a[mid] <= b[diagonal - 1 - mid]:
            low = mid + 1
        else:
            high = mid
    return low


def _ends(sizes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Ends of tokens within their texts."""
    upto = np.cumsum(sizes)
    first = np.cumsum(count) - count
    before = np.concatenate([[0], upto])[first]
    return upto - np.repeat(before, count)


@dataclass
class Pieces:
    """Pieces of the merge paths of a slice of documents: all tokens in one row, and how many of them each piece has."""

    doc: np.ndarray
    piece: np.ndarray
    pieces: np.ndarray  # of the document
    a: np.ndarray
    ends_a: np.ndarray
    count_a: np.ndarray
    b: np.ndarray
    ends_b: np.ndarray
    count_b: np.ndarray
    left_id: np.ndarray  # the A token before the piece, -1 for none
    left_end: np.ndarray


def cut(a: np.ndarray, sizes_a: np.ndarray, count_a: np.ndarray, b: np.ndarray, sizes_b: np.ndarray, count_b: np.ndarray, work: int) -> Pieces:
    """Cuts the merge of each document's token ends at every ``work``-th diagonal."""
    ends_a, ends_b = _ends(sizes_a, count_a), _ends(sizes_b, count_b)
    to_a, to_b = np.cumsum(count_a), np.cumsum(count_b)
    pieces = np.maximum(1, -(-(count_a + count_b) // work))
    doc = np.repeat(np.arange(len(pieces)), pieces)
    piece = expand(np.zeros(len(pieces), np.int64), pieces)
    stop_a, stop_b = to_a[doc], to_b[doc]  # right for the last piece of a document
    for k in np.flatnonzero(piece + 1 < pieces[doc]):
        d, diagonal = doc[k], int(piece[k] + 1) * work
        x, y = to_a[d] - count_a[d], to_b[d] - count_b[d]
        i = crossing(ends_a[x: to_a[d]], ends_b[y: to_b[d]], diagonal)
        stop_a[k], stop_b[k] = x + i, y + diagonal - i
    start = np.concatenate([[0], stop_a[:-1]])
    left = np.where((piece > 0) & (start > (to_a - count_a)[doc]), start - 1, -1)
    pick = lambda values: np.where(left >= 0, values[left], -1) if len(values) else np.full(len(left), -1)
    return Pieces(doc, piece, pieces[doc], a, ends_a, np.diff(stop_a, prepend=0), b, ends_b, np.diff(stop_b, prepend=0), pick(a), pick(ends_a))


def merged(p: Pieces, size_b: int, digest: bool, decimal: pa.Array) -> dict[str, pa.Array]:
    """Links and groups of each piece: ``n_a, n_b, n_links``, ``pairs`` (a * size_b + b, distinct) and ``times`` of its links.

    The groups of a document of one piece are in ``groups`` (with ``digest`` as a SHA-256). A piece of several has ``head_a`` and
    ``head_b``, the ids up to its first border, ``body``, the groups between borders, ``tail_a`` and ``tail_b``, the ids after the last.
    """
    n = len(p.piece)
    every = np.arange(n)
    base = every.astype(np.int64) << 40  # ends of different pieces never meet
    of_a, of_b = np.repeat(every, p.count_a), np.repeat(every, p.count_b)
    key_a, key_b = base[of_a] + p.ends_a, base[of_b] + p.ends_b
    at = np.cumsum(p.count_a) - p.count_a
    all_a, id_a = np.insert(key_a, at, base + p.left_end), np.insert(p.a, at, p.left_id)
    place = np.searchsorted(all_a, key_b)
    hit = np.flatnonzero(all_a[np.minimum(place, len(all_a) - 1)] == key_b)
    border = key_b[hit]
    piece = of_b[hit]
    n_links = np.bincount(piece, minlength=n)

    pair = id_a[place[hit]].astype(np.int64) * size_b + p.b[hit]
    order = np.lexsort((pair, piece))
    pair, piece = pair[order], piece[order]
    first = np.ones(len(pair), bool)
    first[1:] = (pair[1:] != pair[:-1]) | (piece[1:] != piece[:-1])
    where = np.flatnonzero(first)
    times = np.diff(np.concatenate([where, [len(pair)]]))
    distinct = np.bincount(piece[where], minlength=n)

    # groups: those that end at a border of the piece, and one for what follows the last border
    top = np.cumsum(n_links + 1)
    total = int(top[-1]) if n else 0
    text_a = _joined(p.a, np.searchsorted(border, key_a) + of_a, total, decimal)
    text_b = _joined(p.b, np.searchsorted(border, key_b) + of_b, total, decimal)
    both = pc.binary_join_element_wise(text_a, text_b, "|")
    several = p.pieces > 1
    start = top - n_links - 1
    skip = several.astype(np.int64)  # the first group of a piece of several may begin before it
    inner = np.maximum(n_links - skip, 0)
    body = pc.binary_join(lists_of(both.take(pa.array(expand(start + skip, inner))), inner), ";")
    only, none = pa.array(~several), pa.scalar(None, pa.string())
    groups = pc.if_else(only, body, none)
    if digest:
        groups = pa.array([t and hashlib.sha256(t.encode()).hexdigest() for t in groups.to_pylist()], pa.string())
    head = lambda text: pc.if_else(pa.array(several & (n_links > 0)), text.take(pa.array(start)), none)
    tail = lambda text: pc.if_else(only, none, text.take(pa.array(top - 1)))
    return {"piece": pa.array(p.piece, pa.int32()), "pieces": pa.array(p.pieces, pa.int32()), "n_a": pa.array(p.count_a, pa.int64()),
            "n_b": pa.array(p.count_b, pa.int64()), "n_links": pa.array(n_links, pa.int64()), "pairs": lists(pair[where], distinct, pa.int64()),
            "times": lists(times, distinct, pa.int32()), "groups": groups, "head_a": head(text_a), "head_b": head(text_b),
            "body": pc.if_else(only, none, body), "tail_a": tail(text_a), "tail_b": tail(text_b)}


def linked(docs: DataFrame, path_a: str, path_b: str, size_b: int, text: str, keep: list[str], digest: bool, work: int) -> DataFrame:
    """Pieces of all documents with the columns of `merged`, ``row``, the number of the document, and ``kept``, its columns."""
    key = f"pair {path_a} {path_b}"
    kept = F.struct(*keep) if keep else F.struct(F.lit(0))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), kept.alias("kept"), F.col(text).alias("text"))
    ddl = ", ".join([T.StructType([rows.schema["row"], rows.schema["kept"]]).toDDL(),
                     "piece int, pieces int, n_a long, n_b long, n_links long, pairs array<long>, times array<int>, groups string",
                     "head_a string, head_b string, body string, tail_a string, tail_b string"])

    def make():
        pair = worker_cache(key, lambda: Pair(path_a, path_b))
        decimal = pa.array([str(i) for i in range(1 << 17)])

        def fn(texts: Texts, batch: pa.RecordBatch) -> dict:
            a, count_a, b, count_b = pair.tokens([t or "" for t in batch.column("text").to_pylist()])
            p = cut(a, pair.spans_a.size[a], count_a, b, pair.spans_b.size[b], count_b, work)
            doc = pa.array(p.doc)
            return {"row": batch.column("row").take(doc), "kept": batch.column("kept").take(doc)} | merged(p, size_b, digest, decimal)

        return fn

    return per_text(rows, make, ddl, rows=False, holds=(key,))


def lists_of(values: pa.Array, count: np.ndarray) -> pa.ListArray:
    offsets = np.zeros(len(count) + 1, np.int32)
    np.cumsum(count, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def _joined(ids: np.ndarray, group: np.ndarray, total: int, decimal: pa.Array) -> pa.Array:
    """Decimal ids of each group, joined by commas."""
    texts = decimal.take(pa.array(ids)) if not len(ids) or ids.max() < len(decimal) else pa.array(ids).cast(pa.string())
    return pc.binary_join(lists_of(texts, np.bincount(group, minlength=total)), ",")


def stitched(parts: DataFrame, digest: bool) -> DataFrame:
    """``row, groups`` of the documents of several pieces: what follows a piece's last border is joined to what comes before the
    first border of a later one. One group holds the texts of one document's groups."""

    def run(table: pa.Table) -> pa.Table:
        done, a, b = [], [], []
        for r in table.sort_by("piece").to_pylist():
            if r["n_links"]:
                a, b = a + [r["head_a"]], b + [r["head_b"]]
                done.append("|".join(",".join(x for x in side if x) for side in (a, b)))
                if r["body"]:
                    done.append(r["body"])
                a, b = [], []
            a, b = a + [r["tail_a"]], b + [r["tail_b"]]
        text = ";".join(done)
        return pa.table({"row": [table.column("row")[0].as_py()], "groups": [hashlib.sha256(text.encode()).hexdigest() if digest else text]},
                        schema=pa.schema([("row", pa.int64()), ("groups", pa.string())]))

    slim = parts.where("pieces > 1").select("row", "piece", "n_links", "head_a", "head_b", "body", "tail_a", "tail_b")
    return slim.groupBy("row").applyInArrow(run, "row long, groups string")


def pair_counts(parts: DataFrame, size_b: int) -> DataFrame:
    """``pair, n, best``: links of each pair of ids in the corpus, and whether no other pair of its B id has more."""
    counts = parts.select(F.explode(F.arrays_zip("pairs", "times")).alias("e")).groupBy(F.col("e.pairs").alias("pair")).agg(
        F.sum("e.times").alias("n")).withColumn("b", F.col("pair") % size_b)
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return staged(counts.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")


def link_sums(parts: DataFrame, counts: DataFrame, hot: int = HOT) -> DataFrame:
    """``row, n_best, count_sum`` of the documents with links.

    Pairs with at least 2^k links are broadcast, with the least k for which these are at most ``hot`` pairs.
    """
    octaves = counts.groupBy((F.length(F.bin("n")) - 1).alias("octave")).count().collect()  # at most 63 rows
    above, floor = 0, 0
    for r in sorted(octaves, key=lambda r: -r.octave):
        above += r["count"]
        if above > hot:
            floor = r.octave + 1
            break
    links = parts.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("e")).select("row", F.col("e.pairs").alias("pair"), F.col("e.times").alias("times"))
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum")]
    frequent = F.broadcast(counts.where(F.col("n") >= 1 << floor))
    found = links.join(frequent, "pair").groupBy("row").agg(*sums)
    if floor:
        rare = links.join(frequent.select("pair"), "pair", "left_anti").hint("merge").join(counts.where(F.col("n") < 1 << floor), "pair")
        found = found.unionByName(rare.groupBy("row").agg(*sums)).groupBy("row").agg(
            F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return found


def aligned(docs: DataFrame, path_a: str, path_b: str, text: str = "text", keep: list[str] | None = None, digest: bool = False,
            work: int = WORK, hot: int = HOT) -> DataFrame:
    """Per document: ``keep`` columns (default: all but the text and those called like a result), ``n_a, n_b`` tokens, ``n_groups, n_links``, ``n_best`` and ``count_sum``
    of its links, and ``groups``: ``a1,a2|b1;a3|b2,b3`` (with ``digest``: its SHA-256; empty for a document without tokens).

    ``path_a`` is a byte-level tokenizer file, ``path_b`` a SentencePiece model of the merge type, each on every executor.
    """
    own = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
    keep = [c for c in docs.columns if c not in own and (c != text if keep is None else c in keep)]
    from sentencepiece import SentencePieceProcessor

    size_b = SentencePieceProcessor(model_file=path_b).get_piece_size()
    parts = staged(linked(docs, path_a, path_b, size_b, text, keep, digest, work), "aligned")
    sums = link_sums(parts, pair_counts(parts, size_b), hot)
    totals = parts.groupBy("row").agg(
        F.first("kept").alias("kept"), F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"), F.sum("n_links").alias("n_links"), F.max("groups").alias("groups"))
    found = totals.join(sums, "row", "left").join(stitched(parts, digest).withColumnRenamed("groups", "whole"), "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return found.select(*(F.col("kept")[c].alias(c) for c in keep), "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", zero("n_best"),
                        zero("count_sum"), F.coalesce("whole", "groups").alias("groups"))
