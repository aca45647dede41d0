"""Benchmark decontamination: n-gram windows of benchmark items looked up along every document.

Words are runs of ASCII letters (lower-cased), digits and non-ASCII characters. A window is ``n``
consecutive words of an item; an item of fewer words, but not none, is one window. Every word inside any
occurrence of a window in a document is hit.

The windows are counted and measured first. Up to ``most`` of them (default 1 000 000) with up to ``most_bytes`` of
words (default 64 MB) are broadcast as sorted hashes with their texts, and each candidate is verified word by word.
More are matched by a shuffled equi-join on 128 bits of window hash, with the same result.

Null and empty texts have no words. A null item text gives no window. Items with equal texts are all
reported; an item without an id hits words, but has no id to report. Rows that repeat are judged alike. Other columns pass through, but those named like an added
column are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motefield.llm.common import ALNUM, expand, gram_hashes, gram_starts, lists, mix, per_text, staged

ADDED = "n_words long, n_hit long, items array<long>, spans array<struct<start:int,end:int>>"
_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)


def _grams(words, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    at = gram_starts(words.first, n)
    return at, gram_hashes(h, n)[at]


def windows(bench: DataFrame, n: int, item: str, text: str) -> DataFrame:
    """``item_id, m, gram, check, words``: the windows of each item, with two hashes and the words."""

    def make():
        def fn(texts, batch):
            w = texts.lower().words(ALNUM)
            h = w.hashes()
            ids = np.array(batch.column(item).cast(pa.int64()).to_pylist(), object)
            size = np.minimum(w.count, n)
            out = []
            for m in np.unique(size[size > 0]):
                at, g = _grams(w, h, int(m))
                c = gram_hashes(mix(h ^ _SECOND), int(m))[at]
                doc = np.searchsorted(w.first, at, "right") - 1
                own = size[doc] == m
                for i, x, y, d in zip(at[own], g[own], c[own], doc[own]):
                    words = [texts.buf[s:e].tobytes() for s, e in zip(w.start[i:i + m], w.end[i:i + m])]
                    out.append((ids[d], int(m), x.astype(np.int64), y.astype(np.int64), b" ".join(words)))
            cols = list(zip(*out)) if out else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            return {k: pa.array(list(c), t) for k, c, t in zip(("item_id", "m", "gram", "check", "words"), cols, kinds)}

        return fn

    ddl = "item_id long, m int, gram long, check long, words binary"
    source = bench.select(F.col(item), F.col(text).cast("string").alias(text))
    return per_text(source, make, ddl, text, rows=False)


def _marked(count: int, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    step = np.zeros(count + 1, np.int32)
    np.add.at(step, at, 1)
    np.add.at(step, at + size, -1)
    return np.cumsum(step[:-1]) > 0


def _spans(hit: np.ndarray, first: np.ndarray):
    """Runs of hit words per text: list column of (start, end) word indexes within the text."""
    begin, stop = hit.copy(), hit.copy()
    if len(hit):
        begin[1:] &= ~hit[:-1]
        stop[:-1] &= ~hit[1:]
        edge = first[1:-1]
        edge = edge[(edge > 0) & (edge < len(hit))]
        begin[edge] = hit[edge]
        stop[edge - 1] = hit[edge - 1]
    s, e = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    doc = np.searchsorted(first, s, "right") - 1
    pairs = pa.StructArray.from_arrays([pa.array((s - first[doc]).astype(np.int32)), pa.array((e - first[doc]).astype(np.int32))], ["start", "end"])
    count = np.bincount(doc, minlength=len(first) - 1)
    offs = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offs), pairs)


def contamination(docs: DataFrame, bench: DataFrame, n: int = 13, text: str = "text", item: str = "item_id",
                  bench_text: str = "text", id_col: str = "doc_id", keep: list[str] | None = None,
                  most: int = 1_000_000, most_bytes: int = 1 << 26) -> DataFrame:
    """Adds ``n_words, n_hit, items`` (ids of items with an occurring window) and ``spans`` (hit word
    ranges) to each row. ``keep`` names the columns to pass through (default: all)."""
    wins = windows(bench, n, item, bench_text)
    sizes = {r["m"]: (r["n"], r["b"]) for r in wins.groupBy("m").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("words")).alias("b")).collect()}  # n rows at most
    if sum(n for n, _ in sizes.values()) > most or sum(b for _, b in sizes.values()) > most_bytes:
        return _shuffled(docs, wins, sorted(sizes), text, id_col, keep)
    rows = wins.collect()
    tables = {}
    for m in sorted(sizes):
        mine = sorted((r["gram"] & (2**64 - 1), bytes(r["words"]), r["item_id"] is not None, r["item_id"] or 0) for r in rows if r["m"] == m)
        keys = np.array([r[0] for r in mine], np.uint64)
        coarse = np.zeros(1 << 20, bool)
        coarse[keys >> np.uint64(44)] = True
        tables[m] = keys, coarse, [r[1] for r in mine], np.array([r[2] for r in mine], bool), np.array([r[3] for r in mine], np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(tables)

    def make():
        tables = shared.value

        def fn(texts, batch):
            w = texts.lower().words(ALNUM)
            h = w.hashes()
            at_all, size_all, item_all, known_all = [], [], [], []
            for m, (keys, coarse, words, known, ids) in tables.items():
                at, g = _grams(w, h, m)
                maybe = np.flatnonzero(coarse[g >> np.uint64(44)])
                at, g = at[maybe], g[maybe]
                lo, hi = np.searchsorted(keys, g, "left"), np.searchsorted(keys, g, "right")
                for a, x, y in zip(at[hi > lo], lo[hi > lo], hi[hi > lo]):
                    seen = b" ".join(texts.buf[s:e].tobytes() for s, e in zip(w.start[a:a + m], w.end[a:a + m]))
                    for k in range(x, y):
                        if words[k] == seen:
                            at_all.append(a), size_all.append(m), item_all.append(ids[k]), known_all.append(known[k])
            at, size, ids, known = (np.array(x, t) for x, t in ((at_all, np.int64), (size_all, np.int64), (item_all, np.int64), (known_all, bool)))
            hit = _marked(len(w.start), at, size)
            doc = np.searchsorted(w.first, at, "right") - 1
            pairs = np.unique(np.stack([doc[known], ids[known]]), axis=1)
            sums = np.concatenate([[0], np.cumsum(hit)])
            return {
                "n_words": pa.array(w.count.astype(np.int64)), "n_hit": pa.array(sums[w.first[1:]] - sums[w.first[:-1]]),
                "items": lists(pairs[1], np.bincount(pairs[0], minlength=texts.n), pa.int64()), "spans": _spans(hit, w.first),
            }

        return fn

    return per_text(docs, make, ADDED, text, keep)


def _shuffled(docs: DataFrame, wins: DataFrame, sizes: list[int], text: str, id_col: str, keep: list[str] | None) -> DataFrame:
    """The same without a broadcast: all document windows join the benchmark windows on 128 hash bits.

    The result is joined back by a hash of id and text, which is never null: rows that repeat an id, or have none,
    are told apart by their texts. A window that very many documents share is one row on the benchmark side, so only the
    document side of its key is large and AQE splits it.
    """
    added = [c for c in ("n_words", "n_hit", "items", "spans")]
    base = docs.select(*[c for c in docs.columns if c not in added])
    keyed = docs.withColumn("__key", F.xxhash64(F.col(id_col), F.col(text).cast("string")))

    def make():
        def fn(texts, batch):
            w = texts.lower().words(ALNUM)
            h = w.hashes()
            keys = batch.column("__key")
            cols = [[], [], [], [], []]
            for m in sizes:
                at, g = _grams(w, h, m)
                doc = np.searchsorted(w.first, at, "right") - 1
                c = gram_hashes(mix(h ^ _SECOND), m)[at] if len(at) else g
                for col, v in zip(cols, (doc, at - w.first[doc], np.full(len(at), m), g.astype(np.int64), c.astype(np.int64))):
                    col.append(v)
            doc, at, m, g, c = (np.concatenate(x) for x in cols)
            return {"__id": keys.take(pa.array(doc)), "at": pa.array(at.astype(np.int32)), "m": pa.array(m.astype(np.int32)), "gram": pa.array(g), "check": pa.array(c)}

        return fn

    spots = per_text(keyed.select("__key", text), make, "__id long, at int, m int, gram long, check long", text, rows=False)
    items = staged(wins.groupBy("m", "gram", "check").agg(F.collect_set("item_id").alias("ids")), "windows")
    found = spots.join(items, ["m", "gram", "check"]).groupBy("__id").agg(
        F.collect_set(F.struct("at", "m")).alias("__at"), F.array_distinct(F.flatten(F.collect_set("ids"))).alias("__items"))
    joined = keyed.select("__key", *base.columns).join(found, F.col("__key") == F.col("__id"), "left").drop("__id", "__key")
    names = [c for c in base.columns if keep is None or c in keep]

    def finish():
        def fn(texts, batch):
            w = texts.lower().words(ALNUM)
            at, size = [], []
            for d, spots in enumerate(batch.column("__at").to_pylist()):
                for s in spots or ():
                    at.append(w.first[d] + s["at"]), size.append(s["m"])
            hit = _marked(len(w.start), np.array(at, np.int64), np.array(size, np.int64))
            sums = np.concatenate([[0], np.cumsum(hit)])
            items = pa.array([sorted(x or ()) for x in batch.column("__items").to_pylist()], pa.list_(pa.int64()))
            return {"n_words": pa.array(w.count.astype(np.int64)), "n_hit": pa.array(sums[w.first[1:]] - sums[w.first[:-1]]), "items": items, "spans": _spans(hit, w.first)}

        return fn

    return per_text(joined, finish, ADDED, text, names)


def without_spans(docs: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """Cuts the hit word ranges of `contamination` out of each text, with what stands between their words."""

    def make():
        def fn(texts, batch):
            raw = texts.buf
            w = texts.lower().words(ALNUM)
            out = []
            for d, cut in enumerate(batch.column(spans).to_pylist()):
                at, parts = texts.offs[d], []
                for s in cut or ():
                    parts.append(raw[at: w.start[w.first[d] + s["start"]]].tobytes())
                    at = w.end[w.first[d] + s["end"] - 1]
                parts.append(raw[at: texts.offs[d + 1]].tobytes())
                out.append(b"".join(parts).decode())
            return {text: pa.array(out, pa.string())}

        return fn

    return per_text(docs, make, f"{text} string", text, [c for c in docs.columns if c != text])


def is_contaminated(n_hit: str = "n_hit", n_words: str = "n_words"):
    """At least one word in twenty is hit."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))
