"""Substring dedup: repeated word windows by suffix trees partitioned by variable-length prefixes.

A word goes if a window of ``n`` consecutive words of its document that covers it starts anywhere else too
(the same document included), judged on the input. That is: the window is an internal node of depth ``n``
or more in the suffix tree of the corpus. The tree is never built whole. Suffixes are partitioned by a
prefix that is only as long as needed:

1. *Short prefix.* Each window of a text has an anchor, the first of its ``k``-word groups with the least
   hash. Equal windows have equal anchors at the same offset, so all windows that share an anchor form one
   row (a *span*) under the anchor's k-word prefix, and only about 2 in n - k + 2 suffixes are partition
   roots. A prefix with one span is a leaf: nothing below it repeats.
2. *Span prefix.* A prefix whose spans are all equal is a chain without a branch; every window in it repeats.
   So does every window of a span that occurs twice.
3. *Full prefix.* Only where a prefix has different spans does the subtree branch. One copy of each
   different span is cut into its windows (from the text), and a node of depth n with two leaves or more
   is a repeat; adjacent ones form the maximal repeats.

Groups are hash aggregates of counts (partial before each shuffle, spilling), so a prefix that a third of
all documents share costs one row a task. Prefixes are compared as 64-bit hashes within each other: windows
are equal on 128 bits of anchor and window hash.

Null and empty texts have no words; a text of under n words has no window and stays whole. Repeated rows are
copies of each other, so all of their windows repeat and all copies lose them. Null ids are allowed.
Other columns pass through; those named like an added column are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motefield.llm.common import NOT_SPACE, _powers, expand, gram_hashes, gram_starts, lists, mix, per_text, staged

ADDED = "n_words long, n_removed long, repeats array<int>, kept_text string"


def anchors(g: np.ndarray, width: int) -> np.ndarray:
    """Index of the first least value of g[i : i + width] for each i, by doubling the reach."""
    at, reach = np.arange(len(g)), 1

    def joined(left, right):
        return np.where(g[right] < g[left], right, left)

    while reach * 2 <= width:
        at = joined(at[: len(at) - reach], at[reach:])
        reach *= 2
    more = width - reach
    return joined(at[: len(at) - more], at[more:]) if more else at


def _span_rows(texts, n: int, k: int):
    """Spans of a slice: text index, first window, number of windows, anchor hash, span hash."""
    w = texts.words(NOT_SPACE)
    h = w.hashes()
    s = gram_starts(w.first, n)
    if not len(s):
        return None
    g = gram_hashes(h, k)
    p = anchors(g, n - k + 1)[s]
    new = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
    lo, a = s[new], p[new]
    count = np.diff(np.append(new, len(s)))
    pw, inv = _powers(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * pw[: len(h)], out=sums[1:])
    body = (sums[lo + count - 1 + n] - sums[lo]) * inv[lo]
    span = mix(body + mix((count * 64 + (a - lo)).astype(np.uint64)))
    doc = np.searchsorted(w.first, lo, "right") - 1
    return doc, lo - w.first[doc], count, g[a].view(np.int64), span.view(np.int64)


def _spans(docs: DataFrame, n: int, k: int) -> DataFrame:
    def make():
        def fn(texts, batch):
            got = _span_rows(texts, n, k)
            if got is None:
                return None
            doc, lo, count, anchor, span = got
            return {"_key": batch.column("_key").take(pa.array(doc)), "lo": pa.array(lo.astype(np.int32)),
                    "n": pa.array(count.astype(np.int16)), "anchor": pa.array(anchor), "span": pa.array(span)}

        return fn

    return per_text(docs, make, "_key long, lo int, n short, anchor long, span long", "_text", rows=False)


def _windows(docs: DataFrame, n: int) -> DataFrame:
    """The windows of the spans listed beside each text."""

    def make():
        def fn(texts, batch):
            h = None
            w = texts.words(NOT_SPACE)
            h = gram_hashes(w.hashes(), n)
            col = batch.column("spans")
            sizes = np.diff(np.frombuffer(col.buffers()[1], np.int32)[col.offset: col.offset + len(col) + 1])
            flat = col.flatten()
            lo, count, anchor, single = (flat.field(x).to_numpy(zero_copy_only=False) for x in ("lo", "n", "anchor", "single"))
            doc = np.repeat(np.arange(len(sizes)), sizes)
            at = expand(lo.astype(np.int64), count.astype(np.int64))
            own = np.repeat(np.arange(len(lo)), count)
            return {"anchor": pa.array(anchor[own]), "window": pa.array(h[w.first[doc[own]] + at].view(np.int64)),
                    "_key": batch.column("_key").take(pa.array(doc[own])), "at": pa.array(at.astype(np.int32)), "single": pa.array(single[own])}

        return fn

    return per_text(docs, make, "anchor long, window long, _key long, at int, single boolean", "_text", rows=False)


def repeats(docs: DataFrame, n: int = 35, k: int = 8, few: int = 1_000_000) -> DataFrame:
    """``_key, runs``: per row key the repeated windows as (first window, number of windows) pairs.

    ``docs``: ``_key, _text``. ``few``: up to so many row keys are broadcast (8 bytes each) to thin the texts
    before they are shuffled for step 3; beyond, all texts are.
    """
    spans = staged(_spans(docs, n, k), "spans")
    shared = spans.groupBy("anchor").agg(F.count(F.lit(1)).alias("c"), (F.min("span") != F.max("span")).alias("mixed"))
    shared = staged(shared.where("c > 1").select("anchor", "mixed"), "prefixes")
    found = staged(spans.join(shared, "anchor"), "repeated-prefixes")
    branch = found.where("mixed")
    kinds = staged(branch.groupBy("anchor", "span").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("_key", "lo", "n")).alias("rep")), "branches")
    whole = found.where("not mixed").select("_key", "lo", "n")
    twice = branch.join(kinds.where("c > 1").select("anchor", "span"), ["anchor", "span"]).select("_key", "lo", "n")
    reps = kinds.select("anchor", (F.col("c") == 1).alias("single"), "rep.*").groupBy("_key").agg(
        F.collect_set(F.struct("lo", "n", "anchor", "single")).alias("spans"))
    reps = staged(reps, "representatives")
    texts = docs
    if reps.count() <= few:
        texts = docs.join(F.broadcast(reps.select("_key")), "_key", "left_semi")
    # rows that repeat have one key; their spans occur twice, so they add to no count that decides
    windows = staged(_windows(texts.join(reps, "_key"), n), "windows")
    nodes = windows.groupBy("anchor", "window").agg(F.count(F.lit(1)).alias("c"), F.max("single").alias("open"))
    nodes = staged(nodes.where("c > 1 and open").select("anchor", "window"), "nodes")
    deep = windows.where("single").join(nodes, ["anchor", "window"]).select("_key", F.col("at").alias("lo"), F.lit(1).cast("short").alias("n"))
    return whole.unionByName(twice).unionByName(deep).groupBy("_key").agg(F.collect_set(F.struct("lo", "n")).alias("runs"))


def substring_dedup(docs: DataFrame, n: int = 35, k: int = 8, id_col: str = "doc_id", text: str = "text",
                    keep: list[str] | None = None) -> DataFrame:
    """Adds ``n_words, n_removed, repeats`` (flat list of first word and end of each removed run) and
    ``kept_text`` (kept words joined by one space) to each row of ``docs``."""
    keyed = docs.withColumn("__key", F.xxhash64(F.col(id_col), F.col(text))).withColumn("__text", F.col(text).cast("string"))
    runs = staged(repeats(keyed.select(F.col("__key").alias("_key"), F.col("__text").alias("_text")), n, k), "runs")
    names = [c for c in docs.columns if keep is None or c in keep]
    texts = keyed.select("__key", "__text", *names).join(runs.select(F.col("_key").alias("__key"), F.col("runs").alias("__runs")), "__key", "left")

    def make():
        def fn(texts, batch):
            w = texts.words(NOT_SPACE)
            at, size = [], []
            for first, own in zip(w.first.tolist(), batch.column("__runs").to_pylist()):
                for r in own or ():
                    at.append(first + r["lo"]), size.append(r["n"] + n - 1)
            step = np.zeros(len(w.start) + 1, np.int32)
            at, size = np.array(at, np.int64), np.array(size, np.int64)
            np.add.at(step, at, 1)
            np.add.at(step, at + size, -1)
            gone = np.cumsum(step[:-1]) > 0
            sums = np.concatenate([[0], np.cumsum(gone)])
            removed = sums[w.first[1:]] - sums[w.first[:-1]]
            cut, offs = _runs_of(gone, w.first)
            return {"n_words": pa.array(w.count.astype(np.int64)), "n_removed": pa.array(removed),
                    "repeats": lists(cut, offs, pa.int32()), "kept_text": _joined(texts, w, ~gone)}

        return fn

    return per_text(texts, make, ADDED, "__text", names)


def _runs_of(gone: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    same = np.zeros(len(gone), bool)
    same[1:] = doc[1:] == doc[:-1]
    prev, nxt = np.zeros(len(gone), bool), np.zeros(len(gone), bool)
    prev[1:] = gone[:-1] & same[1:]
    nxt[:-1] = gone[1:] & same[1:]
    s, e = np.flatnonzero(gone & ~prev), np.flatnonzero(gone & ~nxt) + 1
    base = first[doc[s]] if len(s) else s
    cut = np.stack([s - base, e - base], 1).ravel().astype(np.int32)
    return cut, 2 * np.bincount(doc[s], minlength=len(first) - 1) if len(s) else np.zeros(len(first) - 1, np.int64)


def _joined(texts, w, stay: np.ndarray) -> pa.Array:
    """The words that stay, joined by one space, per text: bytes are copied in one gather."""
    s, e = w.start[stay], w.end[stay]
    size = e - s + 1
    doc = w.text_of()[stay]
    last = np.ones(len(s), bool)
    last[:-1] = doc[1:] != doc[:-1]
    out = np.full(int(size.sum()), 0x20, np.uint8)
    to = np.cumsum(size) - size
    out[expand(to, e - s)] = texts.buf[expand(s, e - s)]
    if len(out):
        mask = np.ones(len(out), bool)
        mask[(to + size - 1)[last]] = False
        out = out[mask]
    length = np.bincount(doc, size - last, minlength=texts.n).astype(np.int64) if len(s) else np.zeros(texts.n, np.int64)
    offs = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    return pa.StringArray.from_buffers(texts.n, pa.py_buffer(offs), pa.py_buffer(out.tobytes()))
