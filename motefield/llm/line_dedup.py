"""Line dedup: repeated runs of lines by prefix doubling over line-ID sequences; later copies are deleted.

A document is its sequence of lines with words, each named by 128 hash bits of the line without outer blanks. Doubling
names runs of 1, 2, 4, ... lines, and any run of n lines by the two longest of these that cover it. Suffixes that share
the name of their first n lines are one interval of the suffix array with a common prefix of at least n lines; its first
member, in the order of id and line, is the original. Names are content hashes, so each is made where its document is
and only the intervals meet, in two shuffles. No order among different suffixes is needed, so none is made.

A run of any length counts with ``min_words`` words or more, and a line goes if a run that covers it counts and starts
earlier too. Depths up to ``min_words`` decide this exactly, as every line has a word. Take a line of a repeated run that
counts: the shortest counting run that starts at the line lies in the repeated run, or the shortest that ends with it
does, or else the shortest that starts with the repeated run covers the line. So two runs are looked up per line, the
shortest counting ones that start and end with it, and doubling ends where they do.

Null and empty texts, and texts of blanks, have no lines and stay as they are (null: null). Blank lines stay. Rows
with a null id come last, in the order of a hash of their text. Rows that repeat id and text are one document
and share the verdict. Other columns pass through; those named like an added one are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motefield.llm.common import NOT_SPACE, _powers, byte_class, hash_spans, lists, mix, per_text, staged

ADDED = "n_lines long, n_removed long, kept_text string"
_IN_LINE = byte_class(lambda b: b != 0x0A)
_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _lines(texts):
    """Lines with words: byte bounds without outer blanks, words, text index; and bounds of all lines of each."""
    rows, words = texts.words(_IN_LINE), texts.words(NOT_SPACE)
    first = np.searchsorted(words.start, rows.start)
    last = np.searchsorted(words.start, rows.end)
    full = np.flatnonzero(last > first)
    return words.start[first[full]], words.end[last[full] - 1], (last - first)[full], rows.text_of()[full], rows.start[full], rows.end[full]


def _order(id_col: str, text: str):
    """Row key whose order is that of the documents."""
    return F.struct(F.col(id_col).isNull().alias("n"), F.coalesce(F.col(id_col), F.lit(0)).cast("long").alias("i"), F.xxhash64(text).alias("t"))


def _checks(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A second hash of byte spans: the same sum over other values of the bytes."""
    pw, inv = _powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_VALUES[buf] * pw[: len(buf)], out=sums[1:])
    return mix((sums[end] - sums[start]) * inv[start])


def line_names(docs: DataFrame) -> DataFrame:
    """``key, name array<long>, check array<long>, words array<int>``: the line sequence of each document with lines."""

    def make():
        def fn(texts, batch):
            s, e, words, doc, _, _ = _lines(texts)
            count = np.bincount(doc, minlength=texts.n) if len(doc) else np.zeros(texts.n, np.int64)
            name, check = (f(texts.buf, s, e).view(np.int64) for f in (hash_spans, _checks))
            return {"name": lists(name, count, pa.int64()), "check": lists(check, count, pa.int64()), "words": lists(words.astype(np.int32), count, pa.int32())}

        return fn

    return per_text(docs, make, "name array<long>, check array<long>, words array<int>", "_text", ["key"])


def _joined(left: np.ndarray, right: np.ndarray, n) -> np.ndarray:
    return mix(left * np.uint64(0x9E3779B97F4A7C15) + mix(right + n))


def shortest_runs(words: np.ndarray, first: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the shortest runs of ``min_words`` words or more that start and that end with each line; ``first``: where
    the lines of each document start, and the end of all."""
    total = np.concatenate([[0], np.cumsum(words)])
    own = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.arange(len(words))
    end = np.searchsorted(total, total[:-1] + min_words)
    begins = end <= first[1:][own]
    start = np.searchsorted(total, total[1:] - min_words, "right") - 1
    ends = (start >= first[:-1][own]) & (end[start] != at + 1)
    return np.concatenate([at[begins], start[ends]]), np.concatenate([end[begins], at[ends] + 1])


def _doubled(min_words: int):
    """Names of the shortest counting runs inside stretches of repeated lines."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            count = pc.list_value_length(batch.column("words")).to_numpy()
            first = np.concatenate([[0], np.cumsum(count)])
            flat = {c: batch.column(c).flatten().to_numpy() for c in ("name", "check", "words", "spots")}
            live = np.zeros(first[-1] + 1, np.int64)
            live[1:][np.repeat(first[:-1], pc.list_value_length(batch.column("spots")).to_numpy()) + flat["spots"]] = 1
            a, e = shortest_runs(flat["words"].astype(np.int64), first, min_words)
            repeated = np.cumsum(live)
            keep = (e - a > 1) & (repeated[e] - repeated[a] == e - a)
            a, e = a[keep], e[keep]
            if not len(a):
                continue
            named = [np.zeros(len(a), np.uint64), np.zeros(len(a), np.uint64)]
            deep, k = [flat["name"].view(np.uint64), flat["check"].view(np.uint64)], 1
            while True:
                own = np.flatnonzero((e - a >= k) & (e - a < 2 * k))
                for out, h in zip(named, deep):
                    out[own] = _joined(h[a[own]], h[e[own] - k], (e - a)[own].astype(np.uint64))
                if 2 * k > (e - a).max():
                    break
                deep, k = [_joined(h[:-k], h[k:], np.uint64(k)) for h in deep], 2 * k
            doc = np.searchsorted(first, a, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(pa.array(doc)), pa.array((e - a).astype(np.int32)), *(pa.array(x.view(np.int64)) for x in named),
                 pa.array((a - first[doc]).astype(np.int32))], ["key", "n", "name", "check", "at"])

    return run


def _later(runs: DataFrame, by: list[str]) -> DataFrame:
    """Rows of ``runs`` (key, at, ...) with a flag: does the interval's first member come before?"""
    firsts = runs.groupBy(*by).agg(F.min(F.struct("key", "at")).alias("first"), F.count(F.lit(1)).alias("c"))
    firsts = staged(firsts.where("c > 1").drop("c"), "intervals")
    return runs.join(firsts, by).withColumn("later", F.struct("key", "at") > F.col("first")).drop("first")


def repeated_runs(docs: DataFrame, min_words: int = 10) -> DataFrame:
    """``key, runs array<struct<at,n>>``: per document the runs (line index among lines with words, lines) that
    start earlier elsewhere. ``docs``: ``key, _text``, one row per key."""
    min_words = max(min_words, 1)
    sequences = staged(line_names(docs), "line-names")
    kind = sequences.schema["key"].dataType.simpleString()
    line = F.posexplode(F.arrays_zip("name", "check", "words")).alias("at", "x")
    single = sequences.select("key", line).select("key", "at", "x.name", "x.check", "x.words")
    repeated = staged(_later(single, ["name", "check"]).select("key", "at", "words", "later"), "repeated-lines")
    spots = repeated.groupBy("key").agg(F.collect_list("at").alias("spots"), F.min("words").alias("w"))
    short = spots.where((F.col("w") < min_words) & (F.size("spots") > 1)).drop("w")
    runs = sequences.join(short, "key").mapInArrow(_doubled(min_words), f"key {kind}, n int, name long, check long, at int")
    longer = _later(staged(runs, "doubled"), ["n", "name", "check"]).where("later").select("key", "at", "n")
    alone = repeated.where(F.col("later") & (F.col("words") >= min_words)).select("key", "at", F.lit(1).alias("n"))
    return alone.union(longer).groupBy("key").agg(F.collect_list(F.struct("at", "n")).alias("runs"))


def line_dedup(docs: DataFrame, min_words: int = 10, id_col: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``n_lines, n_removed`` (lines with words) and ``kept_text`` to each row of ``docs``."""
    keyed = docs.withColumn("__text", F.col(text).cast("string")).withColumn("__key", _order(id_col, text))
    sequences = keyed.select(F.col("__key").alias("key"), F.col("__text").alias("_text"))
    if _may_repeat(docs, id_col):
        sequences = sequences.dropDuplicates(["key"])
    runs = staged(repeated_runs(sequences, min_words), "line-runs").select(F.col("key").alias("__key"), F.col("runs").alias("__runs"))
    names = [c for c in docs.columns if keep is None or c in keep]
    met = keyed.join(runs, "__key", "left")

    def make():
        def fn(texts, batch):
            s, e, words, doc, row_start, row_end = _lines(texts)
            first = np.searchsorted(doc, np.arange(texts.n + 1))
            step = np.zeros(len(doc) + 1, np.int32)
            for d, own in enumerate(batch.column("__runs").to_pylist()):
                for r in own or ():
                    step[first[d] + r["at"]] += 1
                    step[first[d] + r["at"] + r["n"]] -= 1
            gone = np.cumsum(step[:-1]) > 0
            removed = np.bincount(doc[gone], minlength=texts.n) if len(doc) else np.zeros(texts.n, np.int64)
            raw, offs, kept = texts.buf, texts.offs, []
            null = batch.column("__text").is_null().to_pylist()
            for d in range(texts.n):
                if null[d]:
                    kept.append(None)
                elif not removed[d]:
                    kept.append(raw[offs[d]: offs[d + 1]].tobytes().decode())
                else:
                    at, parts = offs[d], []
                    for k in np.flatnonzero(gone[first[d]: first[d + 1]]) + first[d]:
                        parts.append(raw[at: row_start[k]].tobytes())
                        at = min(row_end[k] + 1, offs[d + 1])
                    parts.append(raw[at: offs[d + 1]].tobytes())
                    whole = b"".join(parts)
                    if at == offs[d + 1] and raw[offs[d + 1] - 1] != 0x0A and whole.endswith(b"\n"):
                        whole = whole[:-1]  # the last line went: the break before it goes too
                    kept.append(whole.decode())
            return {"n_lines": pa.array(np.diff(first).astype(np.int64)), "n_removed": pa.array(removed.astype(np.int64)), "kept_text": pa.array(kept, pa.string())}

        return fn

    return per_text(met, make, ADDED, "__text", names)


def _may_repeat(docs: DataFrame, id_col: str) -> bool:
    """Do ids repeat (or miss)? Then equal rows have to be made one before lines are counted."""
    n, ids = docs.select(F.count(F.lit(1)), F.count(id_col)).first()
    return ids < n or docs.groupBy(id_col).count().where("count > 1").limit(1).count() > 0
