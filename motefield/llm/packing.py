"""Packing of documents into fixed-length token sequences: first-fit decreasing in randomised groups.

Rows are dealt at random (seeded, per scan partition, so a task that runs again deals the same) into groups
of about ``group_docs`` rows, so no key, source or set of copies can fill a group. Within a group whole
sequences are cut off long documents; what remains is placed by first-fit decreasing, with the first bin
that has room found in a tournament tree of free space. The emptiest bins are then dissolved into the
gaps of the others, so a group has at most one sequence that is not full.

Null texts count as empty: a document of one token, the end token. Repeated rows are packed as often as they
occur. An empty table gives no rows. Columns other than id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motefield.llm.common import Texts, release, slices, worker_cache
from motefield.llm.tokens import WordTokenizer

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>")


class Tournament:
    """Free space of bins as a tournament tree: each inner node holds the best of its two sides."""

    def __init__(self, bins: int, size: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.best = [size] * (2 * self.leaves)
        self.bins = bins
        for i in range(bins, self.leaves):
            self.best[self.leaves + i] = 0
        for i in range(self.leaves - 1, 0, -1):
            self.best[i] = max(self.best[2 * i], self.best[2 * i + 1])

    def place(self, amount: int) -> int:
        """Takes ``amount`` from the first bin that has room, and returns the bin."""
        i = 1
        while i < self.leaves:
            i *= 2
            if self.best[i] < amount:
                i += 1
        self.best[i] -= amount
        bin_ = i - self.leaves
        while i > 1:
            i //= 2
            self.best[i] = max(self.best[2 * i], self.best[2 * i + 1])
        return bin_


def pack(lengths: Sequence[int], size: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) pieces for documents of the given token counts."""
    full = [[(d, at, size)] for d, n in enumerate(lengths) for at in range(0, n - n % size, size)]
    rest = sorted(((n % size, d) for d, n in enumerate(lengths) if n % size), key=lambda x: (-x[0], x[1]))
    if not rest:
        return full
    tree = Tournament(len(rest), size)
    bins: list[list[tuple[int, int, int]]] = [[] for _ in rest]
    for n, d in rest:
        bins[tree.place(n)].append((d, lengths[d] - n, n))
    held = [(sum(p[2] for p in b), b) for b in bins if b]
    full += [b for n, b in held if n == size]
    held = sorted((x for x in held if x[0] < size), key=lambda x: -x[0])
    stay = sum(n for n, _ in held) // size
    pool = [p for _, b in held[stay:] for p in b]
    for n, b in held[:stay]:
        while n < size and pool:
            d, at, k = pool.pop()
            take = min(k, size - n)
            b.append((d, at, take))
            n += take
            if take < k:
                pool.append((d, at + take, k - take))
        full.append(b)
    return full + [pool] if pool else full


def packed(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 2, group_docs: int = 1024,
           id_col: str = "doc_id", text: str = "text", seed: int = 17, with_ids: bool = True) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and the
    piece's token ids (``with_ids``). ``tokenizer`` is the path of a tokenizer file on every worker."""
    count = docs.select(F.count(F.lit(1))).scalar()
    groups = F.greatest(F.ceil(count / group_docs), F.lit(1))
    dealt = docs.select(
        F.floor(F.rand(seed) * groups).cast("long").alias("_group"), F.col(id_col).cast("long").alias("doc_id"),
        F.col(text).cast("string").alias("text"))
    names = [c.split()[0] for c in PIECES.split(", ")]
    ddl = PIECES if with_ids else PIECES.rpartition(",")[0]

    def run(table: pa.Table) -> pa.Table:
        key = "words:" + tokenizer
        release((key,))
        coder = worker_cache(key, lambda: WordTokenizer(tokenizer))
        group = table.column("_group")[0].as_py()
        ids, docs_, counts = [], [], []
        for batch in table.select(["doc_id", "text"]).combine_chunks().to_batches():
            for part in slices(batch, "text"):
                got, n = coder.encode(Texts(part.column("text")))
                ids.append(np.insert(got, np.cumsum(n), end_id))
                counts.append(n + 1)
                docs_ += part.column("doc_id").to_pylist()
        flat, counts = np.concatenate(ids).astype("<u4"), np.concatenate(counts)
        first = np.cumsum(counts) - counts
        out: list[list] = [[] for _ in names]
        for k, pieces in enumerate(pack(counts.tolist(), size)):
            offset = 0
            for d, at, n in pieces:
                own = flat[first[d] + at: first[d] + at + n]
                row = (docs_[d], at, n, zlib.crc32(own), int(counts[d]), group * (1 << 24) + k, offset, own.astype(np.int32) if with_ids else None)
                for col, v in zip(out, row):
                    col.append(v)
                offset += n
        cols = [pa.array(c, pa.int64()) for c in out[:7]]
        if with_ids:
            cols.append(pa.array(out[7], pa.list_(pa.int32())))
        return pa.table(cols, names[: len(cols)])

    return dealt.groupBy("_group").applyInArrow(run, ddl)
