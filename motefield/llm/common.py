"""Shared pieces of the text operators: stage tables, byte-level word splitting, rolling n-gram hashes.

Texts reach Python as Arrow batches. A batch is cut into slices of a few MB, and each slice is worked on
as one numpy byte buffer: word bounds come from a byte class table, hashes of words and of n-word
sequences from prefix sums. Memory of a task is a multiple of the slice (or of one longer text).
"""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SLICE_BYTES = 1 << 20


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; without that setting, below the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    base = base or spark.conf.get("spark.sql.warehouse.dir") + "/_stages"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes a stage to the shared folder and reads it back: later jobs start from files, so an executor
    that is lost costs only the tasks it ran."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def default_parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def worker_cache(key: str, make):
    """An object that lives in the Python worker process over the tasks of a stage, until `release`."""
    store = sys.modules.setdefault("_worker_cache", types.ModuleType("_worker_cache")).__dict__.setdefault("held", {})
    if key not in store:
        store[key] = make()
    return store[key]


def release(keep: tuple[str, ...] = ()) -> None:
    """Drops what earlier stages left in this worker, but for the ``keep`` keys: workers are used again, and a
    vocabulary or word memory of one stage must not take memory from the next."""
    held = sys.modules.setdefault("_worker_cache", types.ModuleType("_worker_cache")).__dict__.setdefault("held", {})
    for key in [k for k in held if k not in keep]:
        del held[key]
    pa.default_memory_pool().release_unused()


# ---------------------------------------------------------------- byte buffers

_PRIME = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2^64, at least n of each."""
    size = 1 << max(20, int(n).bit_length())
    if size not in _TABLES:
        _TABLES.clear()
        both = []
        for base in (_PRIME, pow(_PRIME, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _TABLES[size] = both[0], both[1]
    return _TABLES[size]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_class(inside: Callable[[int], bool]) -> np.ndarray:
    return np.array([inside(b) for b in range(256)])


#: bytes of ``[^\x20\x09-\x0D]+``
NOT_SPACE = byte_class(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z is lower-cased: digits, a-z, all non-ASCII
ALNUM = byte_class(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


class Texts:
    """A slice of texts as one byte buffer; nulls are empty."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_string()).fill_null("")
        self.n = len(column)
        _, offsets, data = column.buffers()
        offs = np.frombuffer(offsets, np.int64)[column.offset: column.offset + self.n + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.buf = raw[offs[0]: offs[-1]]
        self.offs = offs - offs[0]

    def lower(self) -> Texts:
        self.buf = LOWER[self.buf]
        return self

    def words(self, inside: np.ndarray) -> Words:
        return Words(self, inside)


class Words:
    """Word bounds of a slice: ``start``/``end`` bytes, ``first[d]``..``first[d+1]`` the words of text d."""

    def __init__(self, texts: Texts, inside: np.ndarray):
        self.texts = texts
        w = inside[texts.buf]
        n = len(w)
        starts, ends = w.copy(), w.copy()
        if n:
            starts[1:] &= ~w[:-1]
            ends[:-1] &= ~w[1:]
            edge = texts.offs[1:-1]
            edge = edge[(edge > 0) & (edge < n)]
            starts[edge] = w[edge]
            ends[edge - 1] = w[edge - 1]
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, texts.offs)
        self.count = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return hash_spans(self.texts.buf, self.start, self.end)

    def text_of(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(self.texts.n), self.count)


def hash_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans."""
    n = len(buf)
    pw, inv = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * pw[:n], out=sums[1:])
    return mix((sums[end] - sums[start]) * inv[start])


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of words i..i+n-1 for each i; spans may cross texts, see `gram_ok`."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    pw, inv = _powers(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * pw[: len(words)], out=sums[1:])
    m = len(words) - n + 1
    return mix((sums[n:] - sums[:m]) * inv[:m] + np.uint64(n))


def gram_starts(first: np.ndarray, n: int) -> np.ndarray:
    """Word indexes at which n words of one text start."""
    count = np.diff(first)
    have = np.maximum(count - n + 1, 0)
    return expand(first[:-1], have)


def expand(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[k], start[k]+1, ... (count[k] of them) for each k, in one array."""
    total = int(count.sum())
    before = np.cumsum(count) - count
    return np.arange(total) + np.repeat(start - before, count)


def lists(values: np.ndarray, count: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    """A list column from flat values and the length of each list."""
    offs = np.zeros(len(count) + 1, np.int32)
    np.cumsum(count, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(values, kind))


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges whose texts hold about ``most`` bytes; one longer text is a range of its own."""
    column = batch.column(text).cast(pa.large_string())
    if not len(column):
        return
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def per_text(df: DataFrame, make: Callable[[], Callable], added: str, text: str = "text",
             keep: list[str] | None = None, rows: bool = True, holds: tuple[str, ...] = ()) -> DataFrame:
    """Runs a numpy function over slices of a text column.

    ``make()`` runs once per task and gives ``fn(texts: Texts, batch)``. With ``rows`` it returns the
    added columns for the same rows, set beside the columns in ``keep`` (default: all; one that clashes
    with an added name is replaced). Without, it returns whole columns of any length (``keep`` is unused).
    ``holds`` names the `worker_cache` entries the function uses.
    """
    new = T.StructType.fromDDL(added)
    kept = [] if not rows else [f for f in df.schema if f.name not in new.names and (keep is None or f.name in keep)]
    names = [f.name for f in kept]
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in [*kept, *new]])
    fields = new.names

    def run(batches):
        release(holds)
        fn = make()
        for batch in batches:
            for part in slices(batch, text):
                out = fn(Texts(part.column(text)), part)
                if out is not None:
                    cols = [part.column(c) for c in names] + [out[c] for c in fields]
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names + fields)

    return df.mapInArrow(run, schema)
