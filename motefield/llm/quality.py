"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each text gives a fixed vector of statistics (`FEATURES`), each put through a transform that makes it roughly
normal (log, square root, logit). Classes are normal densities with covariances shrunk towards the pooled one
and towards a multiple of the identity. A score is the logistic of the difference of the two Mahalanobis
log-densities plus the log prior ratio; the Cholesky factors are computed once per fit and cached in the model.

The fit needs counts, sums and cross products per class: one aggregate over all labelled rows, a few KB to
the driver whatever the data. Null texts count as empty. Rows without a label, or with a null one, take no
part in the fit; several labels of one id count as their maximum. A class without rows makes every score the
share of class 1 among labelled rows (0.5 without any).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motefield.llm.common import NOT_SPACE, Texts, gram_hashes, gram_starts, lists, per_text, staged

FEATURES = (
    "words", "word_length", "word_spread", "letters", "capitals", "digits", "punctuation", "symbols", "bars", "exclamations",
    "non_ascii", "line_words", "line_spread", "repeated_lines", "repeated_words", "repeated_pairs", "repeated_triples", "ends",
    "capital_words", "short_words", "commas", "longest_run",
)

SHORT = 20  # words at which deviations count half


def _lut(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_KINDS = {
    "letters": _lut(bytes([*range(65, 91), *range(97, 123), *range(128, 256)])), "capitals": _lut(bytes(range(65, 91))), "digits": _lut(b"0123456789"),
    "punctuation": _lut(b".,;:?'\"()-"), "symbols": _lut(b"#$%&*+/<=>@[\\]^_`{}~"), "bars": _lut(b"|"), "exclamations": _lut(b"!"),
    "non_ascii": _lut(bytes(range(128, 256))), "commas": _lut(b","), "ends": _lut(b".!?"),
}
_NEWLINE = ~_lut(b"\n\r")


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


def _repeated(h: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """Share of n-word groups of each text that occurred in it before."""
    at = gram_starts(first, n)
    g = gram_hashes(h, n)[at] if n > 1 else h[at]
    doc = np.searchsorted(first, at, "right") - 1
    order = np.lexsort((g, doc))
    again = np.zeros(len(g), np.float64)
    if len(g) > 1:
        x, d = g[order], doc[order]
        again[1:] = (x[1:] == x[:-1]) & (d[1:] == d[:-1])
    docs = len(first) - 1
    count = np.bincount(doc, minlength=docs)
    return np.bincount(doc[order], again, minlength=docs) / np.maximum(count, 1)


def statistics(texts: Texts) -> np.ndarray:
    """One transformed row of `FEATURES` per text."""
    buf, offs = texts.buf, texts.offs
    size = np.maximum(np.diff(offs), 1)
    w = texts.words(NOT_SPACE)
    h = w.hashes()
    n = np.maximum(w.count, 1)
    length = (w.end - w.start).astype(np.float64)
    mean = _sums(length, w.first) / n
    spread = np.sqrt(np.maximum(_sums(length**2, w.first) / n - mean**2, 0))
    share = {k: _sums(lut[buf], offs) / size for k, lut in _KINDS.items()}
    lines = texts.words(_NEWLINE)
    rows = np.maximum(lines.count, 1)
    line_len = (lines.end - lines.start).astype(np.float64)
    line_mean = _sums(line_len, lines.first) / rows
    line_spread = np.sqrt(np.maximum(_sums(line_len**2, lines.first) / rows - line_mean**2, 0))
    big = _KINDS["capitals"][buf[w.start]] if len(w.start) else np.zeros(0)
    longest = np.zeros(texts.n)
    if len(length):
        np.maximum.at(longest, w.text_of(), length)
    odds = lambda x: np.log((x + 0.002) / (1.002 - x))
    columns = {
        "words": np.log1p(w.count), "word_length": np.log1p(mean), "word_spread": np.log1p(spread), "line_words": np.log1p(line_mean),
        "line_spread": np.log1p(line_spread), "repeated_lines": odds(_repeated(lines.hashes(), lines.first, 1)),
        "repeated_words": np.sqrt(_repeated(h, w.first, 1)), "repeated_pairs": odds(_repeated(h, w.first, 2)),
        "repeated_triples": odds(_repeated(h, w.first, 3)), "capital_words": odds(_sums(big, w.first) / n),
        "short_words": np.sqrt(_sums(length <= 3, w.first) / n), "longest_run": np.log1p(longest),
    } | {k: odds(v) for k, v in share.items()}
    return np.stack([columns[f] for f in FEATURES], 1)


def measured(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``features`` (array of doubles) to each row."""

    def make():
        def fn(texts, batch):
            x = statistics(texts)
            return {"features": lists(x.ravel(), np.full(texts.n, x.shape[1]), pa.float64())}

        return fn

    return per_text(docs, make, "features array<double>", text, keep)


@dataclass
class Discriminant:
    """Class means, Cholesky factors of the shrunk covariances, log-determinants and priors."""

    means: np.ndarray
    factors: np.ndarray
    logdets: np.ndarray
    priors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for rows of features."""
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        words = np.expm1(x[:, :1])  # statistics of a few words say little: they move towards the mean
        z *= words / (words + SHORT)
        dens = []
        for m, f, d, p in zip(self.means, self.factors, self.logdets, self.priors):
            y = np.linalg.solve(f, (z - m).T)  # f is triangular
            dens.append(-0.5 * (y * y).sum(0) - 0.5 * d + np.log(p))
        gap = np.clip(dens[1] - dens[0], -700, 700) / np.sqrt(x.shape[1])  # statistics are correlated: temper the odds
        return 1 / (1 + np.exp(-gap))


def fit(rows: DataFrame, label: str = "label", shrink: float = 0.3, ridge: float = 0.05) -> Discriminant:
    """Fits on ``features`` and a 0/1 label. ``shrink`` moves class covariances to the pooled one, ``ridge``
    the result to a multiple of the identity."""
    k = len(FEATURES)

    def partial(batches):
        """Per task and class: count, sums and cross products; centred on nothing, so they add up."""
        total = {c: np.zeros((k + 1, k + 1)) for c in (0, 1)}
        for batch in batches:
            if batch.num_rows:
                x = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
                y = batch.column(label).to_numpy(zero_copy_only=False)
                x1 = np.concatenate([np.ones((len(x), 1)), x], 1)
                for c in (0, 1):
                    own = x1[y == c]
                    total[c] += own.T @ own
        for c, t in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(t.size, c, np.int32)), pa.array(np.arange(t.size, dtype=np.int32)), pa.array(t.ravel())], ["c", "cell", "v"])

    used = rows.where(F.col(label).isin(0, 1)).select("features", F.col(label).cast("int").alias(label))
    cells = used.mapInArrow(partial, "c int, cell int, v double").groupBy("c", "cell").agg(F.sum("v").alias("v")).collect()
    moments = np.zeros((2, (k + 1) ** 2))
    for r in cells:  # 2 * (features + 1)^2 rows
        moments[r["c"], r["cell"]] = r["v"]
    moments = moments.reshape(2, k + 1, k + 1)
    n = moments[:, 0, 0]
    if n.min() < 2:
        share = n[1] / n.sum() if n.sum() else 0.5
        zero = np.zeros(0)
        return Discriminant(zero, zero, zero, zero, zero, zero, float(share))
    both = moments.sum(0)
    centre = both[0, 1:] / n.sum()
    scale = np.sqrt(np.maximum(np.diag(both)[1:] / n.sum() - centre**2, 1e-6))
    means, covs = [], []
    for m, c in zip(moments, n):
        mu = m[0, 1:] / c
        means.append((mu - centre) / scale)
        covs.append((m[1:, 1:] / c - np.outer(mu, mu)) / np.outer(scale, scale))
    pooled = sum(c * w for c, w in zip(covs, n)) / n.sum()
    factors, logdets = [], []
    for c in covs:
        s = (1 - shrink) * c + shrink * pooled
        s = (1 - ridge) * s + ridge * np.trace(s) / k * np.eye(k)
        f = np.linalg.cholesky(s)
        factors.append(f)
        logdets.append(2 * np.log(np.diag(f)).sum())
    return Discriminant(np.array(means), np.array(factors), np.array(logdets), n / n.sum(), centre, scale)


def scored(measured_docs: DataFrame, model: Discriminant, threshold: float = 0.3) -> DataFrame:
    """Replaces ``features`` by ``score`` and ``predicted``."""
    kept = [f for f in measured_docs.columns if f not in ("features", "score", "predicted")]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(model.score(x))], [*kept, "score"])

    ddl = measured_docs.select(*kept).schema.add("score", "double")
    return measured_docs.mapInArrow(run, ddl).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(id_col: str = "doc_id", parts: int = 5, part: int = 0):
    return F.crc32(F.col(id_col).cast("string")) % parts == part


def classified(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality",
               threshold: float = 0.3) -> DataFrame:
    """``id_col, held_out, score, predicted`` per row of ``docs``; fitted on the labelled rows that are not held out."""
    stats = staged(measured(docs.select(id_col, F.col(text).cast("string").alias(text)), id_col, text, [id_col]), "statistics")
    model = fit(training(stats, labels, id_col, label))
    return scored(stats, model, threshold).withColumn("held_out", F.coalesce(held_out(id_col), F.lit(False)))


def training(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "quality") -> DataFrame:
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(id_col).agg(F.max(label).alias("label"))
    return stats.join(known, id_col)


def quality_filter(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality",
                   threshold: float = 0.3) -> DataFrame:
    """Rows of ``docs`` that score ``threshold`` or more, columns as they are. Rows are scored where they are,
    so ids may repeat or be null."""
    stats = staged(measured(docs.select(id_col, F.col(text).cast("string").alias(text)), id_col, text, [id_col]), "statistics")
    model = fit(training(stats, labels, id_col, label))

    def make():
        def fn(texts, batch):
            return {"__score": pa.array(model.score(statistics(texts)))}

        return fn

    return per_text(docs, make, "__score double", text).where(F.col("__score") >= threshold).select(*docs.columns)
