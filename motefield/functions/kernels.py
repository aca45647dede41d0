"""Smoothing kernels on a unit disc."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 2-D normalisation per kernel, in kernel id order.
NORMS = {
    "cubic_spline": 1.8189136353,
    "wendland_c2": 2.2281692033,
    "gaussian": 1.2969948338,
    "quartic": 0.9549296586,
    "sphere": 0.4774648293,
}
KERNELS = list(NORMS)


def kernel(name: str, r2: Column) -> Column:
    """Kernel value at squared radius ``r2`` (no support test: callers keep ``r2 <= 1``)."""
    norm = NORMS[name]
    r = F.sqrt(r2)
    if name == "cubic_spline":
        edge = 1.0 - r
        return F.when(r <= 0.5, 1.0 - 6.0 * r2 * edge).otherwise(2.0 * edge * edge * edge) * norm
    if name == "wendland_c2":
        edge2 = (1.0 - r) * (1.0 - r)
        return edge2 * edge2 * (4.0 * r + 1.0) * norm
    if name == "gaussian":
        return F.exp(-4.0 * r2) * norm
    if name == "quartic":
        return (1.0 - r2) * (1.0 - r2) * norm
    return F.sqrt(F.greatest(1.0 - r2, F.lit(0.0))) * norm


def supported_kernel(name: str, r2: Column) -> Column:
    """Kernel value with its support: zero outside the unit disc."""
    return F.when(r2 > 1.0, 0.0).otherwise(kernel(name, F.least(r2, F.lit(1.0))))


def kernel_values(name: str, r2):
    """As `kernel`, on a numpy array."""
    import numpy as np

    r = np.sqrt(r2)
    edge = 1.0 - r
    if name == "cubic_spline":
        out = np.where(r <= 0.5, 1.0 - 6.0 * r2 * edge, 2.0 * edge * edge * edge)
    elif name == "wendland_c2":
        out = edge * edge * edge * edge * (4.0 * r + 1.0)
    elif name == "gaussian":
        out = np.exp(-4.0 * r2)
    elif name == "quartic":
        out = (1.0 - r2) * (1.0 - r2)
    else:
        out = np.sqrt(np.maximum(1.0 - r2, 0.0))
    return out * NORMS[name]
