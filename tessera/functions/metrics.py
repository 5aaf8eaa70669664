"""Distances between vectors as Column expressions, and the registry of their names.

The metrics differ in what two all-zero vectors are apart: `empty_value` says
so where it matters (0 in clustering, 1 in lookup tables).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Metric = Callable[[Column, Column], Column]
EPS = 1e-10


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def l2_squared(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(l2_squared(a, b))


def binary_jaccard(a: Column, b: Column, empty_value: float = 1.0) -> Column:
    """1 - both nonzero / either nonzero."""
    both = _total(F.zip_with(a, b, lambda x, y: F.when((x != 0) & (y != 0), 1.0).otherwise(0.0)))
    either = _total(F.zip_with(a, b, lambda x, y: F.when((x != 0) | (y != 0), 1.0).otherwise(0.0)))
    return F.when(either == 0, F.lit(float(empty_value))).otherwise(1 - both / either)


def set_jaccard(a: Column, b: Column, empty_value: float = 1.0) -> Column:
    """Binary Jaccard of sparse vectors given as arrays of their distinct active cells."""
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) == 0, F.lit(float(empty_value))).otherwise(1 - both / (F.size(a) + F.size(b) - both))


def weighted_jaccard(a: Column, b: Column, empty_value: float = 0.0) -> Column:
    """1 - sum of minima / sum of maxima, for vectors without negative entries."""
    low, high = _total(F.zip_with(a, b, lambda x, y: F.least(x, y))), _total(F.zip_with(a, b, lambda x, y: F.greatest(x, y)))
    return F.when(high == 0, F.lit(float(empty_value))).otherwise(1 - low / high)


def general_jaccard(a: Column, b: Column) -> Column:
    """Weighted Jaccard with EPS in the denominator, so that two zero vectors are 1 apart."""
    return 1 - _total(F.zip_with(a, b, lambda x, y: F.least(x, y))) / (_total(F.zip_with(a, b, lambda x, y: F.greatest(x, y))) + EPS)


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), F.lit(0), lambda acc, x: acc + x)


METRICS: dict[str, Metric] = {
    "l2sq": l2_squared,
    "l2": l2,
    "jaccard": binary_jaccard,
    "jaccard0": lambda a, b: binary_jaccard(a, b, 0.0),
    "weighted_jaccard": weighted_jaccard,
    "gjaccard": general_jaccard,
    "hamming": hamming,
}


def metric(name: str | Metric) -> Metric:
    """A registered metric, or the callable itself."""
    if callable(name):
        return name
    if name not in METRICS:
        raise ValueError(f"unknown metric {name!r}; known: {', '.join(METRICS)}")
    return METRICS[name]


SET_METRICS: dict[str, Metric] = {
    "jaccard": set_jaccard,
    "jaccard0": lambda a, b: set_jaccard(a, b, 0.0),
    "gjaccard": lambda a, b: 1 - F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b) - F.size(F.array_intersect(a, b)) + EPS),
    "hamming": lambda a, b: F.size(a) + F.size(b) - 2 * F.size(F.array_intersect(a, b)),
}


def set_metric(name: str | Metric) -> Metric:
    """The metric of that name between sparse vectors given as arrays of their distinct active cells, or the callable itself."""
    if callable(name):
        return name
    if name not in SET_METRICS:
        raise ValueError(f"unknown metric of sets {name!r}; known: {', '.join(SET_METRICS)}")
    return SET_METRICS[name]


def _added(a: np.ndarray, b: np.ndarray, term: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sums of a term over entries, one entry after the other as the expressions above have it, for all rows of a and b."""
    total = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        total += term(a[:, j, None], b[None, :, j])
    return total


def _binary_rows(empty_value: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        both, either = _added(a, b, lambda x, y: (x != 0) & (y != 0)), _added(a, b, lambda x, y: (x != 0) | (y != 0))
        return np.where(either == 0, empty_value, 1 - both / np.where(either == 0, 1, either))

    return distances


#: Distances of all rows of one matrix to all rows of another, for metrics that have them; they equal METRICS bit by bit.
ROW_METRICS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "l2sq": lambda a, b: _added(a, b, lambda x, y: (x - y) * (x - y)),
    "l2": lambda a, b: np.sqrt(_added(a, b, lambda x, y: (x - y) * (x - y))),
    "jaccard": _binary_rows(1.0),
    "jaccard0": _binary_rows(0.0),
    "gjaccard": lambda a, b: 1 - _added(a, b, np.minimum) / (_added(a, b, np.maximum) + EPS),
}


def user_metric(distance: Callable[[np.ndarray, np.ndarray], float]) -> Metric:
    """A metric from a Python function of two arrays, run over Arrow batches."""

    @F.pandas_udf("double")
    def apply(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([float(distance(np.asarray(x), np.asarray(y))) for x, y in zip(a, b, strict=True)])

    return lambda a, b: apply(a, b)
