"""Distances as Column expressions, and a registry to add others.

A metric with axis_bound promises that no coordinate's difference exceeds the distance; grids then prune its joins.
Others are pruned by their distances from a few points, by the triangle inequality.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Metric:
    """of: the distance of two points out of their coordinates' Columns.

    norm, if the distance is one of the coordinates' differences alone and doesn't fall when any of these grows: that
    function; diameter then is the distance of opposite corners of a unit cube, by its dimensions. rows: the distances
    of the rows of two (rows x dims) arrays, for metrics in Python. Every metric must keep the triangle inequality.
    """

    name: str
    of: Callable[[list[Column], list[Column]], Column]
    axis_bound: bool
    norm: Callable[[list[Column]], Column] | None = None
    diameter: Callable[[int], float] | None = None
    rows: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None

    def between(self, a: Column, b: Column, dims: int) -> Column:
        """Distance of two coordinate arrays of dims elements; unrolled, so it is part of generated code."""
        return self.of([a[i] for i in range(dims)], [b[i] for i in range(dims)])

    def from_origin(self, a: Column, dims: int) -> Column:
        return self.of([a[i] for i in range(dims)], [F.lit(0.0)] * dims)


def _euclidean(d: list[Column]) -> Column:
    return F.sqrt(reduce(lambda s, t: s + t, [x * x for x in d]))


def _manhattan(d: list[Column]) -> Column:
    return reduce(lambda s, t: s + t, [F.abs(x) for x in d])


def _chebyshev(d: list[Column]) -> Column:
    return F.greatest(*[F.abs(x) for x in d]) if len(d) > 1 else F.abs(d[0])


#: Fixed value: how far apart numbers may be that count as equal.
TOLERANCE = 1e-10


def almost_equal(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    return F.abs(a - b) <= tolerance


def almost_at_least(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    return (a > b) | almost_equal(a, b, tolerance)


def almost_at_most(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    return (a < b) | almost_equal(a, b, tolerance)


_registry: dict[str, Metric] = {}


def register(metric: Metric) -> Metric:
    _registry[metric.name] = metric
    return metric


def _by_norm(name: str, norm: Callable[[list[Column]], Column], diameter: Callable[[int], float], rows: Callable) -> Metric:
    return register(Metric(name, lambda a, b: norm([x - y for x, y in zip(a, b, strict=True)]), True, norm, diameter, rows))


_by_norm("euclidean", _euclidean, math.sqrt, lambda a, b: np.sqrt(((a - b) ** 2).sum(1)))
_by_norm("manhattan", _manhattan, float, lambda a, b: np.abs(a - b).sum(1))
_by_norm("chebyshev", _chebyshev, lambda dims: 1.0, lambda a, b: np.abs(a - b).max(1))


def metric(name: str) -> Metric:
    if name not in _registry:
        raise ValueError(f"no metric {name!r}; known: {', '.join(sorted(_registry))}")
    return _registry[name]


def register_python(name: str, fn: Callable, axis_bound: bool = False) -> Metric:
    """A metric out of a vectorised Python function of two (rows x dims) float arrays."""
    @F.pandas_udf(T.DoubleType())
    def udf(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(fn(np.stack(a.to_numpy()), np.stack(b.to_numpy())))

    return register(Metric(name, lambda a, b: udf(F.array(*a), F.array(*b)), axis_bound, rows=fn))
