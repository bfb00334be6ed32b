"""Column builders for vector arithmetic on ``array<double>`` columns.

All stay JVM-side (higher-order functions ``zip_with`` / ``aggregate``), so they run inside
whole-stage code generation with no Python worker. Float vectors are cast to double first, as the
SQL oracle does, so sums agree to the last digits.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F



def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_double(v) -> Column:
    return _c(v).cast("array<double>")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(F.transform(_c(a), lambda x: x * x), F.lit(0.0), lambda acc, x: acc + x))


def cosine_similarity(a, b) -> Column:
    """NULL where a vector has length zero: its direction is undefined."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def cosine_distance(a, b) -> Column:
    """1 - cos(a, b), the distance the reference uses by default."""
    return F.lit(1.0) - cosine_similarity(a, b)


def euclidean_distance(a, b) -> Column:
    return F.sqrt(
        F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x)
    )


def vector_sub(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x - y)


def vector_scale(a, s) -> Column:
    s = _c(s) if not isinstance(s, (int, float)) else F.lit(float(s))
    return F.transform(_c(a), lambda x: x * s)


DISTANCES: dict[str, Callable[[Column, Column], Column]] = {
    "cosine": cosine_distance,
    "euclidean": euclidean_distance,
}


def distance_fn(metric) -> Callable[[Column, Column], Column]:
    """Resolve a distance: a name in ``DISTANCES`` or any ``(Column, Column) -> Column``."""
    if callable(metric):
        return metric
    try:
        return DISTANCES[metric]
    except KeyError:
        raise ValueError(f"unknown distance {metric!r}; known: {sorted(DISTANCES)}") from None
