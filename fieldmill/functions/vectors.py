"""Vector expressions over array columns, computed in double."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import as_col, let


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(
        F.zip_with(as_col(a), as_col(b), lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(as_col(v), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalise(v: Column | str) -> Column:
    """Unit vector as array<double>; null for the zero vector."""
    v = as_col(v)
    return let(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)))
