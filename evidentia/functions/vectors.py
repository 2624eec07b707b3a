"""Vector expressions over arrays of numbers, computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """Each value divided by the length plus 1e-12, so that a zero vector stays zero."""
    return F.transform(v, lambda x: x.cast("double") / (norm(v) + 1e-12))


def usable(v: Column, dim: int | None = None) -> Column:
    """Not null, of the wanted length, all values finite and not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    length = F.size(v) == dim if dim is not None else F.size(v) > 0
    return v.isNotNull() & length & finite & F.exists(v, lambda x: x != 0)
