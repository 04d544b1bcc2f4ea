"""Vector expressions over ARRAY<DOUBLE>, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_distance(a: Column, b: Column) -> Column:
    square = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(square, F.lit(0.0), lambda s, x: s + x))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """-1 to 1; 0 for different or empty lengths, zero vectors and non-finite results."""
    raw = dot(a, b) / (norm(a) * norm(b))
    fine = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm(a) > 0) & (norm(b) > 0) & ~F.isnan(raw)
    return F.when(fine, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw))).otherwise(F.lit(0.0))


def l2_normalise(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    return F.when(norm(a) > 0, F.transform(a, lambda x: x / norm(a))).otherwise(a)
