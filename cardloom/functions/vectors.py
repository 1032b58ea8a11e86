"""Vector arithmetic in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def strength(product: Column) -> Column:
    """Dot product of unit vectors as a link strength in [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (product + 1) / 2))


def rrf(rank: Column, k: int = 60) -> Column:
    """Reciprocal-rank term; a missing rank counts 0."""
    return F.coalesce(1 / (k + rank), F.lit(0.0))
