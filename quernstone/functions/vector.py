"""Vector functions as Spark column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; 0 where lengths differ, a vector is null, empty or zero."""
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    fits = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.coalesce(F.when(fits, F.try_divide(_dot(a, b), norms)), F.lit(0.0))
