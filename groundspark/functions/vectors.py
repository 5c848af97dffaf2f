"""Vector functions over array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; null where a side is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)


def unit(a: Column) -> Column:
    size = F.greatest(norm(a), F.lit(1e-9))
    return F.element_at(F.transform(F.array(size), lambda n: F.transform(a.cast("array<double>"), lambda x: x / n)), 1)


def masked_mean(vectors: Column, mask: Column) -> Column:
    """Mean of the vectors whose mask is 1, as of token vectors and an attention mask."""
    chosen = F.transform(F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda z: z["m"] == 1), lambda z: z["v"])
    total = F.aggregate(chosen, F.transform(F.element_at(vectors, 1), lambda x: F.lit(0.0)), lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    return F.transform(total, lambda x: x / F.greatest(F.size(chosen), F.lit(1e-9)))
