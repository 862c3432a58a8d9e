"""Vector functions as column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity; null for a zero vector. Norms can be given where they are computed once a row."""
    by = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(by > 0, dot(a, b) / by)


def strict_cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; a zero vector or two lengths are an error, not a null."""
    wrong = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in length"))).when((norm(a) == 0) | (norm(b) == 0), F.raise_error(F.lit("a zero vector has no direction")))
    return F.coalesce(wrong.cast("double"), cosine(a, b))


def finite(a: Column) -> Column:
    return F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
