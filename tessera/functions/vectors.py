"""Vector expressions over array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column, eps: float = 1e-9) -> Column:
    """Divided by the norm, which counts as ``eps`` at least."""
    return F.transform(F.arrays_zip(a.alias("x"), F.array_repeat(F.greatest(norm(a), F.lit(eps)), F.size(a)).alias("n")), lambda p: p["x"] / p["n"])


def cosine_added_eps(a: Column, b: Column, eps: float = 1e-9) -> Column:
    """Cosine whose norms each have ``eps`` added, as the dense reranker defines it."""
    return dot(a, b) / ((norm(a) + eps) * (norm(b) + eps))
