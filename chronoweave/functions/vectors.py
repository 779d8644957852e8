"""Vector expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    """Sequential double-precision sum over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    cut = lambda v: F.slice(v, F.lit(1), n)
    products = F.zip_with(cut(a), cut(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine; null where a norm is zero, which would be NaN and pass any lower bound."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms)


def leading(v: Column, dim: int) -> Column:
    """The first components as they are; a shorter vector is an error."""
    return F.when(F.size(v) >= dim, F.slice(v, 1, dim)).otherwise(F.raise_error(F.lit(f"vector shorter than {dim}")).cast("array<float>"))
