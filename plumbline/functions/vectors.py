"""Vector expressions on ARRAY columns, accumulated in double (V1-V3, V6, V8)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda s, x: s + x * x))


def _divided(v: Column, by: Column) -> Column:
    """``v`` over one number, found once: an expression in the lambda itself would be evaluated for each element."""
    return F.get(F.transform(F.array(by), lambda n: F.transform(as_double(v), lambda x: x / n)), F.lit(0))


def l2_floor(v: Column, eps: float = 1e-12) -> Column:
    """V1: divide by max(norm, eps)."""
    return _divided(v, F.greatest(norm(v), F.lit(eps)))


def l2_zero_safe(v: Column) -> Column:
    """V2: a zero vector stays as it is."""
    n = norm(v)
    return _divided(v, F.when(n == 0, 1.0).otherwise(n))


def cosine(a: Column, b: Column) -> Column:
    return dot(l2_zero_safe(a), l2_zero_safe(b))


def nan_cells(v: Column) -> Column:
    return F.size(F.filter(v, lambda x: F.isnan(x)))


def inf_cells(v: Column) -> Column:
    return F.size(F.filter(as_double(v), lambda x: F.abs(x) == F.lit(float("inf"))))


def all_zero(v: Column) -> Column:
    """NaN counts as non-zero, -0.0 as zero."""
    return F.forall(as_double(v), lambda x: (x == 0) & ~F.isnan(x))
