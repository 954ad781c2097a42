"""Vectors as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(u: Column, v: Column) -> Column:
    return total(F.zip_with(u, v, lambda a, b: a * b))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def distance(u: Column, v: Column) -> Column:
    return norm(F.zip_with(u, v, lambda a, b: a - b))


def l2(v: Column, eps: float = 1e-12) -> Column:
    """v over its length, or over eps where it is shorter."""
    n = F.greatest(norm(v), F.lit(eps))
    return F.transform(v, lambda x: x / n)


def l1(v: Column, eps: float = 1e-12) -> Column:
    """Positive parts of v over their sum."""
    own = F.transform(v, lambda x: F.greatest(x, F.lit(0.0)))
    return F.transform(own, lambda x: x / F.greatest(total(own), F.lit(eps)))


def joint(u: Column, v: Column) -> Column:
    """Both modalities, each of length 1, side by side."""
    return F.concat(l2(u), l2(v))


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))
