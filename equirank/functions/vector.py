"""Vector functions: JVM-side dot products and cosines, and the Arrow batch form for many queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where either vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def usable(v: Column, size: int | None = None) -> Column:
    """The vector is not null, holds only finite numbers, is not zero and, if given, has `size` numbers."""
    fine = F.exists(v, lambda x: x != 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    if size is not None:
        fine = fine & (F.size(v) == size)
    return F.coalesce(fine, F.lit(False))
