"""Vector expressions over ``ARRAY<DOUBLE>`` columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(a: Column) -> Column:
    """Unit vector; a zero vector has none, so it gives null."""
    length = norm(a)
    return F.when(length > 0, F.transform(a, lambda x: x / length))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def clamp(c: Column) -> Column:
    """Into -1 .. 1; what is null or not a number has no place there and gives null."""
    inside = lambda x: F.when(x.isNotNull() & ~F.isnan(x), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)))
    return bound(c, inside)


def vector_reject_reason(a: Column) -> Column:
    """Why a single vector cannot be compared; null where it can."""
    return (
        F.when(a.isNull(), "null vector")
        .when(F.size(a) == 0, "zero-length vector")
        .when(F.exists(a, lambda x: x.isNull()), "null element")
        .when(F.exists(a, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))), "not a number")
    )


def sizes_differ(a: Column, b: Column) -> Column:
    return F.when(F.size(a) != F.size(b), "dimension mismatch")


def cosine_normalized(a: Column, b: Column) -> Column:
    """Unit vectors: the dot product alone. Null for vectors that cannot be compared."""
    return F.when(F.size(a) == F.size(b), clamp(dot(a, b)))


def cosine_reject_reason(a: Column, b: Column) -> Column:
    zero = F.when((norm(a) == 0) | (norm(b) == 0), "zero-magnitude vector")
    return F.coalesce(vector_reject_reason(a), vector_reject_reason(b), sizes_differ(a, b), zero)


def cosine(a: Column, b: Column) -> Column:
    """Full cosine. Null where :func:`cosine_reject_reason` has a reason."""
    valid = cosine_reject_reason(a, b).isNull()
    return F.when(valid, clamp(dot(a, b) / (norm(a) * norm(b))))
