"""Vector functions as Column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(x: Column) -> Column:
    return F.transform(x, lambda e: e.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_d(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Null where either has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def literal(values: list[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def problem(a: Column, width: int) -> Column:
    """What is wrong with a vector, or null: missing, width, not finite, zero."""
    odd = F.exists(a, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return F.when(a.isNull(), "missing").when(F.size(a) != width, "dimension").when(odd, "not_finite").when(norm(a) == 0, "zero_norm")


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))
