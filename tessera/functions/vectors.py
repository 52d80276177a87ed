"""Vector expressions on ``array<double>`` columns (higher-order SQL functions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def as_double(vec) -> Column:
    return _c(vec).cast("array<double>")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(vec) -> Column:
    return F.sqrt(F.aggregate(as_double(vec), F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(vec) -> Column:
    """``e / ||e||``; a zero vector gives nulls (``try_divide``) instead of an error."""
    v = as_double(vec)
    n = norm(v)
    return F.transform(v, lambda x: F.try_divide(x, n))


def head_weight(k, j) -> Column:
    """Weight rule of the fixed linear head: ((31k + 17j) mod 101 - 50) / 50."""
    return (F.pmod(F.lit(31) * k + F.lit(17) * j, F.lit(101)) - F.lit(50)) / F.lit(50.0)


def linear_head(vec, n_classes: int, bias: float = 0.0) -> Column:
    """``W x + b`` for the rule-defined W, as an array of ``n_classes`` logits."""
    v = as_double(vec)
    return F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)), lambda k: F.aggregate(
        F.transform(v, lambda x, j: x * head_weight(k, j)), F.lit(float(bias)), lambda s, y: s + y))
