"""Column functions on vectors; all sums are taken in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strata import constants as K


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(v: Column) -> Column:
    """Divide by the norm; an empty or all-zero vector stays as it is."""
    return F.transform(
        F.array(as_double(v)),
        lambda d: F.transform(
            F.array(norm(d)),
            lambda n: F.when(n > 0, F.transform(d, lambda x: x / n)).otherwise(d),
        )[0],
    )[0]


def unit(v: Column) -> Column:
    """Unit vector, or null where there is no direction."""
    return F.transform(F.array(l2_normalize(v)), lambda u: F.when(norm(u) > 0, u))[0]


def keep(score: Column) -> Column:
    """A measured value at the precision in which documents are compared."""
    return F.round(score, K.SCORE_DECIMALS)


def clamp01(x: Column) -> Column:
    return F.when(x.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))


def cosine_clamped(a: Column, b: Column) -> Column:
    """Cosine of two vectors, cut to [0, 1]; null where a vector has no direction."""
    return clamp01(dot(unit(a), unit(b)))
