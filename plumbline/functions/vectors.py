"""Column expressions over vectors held as arrays. Sums are in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = Column | str


def _doubles(v: Vector) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def total(v: Vector) -> Column:
    return F.aggregate(_doubles(v), F.lit(0.0), lambda a, x: a + x)


def dot(v: Vector, w: Vector) -> Column:
    return F.aggregate(F.zip_with(_doubles(v), _doubles(w), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)


def norm(v: Vector) -> Column:
    return F.sqrt(F.aggregate(_doubles(v), F.lit(0.0), lambda a, x: a + x * x))


def scaled(v: Vector, by: Column) -> Column:
    return F.transform(_doubles(v), lambda x: x * by)


def plus(v: Vector, w: Vector) -> Column:
    return F.zip_with(_doubles(v), _doubles(w), lambda a, b: a + b)


def minus(v: Vector, w: Vector) -> Column:
    return F.zip_with(_doubles(v), _doubles(w), lambda a, b: a - b)


def row_l2(v: Vector) -> Column:
    """Divided by its length, taken as 1e-8 at least."""
    return scaled(v, F.lit(1.0) / F.greatest(norm(v), F.lit(1e-8)))


def unit(v: Vector) -> Column:
    """Divided by its length; unchanged where that is 1e-12 or less."""
    return F.when(norm(v) > 1e-12, scaled(v, F.lit(1.0) / norm(v))).otherwise(_doubles(v))


def standardized(v: Vector, center: Vector, scale: Vector) -> Column:
    return F.zip_with(minus(v, center), _doubles(scale), lambda a, s: a / s)


def finite(v: Vector) -> Column:
    """Whether every cell is a number."""
    return F.forall(_doubles(v), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))


def cosine(v: Vector, w: Vector) -> Column:
    return F.try_divide(dot(v, w), norm(v) * norm(w))


def literal(values: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in values))


def rounded(v: Vector, digits: int = 6) -> Column:
    """Each cell rounded, without a negative zero."""
    return F.transform(_doubles(v), lambda x: F.round(x, digits) + F.lit(0.0))
