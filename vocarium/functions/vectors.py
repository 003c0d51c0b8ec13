"""Arrays as vectors: built-in higher-order functions only."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(values: Iterable[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The direction of a vector; the zero vector stays zero."""
    # the norm is bound by an outer lambda, else each element would compute it again
    return F.element_at(F.transform(F.array(norm(a)), lambda n: F.when(n == 0, a).otherwise(F.transform(a, lambda x: x / n))), 1)


def scaled(a: Column, factors: Iterable[float]) -> Column:
    return F.zip_with(a, literal(factors), lambda x, f: x * f)


def plus(a: Column, b: Column, sign: int = 1) -> Column:
    return F.zip_with(a, b, lambda x, y: x + sign * y)


def distance(a: Column, b: Column) -> Column:
    return norm(plus(a, b, -1))
