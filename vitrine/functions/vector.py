"""Vector expressions on arrays of numbers, in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Up to so many components a sum is written out, so it runs inside generated code; beyond, as a fold.
UNROLL = 256


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dot_with(a: Column, values: Sequence[float]) -> Column:
    """Inner product with a constant vector."""
    if len(values) > UNROLL:
        return dot(a, F.array(*[F.lit(float(v)) for v in values]))
    total = F.lit(0.0)
    for k, v in enumerate(values):
        total = total + F.get(a, F.lit(k)).cast("double") * F.lit(float(v))
    return total


def norm(a: Column, size: int | None = None) -> Column:
    if size is None or size > UNROLL:
        return F.sqrt(dot(a, a))
    total = F.lit(0.0)
    for k in range(size):
        x = F.get(a, F.lit(k)).cast("double")
        total = total + x * x
    return F.sqrt(total)


def cosine_with(a: Column, values: Sequence[float]) -> Column:
    """Cosine similarity with a constant vector; null if the lengths differ or a norm is zero."""
    own = sum(float(v) ** 2 for v in values) ** 0.5
    both = norm(a, len(values)) * F.lit(own)
    return F.when((F.size(a) == len(values)) & (both > 0), dot_with(a, values) / both)


def normalized(a: Column) -> Column:
    """Length one; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def literal(a: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: x.cast("string")), ","), F.lit("]"))


def head(a: Column, n: int) -> Column:
    """The first n components."""
    return F.slice(a, 1, n)


def checked(a: Column, size: int) -> Column:
    """The vector; an error if it has another number of components."""
    wrong = F.concat(F.lit(f"expected {size} components, found "), F.size(a).cast("string"))
    return F.when(F.size(a) == size, a).otherwise(F.raise_error(wrong).cast("array<double>"))


def nonzero(a: Column) -> Column:
    """Whether there is a vector with a component other than zero."""
    return F.coalesce(F.exists(a, lambda x: x != 0), F.lit(False))
