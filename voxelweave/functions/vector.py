"""Column expressions on ARRAY<DOUBLE> vectors, and the element-wise SUM aggregate."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))


def scaled(v: Column, weight: Column) -> Column:
    return F.transform(v, lambda x: x * weight)


def mean_of_two(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x + y) / F.lit(2.0))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row.

    A scalar written into a lambda would be computed again for every element, and an array used twice
    would be built twice; as a lambda variable it is bound.
    """
    return F.transform(F.array(value), body)[0]


def l2_normalised(v: Column, eps: float = 1.0e-8) -> Column:
    return let(v, lambda u: let(F.lit(1.0) / F.greatest(norm(u), F.lit(eps)), lambda k: scaled(u, k)))


def without_projection(raw: Column, shared: Column, eps: float = 1.0e-8) -> Column:
    """(raw - shared) less its projection on shared; the denominator carries + eps."""
    return let(
        minus(raw, shared),
        lambda gap: let(
            dot(shared, gap) / (dot(shared, shared) + F.lit(eps)), lambda factor: F.zip_with(gap, shared, lambda g, s: g - factor * s)
        ),
    )


def vector_sum(v: Column) -> Column:
    """Element-wise SUM over a group, with map-side partial sums."""
    return vector_to_array(Summarizer.sum(array_to_vector(v)))


def lanes(vec: Column, width: int) -> Column:
    """A vector as consecutive slices of at most ``width`` values."""
    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(vec) / F.lit(width)).cast("int") - 1), lambda i: F.slice(vec, i * width + 1, F.lit(width)))


def lane_sums(part: Column, width: int, weight: Column | None = None) -> list[Column]:
    """Generated-code sums of every position of a slice; positions past its end give NULL."""
    values = [F.get(part, F.lit(i)) for i in range(width)]
    return [F.sum(v if weight is None else v * weight).alias(f"_{i}") for i, v in enumerate(values)]


def lane_values(width: int) -> Column:
    return F.filter(F.array(*[F.col(f"_{i}") for i in range(width)]), lambda v: v.isNotNull())
