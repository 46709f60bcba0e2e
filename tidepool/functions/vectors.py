"""Vectors as arrays: sums run in element order and in double, so results are the same everywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    """Double dot product; null where the lengths differ."""
    products = F.zip_with(doubles(a), doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalized(v: Column) -> Column:
    """Unit float vector; null for a zero or non-finite norm."""

    def divided(size: Column) -> Column:
        fine = (size > 0) & ~F.isnan(size) & (size < float("inf"))
        return F.when(fine, F.transform(v, lambda x: (x.cast("double") / size).cast("float")))

    # The norm is bound as the element of an array, or Spark would sum it anew for every component.
    return F.get(F.transform(F.array(norm(v)), divided), F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of unit vectors, clamped to [-1, 1] and cut to float, which is what ranks."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b))).cast("float")


def vector_problems(model: Column, v: Column, dimension: int, tolerance: float = 1e-5) -> Column:
    """Names of the rules that a vector breaks; empty if it is fine."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    bad_model = (F.trim(F.coalesce(model, F.lit(""))) == "") | (F.octet_length(model) > 1024)
    rules = [
        ("model", bad_model),
        ("dimension", v.isNull() | (F.size(v) != dimension)),
        ("finite", ~F.coalesce(finite, F.lit(False))),
        ("norm", ~F.coalesce(F.abs(norm(v) - 1) <= tolerance, F.lit(False))),
    ]
    return broken(rules)


def broken(rules: list[tuple[str, Column]]) -> Column:
    """Array of the names whose condition holds."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules]))
