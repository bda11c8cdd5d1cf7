"""Vector expressions over array columns; arithmetic is done in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def sum_squares(v: Column) -> Column:
    return F.aggregate(as_double(v), F.lit(0.0), lambda s, x: s + x * x)


def norm(v: Column, p: int = 2) -> Column:
    if p == 1:
        return F.aggregate(as_double(v), F.lit(0.0), lambda s, x: s + F.abs(x))
    return F.sqrt(sum_squares(v))


def normalise(v: Column, p: int = 2) -> Column:
    """Divide by the p-norm; p = 0 leaves the vector alone."""
    if p not in (0, 1, 2):
        raise ValueError("norm must be 0, 1 or 2")
    if p == 0:
        return as_double(v)
    # The norm is bound once per row by the one-element outer array; inside the inner lambda it would
    # be evaluated again for every component.
    return F.flatten(
        F.transform(F.array(norm(v, p)), lambda n: F.transform(as_double(v), lambda x: F.try_divide(x, n)))
    )


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x
    )


def mix(utterance: Column, template: Column, ratio: Column | float, p: int = 0) -> Column:
    """(1 - ratio) * utterance + ratio * template, both p-normalised first."""
    r = F.lit(float(ratio)) if not isinstance(ratio, Column) else ratio
    return F.zip_with(normalise(utterance, p), normalise(template, p), lambda x, y: (1.0 - r) * x + r * y)


def all_finite(v: Column) -> Column:
    limit = float("inf")
    return F.forall(as_double(v), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit))


def vector_problem(v: Column, dim: int | None = None) -> Column:
    """Why a vector cannot be used; null when it can."""
    bad = (
        F.when(v.isNull() | (F.size(v) == 0), "empty vector")
        .when(~all_finite(v), "non-finite vector")
    )
    if dim is not None:
        bad = bad.when(F.size(v) != dim, "wrong dimension")
    return bad


def truncate_normalise(v: Column, dims: int) -> Column:
    """First ``dims`` components, then unit length; unusable vectors stop the job."""
    head = F.slice(as_double(v), 1, dims)
    problem = (
        vector_problem(v)
        .when(F.size(v) < dims, "dimension out of range")
        .when(norm(head) == 0.0, "zero vector")
    )
    if dims < 1:
        raise ValueError("dims must be positive")
    return F.when(problem.isNull(), normalise(head, 2)).otherwise(F.raise_error(problem).cast("array<double>"))


def to_columns(v: Column, dims: int, prefix: str = "norm_emb_") -> list[Column]:
    return [F.get(v, F.lit(i)).alias(f"{prefix}{i}") for i in range(dims)]
