"""Vector expressions as column functions (codegen-free higher-order functions, but no Python crossing)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Added to every norm, so that a zero vector has similarity 0 with everything instead of NULL or NaN.
NORM_EPSILON = 1e-8


def as_double(v) -> Column:
    return F.col(v).cast("array<double>") if isinstance(v, str) else v.cast("array<double>")


def dot(u, v) -> Column:
    return F.aggregate(
        F.zip_with(as_double(u), as_double(v), lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x
    )


def norm(v) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalise(v) -> Column:
    # The norm enters as a second array: inside a lambda it would be computed again for every element.
    scale = F.array_repeat(norm(v) + F.lit(NORM_EPSILON), F.size(as_double(v)))
    return F.zip_with(as_double(v), scale, lambda x, s: x / s)


def cosine(u, v) -> Column:
    return dot(u, v) / ((norm(u) + F.lit(NORM_EPSILON)) * (norm(v) + F.lit(NORM_EPSILON)))


def euclidean(u, v) -> Column:
    return F.sqrt(
        F.aggregate(
            F.zip_with(as_double(u), as_double(v), lambda a, b: (a - b) * (a - b)),
            F.lit(0.0),
            lambda acc, x: acc + x,
        )
    )


def zero_vector(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)


def is_blank(text) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(~c.rlike(r"\S"), F.lit(True))


def blank_to_zero(text, v, dim: int) -> Column:
    """The vector, or zeros where the text is missing or holds white space only."""
    return F.when(is_blank(text), zero_vector(dim)).otherwise(F.coalesce(as_double(v), zero_vector(dim)))
