"""Vector functions as columns over array<double>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product; vectors of different length give an error, as a missing component would be null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """v over its norm; a zero vector stays as it is."""
    n = norm(v)
    return F.transform(v, lambda x: x / F.when(n == 0, 1.0).otherwise(n))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either vector is zero."""
    n = F.sqrt(dot(a, a) * dot(b, b))
    return dot(a, b) / F.when(n == 0, 1.0).otherwise(n)


def proximity(a: Column, b: Column) -> Column:
    """Negative Euclidean distance: larger is nearer."""
    return -F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def compact(v: Column, digits: int = 5) -> Column:
    """Each element rounded to so many significant digits."""
    return F.transform(v, lambda x: F.format_string(f"%.{digits - 1}e", x).cast("double"))


def concat_blocks(*blocks: Column) -> Column:
    """The blocks of a feature record in layout order; null if one is missing."""
    return F.concat(*blocks)
