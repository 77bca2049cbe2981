"""Vector functions over array columns, computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column) -> Column:
    """The vector over its length; a zero vector stays zero."""
    n = norm(v)
    return F.transform(doubles(v), lambda x: x / F.when(n == 0, 1.0).otherwise(n))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (norm(a) * norm(b))


def decoded(text: Column) -> Column:
    """Vector from text: a JSON array, or numbers divided by commas; null if neither parses."""
    return F.from_json(F.concat(F.lit("["), F.regexp_replace(text, r"[\[\]\s]", ""), F.lit("]")), "array<double>")


def encoded(v: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(doubles(v), lambda x: F.format_string("%.10g", x)), ","), F.lit("]"))
