"""Arithmetic on array columns."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F


def sum_vectors(vec: Column) -> Column:
    """Element-wise sum as an aggregate, with partial sums before the shuffle."""
    return vector_to_array(Summarizer.sum(array_to_vector(vec.cast("array<double>"))))


def mean_vectors(vec: Column) -> Column:
    return vector_to_array(Summarizer.mean(array_to_vector(vec.cast("array<double>"))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length).otherwise(F.lit(0.0))


def unit(a: Column) -> Column:
    length = norm(a)
    return F.when(
        length > 0, F.transform(a, lambda x: x.cast("double") / length)
    ).otherwise(a.cast("array<double>"))


def zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


