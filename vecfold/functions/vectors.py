"""Vector expressions on ``array<double>`` columns and grouped vector aggregates."""

from __future__ import annotations

from typing import Callable

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOUBLES = "array<double>"


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda s, x: s + x)


def as_doubles(v: Column) -> Column:
    return v.cast(DOUBLES)


def sqdist(a: Column, b: Column) -> Column:
    """Squared Euclidean distance; both sides become doubles before subtracting."""
    return _sum(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: (x - y) * (x - y)))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(as_doubles(v), lambda x: x * x)))


def scale(v: Column, by: Column) -> Column:
    return F.transform(as_doubles(v), lambda x: x * by)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also when ``body`` loops over elements."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalise(v: Column) -> Column:
    """``v / |v|``, or ``v`` itself when its norm is not above 1e-10."""

    def divided(s: Column) -> Column:
        return F.when(s["n"] > 1e-10, F.transform(s["u"], lambda x: x / s["n"])).otherwise(s["u"])

    return _let(as_doubles(v), lambda u: _let(F.struct(u.alias("u"), norm(u).alias("n")), divided))


def pool(vectors: Column) -> Column:
    """Mean of an ``array<array>`` of vectors, normalised; an empty list is an error."""
    rows = F.size(vectors)
    summed = F.aggregate(
        F.slice(vectors, 2, F.greatest(rows - 1, F.lit(0))),
        as_doubles(F.element_at(vectors, 1)),
        lambda acc, v: F.zip_with(acc, as_doubles(v), lambda x, y: x + y),
    )
    mean = _let(
        F.struct(summed.alias("s"), rows.alias("n")), lambda p: F.transform(p["s"], lambda x: x / p["n"])
    )
    empty = F.raise_error(F.lit("cannot pool an empty list of vectors")).cast(DOUBLES)
    return F.when(rows > 0, normalise(mean)).otherwise(empty)


def mean_vector(v: str) -> Column:
    """Aggregate: element-wise mean, computed with partial aggregation on the JVM."""
    return vector_to_array(Summarizer.mean(array_to_vector(as_doubles(F.col(v)))))


def pool_by(df: DataFrame, key: str, v: str, out: str = "pooled") -> DataFrame:
    """Pooled vector per key (aggregate form of ``pool``)."""
    return df.groupBy(key).agg(mean_vector(v).alias("_mean")).select(
        key, normalise(F.col("_mean")).alias(out)
    )


def axis_ranges(df: DataFrame, v: str, by: list[str] = ()) -> DataFrame:
    """Element-wise ``mins`` and ``maxs`` of a vector column, overall or per group."""
    s = Summarizer.metrics("min", "max").summary(array_to_vector(as_doubles(F.col(v)))).alias("_s")
    return df.groupBy(*by).agg(s).select(
        *by,
        vector_to_array(F.col("_s.min")).alias("mins"),
        vector_to_array(F.col("_s.max")).alias("maxs"),
    )


def centroids(df: DataFrame, by: list[str], v: str) -> DataFrame:
    """Mean vector and row count per group."""
    return df.groupBy(*by).agg(
        mean_vector(v).alias("centroid"), F.count(F.lit(1)).alias("size")
    )


@F.pandas_udf(T.BinaryType())
def pack_f32(v: pd.Series) -> pd.Series:
    """Vector to little-endian float32 bytes."""
    return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def unpack_f32(blob: pd.Series) -> pd.Series:
    """Little-endian float32 bytes to vector; trailing bytes short of four are ignored."""
    return blob.map(
        lambda b: None if b is None else np.frombuffer(b[: len(b) // 4 * 4], "<f4")
    )
