"""Nearest records to a query vector, with a metadata filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(vectors: DataFrame, query: list[float], k: int = 5, where: str | None = None) -> DataFrame:
    """The k nearest rows by cosine distance, ties to the smaller id: a filter, a projection and a bounded top-k."""
    rows = vectors.where(where) if where else vectors
    return rows.withColumn("distance", cosine_distance(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query]))).orderBy("distance", "vec_id").limit(k)
