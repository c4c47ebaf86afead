"""Joins between tables, set operations and nearest vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows of child whose key no parent has; null keys are orphans."""
    return child.join(parent.select(F.col(parent_key).alias("_key")), F.col(child_key) == F.col("_key"), "left_anti")


def with_parent(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    return child.join(parent.select(F.col(parent_key).alias("_key")), F.col(child_key) == F.col("_key"), "left_semi")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def nearest(vectors: DataFrame, query: list[float], id_col: str, vector_col: str, k: int) -> DataFrame:
    """id, similarity of the k vectors with the largest cosine; each task keeps k."""
    q = F.array(*[F.lit(float(x)) for x in query])
    v = F.col(vector_col)
    cosine = F.try_divide(dot(v, q), F.sqrt(dot(v, v)) * F.sqrt(dot(q, q)))
    return vectors.select(id_col, F.round(cosine, 6).alias("similarity")).orderBy(F.desc("similarity"), id_col).limit(k)
