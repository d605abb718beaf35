"""Cosine similarity and top-k search with one query vector, in JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where one is all zero, null where one is null or their lengths differ."""
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(F.size(a) == F.size(b), F.coalesce(F.try_divide(_dot(a, b), norms), F.lit(0.0)))


def cosine_to(column: str, query: list[float]) -> Column:
    """Cosine to a fixed vector, whose norm is computed once."""
    norm = sum(x * x for x in query) ** 0.5
    vector, fixed = F.col(column), F.lit([float(x) for x in query])
    value = F.try_divide(_dot(vector, fixed), F.sqrt(_dot(vector, vector)) * F.lit(norm))
    return F.when(F.size(vector) == len(query), F.coalesce(value, F.lit(0.0)))


def usable(column: str, dim: int) -> Column:
    """A vector that can be compared: of the right length and not all zero."""
    return (F.size(column) == dim) & F.exists(column, lambda x: x != 0)


def query_vector(df: DataFrame, id_col: str, vector_col: str, dim: int) -> list[float]:
    """The vector of the smallest id that has a usable one: a query that comes from the data."""
    row = df.filter(usable(vector_col, dim)).orderBy(id_col).select(vector_col).first()
    return [float(x) for x in row[0]] if row else [0.0] * dim


def top_k(
    df: DataFrame, id_col: str, vector_col: str, query: list[float], k: int, where: Column | None = None, post_filter: bool = False
) -> DataFrame:
    """The k most similar rows, with their ``similarity``; ties go to the smaller id.

    ``where`` is applied before the search, or with ``post_filter`` to the k rows
    found, so that fewer may come back.
    """
    rows = df.filter(usable(vector_col, len(query)))
    if where is not None and not post_filter:
        rows = rows.filter(where)
    found = rows.withColumn("similarity", cosine_to(vector_col, query)).orderBy(F.desc("similarity"), id_col).limit(k)
    return found.filter(where) if where is not None and post_filter else found
