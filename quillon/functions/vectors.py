"""Vector functions over array<double> columns (V1-V9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import col


def dot(a: Column | str, b: Column | str) -> Column:
    """V8."""
    return F.aggregate(F.zip_with(col(a).cast("array<double>"), col(b).cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """V3: 0 if either has no length; null for vectors of different sizes."""
    n = norm(a) * norm(b)
    return F.when(F.size(col(a)) == F.size(col(b)), F.when(n == 0, 0.0).otherwise(dot(a, b) / n))


def normalized(a: Column | str) -> Column:
    """V2: a zero vector stays as it is."""
    v = col(a).cast("array<double>")
    # The length is bound once, as a function's body is evaluated anew for every element.
    return F.transform(F.array(norm(a)), lambda n: F.transform(v, lambda x: F.when(n == 0, x).otherwise(x / n)))[0]


def add(a: Column | str, b: Column | str) -> Column:
    """V4."""
    return F.zip_with(col(a), col(b), lambda x, y: x + y)


def scale(a: Column | str, by: Column | float) -> Column:
    """V4."""
    return F.transform(col(a), lambda x: x * by)


def encode(a: Column | str) -> Column:
    """V1: a literal with six decimals."""
    return F.concat(F.lit("["), F.array_join(F.transform(col(a), lambda x: F.format_string("%.6f", x.cast("double"))), ","), F.lit("]"))


def decode(x: Column | str) -> Column:
    """V1."""
    return F.transform(F.split(F.btrim(col(x), F.lit("[]")), ","), lambda v: v.cast("double"))


def knn(rows: DataFrame, query: Column, k: int, id_col: str = "work_id", vector: str = "embedding") -> DataFrame:
    """V5: the k rows of the largest cosine, ties by id; each task keeps k rows before the merge."""
    scored = rows.where(F.col(vector).isNotNull()).withColumn("sim", cosine(vector, query))
    return scored.orderBy(F.col("sim").desc(), F.col(id_col)).limit(k)
