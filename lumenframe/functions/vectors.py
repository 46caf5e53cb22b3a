"""Vectors as arrays: distances, means, fingerprints, and ordered takes of the nearest rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lumenframe.functions.text import col


def _double(v) -> Column:
    return col(v).cast("array<double>")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_squared(a, b) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a, b) -> Column:
    """1 - cosine; 1 where either vector has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 1.0).otherwise(1 - dot(a, b) / F.nullif(norms, F.lit(0.0)))


@F.arrow_udf(StringType())
def _six_decimals(vectors: pa.Array) -> pa.Array:
    out = []
    for v in vectors.to_pylist():
        if v is not None and None in v:
            v = [x for x in v if x is not None]
        out.append(None if v is None else ",".join(["%.6f"] * len(v)) % tuple(v))
    return pa.array(out, pa.string())


def fingerprint(v) -> Column:
    """SHA-1 of the numbers at six decimals, without nulls.

    Decimals are rounded from the binary number itself and ties go to the even digit (0.0078125: 0.007812), as in C. `format_string`
    rounds the shortest decimal form half up.
    """
    return F.sha1(_six_decimals(_double(v)))


def mean_vectors(df: DataFrame, by: list[str], vector: str = "embedding", out: str = "mean") -> DataFrame:
    """Element-wise mean of each group, not normalised. Partial sums shuffle: one row a group, position and task."""
    rows = df.select(*by, F.posexplode(_double(vector)).alias("__pos", "__x")).groupBy(*by, "__pos").agg(F.avg("__x").alias("__x"))
    return rows.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("__pos", "__x"))), lambda s: s["__x"]).alias(out))


def check_dimension(df: DataFrame, vector: str, dimension: int) -> DataFrame:
    """df, failing at run time on a vector of another dimension."""
    return df.where(F.when(F.size(vector) == dimension, True).otherwise(F.raise_error(F.format_string("expected %d dimensions, got %d", F.lit(dimension), F.size(vector))).isNull()))


def top_k(df: DataFrame, query: list[float], k: int, key: str, vector: str = "embedding", metric: str = "l2") -> DataFrame:
    """The k nearest rows with `distance`, ties by key: an ordered take, so each task keeps k rows at most."""
    q = F.array(*[F.lit(float(x)) for x in query])
    d = l2_squared(vector, q) if metric == "l2" else cosine_distance(vector, q)
    return df.withColumn("distance", d).orderBy("distance", key).limit(k)


def range_search(df: DataFrame, query: list[float], threshold: float, key: str, vector: str = "embedding", most: int | None = None) -> DataFrame:
    """All rows at a cosine distance within the threshold, or the `most` nearest of them."""
    if most is not None:
        return top_k(df, query, most, key, vector, "cosine").where(F.col("distance") <= threshold)
    return df.withColumn("distance", cosine_distance(vector, F.array(*[F.lit(float(x)) for x in query]))).where(F.col("distance") <= threshold)
