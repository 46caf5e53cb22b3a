"""Catalog tables stored by key, so that the joins that every status view repeats need no shuffle.

Catalog, vectors and histories that are bucketed by uid into the same number of buckets join bucket by bucket. A table is written once; what is
pending is asked for again and again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def store(df: DataFrame, name: str, key: str, buckets: int = BUCKETS, path: str | None = None) -> DataFrame:
    """Write df as a table bucketed and sorted by key; null keys stay. One file a bucket: rows are dealt as the buckets will be."""
    writer = df.repartition(buckets, F.col(key)).write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return df.sparkSession.table(name)


def append(df: DataFrame, name: str, key: str, buckets: int = BUCKETS) -> None:
    """New rows to the same buckets, each with one more file."""
    df.repartition(buckets, F.col(key)).write.mode("append").bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def exchanges(df: DataFrame) -> int:
    """Shuffles in the plan of df."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning") + plan.count("Exchange RoundRobinPartitioning") + plan.count("Exchange SinglePartition")


def drop(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")
