"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import Table

MOST_ROUNDS, SALTS = 40, 256


def with_least(rows: DataFrame, by: str, value: str | Column, spread: str, out: str) -> DataFrame:
    """rows with `out`, the least value of their group. The groups' rows are spread by `spread` over up to SALTS keys, and only keys
    that occur meet their least value, so a group of any size stays in many tasks and no group gets more keys than it has rows."""
    rows = rows.withColumn("__salt", F.pmod(F.xxhash64(spread), SALTS))
    parts = rows.groupBy(by, "__salt").agg(F.min(value).alias(out))
    least = parts.groupBy(by).agg(F.min(out).alias(out), F.collect_list("__salt").alias("__salts"))
    return rows.join(least.select(by, out, F.explode("__salts").alias("__salt")), [by, "__salt"]).drop("__salt")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges(u, v), u > v. Large: each vertex ties its larger neighbours to its least one. Small: ties its smaller ones and itself."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        out = with_least(both, "u", "v", "v", "m").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = with_least(edges, "u", "v", "v", "m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges(u, v) of any orderable type -> (node, root): every vertex with an edge, and its component's least vertex.

    Each round is written to the shared folder, so lineage stays short. Edges to itself are dropped.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    table = Table(edges, "edges")
    for _ in range(MOST_ROUNDS):
        before = table.read()
        after = Table(_star(_star(before, True), False), "edges")
        # A fixed point is a set of stars: nobody is both a root and a leaf, and each leaf has one root.
        stable = after.read().groupBy("u").count().where("count > 1").isEmpty() and after.read().select("u").distinct().join(after.read().select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()
        table.drop()
        table = after
        if stable:
            break
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    stars = table.read()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
