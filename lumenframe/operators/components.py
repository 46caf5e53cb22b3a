"""Connected components of an undirected graph by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.sources.shared import forget, written

SALTS = 64


def with_least(rows: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """rows with the least value of their group. A group's rows are dealt over salts, which alone meet its least value."""
    rows = rows.withColumn("__salt", F.pmod(F.xxhash64(value), SALTS))
    parts = rows.groupBy(*by, "__salt").agg(F.min(value).alias(out))
    least = parts.groupBy(*by).agg(F.min(out).alias(out), F.collect_list("__salt").alias("__salts"))
    return rows.join(least.select(*by, out, F.explode("__salts").alias("__salt")), [*by, "__salt"]).drop("__salt")


def _large_star(edges: DataFrame) -> DataFrame:
    """edges(a, b), a > b: every vertex ties its larger neighbours to the least of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return with_least(both, ["a"], "b", "least").where("b > a").select(F.col("b").alias("a"), F.least("a", "least").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every vertex ties its smaller neighbours and itself to the least of them."""
    tied = with_least(edges, ["a"], "b", "least")
    own = edges.groupBy("a").agg(F.min("b").alias("b"))
    return tied.where("b > least").select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(own)


def connected_components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """nodes(id), edges(a, b) -> (id, component): the least id reachable.

    Rounds grow with the logarithm of a component's size; each is written to the shared folder. A vertex with any number of
    neighbours is dealt over salted keys. Nodes without an edge are their own component; edges must lie between nodes.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
    for _ in range(most_rounds):
        after = written(_small_star(_large_star(now)).distinct(), "edges")
        # Both stars keep a set of stars as it is, and change any other.
        same = after.count() == now.count() and after.join(now, ["a", "b"], "left_anti").isEmpty()
        forget(now)
        now = after
        if same:
            stars = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
            return nodes.select("id").distinct().join(stars, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
