"""Facets of large libraries by sketches that merge.

A task keeps, for each attribute, a sketch of its distinct values and one of its most frequent ones, both of a fixed size however many rows or
values there are. Sketches add up: over tasks, over batches, over libraries. Only what the sketches leave in question is counted
exactly, so no row ever holds all values of an attribute that has many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values that the sketch of frequent ones tracks, and the precision of the distinct one (its estimates are within about 1 %).
ITEMS, PRECISION = 1000, 14


def known_values(df: DataFrame, attributes: list[str]) -> DataFrame:
    """(attribute, value) of every known value of every row."""
    wide = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in attributes])
    return wide.unpivot([], attributes, "attribute", "value").where("value IS NOT NULL AND value NOT IN ('', 'unknown')")


def facet_sketches(df: DataFrame, attributes: list[str], items: int = ITEMS) -> DataFrame:
    """(attribute, n, different, frequent): rows with a known value, and the two sketches. Attributes without a known value have no row."""
    frequent = F.call_function("approx_top_k_accumulate", F.col("value"), F.lit(items))
    return known_values(df, attributes).groupBy("attribute").agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg("value", PRECISION).alias("different"), frequent.alias("frequent"))


def merged(sketches: DataFrame, items: int = ITEMS) -> DataFrame:
    """One row an attribute of sketches from several runs of `facet_sketches`."""
    return sketches.groupBy("attribute").agg(F.sum("n").alias("n"), F.hll_union_agg("different").alias("different"), F.call_function("approx_top_k_combine", F.col("frequent"), F.lit(items)).alias("frequent"))


def facet_summary(sketches: DataFrame, top: int = 20) -> DataFrame:
    """(attribute, n, distinct, top): estimates. A count in `top` is short of the true one by at most `error_bound` of n."""
    found = F.transform(F.call_function("approx_top_k_estimate", F.col("frequent"), F.lit(top)), lambda x: F.struct(x["item"].alias("value"), x["count"].alias("n")))
    return sketches.select("attribute", "n", F.hll_sketch_estimate("different").alias("distinct"), found.alias("top"))


def error_bound(items: int = ITEMS) -> float:
    """The share of rows by which a frequent value's count may be off: what the sketch may have thrown out, 3.5 of its table's places."""
    places = 1 << max(3, (-(-items * 4 // 3) - 1).bit_length())
    return 3.5 / places


def frequent_values(df: DataFrame, attributes: list[str], share: float = 0.01, items: int = ITEMS) -> DataFrame:
    """(attribute, value, n), exactly: the values that at least this share of an attribute's known rows have.

    The sketch holds every value above twice its error; those it names, at most `items` an attribute, are counted in a second pass.
    """
    if share < 2 * error_bound(items):
        raise ValueError(f"{items} items can't promise all values of a share of {share}; at least {2 * error_bound(items):.4f}")
    sketches = facet_sketches(df, attributes, items)
    named = sketches.select("attribute", F.col("n").alias("total"), F.explode(F.call_function("approx_top_k_estimate", F.col("frequent"), F.lit(items))).alias("x"))
    named = named.select("attribute", "total", F.col("x.item").alias("value"))
    counts = known_values(df, attributes).join(F.broadcast(named), ["attribute", "value"]).groupBy("attribute", "value", "total").agg(F.count(F.lit(1)).alias("n"))  # items an attribute
    return counts.where(F.col("n") >= share * F.col("total")).select("attribute", "value", "n")


def bounded_facets(df: DataFrame, attributes: list[str], most: int = 1000) -> DataFrame:
    """(attribute, distinct, complete, values): the sorted values of attributes that have at most `most`, null for the others. Values are counted
    before any is listed."""
    values = known_values(df, attributes).distinct()
    sizes = values.groupBy("attribute").agg(F.count(F.lit(1)).alias("distinct")).withColumn("complete", F.col("distinct") <= most)
    lists = values.join(F.broadcast(sizes.where("complete").select("attribute")), "attribute").groupBy("attribute").agg(F.array_sort(F.collect_list("value")).alias("values"))  # a row an attribute
    return sizes.join(lists, "attribute", "left")
