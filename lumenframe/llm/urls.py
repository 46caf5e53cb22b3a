"""URL filters (native): fixed host and path rules first, then rules that FP-growth mines from labelled URLs.

A URL's items are its scheme, host labels, path words and query keys; labelled URLs add the item of their
label. FP-growth keeps item sets above `min_support` that `least_count` labelled URLs have or more; before, items that
fewer have, and items that all have, are pruned, for neither can be in a rule that is kept. Association rules of any length with the bad label as
consequent above `min_confidence` and above the share of bad labels, and of those only rules that beat each of
their own subsets. Rules match through an inverted index: rule items join URL items, and a rule fires for a URL when all of its items were met.

Between rules that fire for one URL the surest counts; its verdict is the same. Very long urls have many items and are
treated like any other; an empty `pages` gives no rows. Null labels are not labels.
Null urls, or urls without `://`, have an empty host and path, fit no fixed rule and have no items; they are
allowed. Repeated rows are judged alike. Without labels of both kinds no rule is mined. Other columns of the
inputs are ignored.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import Table, ascii_lower

RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
BAD, GOOD = "label:bad", "label:good"


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*(/[^?#]*)", 1), F.lit(""))


def fixed_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule (verdict, host, path prefix) that fits a URL, as struct(rule, verdict); null if none does."""
    if not rules:
        return F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    fits = [
        F.when(
            ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)),
            F.struct(F.lit(len(h) + len(p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict")),
        )
        for verdict, h, p in rules
    ]
    return F.array_max(F.array(*fits))


def url_items(url: Column) -> Column:
    """Distinct items of a URL; numbers in a path count as one item."""
    host, path = host_of(url), path_of(url)
    labels = F.transform(F.filter(F.split(host, "\\."), lambda x: x != ""), lambda x: F.concat(F.lit("host:"), x))
    steps = F.transform(F.filter(F.split(ascii_lower(path), "[/._-]+"), lambda x: x != ""), lambda x: F.concat(F.lit("path:"), F.regexp_replace(x, "^\\d+$", "<number>")))
    query = F.regexp_extract_all(F.regexp_extract(url, "\\?([^#]*)", 1), F.lit("(?:^|&)([^=&]+)"), 1)
    keys = F.transform(query, lambda x: F.concat(F.lit("query:"), x))
    scheme = F.array(F.concat(F.lit("scheme:"), ascii_lower(F.regexp_extract(url, "(?s)^(.*?)://", 1))))
    found = F.array_distinct(F.concat(scheme, labels, steps, keys))
    return F.when(host != "", found).otherwise(F.array().cast("array<string>"))


def mine_rules(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.6, least_count: int = 20) -> DataFrame:
    """labelled(url, bad boolean) -> rules(rule_id, items, confidence, support)."""
    found = labelled.where(F.col("bad").isNotNull()).select(url_items(F.col("url")).alias("items"), "bad").where(F.size("items") > 0)
    found = Table(found.withColumn("row", F.monotonically_increasing_id()), "url-items").read()
    n = found.count()
    least = max(least_count, math.ceil(min_support * n))
    items = found.select("row", F.explode("items").alias("item"))
    useful = Table(items.groupBy("item").count().where((F.col("count") >= least) & (F.col("count") < n)).select("item"), "url-items").read()
    kept = items.join(useful, "item").groupBy("row").agg(F.collect_list("item").alias("kept"))
    label = F.array(F.when(F.col("bad"), BAD).otherwise(GOOD))
    baskets = found.join(kept, "row", "left").select(F.concat(F.coalesce("kept", F.array().cast("array<string>")), label).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, least / n) if n else 1.0, minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.where((F.col("consequent") == F.array(F.lit(BAD))) & (F.col("lift") > 1))
    rules = rules.select(F.xxhash64(F.array_sort("antecedent")).alias("rule_id"), F.array_sort("antecedent").alias("items"), "confidence", "support")
    rules = Table(rules, "url-rules").read()
    # A rule goes if one of its subsets is as sure: the subset fires wherever it does. First the subsets with one item less, by
    # equality: items that always occur together make many rules, of which few are left for the join by items.
    less = F.transform("items", lambda x: F.array_remove("items", x))
    parts = rules.where(F.size("items") > 1).select("rule_id", "confidence", F.explode(less).alias("part"))
    weaker = parts.join(rules.select(F.col("items").alias("part"), F.col("confidence").alias("c")), "part").where("c >= confidence")
    rules = Table(rules.join(weaker.select("rule_id").distinct(), "rule_id", "left_anti"), "url-rules").read()
    small = rules.select(F.col("rule_id").alias("sub"), F.col("confidence").alias("c"), F.size("items").alias("n"), F.explode("items").alias("item"))
    large = rules.select("rule_id", "confidence", F.size("items").alias("size"), F.explode("items").alias("item"))
    weaker = large.join(small, "item").where("n < size AND c >= confidence")
    weaker = weaker.groupBy("rule_id", "sub", "n").count().where("count = n").select("rule_id").distinct()
    return rules.join(weaker, "rule_id", "left_anti")


def filter_urls(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str, str]] = RULES, **mining) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_confidence of every row of pages(page_id, url)."""
    mined = Table(mine_rules(labelled, **mining), "url-rules").read()
    index = mined.select("rule_id", "confidence", F.size("items").alias("n"), F.explode("items").alias("item"))
    url = pages.select("url").where(F.col("url").isNotNull()).distinct()
    met = url.select("url", F.explode(url_items(F.col("url"))).alias("item")).join(index, "item")
    fired = met.groupBy("url", "rule_id", "n", "confidence").agg(F.count(F.lit(1)).alias("met")).where("met = n")
    fired = Table(fired.groupBy("url").agg(F.max("confidence").alias("mined_confidence")), "url-fired").read()
    rows = pages.select("page_id", "url").join(fired, "url", "left")
    fit = fixed_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}).withColumn("fit", fit)
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("mined_confidence").isNotNull(), "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), F.round("mined_confidence", 6).alias("mined_confidence"))


def op4_url_filters(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    labelled = pages.select(F.col("page_id").alias("doc_id"), "url").join(labels.select("doc_id", (F.col("quality") == 0).alias("bad")), "doc_id").where(F.col("url").isNotNull() & F.col("bad").isNotNull())
    return filter_urls(pages, labelled)
