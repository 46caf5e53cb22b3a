"""Timelines, recency, facets, status and other views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions.dates import month_of, year_of
from lumenframe.operators.scans import Ordered


def timeline_counts(df: DataFrame, date: str = "date") -> DataFrame:
    """(year, month, n); undated rows under Unknown and 00."""
    return df.groupBy(year_of(date, "Unknown").alias("year"), month_of(date, "00").alias("month")).agg(F.count(F.lit(1)).alias("n"))


def timeline_summary(df: DataFrame, date: str = "date") -> DataFrame:
    """(year, months as a map, total), the newest year first, Unknown last."""
    months = F.map_from_entries(F.array_sort(F.collect_list(F.struct("month", "n"))))
    out = timeline_counts(df, date).groupBy("year").agg(months.alias("months"), F.sum("n").alias("total"))
    return out.orderBy(F.col("year") == "Unknown", F.desc("year"))


def timeline_rollup(df: DataFrame, date: str = "date") -> DataFrame:
    """Counts by year and month with year totals and the grand total."""
    return df.rollup(year_of(date, "Unknown").alias("year"), month_of(date, "00").alias("month")).agg(F.count(F.lit(1)).alias("n"))


def newest_per_group(df: DataFrame, by: list, order: list, limit: int) -> DataFrame:
    """The first `limit` rows of each group, with their rank. `order` is total."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= limit)


def page(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit must be from 1 to 500, offset 0 or more")
    return df.orderBy(*order).offset(offset).limit(limit)


def timeline_page(df: DataFrame, year: str | None, offset: int = 0, limit: int = 100, date: str = "date", key: str = "uid") -> DataFrame:
    """One year's rows, the newest first; an offset needs a year."""
    if year is None:
        if offset:
            raise ValueError("an offset needs a year")
        return newest_per_group(df.withColumn("year", year_of(date, "Unknown")), ["year"], [F.desc(date), key], limit)
    return page(df.where(year_of(date, "Unknown") == year), [F.desc(date), key], offset, limit)


def year_order(year="year") -> list[Column]:
    return [F.col(year) == "Unknown", F.desc(year)]


def runs(df: DataFrame, label: str, order: list, by: list[str] | None = None) -> DataFrame:
    """df with `section`: 1 more at each row whose label differs from the row before, within each group of `by`."""
    seen = Ordered(df, by or [], order).add(before={"__before": F.struct(label)})
    new = (~F.col("__before").eqNullSafe(F.struct(label))).cast("long")
    return seen.add(sums={"section": new}).rows().drop("__before")


def recent(media: DataFrame, vectors: DataFrame, limit: int, key: str = "uid", over: int = 3) -> DataFrame:
    """The newest catalogued rows that are embedded: `limit` of the newest `over * limit`; a missing time counts as 0."""
    newest = media.orderBy(F.desc(F.coalesce("created_at", F.lit(0.0))), key).limit(over * limit)
    order = [F.desc(F.coalesce("created_at", F.lit(0.0))), key]
    return newest.join(vectors.select(F.col("id").alias(key)), key, "left_semi").orderBy(*order).limit(limit)


def recent_or_any(media: DataFrame, vectors: DataFrame, limit: int, key: str = "uid") -> DataFrame:
    """`recent` as ids; early in indexing, when none of the newest is embedded, the first `limit` of what is."""
    found = recent(media, vectors, limit, key).select(key)
    others = vectors.select(F.col("id").alias(key)).orderBy(key).limit(limit)
    any_found = found.agg((F.count(F.lit(1)) > 0).alias("__any"))  # one row
    return found.unionByName(others.join(F.broadcast(any_found), ~F.col("__any")).select(key))


def facets(df: DataFrame, attributes: list[str], numeric: tuple[str, ...] = ("person_count",)) -> DataFrame:
    """(attribute, values): the distinct known values of each attribute, sorted, numbers by value.

    One row an attribute and value shuffles: the columns are unpivoted and deduplicated before any list is built.
    """
    wide = df.select(*[F.col(c).cast("string").alias(c) for c in attributes])
    long = wide.unpivot([], attributes, "attribute", "value").where("value IS NOT NULL AND value NOT IN ('', 'unknown')").distinct()
    n = F.when(F.col("attribute").isin(*numeric), F.try_to_number("value", F.lit("S999999999")).cast("long"))
    sorted_ = F.array_sort(F.collect_list(F.struct(F.coalesce(n, F.lit(0)).alias("n"), F.col("value").alias("v"))))
    return long.groupBy("attribute").agg(F.transform(sorted_, lambda s: s["v"]).alias("values"))


def meta(vectors: DataFrame, media: DataFrame, uid: str, fields: list[str]) -> DataFrame:
    """One row's fields, the vector table's first, the catalog's where they are missing or empty."""
    v = vectors.where(F.col("id") == uid).select("id", *[F.col(f).cast("string").alias(f"v_{f}") for f in fields])
    m = media.where(F.col("uid") == uid).select(F.col("uid").alias("id"), *[F.col(f).cast("string").alias(f"m_{f}") for f in fields])
    return v.join(m, "id", "full_outer").select("id", *[F.coalesce(F.nullif(f"v_{f}", F.lit("")), F.nullif(f"m_{f}", F.lit(""))).alias(f) for f in fields])


def explore(vectors: DataFrame, registry: DataFrame, uid: str) -> DataFrame:
    """Every registered model, whether it has the row, and which is active."""
    own = vectors.where(F.col("id") == uid).select(F.col("embedding_model").alias("model"), F.lit(True).alias("__in")).distinct()
    return registry.join(own, "model", "left").select("model", "dimension", "is_active", F.coalesce("__in", F.lit(False)).alias("embedded")).orderBy("model")


def latest_per_key(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.max_by(value, order).alias(value))


def log_tail(log, n: int = 30) -> Column:
    log = F.col(log) if isinstance(log, str) else log
    return F.slice(log, F.greatest(F.size(log) - n + 1, F.lit(1)), n)


def directory_list(entries: DataFrame) -> DataFrame:
    """Folders only, without hidden, `$` and system names, by name without case."""
    from lumenframe.functions.paths import is_system_name

    n = F.col("name")
    return entries.where(F.col("is_dir") & ~F.startswith(n, F.lit(".")) & ~F.startswith(n, F.lit("$")) & ~is_system_name(n)).orderBy(F.lower("name"), "name")


def loaded_first(models: DataFrame) -> DataFrame:
    return models.orderBy(~F.coalesce(F.col("state") == "loaded", F.lit(False)), "name")
