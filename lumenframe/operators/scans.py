"""Prefix scans of ordered logs, however long one group is.

Rows are range-partitioned by group and order, so a large group becomes many ranges. Within a range a window computes sums, maxima, last known
values or the row before; a range passes on one summary row, a window over these (as many rows as there are ranges and groups) makes
what each range starts from, and the two are put together. No window holds a whole group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions.text import col
from lumenframe.sources.shared import written


class Ordered:
    """df in the total order `order` within each group of `by` (no columns: one group), as ranges in a table of the shared folder."""

    def __init__(self, df: DataFrame, by: list[str], order: list, ranges: int | None = None):
        self.by, self.order = by, order
        keys = [*by, *order]
        dealt = df.repartitionByRange(ranges, *keys) if ranges else df.repartitionByRange(*keys)
        self.df = written(dealt.withColumn("__range", F.spark_partition_id()), "ranges")

    @property
    def _local(self):
        return Window.partitionBy(*self.by, "__range").orderBy(*self.order)

    def add(self, sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, before: dict[str, Column] | None = None) -> Ordered:
        """More columns: running sums and maxima including the row itself, the last value that isn't null including its own, and the value of the row before."""
        kinds = [(n, c, "sum") for n, c in (sums or {}).items()] + [(n, c, "max") for n, c in (maxima or {}).items()]
        kinds += [(n, c, "last") for n, c in (lasts or {}).items()] + [(n, c, "before") for n, c in (before or {}).items()]
        inputs = {f"__in_{n}": col(c) for n, c, _ in kinds}
        rows = self.df.withColumns(inputs)
        up_to, place = self._local.rowsBetween(Window.unboundedPreceding, 0), F.row_number().over(self._local)
        local, summary, carry, joined = {"__place": place}, [], {}, {}
        earlier = Window.partitionBy(*self.by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
        for n, _, kind in kinds:
            own, here, start = F.col(f"__in_{n}"), F.col(f"__here_{n}"), F.col(f"__start_{n}")
            if kind == "sum":
                local[f"__here_{n}"] = F.sum(own).over(up_to)
                summary.append(F.sum(own).alias(f"__s_{n}"))
                carry[f"__start_{n}"] = F.sum(f"__s_{n}").over(earlier)
                joined[n] = F.coalesce(here + start, here, start)
            elif kind == "max":
                local[f"__here_{n}"] = F.max(own).over(up_to)
                summary.append(F.max(own).alias(f"__s_{n}"))
                carry[f"__start_{n}"] = F.max(f"__s_{n}").over(earlier)
                joined[n] = F.greatest(here, start)
            elif kind == "last":
                local[f"__here_{n}"] = F.last(own, ignorenulls=True).over(up_to)
                summary.append(F.max_by(own, F.when(own.isNotNull(), F.col("__place"))).alias(f"__s_{n}"))
                carry[f"__start_{n}"] = F.last(f"__s_{n}", ignorenulls=True).over(earlier)
                joined[n] = F.coalesce(here, start)
            else:
                local[f"__here_{n}"] = F.lag(own).over(self._local)
                summary.append(F.max_by(own, F.col("__place")).alias(f"__s_{n}"))
                carry[f"__start_{n}"] = F.last(f"__s_{n}").over(earlier)
                joined[n] = F.when(F.col("__place") == 1, start).otherwise(here)
        rows = rows.withColumns(local)
        ranges = rows.groupBy(*self.by, "__range").agg(*summary).withColumns(carry)
        ranges = ranges.select(*(F.col(b).alias(f"__by_{i}") for i, b in enumerate(self.by)), F.col("__range").alias("__of"), *carry)
        same = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"__by_{i}")) for i, b in enumerate(self.by)], F.col("__range") == F.col("__of"))
        kept = self.df.columns
        out = Ordered.__new__(Ordered)
        out.by, out.order = self.by, self.order
        out.df = rows.join(ranges, same).select(*kept, *(c.alias(n) for n, c in joined.items()))
        return out

    def rows(self) -> DataFrame:
        return self.df.drop("__range")


def numbered(df: DataFrame, order: list, by: list[str] | None = None, name: str = "place") -> DataFrame:
    """df with each row's place in the order, from 1."""
    return Ordered(df, by or [], order).add(sums={name: F.lit(1).cast("long")}).rows()
