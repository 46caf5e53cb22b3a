"""Exact and near duplicates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions.hashing import bands, hamming
from lumenframe.operators.components import connected_components, with_least
from lumenframe.operators.metric import onto_members, united
from lumenframe.sources.shared import written


def exact_duplicates(df: DataFrame, key: str, content: str) -> DataFrame:
    """(canonical, copies, n) of each content with its smallest key; partial minima shuffle, not rows."""
    return df.groupBy(F.sha1(F.col(content).cast("binary")).alias("sha1")).agg(F.min(key).alias("canonical"), F.count(F.lit(1)).alias("n"))


def redundant_copies(media: DataFrame) -> DataFrame:
    """'uid::path' of every recorded copy, sorted."""
    return media.select("uid", F.explode("dup_paths").alias("p")).select(F.concat_ws("::", "uid", "p").alias("copy")).orderBy("copy")


def split_copy_id(copy):
    parts = F.split(F.col(copy) if isinstance(copy, str) else copy, "::", 2)
    return F.struct(F.get(parts, F.lit(0)).alias("uid"), F.get(parts, F.lit(1)).alias("path"))


#: Values of one band beyond which it is split by further bits.
HOT = 2048
#: Where bands are too narrow: values of a block, of which two meet in a task, and the values that are compared with a block at once.
BLOCK, TILE = 8192, 64


def value_classes(df: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """members(k, rep) of all rows with a value and reps(v, rep, n): the least key of each different value and how many rows have it."""
    rows = written(df.where(F.col(value).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(value).alias("v")), "values")
    reps = rows.groupBy("v").agg(F.min("k").alias("rep"), F.count(F.lit(1)).alias("n"))
    return with_least(rows, ["v"], "k", "rep").select("k", "rep"), reps


def _edges(threshold: int) -> list[int] | None:
    """Where threshold + 1 bands of bits begin and end; None if they are too narrow to tell values apart."""
    n = threshold + 1
    edges = [64 * i // n for i in range(n + 1)]
    widest = max(b - a for a, b in zip(edges, edges[1:], strict=False))
    return None if (64 - widest) // n < (n - 1).bit_length() + 1 else edges


def near_values(values: DataFrame, threshold: int) -> DataFrame:
    """(v, v2, distance), v < v2, of different 64-bit values(v) within a Hamming distance; none is missed.

    Of threshold + 1 bands of bits two such values share one, so they meet there. A band's value that more than HOT values share is split: the bits
    outside it are cut into as many bands again, of which they share one too. Where bands are so narrow that they tell little apart, all pairs
    are compared, block by block: the work grows with the square of the different values, at about 3 ns a pair, and the shuffle with their number times that of blocks.
    """
    n, edges = threshold + 1, _edges(threshold)
    if edges is None:
        return _by_blocks(values, threshold, _tiles, "v long, v2 long, distance int")
    long = written(values.select("v", F.posexplode(bands("v", n)).alias("band", "code")), "bands")
    hot = long.groupBy("band", "code").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > HOT).select("band", "code")
    cool = _near(long.join(hot, ["band", "code"], "left_anti"), ["band", "code"], threshold)
    outside = F.lit(None).cast("array<long>")
    for i, (a, b) in reversed(list(enumerate(zip(edges, edges[1:], strict=False)))):
        low = F.col("v").bitwiseAND(F.lit((1 << a) - 1))
        rest = low if b == 64 else F.shiftleft(F.shiftrightunsigned("v", b), a).bitwiseOR(low)
        cuts = [(64 - (b - a)) * j // n for j in range(n + 1)]
        parts = F.array(*[F.shiftrightunsigned(rest, x).bitwiseAND(F.lit((1 << (y - x)) - 1)) for x, y in zip(cuts, cuts[1:], strict=False)])
        outside = F.when(F.col("band") == i, parts).otherwise(outside)
    split = long.join(hot, ["band", "code"], "left_semi").select("v", "band", "code", F.posexplode(outside).alias("part", "more"))
    return cool.unionByName(_near(split, ["band", "code", "part", "more"], threshold)).distinct()


def _near(long: DataFrame, on: list[str], threshold: int) -> DataFrame:
    other = long.select(*on, F.col("v").alias("v2"))
    return long.join(other, on).where(F.col("v") < F.col("v2")).select("v", "v2", hamming("v", "v2").alias("distance")).where(F.col("distance") <= threshold).distinct()


def _by_blocks(values: DataFrame, threshold: int, make, schema: str) -> DataFrame:
    """What make(threshold) finds in all pairs of blocks. Values are dealt into blocks by their hash, so that all are about as large."""
    blocks = max(1, -(-values.count() // BLOCK))
    rows = values.select("v", F.pmod(F.xxhash64("v"), F.lit(blocks)).alias("own"))
    rows = rows.select("v", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("other"))
    rows = rows.select("v", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    tasks = min(1024, blocks * (blocks + 1) // 2)
    return rows.repartition(tasks, "i", "j").groupBy("i", "j").applyInArrow(make(threshold), schema)


class Blocks:
    """Two blocks of values that meet, or one that meets itself: all their values, and the places and distances of those within a threshold, tile by tile."""

    def __init__(self, key: tuple, batches: Iterator[pa.RecordBatch]):
        i, j = (k.as_py() for k in key)
        whole = pa.Table.from_batches(batches)
        v, own = (whole.column(name).to_numpy() for name in ("v", "own"))
        self.values, self.n = np.concatenate([v[own == k] for k in dict.fromkeys((i, j))]), int((own == i).sum())
        self.one = i == j

    def hits(self, threshold: int):
        all_values = self.values.view(np.uint64)
        left, shift = all_values[: self.n], 0 if self.one else self.n
        right = all_values[shift:]
        apart, far = np.empty((TILE, len(right)), np.uint64), np.empty((TILE, len(right)), np.uint8)
        for a in range(0, len(left), TILE):
            # In a block itself the values before this tile have met it.
            b, n = a if self.one else 0, len(left[a : a + TILE])
            x, d = apart[:n, b:], far[:n, b:]
            np.bitwise_count(np.bitwise_xor(left[a : a + TILE, None], right[None, b:], out=x), out=d)
            p, q = np.nonzero(d <= threshold)
            if self.one:
                p, q = p[q > p], q[q > p]
            yield a + p, shift + b + q, d[p, q].astype(np.int32)


def _tiles(threshold: int):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two = Blocks(key, batches)
        for p, q, d in two.hits(threshold):
            one, other = two.values[p], two.values[q]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, other)), pa.array(np.maximum(one, other)), pa.array(d)], ["v", "v2", "distance"])

    return run


def _forest(threshold: int):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two = Blocks(key, batches)
        label, held, n = np.arange(len(two.values)), [], 0
        for p, q, _ in two.hits(threshold):
            held.append((p, q))
            n += len(p)
            if n >= len(label):
                label, held, n = united(label, *map(np.concatenate, zip(*held, strict=True))), [], 0
        if held:
            label = united(label, *map(np.concatenate, zip(*held, strict=True)))
        tied = np.flatnonzero(label != np.arange(len(label)))
        yield pa.RecordBatch.from_arrays([pa.array(two.values[tied]), pa.array(two.values[label[tied]])], ["v", "v2"])

    return run


def near_forest(values: DataFrame, threshold: int) -> DataFrame:
    """(v, v2) that tie values(v) together as all links within the distance do; where all pairs are compared, at most a row for each value and block, however many links."""
    return near_values(values, threshold).select("v", "v2") if _edges(threshold) is not None else _by_blocks(values, threshold, _forest, "v long, v2 long")


def near_classes(df: DataFrame, key: str, value: str, threshold: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """members(k, rep), reps(v, rep, n) and links(a, b, distance) between representatives: as many rows as there are rows and different values that are near."""
    members, reps = value_classes(df, key, value)
    return members, reps, between_reps(near_values(reps.select("v"), threshold), reps)


def between_reps(links: DataFrame, reps: DataFrame) -> DataFrame:
    """links(v, v2, ...) of values as links(a, b, ...) of their representatives."""
    links = links.join(reps.select("v", F.col("rep").alias("a")), "v").join(reps.select(F.col("v").alias("v2"), F.col("rep").alias("b")), "v2")
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *links.columns[2:-2])


def near_counts(df: DataFrame, key: str, value: str, threshold: int) -> DataFrame:
    """(k, class, copies, links) of every row with a value: the least key of equal values, how many have it, and how many rows have another value within the distance."""
    members, reps, links = near_classes(df, key, value, threshold)
    size = reps.select(F.col("rep").alias("b"), "n")
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(size, "b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    values = reps.select("rep", F.col("n").alias("copies")).join(near, "rep", "left").select("rep", "copies", F.coalesce("links", F.lit(0)).alias("links"))
    return onto_members(members, values).select("k", F.col("rep").alias("class"), "copies", "links")


def near_pairs(df: DataFrame, key: str, value: str, threshold: int, mode: str = "exact", bucket: int = 500) -> DataFrame:
    """(a, b, distance), a < b, of 64-bit values within a Hamming distance.

    mode 'reference': pairs that share one of four 16-bit bands in a bucket of at most `bucket` members (a cap that
    loses pairs, kept as an option because callers may expect it). mode 'exact': all pairs, multiplied out from `near_classes`; where copies
    abound use that.
    """
    if mode == "reference":
        rows = df.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(value).alias("v"))
        long = rows.select("k", "v", F.posexplode(bands("v", 4)).alias("band", "code"))
        n = F.count(F.lit(1)).over(Window.partitionBy("band", "code"))
        long = long.withColumn("n", n).where(F.col("n") <= bucket)
        other = long.select("band", "code", F.col("k").alias("k2"), F.col("v").alias("v2"))
        met = long.join(other, ["band", "code"]).where(F.col("k") < F.col("k2")).withColumn("distance", hamming("v", "v2")).where(F.col("distance") <= threshold)
        return met.select(F.col("k").alias("a"), F.col("k2").alias("b"), "distance").distinct()
    if mode != "exact":
        raise ValueError(mode)
    members, _, links = near_classes(df, key, value, threshold)
    one, two = members.select(F.col("k").alias("x"), F.col("rep").alias("a")), members.select(F.col("k").alias("y"), F.col("rep").alias("b"))
    apart = links.join(one, "a").join(two, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance")
    same = members.select("rep", F.col("k").alias("a")).join(members.select("rep", F.col("k").alias("b")), "rep").where("a < b").select("a", "b", F.lit(0).alias("distance"))
    return apart.unionByName(same)


def duplicate_groups(df: DataFrame, key: str, value: str, threshold: int = 6, mode: str = "exact", size: str | None = None) -> DataFrame:
    """(component, members, n): groups of two or more, the largest first; members by size, largest first.

    Links are found between distinct values and equal values join their first key, so a group of equal hashes costs its
    size and not its square.
    """
    rows = df.where(F.col(value).isNotNull())
    if mode == "exact":
        members, reps = value_classes(df, key, value)
        links = between_reps(near_forest(reps.select("v"), threshold), reps)
        parts = connected_components(reps.select(F.col("rep").alias("id")), links)
        labels = onto_members(members, parts.withColumnRenamed("id", "rep")).select(F.col("k").alias("id"), "component")
    else:
        labels = connected_components(rows.select(F.col(key).alias("id")), near_pairs(rows, key, value, threshold, mode).select("a", "b"))
    sizes = rows.select(F.col(key).alias("id"), (F.col(size) if size else F.lit(0)).alias("size"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("s"), F.col("id").alias("id"))))
    out = labels.join(sizes, "id").groupBy("component").agg(F.transform(order, lambda s: s["id"]).alias("members"), F.count(F.lit(1)).alias("n"))
    return out.where("n >= 2").orderBy(F.desc("n"), "component")


def deletable(members: DataFrame, by: str = "component", size: str = "size", key: str = "id") -> DataFrame:
    """All but the largest of each group."""
    w = Window.partitionBy(by).orderBy(F.desc(size), key)
    return members.withColumn("rank", F.row_number().over(w)).where("rank > 1").drop("rank")
