"""Exact joins of unit vectors by the triangle inequality of angles.

Equal vectors are one class with one representative; only representatives are compared. Pivots, chosen far apart from a
bounded sample, make regions; each vector goes to its nearest pivot's, and a range shuffle by region and angle deals them into
blocks of a fixed size, so one crowded region is many blocks. A block knows, for every pivot, between which angles its vectors
lie. If two vectors are within an angle t, their angles to any pivot differ by t at most, so a block meets only the regions,
and of those only the blocks, whose windows come that near to its own for every pivot; inside a pair of blocks the same holds
for tiles. Pairs of blocks are dealt to tasks, each gets two blocks, and what is left is a matrix product.

How much that saves is a matter of the data: vectors without any structure lie at about a right angle to each pivot, and then all pairs are
compared. `report` gets the numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.operators.components import with_least
from lumenframe.sources.shared import written

#: Bytes of a block's vectors; rows of a tile; rows from which pivots are chosen, and how many at most.
BLOCK_BYTES, TILE, SAMPLE, PIVOTS = 4 << 20, 256, 4096, 1024
#: Angles are rounded up to this when bounds are compared.
MARGIN = 1e-6


def vector_classes(df: DataFrame, key: str, vector: str, zeros_apart: bool = False) -> tuple[DataFrame, DataFrame]:
    """members(k, rep) of all rows with a vector and reps(k, v, n): the least key of each different vector and how many rows have it.

    Vectors are told apart by 128 bits of hashes. Copies collapse before they shuffle; of members only keys and hashes shuffle.
    zeros_apart: vectors without length, which aren't near each other, are classes of their own.
    """
    rows = df.select(F.col(key).alias("k"), F.col(vector).alias("v")).where("v IS NOT NULL AND k IS NOT NULL")
    own = F.forall("v", lambda x: x == 0) & F.lit(zeros_apart)
    rows = rows.select("k", "v", *(F.when(own, F.xxhash64(F.lit(-i), "k")).otherwise(F.xxhash64(F.lit(i), "v")).alias(f"h{i}") for i in (1, 2)))
    reps = rows.groupBy("h1", "h2").agg(F.min(F.struct("k", "v")).alias("r"), F.count(F.lit(1)).alias("n")).select("r.k", "r.v", "n")
    members = with_least(rows.select("k", "h1", "h2"), ["h1", "h2"], "k", "rep").select("k", "rep")
    return written(members, "members"), written(reps, "reps")


def finite(vector: str) -> Column:
    return F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def vectors_of(column: pa.Array) -> np.ndarray:
    """A list column as doubles, null elements as NaN."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def units(x: np.ndarray) -> np.ndarray:
    """Unit vectors; those without length stay zero."""
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm == 0, 1, norm)


def angles(u: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(u @ pivots.T, -1, 1))


def far_apart(sample: np.ndarray, n: int) -> np.ndarray:
    """Pivots out of a sample of unit vectors: each the farthest from those before."""
    chosen = [0]
    near = angles(sample, sample[:1])[:, 0]
    while len(chosen) < min(n, len(sample)) and near.max() > MARGIN:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, angles(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def choose_pivots(reps: DataFrame, n: int) -> np.ndarray:
    """About one pivot for eight times the square root of the rows, from the SAMPLE rows (or four for each pivot) of least hash."""
    wanted = min(PIVOTS, max(8, math.isqrt(n) // 8))
    rows = reps.select("v").orderBy(F.xxhash64("k")).limit(max(SAMPLE, 4 * wanted)).collect()  # a fixed number
    sample = units(np.array([r["v"] for r in rows], np.float64))
    sample = sample[(sample != 0).any(1)]
    return far_apart(sample, wanted) if len(sample) else np.zeros((0, 1))


def _regions(pivots):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            a = angles(units(vectors_of(batch.column("v"))), pivots.value)
            region = a.argmin(1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("k", "v", "n")), pa.array(region, pa.int32()), pa.array(a[np.arange(len(a)), region])], ["k", "v", "n", "region", "angle"])

    return run


def _blocks(pivots, size: int, kind: np.dtype):
    def block(number: int, ids: pa.Array, weights: pa.Array, region: int, v: np.ndarray) -> pa.RecordBatch:
        u = units(v)
        a = angles(u, pivots.value)
        a_low, a_high = np.where((u == 0).all(1)[:, None], 0, a), np.where((u == 0).all(1)[:, None], np.pi, a)  # zero vectors are near nothing and never ruled out
        arrays = [pa.array([number], pa.int64()), pa.array([region], pa.int32()), *(pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), x) for x in (ids, weights))]
        arrays += [pa.array([v.astype(kind).tobytes()], pa.binary())] + [pa.array([x.tolist()], pa.list_(pa.float64())) for x in (a_low.min(0), a_high.max(0))]
        return pa.RecordBatch.from_arrays(arrays, ["block", "region", "ids", "weights", "data", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]):
        number, held = TaskContext.get().partitionId() << 32, []

        def flush():
            nonlocal number
            table = pa.Table.from_batches(held).combine_chunks()
            number += 1
            return block(number, table.column("k").chunk(0), table.column("n").chunk(0), table.column("region")[0].as_py(), vectors_of(table.column("v").chunk(0)))

        n, last = 0, None
        for batch in batches:
            region = batch.column("region").to_numpy()
            for part in np.split(np.arange(len(region)), np.flatnonzero(np.diff(region)) + 1) if len(region) else ():
                at, stop = int(part[0]), int(part[-1]) + 1
                while at < stop:
                    if held and (n == size or region[at] != last and n >= size // 4):  # small regions share a block
                        yield flush()
                        held, n = [], 0
                    take = min(stop - at, size - n)
                    held.append(batch.slice(at, take))
                    n, at, last = n + take, at + take, region[at]
        if held:
            yield flush()

    return run


def _near(low_a: np.ndarray, high_a: np.ndarray, low_b: np.ndarray, high_b: np.ndarray, most: float) -> np.ndarray:
    """Whether windows, one row each, come within an angle of each other for every pivot."""
    return ((low_a - high_b <= most) & (low_b - high_a <= most)).all(-1)


def _targets(low: np.ndarray, high: np.ndarray, most: float):
    """Blocks' windows to the regions in which a partner may lie; low and high: windows of the regions."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            a, b = (np.stack([np.array(x, np.float64) for x in batch.column(name).to_pylist()]) if batch.num_rows else np.zeros((0, low.shape[1])) for name in ("low", "high"))
            rows, regions = np.nonzero(_near(a[:, None], b[:, None], low[None], high[None], most))
            part = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([part.column("block"), pa.array(regions, pa.int32()), part.column("low"), part.column("high")], ["i", "target", "low_i", "high_i"])

    return run


class Comparison:
    """Two blocks, or one with itself, compared tile by tile where windows allow it."""

    def __init__(self, table: pa.Table, pivots: np.ndarray, most: float, kind: np.dtype):
        self.rows = sorted(table.select(["block", "ids", "weights", "data"]).to_pylist(), key=lambda r: r["block"])
        self.left, self.right, self.most, self.compared = self.rows[0], self.rows[-1], most, 0
        self.angle = angle_of(most)
        self.vectors = [units(np.frombuffer(r["data"], kind).astype(np.float64).reshape(len(r["ids"]), -1)) for r in (self.left, self.right)]
        self.pivots = pivots

    def _tiles(self, u: np.ndarray):
        a, zero = angles(u, self.pivots), (u == 0).all(1)[:, None]
        starts = np.arange(0, len(u), TILE)
        return starts, np.minimum.reduceat(np.where(zero, 0, a), starts), np.maximum.reduceat(np.where(zero, np.pi, a), starts)

    def hits(self):
        """(rows of the left block, rows of the right one, distances) of the pairs within the distance, each once."""
        (ua, ub), same = self.vectors, len(self.rows) == 1
        (sa, la, ha), (sb, lb, hb) = self._tiles(ua), self._tiles(ub)
        for t, at in enumerate(sa.tolist()):
            near = _near(la[t], ha[t], lb, hb, self.angle)
            if same:
                near[:t] = False
            for s in np.flatnonzero(near).tolist():
                x, y = ua[at : at + TILE], ub[sb[s] : sb[s] + TILE]
                self.compared += len(x) * len(y)
                distance = 1 - x @ y.T
                i, j = np.nonzero(distance <= self.most + 1e-12)
                if same:
                    ahead = i + at < j + sb[s]
                    i, j = i[ahead], j[ahead]
                yield i + at, j + sb[s], distance[i, j]


def _pairs(pivots, most: float, kind: np.dtype, key_type: pa.DataType):
    def run(table: pa.Table) -> pa.Table:
        two = Comparison(table, pivots.value, most, kind)
        found = list(two.hits())
        i, j, d = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 3
        p, q = ([r["ids"][x] for x in places.tolist()] for r, places in ((two.left, i), (two.right, j)))
        low, high = [min(x) for x in zip(p, q, strict=True)], [max(x) for x in zip(p, q, strict=True)]
        cols = [pa.array([*low, None], key_type), pa.array([*high, None], key_type), pa.array([*d.tolist(), None], pa.float64()), pa.array([None] * len(low) + [two.compared], pa.int64())]
        return pa.Table.from_arrays(cols, ["a", "b", "distance", "compared"])

    return run


def _degrees(pivots, most: float, kind: np.dtype, key_type: pa.DataType):
    """For each row how many rows of the other block, copies counted, lie within the distance: at most a number for each row, however many pairs."""

    def run(table: pa.Table) -> pa.Table:
        two = Comparison(table, pivots.value, most, kind)
        a, b = np.zeros(len(two.left["ids"]), np.int64), np.zeros(len(two.right["ids"]), np.int64)
        wa, wb = np.array(two.left["weights"], np.int64), np.array(two.right["weights"], np.int64)
        for i, j, _ in two.hits():
            np.add.at(a, i, wb[j])
            np.add.at(b, j, wa[i])
        keys, counts = [], []
        for r, n in ((two.left, a), (two.right, b)):
            some = np.flatnonzero(n)
            keys += [r["ids"][x] for x in some.tolist()]
            counts += n[some].tolist()
        cols = [pa.array([*keys, None], key_type), pa.array([*counts, None], pa.int64()), pa.array([None] * len(keys) + [two.compared], pa.int64())]
        return pa.Table.from_arrays(cols, ["rep", "others", "compared"])

    return run


def united(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """label (the least row of each row's component) with the components of i and j made one."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        root = np.arange(len(label))
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        label = root[label]


def _forest(pivots, most: float, kind: np.dtype, key_type: pa.DataType):
    """Links of two blocks as a forest: every core row (weight over 0) with the least core row that links join it to, and every other row with one
    core row of each component that it touches. At most a row for each row and component, however many pairs."""

    def run(table: pa.Table) -> pa.Table:
        two = Comparison(table, pivots.value, most, kind)
        shift = 0 if len(two.rows) == 1 else len(two.left["ids"])
        ids = two.left["ids"] + (two.right["ids"] if shift else [])
        core = np.array(two.left["weights"] + (two.right["weights"] if shift else []), np.int64) > 0
        label, touches = np.arange(len(ids)), np.zeros(0, np.int64)
        for i, j, _ in two.hits():
            j = j + shift
            both, one = core[i] & core[j], core[i] != core[j]
            label = united(label, i[both], j[both])
            inner, outer = np.where(core[i[one]], i[one], j[one]), np.where(core[i[one]], j[one], i[one])
            touches = np.unique(np.r_[touches, outer * len(ids) + label[inner]])
        touches = np.unique(touches // len(ids) * len(ids) + label[touches % len(ids)]) if len(touches) else touches
        tied = np.flatnonzero(core & (label != np.arange(len(ids))))
        a, b = np.r_[tied, touches // len(ids)], np.r_[label[tied], touches % len(ids)]
        cols = [pa.array([*(ids[x] for x in p.tolist()), None], key_type) for p in (a, b)]
        cols += [pa.array([*core[a].tolist(), None], pa.bool_()), pa.array([None] * len(a) + [two.compared], pa.int64())]
        return pa.Table.from_arrays(cols, ["a", "b", "core", "compared"])

    return run


def angle_of(most: float) -> float:
    return math.acos(max(-1.0, min(1.0, 1 - most))) + MARGIN


def _meet(reps: DataFrame, most: float, make, schema: str, report: dict | None) -> DataFrame | None:
    """What make(pivots, most, kind, key type) finds in all pairs of blocks that may hold a pair within the distance; None without vectors."""
    spark, types = reps.sparkSession, dict(reps.dtypes)
    dim = reps.agg(F.max(F.size("v"))).first()[0] or 0
    reps = reps.where((F.size("v") == dim) & finite("v") & (F.lit(most >= 1) | F.exists("v", lambda x: x != 0)))  # the others are near nothing
    n = reps.count()
    pivots = choose_pivots(reps, n) if n else np.zeros((0, 1))
    if not len(pivots):
        return None
    shared = spark.sparkContext.broadcast(pivots)  # PIVOTS vectors at most
    kind = np.dtype(np.float32 if types["v"] == "array<float>" else np.float64)
    size = max(TILE, min(1 << 14, BLOCK_BYTES // (8 * dim)))
    rows = reps.select("k", "v", "n").mapInArrow(_regions(shared), f"k {types['k']}, v {types['v']}, n long, region int, angle double")
    parts = -(-n // size)
    dealt = rows.repartitionByRange(parts, "region", "angle", "k").sortWithinPartitions("region", "angle", "k").coalesce(parts)
    blocks = written(dealt.mapInArrow(_blocks(shared, size, kind), f"block long, region int, ids array<{types['k']}>, weights array<long>, data binary, low array<double>, high array<double>"), "blocks")
    # Which blocks meet: by region first, then window by window.
    angle = angle_of(most)
    window = blocks.select("region", F.posexplode(F.arrays_zip("low", "high")).alias("p", "w")).groupBy("region", "p").agg(F.min("w.low").alias("low"), F.max("w.high").alias("high"))
    low, high = np.full((len(pivots), len(pivots)), np.inf), np.full((len(pivots), len(pivots)), -np.inf)
    for r in window.collect():  # pivots times pivots
        low[r["region"], r["p"]], high[r["region"], r["p"]] = r["low"], r["high"]
    slim = blocks.select("block", "region", "low", "high")
    asked = slim.mapInArrow(_targets(low, high, angle), "i long, target int, low_i array<double>, high_i array<double>")
    apart = F.exists(F.arrays_zip("low_i", "high_i", "low", "high"), lambda w: (w["low_i"] - w["high"] > angle) | (w["low"] - w["high_i"] > angle))
    pairs = asked.join(slim.withColumnRenamed("block", "j").withColumnRenamed("region", "target"), "target").where((F.col("i") <= F.col("j")) & ~apart).select("i", "j")
    pairs = written(pairs, "pairs")
    sides = pairs.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    meeting = sides.join(blocks.select("block", "ids", "weights", "data"), "block")
    key_type = spark.createDataFrame([], f"k {types['k']}").toArrow().schema.field(0).type
    found = written(meeting.groupBy("i", "j").applyInArrow(make(shared, most, kind, key_type), f"{schema}, compared long"), "links")
    if report is not None:
        count = found.where("compared IS NULL").count()
        report |= {"rows": n, "all_pairs": n * (n - 1) // 2, "pivots": len(pivots), "blocks": blocks.count(), "block_pairs": pairs.count(), "compared": found.agg(F.sum("compared")).first()[0] or 0, "found": count}
    return found.where("compared IS NULL").drop("compared")


def class_links(reps: DataFrame, most: float, report: dict | None = None) -> DataFrame:
    """(a, b, distance), a < b, of reps(k, v, n) within a cosine distance. report: rows, pairs there are, blocks, pairs of blocks, pairs compared, pairs found."""
    schema = f"a {dict(reps.dtypes)['k']}, b {dict(reps.dtypes)['k']}, distance double"
    found = _meet(reps, most, _pairs, schema, report)
    return found if found is not None else reps.sparkSession.createDataFrame([], schema)


def class_degrees(reps: DataFrame, most: float, report: dict | None = None) -> DataFrame:
    """(rep, others) of reps(k, v, n): how many rows with another vector lie within the cosine distance. Pairs are counted where they are found."""
    schema = f"rep {dict(reps.dtypes)['k']}, others long"
    found = _meet(reps, most, _degrees, schema, report)
    return found.groupBy("rep").agg(F.sum("others").alias("others")) if found is not None else reps.sparkSession.createDataFrame([], schema)


def class_forest(reps: DataFrame, most: float, report: dict | None = None) -> DataFrame:
    """(a, b, core) of reps(k, v, n), n over 0 for core rows: edges that join core rows as all links within the distance do (core), and for
    the others at least one core row b of every component that they touch. Pairs of blocks pass on forests, not links."""
    schema = f"a {dict(reps.dtypes)['k']}, b {dict(reps.dtypes)['k']}, core boolean"
    found = _meet(reps, most, _forest, schema, report)
    return found if found is not None else reps.sparkSession.createDataFrame([], schema)


def neighbours(df: DataFrame, key: str, vector: str, most: float, report: dict | None = None) -> DataFrame:
    """(a, b, distance), a < b, of all rows within a cosine distance; zero vectors are at distance 1 from everything, rows without a
    vector or with elements that aren't finite near nothing. Classes are multiplied out into their pairs: where copies abound, use `class_links`."""
    members, reps = vector_classes(df, key, vector)
    links = class_links(reps, most, report)
    one, two = members.select(F.col("k").alias("x"), F.col("rep").alias("a")), members.select(F.col("k").alias("y"), F.col("rep").alias("b"))
    apart = links.join(one, "a").join(two, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance")
    zero = F.forall("v", lambda x: x == 0)
    copied = reps.where(finite("v") & (F.col("n") > 1)).select(F.col("k").alias("rep"), F.when(zero, 1.0).otherwise(0.0).alias("distance")).where(F.col("distance") <= most + 1e-12)
    inside = members.join(copied, "rep").select("rep", F.col("k").alias("a"), "distance").join(members.select("rep", F.col("k").alias("b")), "rep").where("a < b")
    return apart.unionByName(inside.select("a", "b", "distance"))


def onto_members(members: DataFrame, values: DataFrame) -> DataFrame:
    """members(k, rep) with the values(rep, ...) of their class; a class of any size is dealt over salts. Classes without values go."""
    salted = values.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))))
    return members.withColumn("__salt", F.pmod(F.xxhash64("k"), 16)).join(salted, ["rep", "__salt"]).drop("__salt")


def neighbour_counts(df: DataFrame, key: str, vector: str, most: float, report: dict | None = None) -> DataFrame:
    """(k, class, links) of every row with a vector: the least key among equal vectors and how many other rows lie within the cosine
    distance, its copies included. Copies are counted, not paired."""
    members, reps = vector_classes(df, key, vector)
    other = class_degrees(reps, most, report)
    copies = F.when(finite("v") & (F.exists("v", lambda x: x != 0) | F.lit(most >= 1)), F.col("n") - 1).otherwise(0)
    values = reps.select(F.col("k").alias("rep"), copies.alias("copies")).join(other, "rep", "left").select("rep", (F.col("copies") + F.coalesce("others", F.lit(0))).alias("links"))
    return onto_members(members, values).select("k", F.col("rep").alias("class"), "links")
