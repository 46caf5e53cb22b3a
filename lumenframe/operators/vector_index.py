"""A stored nearest-neighbour index: vectors by cell, each cell with its centre and radii, searched until no cell can improve.

Centres come from k-means on a sample of a fixed size; every row is indexed. A cell's rows are dealt by their distance to the centre into
blocks of a fixed size, and a folder for each cell lets Spark skip the cells that nobody visits. By the triangle inequality no row of a
block with radii [r, R] is nearer to a query at distance D from the centre than max(0, r - D, D - R). A search visits cells in order of
that bound, in rounds of growing width, and a query stops at the first cell whose bound exceeds its k-th distance so far. So the answer
is exact; `probes` stops earlier and gives a part of it. Queries travel in packs, cells in blocks, and only k rows for each query and pair of
those come back, so a crowded cell is shared by many tasks.

Distances are Euclidean. A row without vector, with another length than the rest or with an element that isn't finite isn't indexed, and such a
query gets no rows. Equal distances go by the smaller key.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.operators.metric import finite, vectors_of
from lumenframe.sources.shared import forget, new_path, written

#: Rows from which centres are learned, rounds of learning, cells at most, rows of a block, queries of a pack, bytes of packs that are broadcast.
SAMPLE, ROUNDS, CELLS, BLOCK, PACK, BROADCAST = 16_384, 10, 4096, 2048, 512, 16 << 20
#: What rounding may cost a distance, as a share of the lengths of its vectors.
SLACK = 1e-6


def whole(vector: str, dim: int) -> Column:
    v = F.col(vector)
    return v.isNotNull() & (F.size(v) == dim) & finite(vector)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)))


def learn_centres(x: np.ndarray, n: int, rounds: int = ROUNDS) -> np.ndarray:
    """k-means from centres at even steps through the sample; centres that lose all rows go."""
    centres = x[np.linspace(0, len(x) - 1, n).astype(int)]
    for _ in range(rounds):
        own = distances(x, centres).argmin(1)
        kept = np.unique(own)
        centres = np.stack([x[own == c].mean(0) for c in kept])
    return centres


def build(df: DataFrame, key: str, vector: str, path: str | None = None, cells: int | None = None) -> VectorIndex:
    """Index all rows of df under a folder (one in the shared folder by default)."""
    spark = df.sparkSession
    path = path or new_path(spark, "vector-index")
    rows = df.select(F.col(key).alias("k"), F.col(vector).alias("v")).where("k IS NOT NULL AND v IS NOT NULL")
    dim = rows.agg(F.max(F.size("v"))).first()[0] or 0
    rows = rows.where(whole("v", dim))
    n = rows.count()
    key_type = dict(rows.dtypes)["k"]
    sample = np.array([r["v"] for r in rows.select("v").orderBy(F.xxhash64("k")).limit(SAMPLE).collect()], np.float64)  # a fixed number
    centres = learn_centres(sample, min(cells or max(1, math.isqrt(n)), CELLS, len(sample))) if n else np.zeros((0, dim))
    shared = spark.sparkContext.broadcast(centres)  # CELLS vectors at most

    def assign(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            d = distances(vectors_of(batch.column("v")), shared.value)
            cell = d.argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("v"), pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell])], ["k", "v", "cell", "radius"])

    def pack(batches: Iterator[pa.RecordBatch]):
        held, number = [], TaskContext.get().partitionId() << 32
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            for part in np.split(np.arange(len(cell)), np.flatnonzero(np.diff(cell)) + 1) if len(cell) else ():
                at, stop = int(part[0]), int(part[-1]) + 1
                while at < stop:
                    if held and (held[0].column("cell")[0].as_py() != cell[at] or sum(b.num_rows for b in held) == BLOCK):
                        number += 1
                        yield one(held, number)
                        held = []
                    take = min(stop - at, BLOCK - sum(b.num_rows for b in held))
                    held.append(batch.slice(at, take))
                    at += take
        if held:
            yield one(held, number + 1)

    def one(held: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        ids, radius = t.column("k").chunk(0), t.column("radius").to_numpy()
        data = vectors_of(t.column("v").chunk(0)).tobytes()
        cols = [pa.array([number], pa.int64()), pa.array([len(ids)], pa.int32()), pa.array([radius.min()]), pa.array([radius.max()]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([data], pa.binary()), t.column("cell").slice(0, 1).combine_chunks()]
        return pa.RecordBatch.from_arrays(cols, ["block", "n", "near", "far", "ids", "data", "cell"])

    placed = rows.mapInArrow(assign, f"k {key_type}, v {dict(rows.dtypes)['v']}, cell int, radius double") if n else rows.withColumns({"cell": F.lit(0), "radius": F.lit(0.0)})
    dealt = placed.repartitionByRange(max(1, -(-n // (4 * BLOCK))), "cell", "radius", "k").sortWithinPartitions("cell", "radius", "k")
    dealt.mapInArrow(pack, f"block long, n int, near double, far double, ids array<{key_type}>, data binary, cell int").write.partitionBy("cell").parquet(f"{path}/blocks")
    spark.createDataFrame([(c, x) for c, x in enumerate(centres.tolist())], "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
    spark.createDataFrame([(json.dumps({"rows": n, "dim": dim, "key": key_type}),)], "info string").coalesce(1).write.parquet(f"{path}/info")
    return VectorIndex(spark, path)


class VectorIndex:
    """An index that `build` has stored."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        info = json.loads(spark.read.parquet(f"{path}/info").first()["info"])
        self.rows, self.dim, self.key_type = info["rows"], info["dim"], info["key"]
        self.blocks = spark.read.schema(f"block long, n int, near double, far double, ids array<{self.key_type}>, data binary, cell int").parquet(f"{path}/blocks")
        self.centres = np.array([r["centre"] for r in spark.read.parquet(f"{path}/centres").orderBy("cell").collect()], np.float64)  # CELLS at most

    def cells(self) -> DataFrame:
        """(cell, n, near, far): rows and radii of the cells that have rows."""
        return self.blocks.groupBy("cell").agg(F.sum("n").alias("n"), F.min("near").alias("near"), F.max("far").alias("far"))

    def search(self, queries: DataFrame, key: str, vector: str, k: int, probes: int | None = None, skip_own_key: bool = False, report: dict | None = None) -> DataFrame:
        """(query, id, distance, rank) of the k nearest rows of every query. skip_own_key: a query isn't its own answer.
        report: queries, cells there are and visited on average, rows compared as a share of all."""
        asked = queries.select(F.col(key).alias("q"), F.col(vector).alias("v")).where(F.col("q").isNotNull() & whole("v", self.dim))
        q_type = dict(asked.dtypes)["q"]
        schema = f"query {q_type}, id {self.key_type}, distance double"
        if not self.rows:
            return self.spark.createDataFrame([], f"{schema}, rank int")
        asked = written(asked, "queries")
        cells = self.cells().orderBy("cell").collect()  # CELLS at most
        known = np.array([r["cell"] for r in cells]), np.array([r["near"] for r in cells]), np.array([r["far"] for r in cells])
        shared = self.spark.sparkContext.broadcast((self.centres[known[0]], *known))
        best, visited, compared = None, 0, 0
        start, width, last = 0, 1, min(probes or len(cells), len(cells))
        while start < last:
            stop = min(last, start + width)
            limit = None if best is None else best.groupBy("query").agg(F.when(F.count("id") >= k, F.max("distance")).alias("limit"))
            state = asked.withColumn("limit", F.lit(None).cast("double")) if limit is None else asked.join(limit, asked["q"] == limit["query"], "left").select("q", "v", "limit")
            packs = written(state.mapInArrow(_visits(shared, start, stop), f"cell int, queries array<{q_type}>, limits array<double>, reach array<double>, vectors binary"), "packs")
            size = packs.agg(F.sum(F.size("queries")), F.sum(F.length("vectors"))).first()
            if not size[0]:
                break
            visited += size[0]
            side = F.broadcast(packs) if size[1] <= BROADCAST else packs
            found = self.blocks.join(side, "cell").mapInArrow(_nearest(k, self.dim, skip_own_key), f"{schema}, compared long")
            found = written(found, "found")
            compared += found.agg(F.sum("compared")).first()[0] or 0
            found = found.where("id IS NOT NULL").select("query", "id", "distance")
            merged = found if best is None else found.unionByName(best.select("query", "id", "distance"))
            rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))
            before, best = best, written(merged.withColumn("rank", rank).where(F.col("rank") <= k), "nearest")
            forget(packs, *([before] if before is not None else []))
            start, width = stop, width * 3
        if report is not None:
            n = asked.count()
            report |= {"queries": n, "cells": len(cells), "cells_visited": visited / max(1, n), "share_of_cells": visited / max(1, n * len(cells)), "share_of_rows": compared / max(1, n * self.rows)}
        return best if best is not None else self.spark.createDataFrame([], f"{schema}, rank int")


def _visits(shared, start: int, stop: int):
    """Queries to packs for the cells that are next in their order and may still hold a nearer row."""

    def run(batches: Iterator[pa.RecordBatch]):
        centres, names, near, far = shared.value
        held: dict[int, list] = {}

        def pack(cell: int) -> pa.RecordBatch:
            rows = held.pop(cell)
            keys = pa.concat_arrays([r[0] for r in rows])
            lists = [pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), x) for x in (keys, pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.float64()))]
            return pa.RecordBatch.from_arrays([pa.array([int(names[cell])], pa.int32()), *lists, pa.array([b"".join(r[3] for r in rows)], pa.binary())], ["cell", "queries", "limits", "reach", "vectors"])

        for batch in batches:
            v = vectors_of(batch.column("v"))
            if not len(v):
                continue
            limit = np.array([math.inf if x is None else x for x in batch.column("limit").to_pylist()])
            for at in range(0, len(v), 1024):
                d = distances(v[at : at + 1024], centres)
                bound = np.maximum(0, np.maximum(near - d, d - far))
                order = np.lexsort((d, bound), axis=1)[:, start:stop]
                slack = SLACK * (1 + np.linalg.norm(v[at : at + 1024], axis=1) + d.max(1))
                for i, cells in enumerate(order):
                    for c in cells[bound[i, cells] <= limit[at + i] + slack[i]].tolist():
                        rows = held.setdefault(c, [])
                        rows.append((batch.column("q").slice(at + i, 1), limit[at + i], d[i, c], v[at + i].tobytes()))
                        if len(rows) == PACK:
                            yield pack(c)
        for c in list(held):
            yield pack(c)

    return run


def _nearest(k: int, dim: int, skip_own_key: bool):
    """The k nearest rows of a block for every query of a pack that the block's radii don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            names = batch.schema.names
            for r in range(batch.num_rows):
                row = {n: batch.column(n)[r] for n in names}
                keys, ids = row["queries"].values, row["ids"].values
                q = np.frombuffer(row["vectors"].as_py(), np.float64).reshape(-1, dim)
                x = np.frombuffer(row["data"].as_py(), np.float64).reshape(-1, dim)
                limit, reach = row["limits"].values.to_numpy(zero_copy_only=False), row["reach"].values.to_numpy(zero_copy_only=False)
                slack = SLACK * (1 + np.linalg.norm(q, axis=1) + reach + row["far"].as_py())
                ask = np.flatnonzero(np.maximum(row["near"].as_py() - reach, reach - row["far"].as_py()) <= limit + slack)
                at, to, distance = [], [], []
                if len(ask):
                    rough = distances(q[ask], x)
                    most = min(len(x), k + int(skip_own_key))
                    kth = np.minimum(np.partition(rough, most - 1, axis=1)[:, most - 1], limit[ask])
                    # Rounding of the product may tell equal distances apart, so what comes near the k-th is measured again, element by element.
                    i, j = np.nonzero(rough <= (kth + slack[ask])[:, None])
                    d = np.sqrt(((q[ask[i]] - x[j]) ** 2).sum(1))
                    own = np.ones(len(i), bool)
                    if skip_own_key:
                        own = np.array(ids.take(pa.array(j)).to_pylist(), object) != np.array(keys.take(pa.array(ask[i])).to_pylist(), object)
                    i, j, d = i[own], j[own], d[own]
                    names_of = np.array(ids.to_pylist(), object)
                    rank = np.argsort(np.argsort(names_of, kind="stable"), kind="stable")
                    order = np.lexsort((rank[j], d, i))
                    i, j, d = i[order], j[order], d[order]
                    first = np.arange(len(i)) - np.searchsorted(i, i) < k
                    at, to, distance = ask[i[first]], j[first], d[first]
                cols = [pa.concat_arrays([keys.take(pa.array(at, pa.int64())), pa.nulls(1, keys.type)]), pa.concat_arrays([ids.take(pa.array(to, pa.int64())), pa.nulls(1, ids.type)])]
                cols += [pa.array([*distance, None], pa.float64()), pa.array([None] * len(at) + [len(ask) * len(x)], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["query", "id", "distance", "compared"])

    return run
