"""Hard negatives by distributed radix selection.

A window is an anchor with a range of integer scores: first the whole range among rows of its label (its positives), then, for
each positive, the range of scores that make a negative hard among the rows of other labels. The first k rows of every window
are found without gathering the window. Each task counts its rows' scores by the leading digit of their place in the window and
passes on only the highest buckets that hold k of its rows (more can't matter); added up, they name the bucket of the k-th row.
The next pass counts the next digit inside that bucket, until the k-th score itself is known. One last pass gathers the rows
above it and, of those that tie with it, each task's smallest ids as far as places are left. So a window costs k buckets or
rows a task and pass, whatever its size and however many copies tie.

Anchors meet all rows in blocks of a fixed number, whose vectors are broadcast; scores are matrix products, exact in doubles (or
in longs where sums need more than 53 bits). Rows are packed once into a table in the shared folder and each block's result is
appended to another, so a lost executor rereads files. The work is anchors times rows, as the contract asks; a table of blocks of
anchors is worked off one after another.

Nulls: a row without key, label or vector, or with a null or non-finite component, takes no part. Vectors shorter than the longest
count as continued with zeros. Equal scores go by the smaller key. Rows that repeat are rows: a repeated anchor is served
as often, a repeated candidate takes as many places, but rows with an anchor's own key are not its positives. An anchor without positives, a
window without rows and an empty table give no rows. Labels are whole numbers. Other columns, whatever their names, are ignored.
Components so large that a score can't be a long are an error.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import Table, shared_dir
from lumenframe.llm.vector_codes import kept_rows, matrix

#: Anchors in a block, rows in a packed one, bits of a digit, candidates that a task holds before it cuts them to the first k.
ANCHORS, ROWS, DIGIT, HELD = 2048, 2048, 9, 1 << 20
PACKED = "ids array<long>, labels array<long>, data binary, top double, square double"
PAIRS = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _packer(width: int, scale: int):
    def block(ids, labels, v) -> pa.RecordBatch:
        x = matrix(v, width, scale)
        top = float(np.abs(x).max(initial=0))
        square = (x.astype(np.float64) ** 2).sum(1).max(initial=0)
        lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in (ids, labels)]
        return pa.RecordBatch.from_arrays([*lists, pa.array([x.tobytes()], pa.binary()), pa.array([top]), pa.array([float(square)])], ["ids", "labels", "data", "top", "square"])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                yield block(part.column(0), part.column(1), part.column(2))

    return run


def _blocks(batches, width: int):
    """(ids, labels, vectors) of packed rows."""
    for batch in batches:
        for i in range(batch.num_rows):
            ids, labels = (batch.column(k)[i].values.to_numpy() for k in (0, 1))
            yield ids, labels, np.frombuffer(batch.column(2)[i].as_py(), np.int64).reshape(len(ids), width)


class Windows:
    """The windows of a block of anchors, sorted by anchor: their score ranges and how many of their first rows are wanted."""

    def __init__(self, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, want: int, same: bool, digit: int | None = None):
        self.anchor, self.low, self.high, self.want, self.same, self.digit = anchor, low, high, want, same, digit or DIGIT
        # What is still looked for: `need` rows in [base, base + 2^bits).
        self.base, self.need = low.copy(), np.full(len(low), want, np.int64)
        self.bits = np.array([max(1, int(h - lo).bit_length()) for lo, h in zip(low.tolist(), high.tolist(), strict=True)], np.int64)

    @property
    def shift(self) -> np.ndarray:
        return np.maximum(0, self.bits - self.digit)

    def refine(self, found: dict[int, list[tuple[int, int]]]) -> None:
        """found: a window's highest buckets with their counts. A window with too few rows in all keeps every one."""
        shift = self.shift
        for w in np.nonzero(self.bits > 0)[0].tolist():
            left = int(self.need[w])
            for bucket, n in sorted(found.get(w, ()), reverse=True):
                if n >= left:
                    self.base[w] += bucket << int(shift[w])
                    self.bits[w] = shift[w]
                    break
                left -= n
            else:  # it ends below the range: all that is in it
                self.bits[w] = 0
                self.base[w], left = self.low[w], self.want
            self.need[w] = left


class Scorer:
    """What a task needs: the anchors' keys, labels and vectors, and their windows."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, windows: Windows, exact_doubles: bool):
        self.ids, self.labels, self.x, self.windows, self.exact = ids, labels, x.astype(np.float64) if exact_doubles else x, windows, exact_doubles
        n = len(ids)
        self.first, self.last = np.searchsorted(windows.anchor, np.arange(n)), np.searchsorted(windows.anchor, np.arange(n), side="right")
        self.most = int((self.last - self.first).max(initial=0))

    def hits(self, ids, labels, x, low: np.ndarray, high: np.ndarray):
        """(window, row, score) of the rows whose score lies in [low, high] of a window."""
        s = (self.x @ x.T.astype(np.float64)).astype(np.int64) if self.exact else self.x @ x.T
        least, top = np.full(len(self.ids), np.iinfo(np.int64).max), np.full(len(self.ids), np.iinfo(np.int64).min)
        np.minimum.at(least, self.windows.anchor, low)
        np.maximum.at(top, self.windows.anchor, high)
        of = self.labels[:, None] == labels
        of = of & (self.ids[:, None] != ids) if self.windows.same else ~of
        a, r = np.nonzero(of & (s >= least[:, None]) & (s <= top[:, None]))
        s = s[a, r]
        for k in range(self.most):
            w = self.first[a] + k
            ok = w < self.last[a]
            w, row, score = w[ok], r[ok], s[ok]
            ok = (score >= low[w]) & (score <= high[w])
            yield w[ok], row[ok], score[ok]


def _count(shared, width: int):
    def run(batches):
        scorer: Scorer = shared.value
        own = scorer.windows
        shift, size = own.shift, 1 << own.digit
        counts = np.zeros(len(own.low) * size, np.int64)
        active = own.bits > 0
        low = np.where(active, own.base, np.iinfo(np.int64).max)
        high = np.where(active, np.minimum(own.high, own.base + (np.int64(1) << own.bits) - 1), np.iinfo(np.int64).min)
        for ids, labels, x in _blocks(batches, width):
            for w, _, score in scorer.hits(ids, labels, x, low, high):
                np.add.at(counts, w * size + ((score - own.base[w]) >> shift[w]), 1)
        down = counts.reshape(-1, size)[:, ::-1]
        w, place = np.nonzero((down > 0) & (np.cumsum(down, 1) - down < own.need[:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(w, pa.int32()), pa.array(size - 1 - place, pa.int32()), pa.array(down[w, place], pa.int64())], ["w", "bucket", "n"])

    return run


def _gather(shared, width: int, most: int):
    def cut(w, ids, score, want):
        order = np.lexsort((ids, -score, w))
        w, ids, score = w[order], ids[order], score[order]
        first = np.arange(len(w)) - np.searchsorted(w, w) < want
        return w[first], ids[first], score[first]

    def run(batches):
        scorer: Scorer = shared.value
        own = scorer.windows
        held, n = [], 0
        empty = (np.zeros(0, np.int64),) * 3
        for ids, labels, x in _blocks(batches, width):
            for w, row, score in scorer.hits(ids, labels, x, own.base, own.high):
                held.append((w, ids[row], score))
                n += len(w)
                if n > most:
                    held = [cut(*map(np.concatenate, zip(*held, strict=True)), own.want)]
                    n = len(held[0][0])
        w, ids, score = cut(*map(np.concatenate, zip(*held, strict=True)), own.want) if held else empty
        yield pa.RecordBatch.from_arrays([pa.array(w, pa.int32()), pa.array(ids, pa.int64()), pa.array(score, pa.int64())], ["w", "id", "score"])

    return run


def select(table: DataFrame, anchors: tuple, windows: Windows, width: int, exact: bool, passes: list | None = None) -> DataFrame:
    """(w, id, score, rank): the first rows of every window, by score downwards and then by id."""
    sc = table.sparkSession.sparkContext
    packed = table.select("ids", "labels", "data")
    while len(windows.low) and (windows.bits > 0).any():
        shared = sc.broadcast(Scorer(*anchors, windows, exact))
        counts = packed.mapInArrow(_count(shared, width), "w int, bucket int, n long").groupBy("w", "bucket").agg(F.sum("n").alias("n"))
        # A bucket that is there holds a row, so the k-th row lies in one of the k highest: k numbers for each window of the block.
        highest = counts.withColumn("r", F.row_number().over(Window.partitionBy("w").orderBy(F.desc("bucket")))).where(F.col("r") <= windows.want)
        found: dict[int, list[tuple[int, int]]] = {}
        for r in highest.collect():
            found.setdefault(r["w"], []).append((r["bucket"], r["n"]))
        if passes is not None:
            passes.append(int((windows.bits > 0).sum()))
        windows.refine(found)
        shared.unpersist()
    shared = sc.broadcast(Scorer(*anchors, windows, exact))
    rank = F.row_number().over(Window.partitionBy("w").orderBy(F.desc("score"), "id"))
    return packed.mapInArrow(_gather(shared, width, HELD), "w int, id long, score long").withColumn("rank", rank).where(F.col("rank") <= windows.want)


def mine(rows: DataFrame, is_anchor, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, passes: list | None = None) -> DataFrame:
    """PAIRS for rows(id, label, v) and the anchors that the condition `is_anchor` names: for each anchor and each of its first positives, the first
    rows of other labels with low * positive score <= 100 * score <= high * positive score."""
    spark = rows.sparkSession
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL").select(F.col("id").cast("long"), F.col("label").cast("long"), "v")
    width = max(1, rows.agg(F.max(F.size("v"))).first()[0] or 0)
    table = Table(rows.mapInArrow(_packer(width, scale), PACKED), "packed")
    top, square = table.read().agg(F.max("top"), F.max("square")).first()
    if top is None:
        return spark.createDataFrame([], PAIRS)
    if square >= 2.0**56:
        raise OverflowError(f"scores of components scaled by {scale} exceed a long")
    exact, bound = width * top * top < 2**53, int(square) + 1
    # Anchors in blocks of equal size; the rows stay packed.
    chosen = Table(rows.where(is_anchor), "anchors")
    n = chosen.read().count()
    dealt = Table(chosen.read().repartition(max(1, -(-n // ANCHORS))).withColumn("block", F.spark_partition_id()), "anchors")
    chosen.drop()
    path = f"{shared_dir(spark)}/negatives-{uuid.uuid4().hex}"
    spark.createDataFrame([], PAIRS).write.parquet(path)
    for block in range(-(-n // ANCHORS)):
        own = dealt.read().where(F.col("block") == block).orderBy("id", "label", "v").collect()  # a block of anchors
        if not own:
            continue
        x = matrix(pa.array([r["v"] for r in own], pa.list_(pa.float64())), width, scale)
        anchors = (np.array([r["id"] for r in own], np.int64), np.array([r["label"] for r in own], np.int64), x)
        m = len(own)
        near = Windows(np.arange(m), np.full(m, -bound), np.full(m, bound), positives, True)
        found = sorted((r["w"], r["rank"], r["id"], r["score"]) for r in select(table.read(), anchors, near, width, exact, passes).collect() if r["score"] >= 0)
        if not found:
            continue
        of, _, ids, scores = (np.array(c, np.int64) for c in zip(*found, strict=True))
        hard = Windows(of, -((-low * scores) // 100), high * scores // 100, negatives, False)
        out = select(table.read(), anchors, hard, width, exact, passes)
        kept = spark.createDataFrame([(w, int(anchors[0][a]), int(i), int(s)) for w, (a, i, s) in enumerate(zip(of.tolist(), ids.tolist(), scores.tolist(), strict=True))], "w int, anchor_id long, positive_id long, positive_score long")
        out = out.join(F.broadcast(kept), "w")  # positives times the anchors of a block
        out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(path)
    for used in (table, dealt):
        used.drop()
    return spark.read.schema(PAIRS).parquet(path)


def op12_hard_negatives(spark, sf_dir):
    rows = kept_rows(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", "label")
    label = F.col("label").cast("long")
    rows = rows.withColumn("label", F.when(F.col("id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return mine(rows, F.col("id") % 100 == 0)
