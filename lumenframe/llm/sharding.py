"""Sharding by minimax contiguous partition (native).

Equal texts form atomic groups. Groups are put in the order of their text's SHA-256, which
spreads any corpus evenly over the key range, and cut into `shards` contiguous runs so that
the largest run is as small as it can be: a binary search finds the smallest capacity for
which greedy filling needs no more than `shards` runs, then the runs are cut there.

The greedy check never sees the groups one by one. The driver holds at most a few tens of
thousand *segments* of the key range, each with its bytes and number of groups, and splits
only those that a cut may fall into, one aggregate query a level. Capacities are bracketed
between filling segments fractionally (too optimistic) and whole (too pessimistic); once both
agree the answer is exact. Depth is the logarithm of the group count to the base 1024.

Nulls: a null text is empty (size 1) and equals other null and empty texts. Null or repeated
doc_ids are ordinary rows. An empty table gives an empty result. A group larger than the mean
shard stays whole; it then sets the capacity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import Table

KEY_BITS = 60
FAN_BITS = 10
SLOT_BINS = 4096


def with_keys(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    sha = F.sha2(text, 256)
    return docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.conv(F.substring(sha, 1, KEY_BITS // 4), 16, 10).cast("long").alias("key"),
    )


def _fill(segments: list[tuple], capacity: int, fractional: bool, most: int) -> list[int] | None:
    """Greedy cuts as byte positions; None if more than `most` runs are needed or an atom exceeds the capacity."""
    cuts, start, at = [], 0, 0
    for _, _, mass, groups in segments:
        end = at + mass
        if fractional and groups > 1:
            while end - start > capacity:
                start += capacity
                cuts.append(start)
                if len(cuts) >= most:
                    return None
        elif end - start > capacity:
            if mass > capacity or len(cuts) + 1 >= most:
                return None
            start = at
            cuts.append(at)
        at = end
    return cuts


def _least(segments: list[tuple], low: int, high: int, fractional: bool, most: int) -> int:
    while low < high:
        mid = (low + high) // 2
        if _fill(segments, mid, fractional, most) is None:
            low = mid + 1
        else:
            high = mid
    return low


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """groups(key, mass): the least capacity, and the keys at which shards 1.. begin."""
    total, largest = groups.agg(F.sum("mass"), F.max("mass")).first()
    if total is None:
        return 0, []
    segments = [(0, KEY_BITS, total, 2)]  # first key, log2 of the key range, bytes, groups
    while True:
        low = max(largest, -(-total // shards))
        least = _least(segments, low, total, True, shards)
        whole = _least(segments, low, total, False, shards)
        split = [s for s in segments if s[3] > 1 and s[1] > 0]
        if least == whole or not split:
            break
        # A cut k lies between where whole segments put it at the least capacity and k times the largest capacity.
        heavy = [s for s in split if s[2] > least]
        if not heavy:
            early, start, at = [], 0, 0
            for s in segments:
                if at + s[2] - start > least:
                    start = at
                    early.append(at)
                at += s[2]
            spans = [(e, min(total, (k + 1) * whole)) for k, e in enumerate(early[: shards - 1])]
            at, chosen = 0, []
            for s in segments:
                if s[3] > 1 and s[1] > 0 and any(at <= b and at + s[2] >= a for a, b in spans):
                    chosen.append(s)
                at += s[2]
            heavy = chosen or split
        segments = sorted([s for s in segments if s not in set(heavy)] + _split(groups, heavy))
    cuts = _fill(segments, whole, False, shards) or []
    at, keys, wanted = 0, [], set(cuts)
    for first, _, mass, _ in segments:
        if at in wanted and at:
            keys.append(first)
            wanted.discard(at)
        at += mass
    return whole, keys


def _split(groups: DataFrame, chosen: list[tuple]) -> list[tuple]:
    """The chosen segments in up to 1024 parts each."""
    out = []
    by_bits: dict[int, list[int]] = {}
    for first, bits, _, _ in chosen:
        by_bits.setdefault(bits, []).append(first)
    for bits, firsts in by_bits.items():
        fan = min(FAN_BITS, bits)
        rest = bits - fan
        parent = F.shiftright("key", bits) if bits < KEY_BITS else F.lit(0).cast("long")
        rows = (
            groups.where(parent.isin([f >> bits for f in firsts]))
            .groupBy(F.shiftright("key", rest).alias("part"))
            .agg(F.sum("mass").alias("mass"), F.count(F.lit(1)).alias("n"))
            .collect()
        )
        out += [(r["part"] << rest, rest, r["mass"], r["n"]) for r in rows]
    return out


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, capacity for every row of docs(doc_id, text)."""
    rows = with_keys(docs)
    groups = Table(rows.groupBy("key").agg(F.sum("size").alias("mass")), "shard-groups")
    capacity, keys = minimax_cuts(groups.read(), shards)
    groups.drop()
    shard = F.lit(0)
    for k in keys:
        shard = shard + (F.col("key") >= F.lit(k)).cast("int")
    placed = Table(rows.withColumn("shard", shard).withColumn("bin", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(SLOT_BINS)).cast("int")), "shard-rows").read()
    counts = placed.groupBy("shard", "bin").agg(F.count(F.lit(1)).alias("n"))
    # At most shards * SLOT_BINS rows, however many documents there are.
    starts = counts.select("shard", "bin", (F.sum("n").over(Window.partitionBy("shard").orderBy("bin")) - F.col("n")).alias("start"))
    within = F.row_number().over(Window.partitionBy("shard", "bin").orderBy("doc_id", "key")) - 1
    return (
        placed.join(F.broadcast(starts), ["shard", "bin"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("start") + within).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"), F.lit(capacity).cast("long").alias("capacity"),
        )
    )


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), 8)
