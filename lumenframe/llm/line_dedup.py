"""Line dedup with two Bloom filters.

Pass 1: every task marks line keys in a filter of keys it has met once and a filter of keys it has met twice;
merging two tasks' filters also marks what both met once. Pass 2: lines that may be in the merged twice-seen
filter are suspects, and only they shuffle, with their whole keys, for an exact count of documents and the
largest doc_id. Pass 3: each document loses its confirmed keys. Only texts that may lose a line (by a Bloom filter
of their doc_ids) shuffle to meet them; the others are finished where they lie. A line of a great many documents is dealt over
salts of their ids, in the count and in the join.

The filters' size follows the corpus up to `most_bits`; beyond that more lines are suspected, and the result
stays exact. A document counts once for a key however often it has it, and rows with one doc_id are one document in that count; between them there is
no order: rows that share the largest doc_id all keep the line. Rows without a doc_id are one document too, below all others. Null or empty text:
one empty line. Very long texts are split in memory, one at a time. An empty table gives no rows. Other columns, whatever
their names, travel as one struct. Keys are held as 64-bit hashes only within one document's list of drops.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.llm.common import Bloom, Table, WS, pack, texts, unpack

_WS = WS.encode()
SEGMENTS, SALTS = 64, 64
SUSPECTS = "doc_id long, key binary, h long"


def key_of(line: bytes) -> bytes:
    return line.strip(_WS).lower()


def long_enough(key: bytes, least: int) -> bool:
    """At least so many code points."""
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode()) >= least)


def keys_of(text: bytes, least: int) -> set[bytes]:
    return {k for k in map(key_of, text.split(b"\n")) if long_enough(k, least)}


def _slots(h: np.ndarray, bits: int):
    mask = np.uint64(bits - 1)
    for p in (h & mask, (h >> np.uint64(32)) & mask):
        yield (p >> np.uint64(3)).astype(np.int64), np.left_shift(1, (p & np.uint64(7)).astype(np.uint8), dtype=np.uint8)


def _has(f: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    out = np.ones(len(h), bool)
    for at, bit in _slots(h, bits):
        out &= (f[at] & bit) != 0
    return out


def _put(f: np.ndarray, h: np.ndarray, bits: int) -> None:
    for at, bit in _slots(h, bits):
        np.bitwise_or.at(f, at, bit)


def _builder(bits: int, least: int):
    def build(batches):
        once, twice = np.zeros(bits >> 3, np.uint8), np.zeros(bits >> 3, np.uint8)
        for batch in batches:
            h = np.fromiter((xxhash.xxh3_64_intdigest(k) for x in texts(batch) for k in keys_of(x, least)), np.uint64)
            h, n = np.unique(h, return_counts=True)
            _put(twice, h[(n > 1) | _has(once, h, bits)], bits)
            _put(once, h, bits)
        for i, (a, b) in enumerate(zip(np.split(once, SEGMENTS), np.split(twice, SEGMENTS), strict=True)):
            yield pa.RecordBatch.from_pydict({"segment": pa.array([i], pa.int32()), "once": [pack(a)], "twice": [pack(b)]})

    return build


def _merge(batches):
    held: dict[int, list] = {}
    for batch in batches:
        for r in batch.to_pylist():
            a, b = unpack(r["once"], np.uint8), unpack(r["twice"], np.uint8)
            if r["segment"] in held:
                once, twice = held[r["segment"]]
                twice |= b | (once & a)
                once |= a
            else:
                held[r["segment"]] = [a.copy(), b.copy()]
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([pack(x[1]) for x in held.values()], pa.binary())], ["segment", "twice"])


def twice_seen(docs: DataFrame, bits: int, least: int) -> np.ndarray:
    """The merged filter: bits / 8 bytes, whatever the corpus."""
    built = docs.select("text").mapInArrow(_builder(bits, least), "segment int, once binary, twice binary")
    rows = built.repartition(SEGMENTS, "segment").mapInArrow(_merge, "segment int, twice binary").collect()
    out = np.zeros(bits >> 3, np.uint8)
    parts = np.split(out, SEGMENTS)
    for r in rows:
        parts[r["segment"]][:] = unpack(bytes(r["twice"]), np.uint8)
    return out


def _suspects(filt, bits: int, least: int):
    def find(batches):
        f = filt.value
        for batch in batches:
            ids, owner, keys = batch.column(batch.schema.get_field_index("doc_id")), [], []
            for i, x in enumerate(texts(batch)):
                for k in keys_of(x, least):
                    owner.append(i)
                    keys.append(k)
            h = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
            hit = np.flatnonzero(_has(f, h, bits))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array([owner[i] for i in hit], pa.int64())), pa.array([keys[i] for i in hit], pa.binary()), pa.array(h[hit].view(np.int64))], ["doc_id", "key", "h"])

    return find


def _drop(least: int, untouched=None):
    """Rows (row, text, drops, h) without the lines to drop; or, of all rows, those of untouched documents, without a shuffle."""

    def apply(batches):
        for whole in batches:
            for first in range(0, whole.num_rows, 1000):
                batch = whole.slice(first, 1000)
                if untouched is not None:
                    batch = batch.filter(pa.array(~untouched.value.has(batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64))))
                out, lines, dropped = [], [], []
                for x, gone in zip(texts(batch), batch.column(2).to_pylist(), strict=True):
                    parts = x.split(b"\n")
                    lines.append(len(parts))
                    if gone:
                        gone = set(gone)
                        parts = [p for p in parts if not (long_enough(k := key_of(p), least) and np.uint64(xxhash.xxh3_64_intdigest(k)).astype(np.int64) in gone)]
                        x = b"\n".join(parts)
                    dropped.append(lines[-1] - len(parts))
                    out.append(x)
                cols = [batch.column(0), pa.array(out, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in out], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, ["row", "text", "n_lines", "n_dropped", "kept_sha256"])

    return apply


def _touched(filt):
    """The rows of documents that may lose lines."""

    def apply(batches):
        for batch in batches:
            yield batch.filter(pa.array(filt.value.has(batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64))))

    return apply


def dedup_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, most_bits: int = 1 << 30) -> DataFrame:
    """row (the input's other columns as a struct), text (without repeated lines), n_lines, n_dropped, kept_sha256 of every row."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bits = min(most_bits, max(1 << 16, 1 << (total // 16).bit_length()))
    filt = spark.sparkContext.broadcast(twice_seen(docs, bits, least_chars))
    suspects = Table(docs.select("doc_id", "text").mapInArrow(_suspects(filt, bits, least_chars), SUSPECTS), "line-suspects").read()
    filt.unpersist()
    # A line's documents are dealt over salts: there they are counted, and only there they meet what is known of the line.
    dealt = suspects.withColumn("salt", F.pmod(_id_hash("doc_id"), SALTS))
    parts = dealt.groupBy("key", "salt").agg(F.count_distinct(F.struct("doc_id")).alias("n"), F.max("doc_id").alias("top"))
    known = parts.groupBy("key").agg(F.sum("n").alias("n"), F.max("top").alias("top"), F.collect_list("salt").alias("salts")).where(F.col("n") >= least_docs)
    known = Table(known.select("key", "top", F.explode("salts").alias("salt")), "line-keys").read()
    drops = dealt.join(known, ["key", "salt"]).where(~F.col("doc_id").eqNullSafe(F.col("top")))
    drops = Table(drops.groupBy("doc_id").agg(F.collect_set("h").alias("drops")), "line-drops").read()
    touched = spark.sparkContext.broadcast(Bloom.of(drops.select(_id_hash("doc_id").alias("h")), most_bits >> 1) or Bloom(64))
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    rows = docs.select(rest.alias("row"), "text", F.lit(None).cast("array<long>").alias("drops"), _id_hash("doc_id").alias("h"))
    hit = rows.mapInArrow(_touched(touched), rows.schema).drop("drops")
    # The same join at every size: drops grow with the corpus, and small ones would be broadcast.
    hit = hit.join(drops.hint("merge"), hit["row.doc_id"].eqNullSafe(drops["doc_id"]), "left").select("row", "text", "drops", "h")
    out = T.StructType([rows.schema["row"], *[T.StructField(n, t()) for n, t in (("text", T.StringType), ("n_lines", T.LongType), ("n_dropped", T.LongType), ("kept_sha256", T.StringType))]])
    return hit.mapInArrow(_drop(least_chars), out).unionByName(rows.mapInArrow(_drop(least_chars, touched), out))


def _id_hash(name: str):
    return F.xxhash64(F.coalesce(name, F.lit(-1)), F.lit(5))


def clean_documents(docs: DataFrame, **options) -> DataFrame:
    """docs in their own columns without repeated lines; n_chars becomes the new text's length, all others stay as they were."""
    out = dedup_lines(docs, **options)
    return out.select(*[F.col("text") if c == "text" else F.length("text").cast("long").alias(c) if c == "n_chars" else F.col("row").getField(c).alias(c) for c in docs.columns])


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("row.doc_id", "n_lines", "n_dropped", "kept_sha256")
