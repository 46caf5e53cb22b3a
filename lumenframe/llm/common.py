"""What the operators of this subpackage share: shared-folder tables, byte-level tokenisation and hashing."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract here: `[\x20\x09-\x0D]`. bytes.split() and bytes.strip() use exactly this set.
WS = " \t\n\x0b\x0c\r"
WS_RE = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share: spark.checkpoint.dir, or one of our own in local mode where that is unset."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lumenframe-")
        sc.setCheckpointDir(found)
        found = sc.getCheckpointDir() or found
    return found.rstrip("/")


class Table:
    """A Parquet table in the shared folder. It cuts lineage: a lost executor rereads files and recomputes nothing."""

    def __init__(self, df: DataFrame, label: str):
        self.spark, self.schema = df.sparkSession, df.schema
        self.path = f"{shared_dir(self.spark)}/{label}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        drop_path(self.spark, self.path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    with contextlib.suppress(Exception):  # a leftover is harmless
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    """A-Z only, unlike lower()."""
    return F.translate(c, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, also inside nested lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes]:
    """The column's strings as UTF-8; null as empty."""
    col = batch.column(batch.schema.get_field_index(name))
    for x in col.cast(pa.large_binary()):
        yield x.as_py() or b""


class WordHash(dict):
    """word -> 64-bit hash, cached; emptied when it has grown to `most` words, so memory stays bounded."""

    def __init__(self, seed: int = 0, most: int = 150_000):
        self.seed, self.most = seed, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, given the words' hashes; the whole sequence as one if it is shorter, none if empty."""
    if len(h) == 0:
        return h
    n = min(n, len(h))
    m = len(h) - n + 1
    out = np.full(m, n, np.uint64)
    for i in range(n):
        out = mix(out * _M1 + h[i : i + m])
    return out


def flush_size(rows: Iterable, size: int) -> Iterator[list]:
    """Lists of `size` rows."""
    block = []
    for x in rows:
        block.append(x)
        if len(block) >= size:
            yield block
            block = []
    if block:
        yield block


def crc32_text(c: Column) -> Column:
    return F.crc32(F.encode(c.cast("string"), "UTF-8"))


def pack(a: np.ndarray) -> bytes:
    return zlib.compress(a.tobytes(), 1)


def unpack(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b), kind)


class Bloom:
    """A Bloom filter of 64-bit hashes in `PARTS` parts by their highest bits; each part is built in one task from its own hashes."""

    PARTS, PROBES = 64, 3

    def __init__(self, bits: int):
        self.bits, self.data = bits, np.zeros(self.PARTS * bits >> 3, np.uint8)

    @staticmethod
    def _slots(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
        for k in range(Bloom.PROBES):
            yield (mix(h + np.uint64(k + 1)) & np.uint64(bits - 1)).astype(np.int64)

    def has(self, h: np.ndarray) -> np.ndarray:
        base, out = (h >> np.uint64(58)).astype(np.int64) * self.bits, np.ones(len(h), bool)
        for slot in self._slots(h, self.bits):
            slot += base
            out &= ((self.data[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1) == 1
        return out

    @staticmethod
    def of(rows: DataFrame, most_bits: int = 1 << 30) -> Bloom | None:
        """The filter of rows(h long): 16 bits or more for each row, but no more than `most_bits` in all; None without rows."""
        rows = Table(rows, "hashes")
        n = rows.read().count()
        if not n:
            rows.drop()
            return None
        bits = max(64, min(most_bits, 1 << (16 * n - 1).bit_length()) // Bloom.PARTS)

        def build(batches):
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                of = (h >> np.uint64(58)).astype(np.int64)
                for p in np.unique(of).tolist():
                    f = held.setdefault(p, np.zeros(bits, bool))
                    for slot in Bloom._slots(h[of == p], bits):
                        f[slot] = True
            for p, f in held.items():
                yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32()), "bits": pa.array([np.packbits(f, bitorder="little").tobytes()], pa.binary())})

        out = Bloom(bits)
        tasks = max(1, min(Bloom.PARTS, n >> 17))
        built = rows.read().repartition(tasks, F.shiftrightunsigned("h", 58)).mapInArrow(build, "part int, bits binary")
        for r in built.collect():  # most_bits bits in all
            out.data[r["part"] * bits >> 3 : (r["part"] + 1) * bits >> 3] = np.frombuffer(bytes(r["bits"]), np.uint8)
        rows.drop()
        return out
