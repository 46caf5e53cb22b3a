"""Benchmark decontamination: n-gram seeds, then Smith-Waterman.

Words are compared in lower case and without ASCII punctuation. The n-grams of a block of benchmark items are
sent to the tasks (a block has a fixed number of words, so its size does not depend on the corpus; a larger
benchmark takes more passes). Every n-gram of an item is a seed, however many documents hold it. One pass joins
documents to items at the seeds and aligns the passage around them with the item: match 1, mismatch and gap -1.
A document holds an item if the best local alignment reaches `least_score` of the item's words; a passage that
lacks too many of the item's words to reach it is not aligned.

Documents of any length are searched whole. Null texts and items without words match nothing. Repeated
documents and items are each reported. Equal spans: the best score, then the earliest. Other columns are ignored.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import Table, mix, texts

#: Lower case, and a blank for each ASCII punctuation mark.
PLAIN = bytes((32 if not (c >= 128 or chr(c).isalnum()) else ord(chr(c).lower()) if c < 128 else c) for c in range(256))
FOUND = "doc_id long, item_id long, score double, first_word long, last_word long"
_M = np.uint64(0x9E3779B97F4A7C15)


def plain_words(text: bytes) -> list[bytes]:
    return (text if text.isascii() else text.decode().lower().encode()).translate(PLAIN).split()


def gram_keys(ids: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of non-zero ids."""
    out = np.zeros(len(ids) - n + 1, np.uint64)
    for i in range(n):
        out = mix(out * _M + ids[i : i + len(out)].astype(np.uint64))
    return out


class Block:
    """Some items, their vocabulary and their n-grams."""

    def __init__(self, items: list[tuple], n: int):
        self.n, self.vocabulary, self.items, keys, owner, place = n, {}, [], [], [], []
        for item_id, text in items:
            words = plain_words((text or "").encode())
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int64)
            if len(ids) >= n:
                k = gram_keys(ids, n)
                keys.append(k)
                owner.append(np.full(len(k), len(self.items)))
                place.append(np.arange(len(k)))
            self.items.append((item_id, ids))
        join = lambda a, kind: np.concatenate(a).astype(kind) if a else np.zeros(0, kind)
        keys = join(keys, np.uint64)
        self.keys, of = np.unique(keys, return_inverse=True)
        self.owner, self.place = join(owner, np.int64), join(place, np.int64)
        self.by_key = np.argsort(of, kind="stable")
        self.first = np.searchsorted(of[self.by_key], np.arange(len(self.keys) + 1))
        self.sizes = np.array([len(ids) for _, ids in self.items], np.int64)
        self.met = np.zeros(len(self.vocabulary) + 1, bool)

    def shared(self, item: np.ndarray, passage: np.ndarray) -> int:
        """How many of the item's words occur in the passage: no alignment scores more."""
        self.met[passage] = True
        n = int(self.met[item].sum())
        self.met[passage] = False
        return n

    def ids_of(self, text: bytes) -> np.ndarray:
        words = plain_words(text)
        return np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in a document and the keys found there."""
        n = self.n
        if len(ids) < n or not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = ids > 0
        whole = known[: len(ids) - n + 1].copy()
        for i in range(1, n):
            whole &= known[i : i + len(whole)]
        at = np.flatnonzero(whole)
        if not len(at):
            return at, at
        k = np.zeros(len(at), np.uint64)
        for i in range(n):
            k = mix(k * _M + ids[at + i].astype(np.uint64))
        s = np.searchsorted(self.keys, k)
        s[s == len(self.keys)] = 0
        ok = self.keys[s] == k
        return at[ok], s[ok]


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """The best local alignment's score and where it ends in the passage."""
    j = np.arange(len(passage) + 1)
    row, best, end = np.zeros(len(j), np.int64), 0, 0
    for w in item:
        t = np.maximum(row - 1, 0)
        t[1:] = np.maximum(t[1:], row[:-1] + np.where(passage == w, 1, -1))
        row = np.maximum.accumulate(t + j) - j  # gaps in the item: from any earlier cell, one less a word
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
    return best, end


def search(block: Block, text: bytes, least_score: float) -> list[tuple]:
    """(item_id, score, first word, last word) of the items that a text holds."""
    ids = block.ids_of(text)
    at, keys = block.hits(ids)
    if not len(at):
        return []
    n_of = block.first[keys + 1] - block.first[keys]
    rows = np.repeat(np.arange(len(at)), n_of)
    step = np.arange(len(rows)) - np.repeat(np.cumsum(n_of) - n_of, n_of)
    entry = block.by_key[block.first[keys[rows]] + step]
    owner, start = block.owner[entry], at[rows] - block.place[entry]
    out = []
    order = np.lexsort((start, owner))
    owner, start = owner[order], start[order]
    size = block.sizes[owner]
    cut = np.flatnonzero((owner[1:] != owner[:-1]) | (start[1:] - start[:-1] > size[1:])) + 1
    best: dict[int, tuple] = {}
    for a, b in zip(np.r_[0, cut], np.r_[cut, len(owner)], strict=True):
        item = block.items[owner[a]][1]
        slack = len(item) // 2 + block.n
        lo, hi = max(0, int(start[a]) - slack), min(len(ids), int(start[b - 1]) + len(item) + slack)
        if block.shared(item, ids[lo:hi]) < least_score * len(item):
            continue
        score, end = align(item, ids[lo:hi])
        if score >= least_score * len(item) and score > best.get(owner[a], (0,))[0]:
            _, back = align(item[::-1], ids[lo : lo + end][::-1])
            best[owner[a]] = (score, lo + end - back, lo + end - 1)
    for o, (score, first, last) in best.items():
        out.append((block.items[o][0], score / len(block.items[o][1]), first, last))
    return out


def _finder(shared, least_score: float):
    def find(batches):
        block = shared.value
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            rows = [(i, *r) for i, x in zip(ids, texts(batch), strict=True) for r in search(block, x, least_score)]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in FOUND.split(", ")])

    return find


def blocks_of(items: DataFrame, n: int, block_words: int):
    """Blocks of at most about `block_words` words, read one row at a time."""
    held, words = [], 0
    for r in items.select("item_id", "text").where(F.col("text").isNotNull()).orderBy("item_id").toLocalIterator():
        held.append((r.item_id, r.text))
        words += len(r.text.split())
        if words >= block_words:
            yield Block(held, n)
            held, words = [], 0
    if held:
        yield Block(held, n)


def contaminated(docs: DataFrame, items: DataFrame, n: int = 4, least_score: float = 0.5, block_words: int = 1_000_000) -> DataFrame:
    """doc_id, item_id, score, first_word, last_word for each benchmark item that a document holds."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    out = None
    for block in blocks_of(items, n, block_words):
        for size in sorted({len(i[1]) for i in block.items if 0 < len(i[1]) < n}):
            # Items shorter than n words are sought by their own length.
            short = Block([(i, " ".join(_names(block, w))) for i, w in block.items if len(w) == size], size)
            found = docs.mapInArrow(_finder(spark.sparkContext.broadcast(short), 1.0), FOUND)
            out = found if out is None else out.unionByName(found)
        found = docs.mapInArrow(_finder(spark.sparkContext.broadcast(block), least_score), FOUND)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], FOUND) if out is None else out


def _names(block: Block, ids: np.ndarray) -> list[str]:
    words = list(block.vocabulary)
    return [words[i - 1].decode() for i in ids]


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """docs without those that hold a benchmark item."""
    found = Table(contaminated(docs, items, **options).select("doc_id").distinct(), "contaminated").read()
    return docs.join(found.withColumnRenamed("doc_id", "__id"), F.col("doc_id").eqNullSafe(F.col("__id")), "left_anti")


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
