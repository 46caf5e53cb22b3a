"""Exact Jaccard join of documents' word n-gram sets in the Jaccard metric space.

Equal sets collapse first. A set's cells are its rarest shingles, as many as a partner within the radius may
lack, plus three (rarity comes from a sketch of all shingles; any order would be exact): two sets within the radius
share three cells. Sets that share only cells of few members, and fewer than three, stay apart; of a cell with more,
the least set is the pivot, and all its sets enter the pivot's region, so a set is sent once for each pivot and not
for each cell. Inside a region, distances to further pivots make Voronoi regions:
a set belongs to its nearest pivot, and by the triangle inequality also to each pivot at most twice the radius
farther, so linked sets meet in one of them. Regions are cut again until they are small, or already connected, and
are then joined exactly; sets that the join has connected are not compared again. Links leave a region as a
forest, and components follow from these forests.

No task holds a whole large region: one of more than `large` sets is dealt over tasks, each of which measures its share against
the region's pivots; the Voronoi regions are the next level's regions. A region in which every set is linked to one
pivot is done. One that pivots no longer cut goes on as pairs of blocks, a task each: sets that are not linked to its best
pivot meet each other and all others, and those linked to it, being connected, do not meet again.

Nulls, empty texts and texts without words have no shingles and link with nothing. Texts with fewer words than
a shingle form one shingle of all their words. A null doc_id counts as smaller than any other. Rows with the same
doc_id are separate documents. Very long texts have large sets and are treated like any other. Shingles are held as
64-bit hashes and sets as 128-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import Table, WordHash, ngram_hashes, pack, shuffle_parts, texts, unpack
from lumenframe.llm.components import components, with_least

SEGMENTS = 64
SMALL = 192
#: Sets of one region that a task joins at once, whatever the corpus; larger regions are cut over tasks.
LARGE = 512
LEVELS = 6
#: Counters of the sketch, whatever the corpus.
SLOTS = 1 << 22
#: Cells that two linked sets share, if they have as many shingles; cells of up to FEW sets count towards it pair by pair.
SHARED, FEW = 3, 8
PIVOTS = 8


def shingle_set(text: bytes, n: int, hashes: WordHash) -> np.ndarray:
    """Sorted distinct shingles; lower case is A-Z only, and split() breaks at exactly `[\\x20\\x09-\\x0D]`."""
    return np.unique(ngram_hashes(hashes.of(text.lower().split()), n))


def _sketch(n: int):
    def count(batches):
        hashes, total = WordHash(), np.zeros(SLOTS, np.uint32)
        for batch in batches:
            held = [shingle_set(x, n, hashes) for x in texts(batch)]
            if held:
                at, times = np.unique(np.concatenate(held) & np.uint64(SLOTS - 1), return_counts=True)
                total[at.astype(np.int64)] += times.astype(np.uint32)
        for i, x in enumerate(np.split(total, SEGMENTS)):
            yield pa.RecordBatch.from_pydict({"segment": pa.array([i], pa.int32()), "counts": [pack(x)]})

    return count


def _merge(batches):
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for r in batch.to_pylist():
            x = unpack(r["counts"], np.uint32)
            held[r["segment"]] = x + held[r["segment"]] if r["segment"] in held else x
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([pack(x) for x in held.values()], pa.binary())], ["segment", "counts"])


def shingle_counts(docs: DataFrame, n: int) -> np.ndarray:
    """Rough document counts by shingle hash, in a table of fixed size."""
    built = docs.select("text").mapInArrow(_sketch(n), "segment int, counts binary")
    out = np.zeros(SLOTS, np.uint32)
    parts = np.split(out, SEGMENTS)
    for r in built.repartition(SEGMENTS, "segment").mapInArrow(_merge, "segment int, counts binary").collect():
        parts[r["segment"]][:] = unpack(bytes(r["counts"]), np.uint32)
    return out


def _setter(n: int, percent: int, counts):
    def run(batches):
        heat, hashes, seen = counts.value, WordHash(), set()
        mask = np.uint64(len(heat) - 1)
        for batch in batches:
            size, sig, cells = [], [], []
            for x in texts(batch):
                s = shingle_set(x, n, hashes)
                size.append(len(s))
                sig.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                if not len(s) or sig[-1] in seen:
                    cells.append(None)
                    continue
                if len(seen) < 1_000_000:
                    seen.add(sig[-1])
                least = -(-percent * len(s) // 100)  # shingles of any linked set
                most = len(s) - least + min(SHARED, least)
                order = np.lexsort((s, heat[(s & mask).astype(np.int64)]))[:most]
                cells.append(s[order].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(sig, pa.binary()), pa.array(cells, pa.list_(pa.int64()))], ["doc_id", "n", "sig", "cells"])

    return run


def _pivots(batches):
    """(cell, sig, size, largest partner, cells to share) rows of one partition -> (pivot, sig, need).

    For two linked sets, a common cell leaves each of them enough shingles for the other's size. A cell
    falls into runs of sizes; no pair across two runs can be linked there, so each run has a pivot of its own. Runs of few
    sets give all their pairs with the number of cells they need to share; longer ones their pivot with each set, need 0.
    """
    parts = [[], [], [], [], []]
    for batch in batches:
        for k in (0, 2, 3, 4):
            parts[k].append(batch.column(k).to_numpy().astype(np.int64))
        parts[1].append(np.frombuffer(b"".join(batch.column(1).to_pylist()), "V16"))
    if not parts[0]:
        return
    cell, sig, size, most, need = map(np.concatenate, parts)
    halves = sig.view(">u8").reshape(-1, 2)
    order = np.lexsort((halves[:, 1], halves[:, 0], size, cell))
    cell, sig, size, most, need = cell[order], sig[order], size[order], most[order], need[order]
    halves = halves[order]
    start = np.ones(len(cell), bool)
    start[1:] = cell[1:] != cell[:-1]
    # The largest partner any earlier set of the cell allows; cells are kept apart by an offset.
    high = (np.cumsum(start) - 1) * (int(max(most.max(), size.max())) + 1)
    start[1:] |= size[1:] + high[1:] > np.maximum.accumulate(most + high)[:-1]
    first = np.flatnonzero(start)
    times = np.diff(np.r_[first, len(cell)])
    left, right, needs = [], [], []
    long = np.repeat(times, times) > FEW
    left.append(np.repeat(sig[first], times)[long])
    right.append(sig[long])
    needs.append(np.zeros(int(long.sum()), np.int64))
    for n in range(2, FEW + 1):
        at = first[times == n]
        for i in range(n):
            for j in range(i + 1, n):
                a, b = at + i, at + j
                fits = (size[b] <= most[a]) & (size[a] <= most[b])
                a, b = a[fits], b[fits]
                least = (halves[a, 0] < halves[b, 0]) | ((halves[a, 0] == halves[b, 0]) & (halves[a, 1] < halves[b, 1]))
                left.append(sig[np.where(least, a, b)])
                right.append(sig[np.where(least, b, a)])
                needs.append(np.minimum(need[a], need[b]))
    left, right, needs = map(np.concatenate, (left, right, needs))
    for a in range(0, len(left), 20_000):
        part = slice(a, a + 20_000)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in left[part]], pa.binary()), pa.array([x.tobytes() for x in right[part]], pa.binary()), pa.array(needs[part].astype(np.int32))], ["pivot", "sig", "need"])


def _sig_slots(sigs: list[bytes], bits: int):
    halves = np.frombuffer(b"".join(sigs), np.uint64).reshape(-1, 2)
    for k in (0, 1):
        p = (halves[:, k] & np.uint64(bits - 1)).astype(np.int64)
        yield p >> 3, np.left_shift(1, (p & 7).astype(np.uint8), dtype=np.uint8)


def _marker(bits: int):
    def run(batches):
        f = np.zeros(bits >> 3, np.uint8)
        for batch in batches:
            for at, bit in _sig_slots(batch.column(0).to_pylist(), bits):
                np.bitwise_or.at(f, at, bit)
        for i, x in enumerate(np.split(f, SEGMENTS)):
            yield pa.RecordBatch.from_pydict({"segment": pa.array([i], pa.int32()), "bits": [pack(x)]})

    return run


def _merge_bits(batches):
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for r in batch.to_pylist():
            x = unpack(r["bits"], np.uint8)
            held[r["segment"]] = x | held[r["segment"]] if r["segment"] in held else x
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([pack(x) for x in held.values()], pa.binary())], ["segment", "bits"])


def sigs_filter(regions: DataFrame, most_bits: int = 1 << 29) -> np.ndarray:
    """A Bloom filter of the sets that entered a region, of bounded size; a set let through in error joins no region."""
    n = regions.count()
    bits = min(most_bits, max(1 << 12, 1 << (16 * n).bit_length()))
    rows = regions.select("sig").mapInArrow(_marker(bits), "segment int, bits binary").repartition(SEGMENTS, "segment")
    out = np.zeros(bits >> 3, np.uint8)
    parts = np.split(out, SEGMENTS)
    for r in rows.mapInArrow(_merge_bits, "segment int, bits binary").collect():
        parts[r["segment"]][:] = unpack(bytes(r["bits"]), np.uint8)
    return out


def _sender(n: int, shared):
    def run(batches):
        f, hashes, seen = shared.value, WordHash(), set()
        for batch in batches:
            out = []
            for x in texts(batch):
                s = shingle_set(x, n, hashes).tobytes()
                sig = xxhash.xxh3_128_digest(s)
                if s and sig not in seen and all(f[at[0]] & bit[0] for at, bit in _sig_slots([sig], 8 * len(f))):
                    if len(seen) < 1_000_000:
                        seen.add(sig)
                    out.append((sig, s))
            for a in range(0, max(len(out), 1), 500):
                rows = out[a : a + 500]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary()) for i in range(2)], ["sig", "shingles"])

    return run


class Region:
    """Sets that may be linked; links found so far in a union-find forest."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.sets, self.percent = sets, percent
        self.size = np.array([len(s) for s in sets], np.int64)
        self.parent = list(range(len(sets)))

    def root(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def link(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def linked(self, shared: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return 100 * shared >= self.percent * (a + b - shared)

    def overlaps(self, members: np.ndarray, i: int) -> np.ndarray:
        """How many shingles each member shares with set i."""
        flat = np.concatenate([self.sets[m] for m in members])
        at = np.searchsorted(self.sets[i], flat)
        at[at == len(self.sets[i])] = 0
        hit = self.sets[i][at] == flat
        starts = np.cumsum(self.size[members]) - self.size[members]
        return np.add.reduceat(hit.astype(np.int64), starts)

    def settled(self, members: np.ndarray) -> bool:
        r = self.root(int(members[0]))
        return all(self.root(int(m)) == r for m in members[1:])

    def all_pairs(self, left: np.ndarray, right: np.ndarray | None = None) -> None:
        """Compare two blocks, or one with itself, through a product of incidence matrices."""
        both = left if right is None else np.concatenate([left, right])
        flat = np.concatenate([self.sets[m] for m in both])
        rows = np.repeat(np.arange(len(both)), self.size[both])
        _, col, times = np.unique(flat, return_inverse=True, return_counts=True)
        keep = np.flatnonzero(times[col] > 1)
        if not len(keep):
            return
        used, col = np.unique(col[keep], return_inverse=True)
        shared = np.zeros((len(both), len(both)), np.float32)
        order = np.argsort(col, kind="stable")
        rows, col = rows[keep][order], col[order]
        for a in range(0, len(used), 8192):
            lo, hi = np.searchsorted(col, [a, a + 8192])
            m = np.zeros((len(both), min(8192, len(used) - a)), np.float32)
            m[rows[lo:hi], col[lo:hi] - a] = 1
            shared += m @ m.T
        size = self.size[both]
        i, j = np.nonzero(np.triu(self.linked(shared.astype(np.int64), size[:, None], size[None, :]), 1))
        for x, y in zip(both[i].tolist(), both[j].tolist(), strict=True):
            self.link(x, y)

    def blocks(self, members: np.ndarray) -> None:
        """Where pivots no longer tell sets apart: blocks by size, compared as far as sizes allow."""
        members = members[np.argsort(self.size[members], kind="stable")]
        parts = [members[a : a + SMALL] for a in range(0, len(members), SMALL)]
        for i, p in enumerate(parts):
            self.all_pairs(p)
            for q in parts[i + 1 :]:
                if self.size[q[0]] * self.percent > 100 * self.size[p[-1]]:
                    break
                if not self.settled(np.concatenate([p, q])):
                    self.all_pairs(p, q)

    def join(self, members: np.ndarray, depth: int = 0) -> None:
        if len(members) < 2 or self.settled(members):
            return
        if len(members) <= SMALL:
            self.all_pairs(members)
            return
        pivots = members[np.linspace(0, len(members) - 1, PIVOTS).astype(np.int64)]
        near = np.empty((PIVOTS, len(members)))
        for k, p in enumerate(pivots):
            shared = self.overlaps(members, int(p))
            for m in members[self.linked(shared, self.size[members], self.size[p])]:
                self.link(int(m), int(p))
            near[k] = 1 - shared / (self.size[members] + self.size[p] - shared)
        if self.settled(members):
            return
        radius = 1 - self.percent / 100
        inside = near <= near.min(axis=0) + 2 * radius + 1e-9
        if depth >= 8 or inside.sum() > 0.75 * PIVOTS * len(members):
            self.blocks(members)
            return
        for k in range(PIVOTS):
            part = members[inside[k]]
            if len(part) == len(members):
                self.blocks(members)
                return
            self.join(part, depth + 1)


OUT = "u binary, v binary, shingles binary, n long"


def _region_join(percent: int):
    """(pivot, sig, shingles, n) rows, sorted by pivot -> links of regions without n; rows of those with n, the large ones, as they are."""

    def run(batches):
        held, pivot, last, out = [], None, None, []

        def flush():
            rows = [pa.array([e[i] for e in out], kind) for i, kind in enumerate((pa.binary(), pa.binary(), pa.binary(), pa.int64()))]
            out.clear()
            return pa.RecordBatch.from_arrays(rows, ["u", "v", "shingles", "n"])

        def close():
            if len(held) > 1:
                r = Region([np.frombuffer(s, np.uint64) for _, s in held], percent)
                r.join(np.arange(len(held)))
                out.extend((held[i][0], held[r.root(i)][0], None, None) for i in range(len(held)) if r.root(i) != i)
            held.clear()

        for batch in batches:
            for p, sig, s, n in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if n is not None:
                    if (p, sig) != last:
                        out.append((p, sig, s, n))
                    last = p, sig
                    if len(out) >= 1000:
                        yield flush()
                    continue
                if p != pivot:
                    close()
                    pivot = p
                if not held or held[-1][0] != sig:
                    held.append((sig, s))
            if len(out) >= 1000:
                yield flush()
        close()
        yield flush()

    return run


def _measure(percent: int):
    """One share of a large region and the region's pivots -> a row a set, with bits for the pivots it is linked to and for the
    Voronoi regions it enters; and the links found, as a forest."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        sigs = left.column("sig").to_pylist() + right.column("sig").to_pylist()
        held = left.column("shingles").to_pylist()
        own, pivots = len(held), right.num_rows
        r = Region([np.frombuffer(x, np.uint64) for x in held + right.column("shingles").to_pylist()], percent)
        members, linked, inside = np.arange(own), np.zeros(own, np.int64), np.zeros(own, np.int64)
        if own and pivots:
            near = np.empty((pivots, own))
            for k in range(pivots):
                shared, size = r.overlaps(members, own + k), r.size[own + k]
                hit = r.linked(shared, r.size[:own], size)
                linked |= hit.astype(np.int64) << k
                for m in members[hit]:
                    r.link(int(m), own + k)
                near[k] = 1 - shared / (r.size[:own] + size - shared)
            window = near <= near.min(axis=0) + 2 * (1 - percent / 100) + 1e-9
            inside = (window.astype(np.int64) << np.arange(pivots)[:, None]).sum(axis=0)
        edges = [(sigs[i], sigs[r.root(i)]) for i in range(len(sigs)) if sigs[r.root(i)] != sigs[i]]
        first = left.column("region").to_pylist()
        none = [None] * len(edges)
        return pa.table({
            "u": pa.array(first + [u for u, _ in edges], pa.binary()), "v": pa.array(sigs[:own] + [v for _, v in edges], pa.binary()), "shingles": pa.array(held + none, pa.binary()),
            "linked": pa.array(linked.tolist() + none, pa.int64()), "inside": pa.array(inside.tolist() + none, pa.int64()),
        })

    return run


def _cut(big: DataFrame, level: int, percent: int, large: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One level of large regions big(region, sig, shingles, n) -> (links, rows of regions and blocks that fit a task, regions still large)."""
    order = F.xxhash64("sig", F.lit(level))
    salts = F.ceil(F.col("n") / large)
    pivots = big.withColumn("h", order).groupBy("region", F.pmod("h", F.lit(PIVOTS)).alias("k")).agg(F.min_by(F.struct("sig", "shingles"), "h").alias("p"), F.first("n").alias("n"))
    pivots = Table(pivots.select("region", "p.sig", "p.shingles", "n"), f"jaccard-pivots-{level}").read()
    dealt = big.withColumn("salt", F.pmod(F.xxhash64("sig"), salts)).select("region", "salt", "sig", "shingles")
    met = pivots.select("region", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"), "sig", "shingles")
    schema = "u binary, v binary, shingles binary, linked long, inside long"
    out = Table(dealt.groupBy("region", "salt").cogroup(met.groupBy("region", "salt")).applyInArrow(_measure(percent), schema), f"jaccard-level-{level}").read()
    links, rows = out.where("shingles IS NULL").select("u", "v"), out.where("shingles IS NOT NULL").withColumnsRenamed({"u": "region", "v": "sig"})

    bit = lambda c, k: F.getbit(c, F.lit(k)) == 1
    counts = [F.count_if(bit("linked", k)).alias(f"l{k}") for k in range(PIVOTS)] + [F.count_if(bit("inside", k)).alias(f"i{k}") for k in range(PIVOTS)]
    open_ = [F.count_if(bit("inside", k) & ~bit("linked", k)).alias(f"o{k}") for k in range(PIVOTS)]
    seen = rows.groupBy("region").agg(F.count(F.lit(1)).alias("n"), *counts, *open_)
    children = F.array(*[F.when(F.col(f"o{k}") > 0, F.struct(F.lit(k).alias("k"), F.col(f"i{k}").alias("size"))) for k in range(PIVOTS)])
    children = F.filter(children, lambda c: c.isNotNull())
    best = F.array_max(F.array(*[F.struct(F.col(f"l{k}").alias("size"), F.lit(k).alias("k")) for k in range(PIVOTS)]))
    seen = seen.select("region", "n", children.alias("children"), best.alias("best")).where("best.size < n")
    widest = F.coalesce(F.array_max(F.transform("children", lambda c: c["size"])), F.lit(0).cast("long"))
    seen = Table(seen.withColumn("cut", (widest <= 0.75 * F.col("n")) & F.lit(level + 1 < LEVELS)), f"jaccard-seen-{level}").read()

    rows = rows.join(seen, "region")
    child = rows.where("cut").withColumn("c", F.explode("children")).where("getbit(inside, c.k) = 1")
    child = child.select(F.unhex(F.sha1(F.concat("region", F.col("c.k").cast("string").cast("binary")))).alias("region"), "sig", "shingles", F.col("c.size").alias("n"))
    block = large // 2
    apart = rows.where("NOT cut").withColumn("free", F.expr("getbit(linked, best.k) = 0"))
    free, tied = F.greatest(F.ceil((F.col("n") - F.col("best.size")) / block), F.lit(1)), F.ceil(F.col("best.size") / block)
    own = F.when(F.col("free"), F.pmod(F.xxhash64("sig"), free)).otherwise(F.pmod(F.xxhash64("sig"), F.greatest(tied, F.lit(1))))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))
    apart = apart.withColumns({"free_blocks": free, "tied_blocks": tied, "own": own})
    name = lambda kind, a, b: F.concat_ws("-", F.lit(kind), a.cast("string"), b.cast("string"))
    among = F.transform(upto(F.col("free_blocks")), lambda x: name("free", F.least(x, F.col("own")), F.greatest(x, F.col("own"))))
    across = F.transform(upto(F.col("tied_blocks")), lambda x: name("tied", F.col("own"), x))
    back = F.transform(upto(F.col("free_blocks")), lambda x: name("tied", x, F.col("own")))
    apart = apart.withColumn("task", F.explode(F.when(F.col("free"), F.concat(among, across)).otherwise(back)))
    apart = apart.select(F.unhex(F.sha1(F.concat("region", F.col("task").cast("binary")))).alias("pivot"), "sig", "shingles")
    fits = child.where(F.col("n") <= large).select(F.col("region").alias("pivot"), "sig", "shingles")
    return links, fits.unionByName(apart), child.where(F.col("n") > large)


def _join_regions(sent: DataFrame, percent: int, large: int) -> DataFrame:
    """Links (u, v) of sent(pivot, sig, shingles, n), n being the size of a large region and NULL in others."""
    parts = shuffle_parts(sent.sparkSession)
    salt = F.when(F.col("n").isNotNull(), F.pmod(F.xxhash64("sig"), F.ceil(F.col("n") / large))).otherwise(0)

    def joined(rows, name):
        rows = rows.repartition(parts, "pivot", salt).sortWithinPartitions("pivot", "sig")
        return Table(rows.select("pivot", "sig", "shingles", "n").mapInArrow(_region_join(percent), OUT), name).read()

    first = joined(sent, "jaccard-edges")
    links = [first.where("shingles IS NULL").select("u", "v")]
    big = first.where("shingles IS NOT NULL").withColumnsRenamed({"u": "region", "v": "sig"})
    for level in range(LEVELS):
        if big.isEmpty():
            break
        found, fits, left = _cut(big, level, percent, large)
        links += [found, joined(fits.withColumn("n", F.lit(None).cast("long")), f"jaccard-edges-{level}").select("u", "v")]
        big = Table(left, f"jaccard-big-{level}").read()
    out = links[0]
    for x in links[1:]:
        out = out.unionByName(x)
    return out


def link_documents(docs: DataFrame, n: int = 5, percent: int = 80, large: int = LARGE) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs(doc_id, text): linked if 100 * shared >= percent * union."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    counts = spark.sparkContext.broadcast(shingle_counts(docs, n))
    sets = Table(docs.mapInArrow(_setter(n, percent, counts), "doc_id long, n long, sig binary, cells array<long>"), "jaccard-sets").read()
    classes = sets.where("sig IS NOT NULL").groupBy("sig").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).getField("doc_id").alias("first"), F.first("cells", True).alias("cells"), F.first("n").cast("int").alias("n"))
    classes = Table(classes, "jaccard-classes").read()
    parts = shuffle_parts(spark)
    cells = classes.select(F.posexplode("cells").alias("place", "cell"), "sig", "n")
    need = F.expr(f"least({SHARED}, ({percent}L * n + 99) div 100)")
    most = F.expr(f"(n - place + {SHARED - 1}) * 100L div {percent}")
    cells = cells.select("cell", "sig", "n", most.cast("int").alias("most"), need.cast("int").alias("need")).repartition(parts, "cell")
    met = cells.mapInArrow(_pivots, "pivot binary, sig binary, need int").groupBy("pivot", "sig").agg(F.count(F.lit(1)).alias("n"), F.min("need").alias("least"), F.max("need").alias("need"))
    met = Table(met.where("least = 0 OR n >= need").select("pivot", "sig"), "jaccard-met").read()
    regions = met.unionByName(met.select("pivot", F.col("pivot").alias("sig"))).distinct()
    regions = Table(regions, "jaccard-regions").read()
    sizes = regions.groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > large)
    shared = spark.sparkContext.broadcast(sigs_filter(regions))
    sized = regions.join(sizes, "pivot", "left")
    sent = docs.select("text").mapInArrow(_sender(n, shared), "sig binary, shingles binary").join(sized.hint("merge"), "sig").select("pivot", "sig", "shingles", "n")
    edges = _join_regions(sent, percent, large)
    roots = components(edges).withColumnRenamed("node", "sig")
    labels = classes.select("sig", "first").join(roots, "sig", "left").select("sig", "first", F.coalesce("root", "sig").alias("root"))
    least = with_least(labels, "root", F.struct(F.col("first").isNotNull().alias("known"), F.col("first").alias("doc_id")), "sig", "least")
    labels = Table(least.select("sig", "least"), "jaccard-labels").read()
    out = sets.select("doc_id", "n", "sig").join(labels, "sig", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("component_id"))


def one_per_group(docs: DataFrame, **options) -> DataFrame:
    """docs with only the smallest doc_id of each component; rows that share an id stay if one of them does.

    The ids that go are fewer than those that stay, so they join.
    """
    linked = link_documents(docs, **options).groupBy(F.col("doc_id").alias("__id")).agg(F.bool_or(F.expr("doc_id <=> component_id")).alias("stays"))
    gone = Table(linked.where("NOT stays").select("__id"), "jaccard-gone").read()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")), "left_anti")


def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return link_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=3, percent=90)
