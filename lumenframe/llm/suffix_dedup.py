"""Exact substring dedup by threshold-bounded interval expansion on a Burrows-Wheeler transform.

A corpus has no single suffix array here. Every window of `length` bytes has an anchor, the leftmost least-hashed gram
of `GRAM` bytes inside it, and holds half of its other bytes before the anchor or after it; equal windows have equal
anchors at equal distances and equal halves. Anchor and half make a key, and windows meet in their keys' regions.
Consecutive windows with one anchor form a segment of at most 2 * length - GRAM bytes and travel together.

1. The keys alone shuffle (packed, 4 bytes each, in buckets that grow in number with the partitions). Those met twice
   enter a Bloom filter of bounded size.
2. Segments with a key that may be repeated shuffle as places and digests, packed, without their bytes. Equal
   segments collapse first, in each task and again in the region: all but the first are repeats from end to end. A key
   whose segments are all equal is settled by that. Of the others, the first segment of each content is still open.
3. Open segments shuffle with their bytes, once for each open key, and are joined into one text with a separate
   terminator each. Its Burrows-Wheeler transform is expanded breadth first, from the interval of the empty string
   backwards by one character a round; a round gives the boundaries whose suffixes have that many bytes in common, so
   common prefixes come by increasing value and the expansion stops at `length`. Boundaries still open then separate
   equal windows, and all of an interval's windows but the first in the corpus are repeats. A key with more than
   `MOST_OPEN` different segments does not gather in one task: its windows are told apart by their digests, with
   partial minima. That number is fixed, whatever the corpus.
4. Repeats return to their documents, which lose the bytes covered. Documents without any do not shuffle.

Documents are ordered by doc_id (null first), then by a hash of their text; rows equal in both are one document
and all get its result. Null and empty texts have nothing to remove. Very long texts are cut into chunks that
overlap, and no window is lost. Texts under `length` bytes stay whole. An empty table gives no rows. Other columns,
whatever their names, are ignored. Segments count as equal if two independent 64-bit hashes of them agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import Bloom, Table, mix, shuffle_parts

GRAM = 50
CHUNK_BITS = 18
FLUSH = 1 << 19
SEGMENT_FLUSH = 1 << 17
NO_ID = -(1 << 63)
#: Bytes of different segments that one transform takes, if no key has more.
TRANSFORM = 1 << 17
#: Different segments of one key that a transform takes.
MOST_OPEN = 20_000
#: Bytes of text for each task of a shuffle.
TASK_BYTES = 1 << 25

#: A 64-bit code for each byte, for digests that are independent of the keys.
BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers modulo 2^64, and their inverses."""
    if n not in _powers:
        inverse = pow(_BASE, -1, 1 << 64)
        out = []
        for b in (_BASE, inverse):
            x = np.full(n, b, np.uint64)
            x[0] = 1
            out.append(np.cumprod(x, dtype=np.uint64))
        _powers[n] = tuple(out)
    return _powers[n]


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text column's bytes in one array, and each row's offsets."""
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def segments(data: np.ndarray, offsets: np.ndarray, length: int, digests: bool = False):
    """(row, first byte, windows, keys before and after the anchor, 0 where no window has that half, digest) arrays of the
    segments, chunk by chunk; digests only if asked for."""
    half = (length - GRAM) // 2
    k, w = GRAM, length - GRAM + 1
    size = (1 << CHUNK_BITS) + length
    up, down = powers(size)
    mask = np.uint64((1 << (CHUNK_BITS + 1)) - 1)
    index = np.arange(size, dtype=np.uint64)
    for c0 in range(int(offsets[0]), int(offsets[-1]), 1 << CHUNK_BITS):
        chunk = data[c0 : min(c0 + (1 << CHUNK_BITS) + length - 1, int(offsets[-1]))]
        n = len(chunk)
        if n < length:
            continue
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((chunk.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        g = mix((sums[k:] - sums[:-k]) * down[: n - k + 1])
        m, width = (g & ~mask) | index[: len(g)], 1
        while width * 2 <= w:
            m = np.minimum(m[:-width], m[width:])
            width *= 2
        if width < w:
            m = np.minimum(m[: -(w - width)], m[w - width :])
        p = (m & mask).astype(np.int64)
        at = np.arange(c0, c0 + len(p))
        row = np.searchsorted(offsets, at[[0, -1]], "right") - 1
        ends = np.minimum(offsets[row[0] + 1 : row[1] + 2], c0 + len(p))
        rows = np.repeat(np.arange(row[0], row[1] + 1), np.diff(np.r_[c0, ends]))
        valid = offsets[rows + 1] - at >= length
        new = np.ones(len(p), bool)
        new[1:] = (p[1:] != p[:-1]) | (rows[1:] != rows[:-1])
        s = np.flatnonzero(new & valid)
        if not len(s):
            continue
        count = np.r_[0, np.cumsum(valid)]
        size, a = np.diff(np.r_[count[s], count[-1]]), p[s]
        left, right = s <= a - half, s + size - 1 > a - half
        keys = np.zeros((2, len(s)), np.uint64)
        for side, on, first, last in ((0, left, a - half, a + k), (1, right, a, a + k + half)):
            first, last = first[on], last[on]
            keys[side, on] = mix(mix((sums[last] - sums[first]) * down[first]) + np.uint64(side + 1)) | np.uint64(1)
        digest = None
        if digests:
            np.cumsum(BYTE_CODES[chunk] * up[:n], out=sums[1:])
            digest = mix((sums[s + size + length - 1] - sums[s]) * down[s])
        yield rows[s], at[s], size, keys, digest


LOW = np.uint64(0xFFFFFFFF)


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return keys >> np.uint64(64 - (buckets - 1).bit_length())


def _packed_keys(length: int, buckets: int):
    def flush(held):
        keys = np.concatenate(held)
        keys, n = np.unique((_bucket(keys, buckets) << np.uint64(32)) | (keys & LOW), return_counts=True)
        keys = np.repeat(keys, np.minimum(n, 2))  # twice is enough to know
        cut = np.searchsorted(keys >> np.uint64(32), np.arange(buckets + 1))
        short, some = (keys & LOW).astype(np.uint32), np.flatnonzero(np.diff(cut))
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([short[cut[b] : cut[b + 1]].tobytes() for b in some], pa.binary())], ["bucket", "keys"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for _, _, _, keys, _ in segments(*column_bytes(batch.column(0)), length):
                held.append(keys[keys > 0])
                n += len(held[-1])
                if n >= FLUSH:
                    yield flush(held)
                    held, n = [], 0
        if held:
            yield flush(held)

    return run


def _slots(short: np.ndarray, bits: int):
    """Two bits inside a bucket's part of the filter, from the low half of a key."""
    for x in (short, mix(short + np.uint64(1))):
        yield (x & np.uint64(bits - 1)).astype(np.int64)


def _repeated(bits: int):
    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for b, x in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                held.setdefault(b, []).append(np.frombuffer(x, np.uint32))
        for b, parts in held.items():
            keys = np.sort(np.concatenate(parts))
            f = np.zeros(bits, np.uint8)
            for at in _slots(keys[1:][keys[1:] == keys[:-1]].astype(np.uint64), bits):
                f[at] = 1
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([np.packbits(f, bitorder="little").tobytes()], pa.binary())], ["bucket", "bits"])

    return run


SEGMENT = np.dtype([("key", "u8"), ("digest", "u8"), ("doc", "i8"), ("tag", "i8"), ("start", "u4"), ("size", "u4")])
SPAN = np.dtype([("doc", "i8"), ("tag", "i8"), ("start", "u4"), ("size", "u4")])


def _blob(a: np.ndarray) -> bytes:
    """A structured array field by field, which compresses better than row by row."""
    return b"".join(np.ascontiguousarray(a[f]).tobytes() for f in a.dtype.names)


def _unblob(blobs: list[bytes], kind: np.dtype) -> np.ndarray:
    out = np.empty(sum(map(len, blobs)) // kind.itemsize, kind)
    at = 0
    for x in blobs:
        n, first = len(x) // kind.itemsize, 0
        for f in kind.names:
            out[f][at : at + n] = np.frombuffer(x, kind[f], n, first)
            first += n * kind[f].itemsize
        at += n
    return out


def _in_order(a: np.ndarray) -> np.ndarray:
    return a[np.lexsort((a["start"], a["tag"], a["doc"]))]


def _joined(a: np.ndarray) -> np.ndarray:
    """Spans with those that touch made one."""
    if not len(a):
        return a
    a = _in_order(a)
    ends = a["start"].astype(np.int64) + a["size"]
    doc = np.r_[0, np.cumsum((a["doc"][1:] != a["doc"][:-1]) | (a["tag"][1:] != a["tag"][:-1]))] << 33
    high = np.maximum.accumulate(ends + doc)
    first = np.flatnonzero(np.r_[True, a["start"][1:] + doc[1:] > high[:-1]])
    out = a[first]
    out["size"] = high[np.r_[first[1:], len(a)] - 1] - doc[first] - out["start"]
    return out


def _later(group: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Which rows have one of the same group before them, given rows in the corpus' order; rows of one place are one."""
    order = np.argsort(group, kind="stable")
    g, place = group[order], a[order]
    head = np.maximum.accumulate(np.where(np.r_[True, g[1:] != g[:-1]], np.arange(len(g)), 0)) if len(g) else order
    out = np.zeros(len(a), bool)
    out[order] = np.logical_or.reduce([place[f] != place[f][head] for f in ("doc", "tag", "start")])
    return out


def _suspects(length: int, buckets: int, filt):
    def flush(held):
        keys, rows = (np.concatenate(x, axis=-1) for x in zip(*held, strict=True))
        order = np.lexsort((rows["start"], rows["tag"], rows["doc"]))
        keys, rows = keys[:, order], rows[order]
        later = np.zeros(len(rows), bool)
        for side in keys:
            on = np.flatnonzero(side > 0)
            later[on] |= _later(mix(side[on]) ^ rows["digest"][on], rows[on])
        spans = np.empty(int(later.sum()), SPAN)
        for f in SPAN.names:
            spans[f] = rows[f][later]
        keys, rows = keys[:, ~later], rows[~later]
        both = []
        for side in keys:
            part = rows[side > 0]
            part["key"] = side[side > 0]
            both.append(part)
        rows = np.concatenate(both)
        of = _bucket(rows["key"], buckets)
        order = np.argsort(of, kind="stable")
        rows, cut = rows[order], np.searchsorted(of[order], np.arange(buckets + 1))
        some = np.flatnonzero(np.diff(cut))
        blobs = [_blob(rows[cut[b] : cut[b + 1]]) for b in some]
        # Spans only pass through, so any bucket will do.
        spans = _joined(spans)
        own = np.r_[some, int(spans["start"].sum() + len(rows)) % buckets]
        return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array([*blobs, b""], pa.binary()), pa.array([*[b""] * len(blobs), _blob(spans)], pa.binary())], ["bucket", "segments", "spans"])

    def run(batches):
        (f, bits), held, n = filt.value, [], 0
        for batch in batches:
            data, offsets = column_bytes(batch.column(0))
            ids = batch.column(1).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            tags = batch.column(2).to_numpy(zero_copy_only=False)
            for rows, at, count, keys, digest in segments(data, offsets, length, True):
                for side in keys:
                    base, on = _bucket(side, buckets).astype(np.int64) * bits, side > 0
                    for slot in _slots(side & LOW, bits):
                        slot = base + slot
                        on &= ((f[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1) == 1
                    side[~on] = 0
                hit = np.flatnonzero(keys.any(axis=0))
                if not len(hit):
                    continue
                out = np.empty(len(hit), SEGMENT)
                out["digest"], out["doc"], out["tag"] = digest[hit], ids[rows[hit]], tags[rows[hit]]
                out["start"], out["size"] = at[hit] - offsets[rows[hit]], count[hit] + length - 1
                held.append((keys[:, hit], out))
                n += len(hit)
                if n >= SEGMENT_FLUSH:
                    yield flush(held)
                    held, n = [], 0
        if held:
            yield flush(held)

    return run


RESOLVED = "doc_id long, tag long, start long, end long, place long, many boolean"


def _place(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A hash of a segment and one of its keys."""
    out = key.astype(np.uint64)
    for x in (doc, tag, start):
        out = mix(out * np.uint64(_BASE) + x.astype(np.int64).view(np.uint64))
    return out


def _resolve(most_open: int):
    """Spans of the repeated segments of a partition's keys (place null), and the segments still open."""

    def run(batches):
        blobs: list[bytes] = []
        spans: list[bytes] = []
        for batch in batches:
            blobs += filter(None, batch.column(1).to_pylist())
            spans += filter(None, batch.column(2).to_pylist())
        rows = _in_order(_unblob(blobs, SEGMENT))
        del blobs
        later = _later(mix(rows["key"]) ^ rows["digest"], rows)
        found = np.empty(int(later.sum()), SPAN)
        for f in SPAN.names:
            found[f] = rows[f][later]
        found = _joined(np.concatenate([_unblob(spans, SPAN), found]))
        rows = rows[~later]
        rows = rows[np.argsort(rows["key"], kind="stable")]
        edge = np.flatnonzero(np.r_[True, rows["key"][1:] != rows["key"][:-1]]) if len(rows) else np.zeros(0, np.int64)
        times = np.diff(np.r_[edge, len(rows)])
        # Rows of one place and key are one segment, so two rows need not be two contents.
        low, high = (f.reduceat(rows["digest"], edge) if len(rows) else edge for f in (np.minimum, np.maximum))
        opened, many = np.repeat(low != high, times), np.repeat(times > most_open, times)
        rows, many = rows[opened], many[opened]
        place = _place(rows["doc"], rows["tag"], rows["start"], rows["key"]).view(np.int64)
        ends = [a["start"].astype(np.int64) + a["size"] for a in (found, rows)]
        cols = [pa.array(np.r_[found[f], rows[f]].astype(np.int64)) for f in ("doc", "tag", "start")]
        places = pa.array(np.r_[np.zeros(len(found), np.int64), place], mask=np.r_[np.ones(len(found), bool), np.zeros(len(rows), bool)])
        cols += [pa.array(np.r_[ends[0], ends[1]]), places, pa.array(np.r_[np.zeros(len(found), bool), many])]
        for batch in pa.Table.from_arrays(cols, names=[x.split()[0] for x in RESOLVED.split(", ")]).to_batches(100_000):
            yield batch

    return run


OPEN = ["key", "doc_id", "tag", "start", "size", "bytes"]
WINDOWS = "digest binary, doc_id long, tag long, start long"


def _open_segments(length: int, shared, many: bool):
    """The open segments with their bytes, a row for each key that is open; or, of keys with too many, the windows' digests."""
    kinds = [pa.binary(), *[pa.int64()] * 3] if many else [*[pa.int64()] * 4, pa.int32(), pa.binary()]
    names = [x.split()[0] for x in WINDOWS.split(", ")] if many else OPEN

    def run(batches):
        f = shared.value
        for batch in batches:
            data, offsets = column_bytes(batch.column(0))
            ids = batch.column(1).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            tags, raw = batch.column(2).to_numpy(zero_copy_only=False), memoryview(data)
            for rows, at, count, keys, _ in segments(data, offsets, length):
                doc, tag, start = ids[rows], tags[rows], at - offsets[rows]
                out: list[tuple] = []
                for side in keys:
                    hit = np.flatnonzero(f.has(_place(doc, tag, start, side)) & (side > 0))
                    for key, d, t, s, first, n in zip(*(c[hit].tolist() for c in (side.view(np.int64), doc, tag, start, at, count)), strict=True):
                        if many:
                            out += [(xxhash.xxh3_128_digest(raw[first + i : first + i + length]), d, t, s + i) for i in range(n)]
                        else:
                            out.append((key, d, t, s, n + length - 1, bytes(raw[first : first + n + length - 1])))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return run


def suffix_order(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and ranks of a text whose terminators all differ, by prefix doubling from four characters."""
    n, size = len(text), int(text.max()) + 2
    padded = np.r_[text + 1, np.zeros(3, np.int64)]
    if size**4 < 1 << 62:
        key, h = ((padded[:n] * size + padded[1 : n + 1]) * size + padded[2 : n + 2]) * size + padded[3 : n + 3], 4
    else:
        key, h = padded[:n], 1
    while True:
        sa = np.argsort(key, kind="stable")
        new = np.ones(n, bool)
        new[1:] = key[sa[1:]] != key[sa[:-1]]
        rank = np.empty(n, np.int64)
        rank[sa] = np.cumsum(new) - 1
        if new.all():
            return sa, rank
        key = (rank + 1) * (n + 1)
        key[: n - h] += rank[h:] + 1
        h *= 2


def equal_prefixes(text: np.ndarray, sa: np.ndarray, rank: np.ndarray, length: int) -> np.ndarray:
    """A number for each rank; suffixes get the same one if they have `length` characters in common."""
    n = len(text)
    bwt, back = text[sa - 1], rank[sa - 1]  # the character before each suffix, and the suffix that begins with it
    open_ = np.ones(n + 1, bool)  # boundaries whose common prefix is not known yet
    open_[0] = open_[n] = False
    wide = int(text.max()) + 1
    lo, hi = np.array([0]), np.array([n - 1])
    for _ in range(length):
        if not len(lo):
            break
        one = lo == hi
        single = back[lo[one]]
        lo, hi = lo[~one], hi[~one]
        size = hi - lo + 1
        which = np.repeat(np.arange(len(lo)), size)
        at = np.arange(len(which)) - np.repeat(np.cumsum(size) - size - lo, size)
        key = which * wide + bwt[at]
        order = np.argsort(key, kind="stable")
        key, to = key[order], back[at[order]]
        edge = np.flatnonzero(key[1:] != key[:-1]) + 1
        first, last = (np.r_[0, edge], np.r_[edge, len(key)] - 1) if len(key) else (edge, edge)
        lo, hi = np.r_[to[first], single], np.r_[to[last], single]
        new = open_[hi + 1]
        # Intervals of one round end at different ranks, but for equal ones.
        hi, pick = np.unique(hi[new], return_index=True)
        lo = lo[new][pick]
        open_[hi + 1] = False
    return np.cumsum(~open_[:n])


def repeats(parts: list[bytes], doc: np.ndarray, tag: np.ndarray, start: np.ndarray, length: int):
    """(part, first byte, end) of the runs of windows that another part has, or that part itself, earlier in the corpus."""
    size = np.array([len(p) for p in parts])
    n = int(size.sum()) + len(parts)
    text = np.empty(n, np.int64)
    ends = np.cumsum(size + 1) - 1
    body = np.ones(n, bool)
    body[ends] = False
    text[ends] = np.arange(len(parts))
    text[body] = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64) + len(parts)
    sa, rank = suffix_order(text)
    group = equal_prefixes(text, sa, rank, length)[rank]
    part = np.repeat(np.arange(len(parts)), size + 1)
    place = np.arange(n) - np.repeat(ends - size, size + 1)
    window = np.flatnonzero(place + length <= size[part])
    order = window[np.lexsort((start[part[window]] + place[window], tag[part[window]], doc[part[window]], group[window]))]
    of = group[order]
    head = np.maximum.accumulate(np.where(np.r_[True, of[1:] != of[:-1]], np.arange(len(of)), 0)) if len(of) else of
    lead, p = order[head], part[order]
    # A row that is there twice is one document: its window is not earlier than itself.
    own = (doc[p] == doc[part[lead]]) & (tag[p] == tag[part[lead]]) & (start[p] + place[order] == start[part[lead]] + place[lead])
    later = order[~own]
    later.sort()
    if not len(later):
        return later, later, later
    cut = np.flatnonzero((np.diff(later) > 1) | (part[later[1:]] != part[later[:-1]])) + 1
    a, b = later[np.r_[0, cut]], later[np.r_[cut, len(later)] - 1]
    return part[a], place[a], place[b] + length


SPANS = "doc_id long, tag long, start long, end long"


def _regions(length: int):
    """The spans that the transforms of a partition's keys find."""

    def run(batches):
        cols, held = [[] for _ in range(5)], []
        for batch in batches:
            for c, x in zip(cols, batch.columns[:5], strict=True):
                c.append(x.to_numpy(zero_copy_only=False))
            held += batch.column(5).to_pylist()
        if not held:
            return
        key, doc, tag, start, size = map(np.concatenate, cols)
        some = np.lexsort((start, tag, doc, key))
        key, at = key[some], 0
        while at < len(some):
            end, total = at, 0
            while end < len(some) and (total < TRANSFORM or key[end] == key[end - 1]):
                total += int(size[some[end]])
                end += 1
            own = some[at:end]
            part, a, b = repeats([held[i] for i in own], doc[own], tag[own], start[own], length)
            own = own[part]
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in (doc[own], tag[own], start[own] + a, start[own] + b)], ["doc_id", "tag", "start", "end"])
            at = end

    return run


def merged(spans: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


OUT = "doc_id long, kept binary, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>"


def _results(ids: pa.Array, texts: pa.Array, found: list) -> pa.RecordBatch:
    kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    rows, kept = [], []
    for x, spans in zip(texts.cast(pa.large_binary()).to_pylist(), found, strict=True):
        x = x or b""
        spans = merged([(s["start"], s["end"]) for s in spans or ()])
        at, left = 0, []
        for a, b in spans:
            left.append(x[at:a])
            at = b
        kept.append(b"".join([*left, x[at:]]))
        rows.append((len(x), len(x) - len(kept[-1]), [{"start": a, "end": b} for a, b in spans]))
    n, gone, spans = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([ids, pa.array(kept, pa.binary()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, kinds)], ["doc_id", "kept", "n_bytes", "n_removed", "spans"])


def _cut(batches):
    for whole in batches:
        for first in range(0, whole.num_rows, 1000):
            batch = whole.slice(first, 1000)
            yield _results(batch.column(0), batch.column(1), batch.column(2).to_pylist())


def _only(affected, cut: bool):
    """The rows of the documents that may have repeats; or the results of those that have none, without a shuffle."""

    def run(batches):
        for whole in batches:
            for first in range(0, whole.num_rows, 1000):
                batch = whole.slice(first, 1000)
                ids = batch.column(1).fill_null(NO_ID).to_numpy(zero_copy_only=False)
                on = affected.value.has(_document(ids, batch.column(2).to_numpy(zero_copy_only=False)))
                batch = batch.filter(pa.array(on != cut))
                if not cut:
                    yield batch
                elif batch.num_rows:
                    yield _results(batch.column(1), batch.column(0), [None] * batch.num_rows)

    return run


def _document(ids: np.ndarray, tags: np.ndarray) -> np.ndarray:
    return mix(mix(ids.view(np.uint64)) ^ tags.view(np.uint64))


def _documents(batches):
    for batch in batches:
        ids, tags = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
        yield pa.RecordBatch.from_arrays([pa.array(_document(ids, tags).view(np.int64))], ["h"])


def dedup_substrings(docs: DataFrame, length: int = 100, most_bits: int = 1 << 29, most_open: int = MOST_OPEN) -> DataFrame:
    """doc_id, kept (the bytes left), n_bytes, n_removed, spans (maximal removed runs) of every row of docs(doc_id, text)."""
    if length <= GRAM:
        raise ValueError(f"windows must be longer than the anchors' {GRAM} bytes")
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    docs = docs.select("text", "doc_id", F.xxhash64("text").alias("tag"))
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(shuffle_parts(spark), total // TASK_BYTES)
    buckets = 1 << (4 * parts - 1).bit_length()
    bits = max(64, min(most_bits, 1 << (total // 8).bit_length()) // buckets)
    packed = docs.select("text").mapInArrow(_packed_keys(length, buckets), "bucket int, keys binary").repartition(parts, "bucket")
    filt = np.zeros(buckets * bits >> 3, np.uint8)
    for r in packed.mapInArrow(_repeated(bits), "bucket int, bits binary").collect():  # most_bits bits in all
        filt[r["bucket"] * bits >> 3 : (r["bucket"] + 1) * bits >> 3] = np.frombuffer(bytes(r["bits"]), np.uint8)
    filt = share((filt, bits))
    suspects = docs.mapInArrow(_suspects(length, buckets, filt), "bucket int, segments binary, spans binary").repartition(parts, "bucket")
    resolved = Table(suspects.mapInArrow(_resolve(most_open), RESOLVED), "segments").read()
    filt.unpersist()
    spans = resolved.where("place IS NULL").select("doc_id", "tag", "start", "end")
    for many in (False, True):
        own = Bloom.of(resolved.where(F.col("place").isNotNull() & (F.col("many") == many)).select(F.col("place").alias("h")), most_bits)
        if own is None:
            continue
        own = share(own)
        if many:
            windows = Table(docs.mapInArrow(_open_segments(length, own, True), WINDOWS), "windows").read()
            first = windows.groupBy("digest").agg(F.min(F.struct("doc_id", "tag", "start")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
            found = windows.join(first, "digest").where(F.struct("doc_id", "tag", "start") != F.col("first")).select("doc_id", "tag", "start", (F.col("start") + length).alias("end"))
        else:
            opened = docs.mapInArrow(_open_segments(length, own, False), "key long, doc_id long, tag long, start long, size int, bytes binary")
            found = opened.repartition(parts, "key").mapInArrow(_regions(length), SPANS)
        spans = spans.unionByName(Table(found, "repeats").read())
        own.unpersist()
    by_doc = Table(spans.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "by-document").read()
    affected = share(Bloom.of(by_doc.select("doc_id", "tag").mapInArrow(_documents, "h long"), most_bits) or Bloom(64))
    by_doc = by_doc.select(F.col("doc_id").alias("__id"), F.col("tag").alias("__tag"), "spans")
    same = (F.coalesce("doc_id", F.lit(NO_ID)) == F.col("__id")) & (F.col("tag") == F.col("__tag"))
    hit = docs.mapInArrow(_only(affected, False), docs.schema).join(by_doc, same, "left").select("doc_id", "text", "spans")
    return hit.mapInArrow(_cut, OUT).unionByName(docs.mapInArrow(_only(affected, True), OUT))


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
