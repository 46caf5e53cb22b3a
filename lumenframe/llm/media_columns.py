"""Media columns: texts kept as progressive JPEG, and progressive JPEG decoded to RGB tensors.

`store` keeps a payload without loss in the format's own unit, quantised coefficients: byte - 128 is one coefficient, a block of 64 in zigzag
order, two thirds of the blocks luma and the rest chroma of half width and height, on a nearly square grid of macroblocks. Nothing is
transformed or rounded when it is written, and all quantisers are 1. Seven scans carry it: direct terms less their last bit, a low luma
band less its last bit, both chroma planes, the rest of luma, and the two refinements. Restart markers after every few blocks make
short bit streams of their own.

`load` reads any progressive JPEG with Huffman codes (8 bits, one or three components, any whole sampling factors, restarts or
none): scans fill coefficient arrays, first those of spectral selection, then the refinements bit by bit; an inverse transform
in numpy makes samples, chroma is repeated to full resolution, and the result is a height x width x 3 tensor of bytes. All
arithmetic after the coefficients is in whole numbers, so equal files have equal tensors whatever else is decoded beside them.

Python sees no symbol one by one: the bit streams of all scans and images of a batch advance in step, one numpy operation for
all of them, so a batch costs as many steps as its longest stream has symbols.

Nulls and empty texts are a payload of 192 spaces; a null key stays. Very long texts are one image each, up to 6 GB (an image's sides have 16 bits). Equal
texts have equal values, and a task computes a text that it met before only once. Empty tables give no rows; repeated rows stay. `load`
gives null and an error's text for a null or what is not such a file. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import zlib
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT, RESTART = 192, 8
#: Bytes of texts or files that are taken together, bit streams that are written and bytes of them that are read in step (a longer
#: file takes several turns), and contents whose results a task remembers.
TOGETHER, STREAMS, STREAM_BYTES, REMEMBERED = 2 << 20, 4096, 4 << 20, 20_000
STORED = "media binary, n_bytes long"
DIGESTS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
TENSOR = "height int, width int, rgb binary, error string"

# -- tables that follow from rules

ORDER = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (p[0] + p[1], p[(p[0] + p[1] + 1) % 2]))  # zigzag
SCALE = 14


def _inverse() -> np.ndarray:
    """Row z: what a coefficient at zigzag place z adds to the 64 samples, times 2^SCALE, as whole doubles."""
    t = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.5) if u == 0 else 1) / 2 for x in range(8)] for u in range(8)])
    return np.stack([np.round(np.outer(t[v], t[u]) * (1 << SCALE)).ravel() for v, u in ORDER])


INVERSE = _inverse()


class Code:
    """A canonical Huffman code from (symbols of 1 bit, of 2 bits, ...)."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.counts, self.symbols = counts, symbols
        self.value, self.length = np.zeros(256, np.int64), np.zeros(256, np.int64)
        self.prefix = np.zeros(1 << 16, np.int32)  # by 16 bits: length << 8 | symbol; 0 where no code begins so
        code, at = 0, 0
        for n in range(1, 17):
            for s in symbols[at : at + counts[n - 1]]:
                self.value[s], self.length[s] = code, n
                self.prefix[code << 16 - n : code + 1 << 16 - n] = n << 8 | s
                code += 1
            at += counts[n - 1]
            code <<= 1

    @classmethod
    def of(cls, lengths: dict[int, list[int]]) -> Code:
        return cls(bytes(len(lengths.get(n, ())) for n in range(1, 17)), bytes(s for n in sorted(lengths) for s in lengths[n]))

    def segment(self, kind: int) -> bytes:
        return bytes([kind]) + self.counts + self.symbols


#: Sizes of direct terms in 4 bits. Of the others, sizes that letters have in 3 bits, the rest of those without a run and the end of a block in 4.
DIRECT = Code.of({4: list(range(12))})
SHORT = [3, 4, 5], [0, 1, 2, 6, 7]
BANDS = Code.of({3: SHORT[0], 4: SHORT[1], 10: [s for s in (*(r << 4 | n for r in range(16) for n in range(11)),) if s not in SHORT[0] + SHORT[1]]})
SIZE = np.array([int(x).bit_length() for x in range(1 << 12)], np.int64)

# -- writing


def grid(units: int) -> tuple[int, int]:
    """Columns and rows of macroblocks that hold so many units of three blocks."""
    n = -(-units // 2)
    w = int(np.ceil(np.sqrt(n)))
    if w > 4095:
        raise OverflowError("a text of over 6 GB doesn't fit an image")
    return w, -(-n // w)


@functools.lru_cache(256)
def macroblocks(w: int, h: int) -> np.ndarray:
    """The four luma blocks of each macroblock."""
    row, col = np.divmod(np.arange(w * h), w)
    return (4 * w * row + 2 * col)[:, None] + [0, 1, 2 * w, 2 * w + 1]


def _streams(value: np.ndarray, bits: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Bit strings of items, those from first[i] on in stream i, each filled up with ones to whole bytes and with zeros stuffed in."""
    ends = np.append(first[1:], len(bits))
    total = np.concatenate([[0], np.cumsum(bits)])
    length = total[ends] - total[first]
    size = (length + 7) >> 3
    start = np.concatenate([[0], np.cumsum(size)])
    at = total[:-1] + np.repeat(8 * start[:-1] - total[first], ends - first)
    fill = 8 * size - length  # items of their own
    value, bits, at = np.concatenate([value, (1 << fill) - 1]), np.concatenate([bits, fill]), np.concatenate([at, 8 * start[:-1] + length])
    word, wide = at >> 5, value.astype(np.uint64) << (64 - bits - (at & 31)).astype(np.uint64) % np.uint64(64)
    wide[bits == 0] = 0
    n = int(start[-1] >> 2) + 3
    words = np.bincount(word, (wide >> np.uint64(32)).astype(np.float64), n)
    words += np.bincount(word + 1, (wide & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
    data = words.astype(np.uint32).astype(">u4").tobytes()
    cuts = start.tolist()
    return [data[a:b].replace(b"\xff", b"\xff\x00") for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Size and extra bits of numbers."""
    size = SIZE[np.abs(m)]
    return size, m + (m < 0) * ((1 << size) - 1)


def _band(c: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Items of a band's first scan, less `low` bits: values, bits, and the first item of each block."""
    m = np.sign(c) * (np.abs(c) >> low)
    width, there = m.shape[1], m != 0
    block, pos = np.nonzero(there)
    per = there.sum(1)
    first = np.cumsum(per) - per
    run = np.diff(pos, prepend=0) - 1
    head = first[per > 0]
    run[head] = pos[head]
    size, extra = _signed(m[there])
    symbol = (run & 15) << 4 | size
    last = np.full(len(m), -1)
    last[per > 0] = pos[(first + per - 1)[per > 0]]
    ends = last < width - 1
    longs = np.cumsum(run >> 4)
    end_before = np.concatenate([[0], np.cumsum(ends)])
    through = np.cumsum(per)
    all_longs = np.concatenate([[0], longs])[through]
    n = len(pos) + int(longs[-1] if len(longs) else 0) + int(end_before[-1])
    value, bits = np.full(n, BANDS.value[0xF0]), np.full(n, BANDS.length[0xF0])
    to = np.arange(len(pos)) + longs + end_before[block]
    value[to], bits[to] = BANDS.value[symbol] << size | extra, BANDS.length[symbol] + size
    to = (through + all_longs + end_before[:-1])[ends]
    value[to], bits[to] = BANDS.value[0], BANDS.length[0]
    return value, bits, np.concatenate([[0], (through + all_longs + end_before[1:])[:-1]])


def _refined(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Items of the scan that adds the last bit of a band of fewer than 16 places, whose other bits are there."""
    n, width = c.shape
    value, bits = np.zeros((n, width + 1), np.int64), np.zeros((n, width + 1), np.int64)
    run, held, many = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k in range(width):
        t = np.abs(c[:, k])
        old, new = t > 1, t == 1
        symbol = run << 4 | 1
        value[new, k] = ((BANDS.value[symbol] << 1 | (c[:, k] > 0)) << many | held)[new]
        bits[new, k] = (BANDS.length[symbol] + 1 + many)[new]
        held, many = np.where(old, held << 1 | t & 1, np.where(new, 0, held)), np.where(old, many + 1, np.where(new, 0, many))
        run = np.where(new, 0, run + (t == 0))
    ends = (run > 0) | (many > 0)
    value[ends, width] = (BANDS.value[0] << many | held)[ends]
    bits[ends, width] = (BANDS.length[0] + many)[ends]
    there = bits > 0
    first = np.concatenate([[0], np.cumsum(there.sum(1))[:-1]])
    return value[there], bits[there], first


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


HEAD = b"\xff\xd8" + _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
TABLES = _segment(0xDB, b"\0" + b"\1" * 64) + _segment(0xC4, DIRECT.segment(0)) + _segment(0xC4, BANDS.segment(0x10)) + _segment(0xDD, struct.pack(">H", RESTART))
RESTARTS = [bytes([0xFF, 0xD0 + i]) for i in range(8)]
NOTE = b"payload bytes: "


def _scan(components: tuple[int, ...], first: int, last: int, high: int, low: int) -> bytes:
    return _segment(0xDA, bytes([len(components), *(x for c in components for x in (c, 0)), first, last, high << 4 | low]))


def _joined(streams: list[bytes]) -> bytes:
    out = []
    for i, s in enumerate(streams):
        out += [s, RESTARTS[i % 8]]
    return b"".join(out[:-1])


def encode(payloads: list[bytes]) -> list[bytes]:
    """One file for each payload, whose length is a positive multiple of UNIT."""
    grids, lumas, chromas = [], [], ([], [])
    for p in payloads:
        units = len(p) // UNIT
        w, h = grid(units)
        c = np.frombuffer(p, np.uint8).astype(np.int16).reshape(-1, 64) - 128
        cut = [2 * units, 2 * units + -(-units // 2)]
        parts = [np.zeros((n, 64), np.int16) for n in (4 * w * h, w * h, w * h)]
        for part, own in zip(parts, np.split(c, cut), strict=True):
            part[: len(own)] = own
        grids.append((w, h))
        lumas.append(parts[0])
        chromas[0].append(parts[1])
        chromas[1].append(parts[2])
    luma, blue, red = (np.concatenate(x) for x in (lumas, *chromas))
    macro = np.array([w * h for w, h in grids])

    def restarts(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where streams begin among all images' blocks (or macroblocks), and where each image's streams do."""
        n = -(-blocks // RESTART)
        begin = np.concatenate([[0], np.cumsum(blocks)[:-1]])
        images = np.concatenate([[0], np.cumsum(n)])
        return np.repeat(begin, n) + RESTART * (np.arange(images[-1]) - np.repeat(images[:-1], n)), images

    def plane(items, c: np.ndarray, low: int, high: int, blocks) -> list[bytes]:
        starts, images = restarts(blocks)
        ends, streams = np.append(starts[1:], len(c)), []
        for at in range(0, len(starts), STREAMS):
            own = starts[at : at + STREAMS]
            value, bits, first = items(c[own[0] : ends[at + len(own) - 1], low : high + 1].astype(np.int64))
            streams += _streams(value, bits, first[own - own[0]])
        return [_joined(streams[a:b]) for a, b in zip(images, images[1:], strict=False)]

    def whole(c):
        return _band(c, 0)

    # Direct terms in the order of macroblocks.
    begin = np.concatenate([[0], np.cumsum(4 * macro)[:-1]])
    rows = np.concatenate([macroblocks(w, h) + b for (w, h), b in zip(grids, begin, strict=True)])
    direct = np.concatenate([luma[rows, 0], blue[:, :1], red[:, :1]], 1).astype(np.int64)
    starts, images = restarts(macro)
    m = direct >> 1
    before = np.concatenate([np.zeros((1, 6), np.int64), m[:-1]])
    before[starts] = 0
    before = np.concatenate([before[:, 3:4], m[:, :3], before[:, 4:]], 1)
    size, extra = _signed(m - before)
    streams = _streams((DIRECT.value[size] << size | extra).ravel(), (DIRECT.length[size] + size).ravel(), 6 * starts)
    refined = _streams((direct & 1).ravel(), np.ones(direct.size, np.int64), 6 * starts)
    of = [[_joined(s[a:b]) for a, b in zip(images, images[1:], strict=False)] for s in (streams, refined)]
    scans = [
        (_scan((1, 2, 3), 0, 0, 0, 1), of[0]),
        (_scan((1,), 1, 5, 0, 1), plane(lambda c: _band(c, 1), luma, 1, 5, 4 * macro)),
        (_scan((2,), 1, 63, 0, 0), plane(whole, blue, 1, 63, macro)),
        (_scan((3,), 1, 63, 0, 0), plane(whole, red, 1, 63, macro)),
        (_scan((1,), 6, 63, 0, 0), plane(whole, luma, 6, 63, 4 * macro)),
        (_scan((1,), 1, 5, 1, 0), plane(_refined, luma, 1, 5, 4 * macro)),
        (_scan((1, 2, 3), 0, 0, 1, 0), of[1]),
    ]
    out = []
    for i, (p, (w, h)) in enumerate(zip(payloads, grids, strict=True)):
        frame = _segment(0xC2, struct.pack(">BHHB", 8, 16 * h, 16 * w, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
        out.append(b"".join([HEAD, _segment(0xFE, NOTE + b"%d" % len(p)), TABLES, frame, *(x for head, data in scans for x in (head, data[i])), b"\xff\xd9"]))
    return out


# -- reading

MARKER, RST = re.compile(rb"\xff[^\x00\xff\xd0-\xd7]"), re.compile(rb"\xff+[\xd0-\xd7]")


class Plane:
    """A component: its sampling, its blocks in width and height as coded alone and as stored, and where they are stored."""

    def __init__(self, h: int, v: int, table: int):
        self.h, self.v, self.table, self.first = h, v, table, 0


@functools.lru_cache(512)
def block_order(columns: int, rows: int, planes: tuple, only: int | None) -> tuple[np.ndarray, np.ndarray, int]:
    """For an image of so many macroblocks and planes (h, v, first, stride, alone): its stored blocks in the order of a scan of all planes in turn, or of
    plane `only`, the plane of each, and blocks in a restart unit."""
    if only is not None:
        _, _, first, stride, (w, h) = planes[only]
        order = (np.arange(h)[:, None] * stride + np.arange(w)).ravel() + first
        return order, np.zeros(len(order), np.int64), 1
    row, col = np.divmod(np.arange(rows * columns), columns)
    places = [(i, first + (row * v + y) * stride + col * h + x) for i, (h, v, first, stride, _) in enumerate(planes) for y in range(v) for x in range(h)]
    return np.stack([x for _, x in places], 1).ravel(), np.tile([i for i, _ in places], len(row)), len(places)


class Image:
    """The parsed frame of a file. `planes` by component; coefficients lie in the batch's array."""

    def __init__(self):
        self.planes: dict[int, Plane] = {}
        self.quant: dict[int, np.ndarray] = {}
        self.height = self.width = self.blocks = 0
        self.payload_bytes: int | None = None
        self.error: str | None = None

    def lay_out(self, first: int) -> int:
        """Places of the planes from block `first` on; the number of blocks."""
        wide, high = max(p.h for p in self.planes.values()), max(p.v for p in self.planes.values())
        self.columns, self.rows = -(-self.width // (8 * wide)), -(-self.height // (8 * high))
        self.first = at = first
        for p in self.planes.values():
            p.first, p.stride, p.lines = at, self.columns * p.h, self.rows * p.v
            p.alone = -(-(-(-self.width * p.h // wide)) // 8), -(-(-(-self.height * p.v // high)) // 8)
            at += p.stride * p.lines
        self.blocks = at - first
        return self.blocks

    def scan_order(self, ids: list[int]) -> tuple[np.ndarray, np.ndarray, int]:
        """Stored blocks in a scan's order, the component (by place in ids) of each, and blocks in a restart unit."""
        planes = tuple((p.h, p.v, p.first - self.first, p.stride, p.alone) for p in (self.planes[c] for c in ids))
        order, comps, unit = block_order(self.columns, self.rows, planes, 0 if len(ids) == 1 else None)
        return order + self.first, comps, unit


@functools.lru_cache(64)
def _code(counts: bytes, symbols: bytes) -> Code:
    return Code(counts, symbols)


class Lanes:
    """Bit streams of one kind of scan, to be read in step."""

    def __init__(self):
        self.parts: list[tuple] = []  # (image, orders, components, unit, streams, interval, ss, se, al, codes)

    def add(self, *scan) -> None:
        self.parts.append(scan)


class Batch:
    """Files that are decoded together."""

    def __init__(self, files: list[bytes]):
        self.images, self.codes, self.code_ids = [], [], {}
        self.kinds: dict[tuple, Lanes] = {}
        n = 0
        for data in files:
            image = Image()
            try:
                scans = self._parse(data, image)
                n += image.lay_out(n)
                for scan in scans:
                    self._add(image, *scan)
            except (ValueError, IndexError, KeyError, struct.error, ZeroDivisionError) as e:
                image.error = f"not a progressive JPEG that can be read: {e}"
                image.planes = {}
            self.images.append(image)
        self.coef = np.zeros((n + 1) * 64, np.int16)  # the last block takes what isn't to be kept
        self.dummy = n * 64
        # First scans in any order, then refinements from the higher bit down.
        for key in sorted(self.kinds, key=lambda k: (k[0] > 0, -k[0], k[1])):
            self._read(key, self.kinds[key])

    def _parse(self, data: bytes, image: Image) -> list[tuple]:
        if data[:2] != b"\xff\xd8":
            raise ValueError("no start of image")
        at, interval, codes, scans = 2, 0, {}, []
        while True:
            while data[at] == 0xFF and data[at + 1] == 0xFF:
                at += 1
            if data[at] != 0xFF:
                raise ValueError("no marker where one must be")
            marker = data[at + 1]
            if marker == 0xD9:
                break
            size = struct.unpack_from(">H", data, at + 2)[0]
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if len(body) != size - 2:
                raise ValueError("a segment is cut off")
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    n = 64 << wide
                    image.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int64)
                    body = body[1 + n :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    codes[body[0]] = self._id(body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xDD:
                interval = struct.unpack(">H", body)[0]
            elif marker == 0xC2:
                bits, image.height, image.width, n = struct.unpack_from(">BHHB", body)
                if bits != 8 or n not in (1, 3) or not image.height or not image.width:
                    raise ValueError(f"{n} components of {bits} bits, {image.width} x {image.height}")
                for i in range(n):
                    c, hv, table = body[6 + 3 * i : 9 + 3 * i]
                    image.planes[c] = Plane(hv >> 4, hv & 15, table)
                if n == 1:  # sampling factors of a single component mean nothing
                    for p in image.planes.values():
                        p.h = p.v = 1
                tops = max(p.h for p in image.planes.values()), max(p.v for p in image.planes.values())
                if any(tops[0] % p.h or tops[1] % p.v for p in image.planes.values()):
                    raise ValueError("sampling factors that aren't whole")
            elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
                raise ValueError(f"frame type {marker:02x}")
            elif marker == 0xFE and body.startswith(NOTE):
                image.payload_bytes = int(body[len(NOTE) :])
            elif marker == 0xDA:
                n = body[0]
                ids, tables = list(body[1 : 1 + 2 * n : 2]), list(body[2 : 2 + 2 * n : 2])
                ss, se, ahl = body[1 + 2 * n : 4 + 2 * n]
                if not image.planes or any(i not in image.planes for i in ids) or se > 63 or ss > se or (ss and n > 1) or (not ss and se):
                    raise ValueError("a scan of no progressive frame")
                end = MARKER.search(data, at)
                if not end:
                    raise ValueError("the file is cut off")
                end = end.start()
                use = [codes.get(t >> 4 if not ss else 0x10 | t & 15) for t in tables] if not ahl >> 4 or ss else [0] * n
                if None in use:
                    raise ValueError("a scan without its code")
                scans.append((ids, use, ss, se, ahl >> 4, ahl & 15, interval, [s.replace(b"\xff\x00", b"\xff") for s in RST.split(data[at:end])]))
                at = end
        if not image.planes:
            raise ValueError("no frame")
        if any(p.table not in image.quant for p in image.planes.values()):
            raise ValueError("no quantisation table")
        return scans

    def _id(self, counts: bytes, symbols: bytes) -> int:
        key = (counts, symbols)
        if key not in self.code_ids:
            self.code_ids[key] = len(self.codes)
            self.codes.append(_code(*key))
        return self.code_ids[key]

    def _add(self, image: Image, ids, use, ss, se, ah, al, interval, streams) -> None:
        order, comps, unit = image.scan_order(ids)
        per = interval * unit or len(order)
        starts = np.arange(0, len(order), per)
        if len(starts) > len(streams):
            raise ValueError("a scan is cut off")
        key = (ah, "direct" if ss == 0 else "band")
        self.kinds.setdefault(key, Lanes()).add(order, comps, starts, np.minimum(starts + per, len(order)), streams[: len(starts)], ss, se, al, use)

    def _read(self, key: tuple, lanes: Lanes) -> None:
        parts = lanes.parts
        sizes = np.array([len(p[0]) for p in parts])
        base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.order = np.concatenate([*(p[0] for p in parts), [self.dummy // 64]])
        n = np.array([len(p[2]) for p in parts])
        at = np.concatenate([p[2] + b for p, b in zip(parts, base, strict=True)])
        end = np.concatenate([p[3] + b for p, b in zip(parts, base, strict=True)])
        streams = [s for p in parts for s in p[4]]
        lengths = np.array([len(s) for s in streams], np.int64)
        ss, se, al = (np.repeat([p[i] for p in parts], n).astype(np.int64) for i in (5, 6, 7))
        use = np.repeat(np.array([[*p[8], 0, 0][:3] for p in parts], np.int64) << 16, n, axis=0)
        comps = np.concatenate([*(p[1] for p in parts), [0]])
        turn = np.cumsum(lengths) // STREAM_BYTES
        for own in np.split(np.arange(len(streams)), np.flatnonzero(np.diff(turn)) + 1):
            lo, hi = own[0], own[-1] + 1
            data = np.frombuffer(b"".join([*streams[lo:hi], b"\xff" * 8]), np.uint8)
            first = 8 * (np.cumsum(lengths[lo:hi]) - lengths[lo:hi])
            if key[1] == "band":
                (self._refine if key[0] else self._bands)(_windows(data), first, at[lo:hi], end[lo:hi], ss[lo:hi], se[lo:hi], al[lo:hi], use[lo:hi, 0])
            elif key[0]:
                self._refine_direct(data, first, at[lo:hi], end[lo:hi], al[lo:hi])
            else:
                self._direct(_windows(data), first, at[lo:hi], end[lo:hi], al[lo:hi], use[lo:hi], comps)

    def _direct(self, windows, p, at, end, al, use, comps) -> None:
        """Differences of direct terms, one block of every stream a step."""
        prefix = np.concatenate([c.prefix for c in self.codes])
        seen, last = np.zeros(use.shape, np.int64), len(windows) - 1
        rows = np.arange(len(p))
        while len(p):
            w, left = windows[np.minimum(p >> 3, last)], 40 - (p & 7)
            comp = comps[at]
            e = prefix[use[rows, comp] + (w >> left - 16 & 0xFFFF)]
            n = e & 15
            total = (e >> 8) + n
            extra = w >> left - total & (1 << n) - 1
            seen[rows, comp] += extra - np.where(extra < (1 << n >> 1), (1 << n) - 1, 0)
            self.coef[self.order[at] * 64] = seen[rows, comp] << al
            p, at = p + total, at + 1
            on = at < end
            if not on.all():
                p, at, end, al, use, seen = p[on], at[on], end[on], al[on], use[on], seen[on]
                rows = np.arange(len(p))

    def _refine_direct(self, data, p, at, end, al) -> None:
        n = end - at
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        bit = np.minimum(np.repeat(p, n) + step, 8 * len(data) - 1)
        found = data[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1
        self.coef[self.order[np.repeat(at, n) + step] * 64] |= (found.astype(np.int64) << np.repeat(al, n)).astype(np.int16)

    def _bands(self, windows, p, at, end, ss, se, al, use) -> None:
        """First scans of bands, one symbol of every stream a step."""
        prefix = np.concatenate([_acting(c.counts, c.symbols) for c in self.codes])
        last, none, k, steps = len(windows) - 1, len(self.order) - 1, ss.copy(), 0
        while len(p):
            w, left = windows[np.minimum(p >> 3, last)], 40 - (p & 7)
            e = prefix[use + (w >> left - 16 & 0xFFFF)]
            total, n, kind = e & 31, e >> 5 & 15, e >> 14
            one = 1 << n
            extra = w >> left - total & one - 1
            p = p + total
            k = np.minimum(k + (e >> 9 & 31), 63)
            there = (kind == 1) & (at < end)
            to = np.where(there, self.order[at] * 64 + k, self.dummy)
            self.coef[to] = extra - np.where(extra < one >> 1, one - 1, 0) << al
            k += kind == 1
            ended = kind >= 3
            over = (k > se) | ended
            at = np.minimum(np.where(ended, at + one + extra, at + over), none)
            k = np.where(over, ss, k)
            steps += 1
            if steps % 16 == 0 or len(p) < 64:
                on = at < end
                if not on.all():
                    p, at, end, ss, se, al, use, k = (x[on] for x in (p, at, end, ss, se, al, use, k))

    def _refine(self, windows, p, at, end, ss, se, al, use) -> None:
        """Refinements of bands, one symbol or one coefficient of every stream a step."""
        prefix = np.concatenate([_acting(c.counts, c.symbols) for c in self.codes])
        last, none = len(windows) - 1, len(self.order) - 1
        k, run, put, skip = ss.copy(), np.zeros_like(p), np.zeros_like(p), np.zeros_like(p)
        ask, steps = np.ones(len(p), bool), 0
        while len(p):
            w, left = windows[np.minimum(p >> 3, last)], 40 - (p & 7)
            # A symbol where one is due. Ends of blocks leave the rest of the block to be corrected.
            e = prefix[use + (w >> left - 16 & 0xFFFF)]
            total, n, kind = e & 31, e >> 5 & 15, e >> 14
            extra = w >> left - total & (1 << n) - 1
            put = np.where(ask, np.where(kind == 1, np.where(extra > 0, 1, -1) << al, 0), put)
            run = np.where(ask, np.where(kind == 2, 15, e >> 9 & 31), run)
            skip = np.where(ask & (kind >= 3), (1 << n) + extra, skip)
            # Else a coefficient: a bit for one that is there already, a place for a new one at the end of its run.
            go = ~ask & (at < end)
            to = np.where(go, self.order[at] * 64 + np.minimum(k, 63), self.dummy)
            c = self.coef[to].astype(np.int64)
            old = c != 0
            bit = w >> left - 1 & 1
            more = old & (bit == 1) & (np.abs(c) >> al & 1 == 0)
            placed = ~old & (skip == 0) & (run == 0)
            c = c + np.where(more, np.sign(c) << al, 0) + np.where(placed, put, 0)
            self.coef[np.where(go, to, self.dummy)] = c
            self.coef[self.dummy] = 0
            p = p + np.where(ask, total, old & go)
            run = np.where(go & ~old & (skip == 0) & (run > 0), run - 1, run)
            k = k + go
            over = go & (k > se)
            skip = np.where(over & (skip > 0), skip - 1, skip)
            ask = np.where(ask, False, placed & go) | over
            ask &= skip == 0
            at = np.minimum(at + over, none)
            k = np.where(over, ss, k)
            steps += 1
            if steps % 16 == 0 or len(p) < 64:
                on = at < end
                if not on.all():
                    p, at, end, ss, se, al, use, k, run, put, skip, ask = (x[on] for x in (p, at, end, ss, se, al, use, k, run, put, skip, ask))

    def payload(self, image: Image) -> bytes:
        """The bytes that `encode` has put into the coefficients."""
        if image.payload_bytes is None or image.error:
            raise ValueError(image.error or "this file holds no payload")
        units = image.payload_bytes // UNIT
        counts = 2 * units, -(-units // 2), units // 2
        c = self.coef.reshape(-1, 64)
        parts = [c[p.first : p.first + n] for p, n in zip(image.planes.values(), counts, strict=True)]
        return (np.concatenate(parts) + 128).astype(np.uint8).tobytes()

    @functools.cached_property
    def samples(self) -> np.ndarray:
        """All blocks' samples: the inverse transform in whole numbers, so that a block's samples don't depend on its neighbours."""
        c = self.coef[: self.dummy].reshape(-1, 64)
        factors = [(p, i.quant[p.table]) for i in self.images for p in i.planes.values() if (i.quant[p.table] != 1).any()]
        if factors:
            c = c.astype(np.int32)
            for p, q in factors:
                c[p.first : p.first + p.stride * p.lines] *= q.astype(np.int32)
        out = np.empty(c.shape, np.uint8)
        for at in range(0, len(c), 1 << 13):
            s = c[at : at + (1 << 13)].astype(np.float64) @ INVERSE
            out[at : at + len(s)] = np.clip(np.floor(s * 2.0**-SCALE + 128.5), 0, 255)
        return out

    def rgb(self, image: Image) -> np.ndarray:
        """height x width x 3."""
        planes = []
        for p in image.planes.values():
            s = self.samples[p.first : p.first + p.stride * p.lines].reshape(p.lines, p.stride, 8, 8)
            planes.append(s.transpose(0, 2, 1, 3).reshape(8 * p.lines, 8 * p.stride))
        size = (8 * image.rows * max(p.v for p in image.planes.values()), 8 * image.columns * max(p.h for p in image.planes.values()))

        def full(x: np.ndarray) -> np.ndarray:
            v, h = size[0] // x.shape[0], size[1] // x.shape[1]
            x = x.repeat(v, 0) if v > 1 else x
            return (x.repeat(h, 1) if h > 1 else x)[: image.height, : image.width]

        y = full(planes[0])
        if len(planes) == 1:
            return np.repeat(y[:, :, None], 3, 2)
        cb, cr = (x.astype(np.int32) - 128 for x in planes[1:])
        if cb.shape != cr.shape:
            cb, cr = full(cb), full(cr)
        y, half = y.astype(np.int16), 1 << 15
        out = np.empty((image.height, image.width, 3), np.uint8)
        shifts = 91881 * cr + half >> 16, half - 22554 * cb - 46802 * cr >> 16, 116130 * cb + half >> 16
        for i, shift in enumerate(shifts):
            out[:, :, i] = np.clip(y + full(shift.astype(np.int16)), 0, 255)
        return out


@functools.lru_cache(64)
def _acting(counts: bytes, symbols: bytes) -> np.ndarray:
    """By 16 bits of a band's stream: bits of code and extra bits, extra bits, places to go on, and what to do: 1 write, 2 go on, 3 end the block, 4 no code (it ends too)."""
    e = _code(counts, symbols).prefix
    length, run, size = e >> 8, e >> 4 & 15, e & 15
    kind = np.where(size > 0, 1, np.where(run == 15, 2, 3))
    extra = np.where(kind == 1, size, np.where(kind == 3, run, 0))
    ahead = np.where(kind == 1, run, np.where(kind == 2, 16, 0))
    return np.where(length > 0, length + extra | extra << 5 | ahead << 9 | kind << 14, 1 | 4 << 14).astype(np.int64)


def _windows(data: np.ndarray) -> np.ndarray:
    """The 40 bits from each byte on."""
    d = data.astype(np.int64)
    return d[:-4] << 32 | d[1:-3] << 24 | d[2:-2] << 16 | d[3:-1] << 8 | d[4:]


# -- Spark


def padded(text: bytes | None) -> bytes:
    text = text or b""
    return text.ljust(max(1, -(-len(text) // UNIT)) * UNIT)


def _together(rows, size):
    """Runs of rows of about TOGETHER bytes."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += size(row)
        if n >= TOGETHER:
            yield held
            held, n = [], 0
    if held:
        yield held


class Remembered(OrderedDict):
    """What was computed for contents by digest, the most recent ones."""

    def put(self, key: bytes, value) -> None:
        self[key] = value
        if len(self) > REMEMBERED:
            self.popitem(last=False)


def store(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, media, n_bytes): each text as a file."""
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).cast(pa.large_binary())
            for places in _together(range(batch.num_rows), lambda i: len(texts[i].as_py() or b"")):
                own = [texts[i].as_py() or b"" for i in places]
                different = {t: None for t in own}
                for t, media in zip(different, encode([padded(t) for t in different]), strict=True):
                    different[t] = media
                cols = [keys.slice(places[0], len(places)), pa.array([different[t] for t in own], pa.binary()), pa.array([len(t) for t in own], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["key", "media", "n_bytes"])

    return rows.mapInArrow(run, f"key {dict(rows.dtypes)['key']}, {STORED}")


def load(df: DataFrame, key: str, media: str) -> DataFrame:
    """(key, height, width, rgb, error): each file as a tensor."""
    rows = df.select(F.col(key).alias("key"), F.col(media).cast("binary").alias("media"))

    def run(batches):
        for batch in batches:
            keys, files = batch.column(0), batch.column(1)
            for places in _together(range(batch.num_rows), lambda i: len(files[i].as_py() or b"")):
                found = Batch([files[i].as_py() or b"" for i in places])
                out = [(None, None, None, i.error) if i.error else (i.height, i.width, found.rgb(i).tobytes(), None) for i in found.images]
                arrays = [pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([keys.slice(places[0], len(places)), *arrays], ["key", "height", "width", "rgb", "error"])

    return rows.mapInArrow(run, f"key {dict(rows.dtypes)['key']}, {TENSOR}")


def digested(files: list[bytes]) -> list[tuple]:
    """What a file holds, read back: payload's size, digest and tail, the file's size and digest, and a feature of its tensor."""
    batch, out = Batch(files), []
    for data, image in zip(files, batch.images, strict=True):
        payload, rgb = batch.payload(image), batch.rgb(image)
        sums = rgb.reshape(-1, 3).sum(0, dtype=np.int64).tolist()
        feature = f"{image.height}x{image.width} sums {sums[0]},{sums[1]},{sums[2]} crc {zlib.crc32(rgb):08x}"
        out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature))
    return out


def digests(stored: DataFrame) -> DataFrame:
    """(key, DIGESTS) of stored(key, media, n_bytes)."""

    def run(batches):
        seen = Remembered()
        for batch in batches:
            files = batch.column(1)
            for places in _together(range(batch.num_rows), lambda i: len(files[i].as_py())):
                own = [files[i].as_py() for i in places]
                names = [hashlib.sha256(x).digest() for x in own]
                new = {n: x for n, x in zip(names, own, strict=True) if n not in seen}
                known = {n: seen[n] for n in names if n in seen} | dict(zip(new, digested(list(new.values())) if new else [], strict=True))
                for n in new:
                    seen.put(n, known[n])
                cols = [pa.array(c, kind) for c, kind in zip(zip(*(known[n] for n in names), strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
                part = batch.slice(places[0], len(places))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *cols], ["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return stored.mapInArrow(run, f"key {dict(stored.dtypes)['key']}, {DIGESTS}")


def op13_media_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(store(docs, "doc_id", "text")).withColumnRenamed("key", "doc_id")
