"""Content ids, difference hashes and their bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenframe.functions.text import col


def content_id(content) -> Column:
    return F.sha1(col(content))


def signature(size, mtime) -> Column:
    """'size:mtime' with the time at three decimals."""
    return F.concat_ws(":", col(size).cast("string"), F.format_string("%.3f", F.round(col(mtime), 3)))


def hash_long(hex16) -> Column:
    """16 hex digits as a signed 64-bit number."""
    return F.conv(col(hex16), 16, -10).cast("long")


def hash_hex(value) -> Column:
    return F.lpad(F.lower(F.hex(col(value))), 16, "0")


def difference_hash(pixels) -> Column:
    """64 bits from 8 rows of 9 grey values: whether each is brighter than the next, the first bit highest."""
    p = col(pixels)
    at = lambda i: F.get(p, F.floor(i / 8).cast("int") * 9 + i % 8)
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda h, i: F.shiftleft(h, 1).bitwiseOR((at(i) > F.get(p, F.floor(i / 8).cast("int") * 9 + i % 8 + 1)).cast("long")))


def sign_hash(vector) -> Column:
    """64 bits of a 64-d vector: whether each number exceeds the next, the last compared with the first; first bit highest."""
    v = col(vector)
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda h, i: F.shiftleft(h, 1).bitwiseOR((F.get(v, i) > F.get(v, (i + 1) % 64)).cast("long")))


def hamming(a, b) -> Column:
    return F.bit_count(col(a).bitwiseXOR(col(b)))


def bands(value, n: int) -> Column:
    """The value cut into n runs of bits, lowest first; together they hold all 64."""
    edges = [64 * i // n for i in range(n + 1)]
    return F.array(*[F.shiftrightunsigned(col(value), a).bitwiseAND(F.lit((1 << (b - a)) - 1 if b - a < 63 else -1)) for a, b in zip(edges, edges[1:], strict=False)])


def derivative_key(uid) -> Column:
    return F.sha1(col(uid).cast("binary"))
