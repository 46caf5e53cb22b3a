"""Truthiness and small string helpers shared by the other function modules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def filled(c) -> Column:
    """NULL for an empty string: the library treats both as missing."""
    return F.nullif(col(c), F.lit(""))


def first_filled(*cs) -> Column:
    """The first value that is neither NULL nor empty."""
    return F.coalesce(*map(filled, cs))


def first_nonzero(*cs) -> Column:
    """The first number that is neither NULL nor 0."""
    return F.coalesce(*(F.nullif(col(c), F.lit(0)) for c in cs))


def known(c) -> Column:
    """NULL for NULL, '' and 'unknown'."""
    c = col(c)
    return F.when((c != "") & (c != "unknown"), c)


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def contains_any(c, words) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(col(c), F.lit(w)) for w in words], F.lit(False))
