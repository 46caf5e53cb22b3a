import math
from collections import defaultdict

import numpy as np
import pytest

from lumenframe.llm import hard_negatives as H
from lumenframe.llm.vector_codes import kept_rows
from pyspark.sql import functions as F


def brute(rows, is_anchor, scale=256, k=5):
    rows = [(i, label, [math.floor(scale * x) for x in v]) for i, label, v in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]

    def score(a, b):
        return sum(x * y for x, y in zip(a, b, strict=False))

    found = []
    for i, label, v in rows:
        if not is_anchor(i):
            continue
        near = sorted((-score(v, r[2]), r[0]) for r in rows if r[1] == label and r[0] != i)[:k]
        for s, p in near:
            hard = sorted((-score(v, r[2]), r[0]) for r in rows if r[1] != label and 80 * -s <= 100 * score(v, r[2]) <= 100 * -s)[:k]
            found += [(i, p, rank, n, -s, -t) for rank, (t, n) in enumerate(hard, 1)]
    return sorted(found)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<double>, rank string, w int")


def mined(spark, rows, every=10, **how):
    out = H.mine(kept_rows(frame(spark, rows).repartition(3), "vec_id", "embedding", "label"), F.col("id") % every == 0, **how)
    return sorted(tuple(r) for r in out.collect())


def data(n=160, d=6):
    rng = np.random.default_rng(2)
    rows = [(i, int(rng.integers(3)), (np.abs(rng.normal(size=d)) / 2).tolist()) for i in range(n)]
    rows += [(200 + i, i % 2, rows[10][2]) for i in range(40)]  # many copies: many equal scores
    return rows + [(10, rows[10][1], rows[10][2]), (-20, 1, [0.0] * d), (300, None, [1.0] * d), (310, 1, None), (320, 1, [float("nan")] * d), (330, 1, [None] * d), (None, 1, [1.0] * d), (340, 2, []), (350, 2, [0.5] * (d - 2))]


@pytest.mark.parametrize(("digit", "anchors", "held"), [(9, 2048, 1 << 20), (3, 7, 8)])
def test_equals_brute_force(spark, monkeypatch, digit, anchors, held):
    for name, value in (("DIGIT", digit), ("ANCHORS", anchors), ("HELD", held)):
        monkeypatch.setattr(H, name, value)
    rows, passes = data(), []
    want = brute(rows, lambda i: i % 10 == 0)
    assert mined(spark, rows, passes=passes) == want and len(want) > 200
    assert len(passes) >= 4  # digits were refined, for positives and for negatives


def test_long_integers_few_and_no_rows(spark):
    large = [(i, i % 2, [1e6 + 17 * i, 3e5 - i]) for i in range(30)]
    assert mined(spark, large) == brute(large, lambda i: i % 10 == 0)
    assert mined(spark, [(10, 1, [0.5]), (11, 2, [0.5])]) == [] and mined(spark, [(11, 1, [0.5])]) == []
    assert mined(spark, [(10, 1, [0.5]), (11, 1, [0.5]), (12, 2, [0.5])]) == [(10, 11, 1, 12, 16384, 16384)]
    assert mined(spark, []) == []
    with pytest.raises(Exception, match="exceed a long"):
        mined(spark, [(10, 1, [1e8] * 3)])


def test_windows_find_the_kth_score():
    w = H.Windows(np.array([0]), np.array([0]), np.array([(1 << 12) - 1]), 5, True)
    w.refine({0: [(500, 3), (400, 9)]})  # buckets of 8 scores
    assert (w.base[0], w.bits[0], w.need[0]) == (3200, 3, 2)
    w.refine({0: [(7, 1), (2, 6)]})
    assert (w.base[0], w.bits[0], w.need[0]) == (3202, 0, 1)
