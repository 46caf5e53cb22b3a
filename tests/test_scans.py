"""Prefix scans against plain loops, with one group that holds nearly all rows and many ranges."""

import random

from pyspark.sql import functions as F

from lumenframe.operators import aggregate as A
from lumenframe.operators.scans import Ordered, numbered


def log(spark, n=300, seed=1):
    rng = random.Random(seed)
    rows = [(rng.choice(["hot"] * 9 + ["a", None]), rng.randrange(80), i, rng.choice([None, 1, 2, 5]), rng.choice(["ok", "fail", "fail", "skipped"])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, t long, id long, v long, status string").repartition(3)


def test_scans_over_many_ranges(spark):
    rows, df = log(spark)
    found = Ordered(df, ["k"], ["t", "id"], ranges=17).add(sums={"total": F.col("v")}, maxima={"top": F.col("v")}, lasts={"known": F.col("v")}, before={"prior": F.col("v")})
    assert found.df.select("__range").distinct().count() > 10
    got = {r.id: (r.total, r.top, r.known, r.prior) for r in found.rows().collect()}
    held, want = {}, {}
    for k, _, i, v, _ in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        total, top, known, prior = held.get(k, (None, None, None, None))
        if v is not None:
            total, top, known = (total or 0) + v, max(top or 0, v), v
        want[i] = (total, top, known, prior)
        held[k] = (total, top, known, v)
    assert got == want
    places = {r.id: r.place for r in numbered(df, [F.desc("t"), "id"]).collect()}
    assert places == {r[2]: n for n, r in enumerate(sorted(rows, key=lambda r: (-r[1], r[2])), 1)}
    assert numbered(df.limit(0), ["t"]).isEmpty()


def test_counts_in_spans_and_failures(spark):
    rows, df = log(spark, seed=2)
    timed = df.withColumn("ts", F.when(F.col("id") != 7, F.timestamp_seconds("t")))
    got = {r.id: (r.s5, r.s30) for r in A.sliding_counts(timed, "k", "ts", {"s5": 5, "s30": 30}).collect()}
    want = {i: tuple(sum(1 for k2, t2, i2, _, _ in rows if k2 == k and i2 != 7 and t - s < t2 <= t) for s in (5, 30)) for k, t, i, _, _ in rows}
    want[7] = (None, None)
    assert got == want
    failures, aborted, state = {}, {}, {}
    for k, t, i, _, status in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        n, over = state.get(k, (0, False))
        n = 0 if status == "ok" else n + (status == "fail")
        failures[i] = n
        if not over:
            aborted[i] = n >= 4
        state[k] = (n, over or n >= 4)
    assert {r.id: r.failures for r in A.failure_runs(df, ["k"], ["t", "id"]).collect()} == failures
    assert {r.id: r.aborted for r in A.until_abort(df, ["k"], ["t", "id"], 4).collect()} == aborted
