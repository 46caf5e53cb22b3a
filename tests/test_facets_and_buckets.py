"""Sketches against exact counts, and joins of bucketed tables without a shuffle."""

import random
from collections import Counter

import pytest

from lumenframe.operators import facets as FA
from lumenframe.operators import pending as PE
from lumenframe.sources import buckets as BU


def library(spark, seed=3, n=6000):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["indoor"] * 6 + ["outdoor", "", "unknown", None]), f"o{int(rng.paretovariate(0.6))}", "x") for i in range(n)]
    return rows, spark.createDataFrame(rows, "uid long, scene string, objects string, attribute string")


def test_sketches_stay_within_their_bounds_and_merge(spark):
    rows, df = library(spark)
    more, other = library(spark, seed=4, n=3000)
    merged = FA.merged(FA.facet_sketches(df, ["scene", "objects", "uid"], 100).unionByName(FA.facet_sketches(other, ["scene", "objects", "uid"], 100)), 100)
    got = {r.attribute: r for r in FA.facet_summary(merged, 5).collect()}
    for place, name in ((1, "scene"), (2, "objects"), (0, "uid")):
        exact = Counter(str(r[place]) for r in rows + more if r[place] not in (None, "", "unknown"))
        assert got[name].n == sum(exact.values()) and abs(got[name].distinct - len(exact)) <= 0.03 * len(exact)
        bound = FA.error_bound(100) * got[name].n
        assert all(abs(x.n - exact[x.value]) <= bound for x in got[name].top)
    assert got["scene"].top[0].value == "indoor" and len(got["uid"].top) <= 5


def test_frequent_values_are_exact(spark):
    rows, df = library(spark)
    got = {(r.attribute, r.value): r.n for r in FA.frequent_values(df, ["scene", "objects", "uid", "attribute"]).collect()}
    want = {}
    for place, name in ((1, "scene"), (2, "objects"), (0, "uid"), (3, "attribute")):
        exact = Counter(str(r[place]) for r in rows if r[place] not in (None, "", "unknown"))
        want |= {(name, v): n for v, n in exact.items() if n >= 0.01 * sum(exact.values())}
    assert got == want and ("attribute", "x") in got
    with pytest.raises(ValueError):
        FA.frequent_values(df, ["scene"], share=0.001, items=100)
    assert FA.frequent_values(df.limit(0), ["scene"]).isEmpty()


def test_long_lists_are_counted_not_listed(spark):
    _, df = library(spark)
    got = {r.attribute: (r.distinct, r.complete, r["values"]) for r in FA.bounded_facets(df, ["scene", "uid"], 10).collect()}
    assert got == {"scene": (2, True, ["indoor", "outdoor"]), "uid": (6000, False, None)}


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        media = spark.range(2000).selectExpr("id AS uid", "concat('/a/', id, '.jpg') AS path", "'' AS media_type", "'{\"caption\": \"x\"}' AS caption_json", "'' AS caption")
        vectors = spark.range(0, 2000, 3).selectExpr("id", "array(1.0D) AS v")
        catalog = BU.store(media, "bucketed_media", "uid", 8, str(tmp_path / "media"))
        embedded = BU.store(vectors, "bucketed_vectors", "id", 8, str(tmp_path / "vectors"))
        BU.append(spark.range(3000, 3010).selectExpr("id", "array(2.0D) AS v"), "bucketed_vectors", "id", 8)
        embedded = spark.table("bucketed_vectors")
        for pending, plain in ((PE.missing(catalog, embedded), PE.missing(media, vectors)), (PE.embed_pending(catalog, embedded), PE.embed_pending(media, vectors))):
            assert BU.exchanges(pending) == 0 and BU.exchanges(plain) > 0
            assert sorted(r.uid for r in pending.collect()) == sorted(r.uid for r in plain.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        BU.drop(spark, "bucketed_media")
        BU.drop(spark, "bucketed_vectors")
