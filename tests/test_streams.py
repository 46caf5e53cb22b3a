import random

from pyspark.sql import functions as F

from lumenframe.streaming import streams as S


def requests(spark, rows):
    return spark.createDataFrame(rows, "provider string, request_id long, ts_us long")


ROWS = [("g", 1, 0), ("g", 2, 1_000_000), ("g", 3, 2_000_000), ("g", 4, 60_000_000), ("l", 5, 0), ("l", 6, 1), ("g", 7, 61_500_000)]
LIMITS = {"g": {"rpm": 2}, "x": {}}


def test_admission(spark):
    got = {r.request_id: (r.granted, r.wait_s, r.limit_name) for r in S.admit(requests(spark, ROWS), LIMITS).collect()}
    assert got[3] == (False, 58.0, "rpm") and got[4][0] and got[7][0] and got[5][0] and got[6][0]
    now = [r for r in S.waiting(S.admit(requests(spark, ROWS[:3]), LIMITS), 2_000_000).collect()]
    assert [(r.provider, r.seconds, r.limit) for r in now] == [("g", 58.0, "rpm")]


def test_most_constrained_window():
    windows = S.Windows({"rps": 0, "rpm": 2, "rph": 2})
    for t in (0, 1_000_000):
        windows.grant(t)
    assert windows.opening(2_000_000) == (3_600_000_000, "rph")
    assert S.Windows({}).opening(5) == (5, None)


def test_windows_keep_equal_times():
    windows = S.Windows({"rps": 2})
    for _ in range(2):
        windows.grant(5)
    again = S.Windows({"rps": 2}, windows.leaves())
    assert windows.opening(6) == again.opening(6) == (1_000_005, "rps")


def brute(rows, limits):
    want, granted = {}, {}
    for p, i, t in sorted(rows, key=lambda r: (r[2], r[1])):
        waits = []
        for name, span in S.WINDOWS.items():
            inside = [g for g in granted.get(p, []) if g + span * 1_000_000 > t]
            cap = limits.get(p, {}).get(name, 0)
            if cap and len(inside) >= cap:
                waits.append((inside[-cap] + span * 1_000_000 - t) / 1e6)
        if not waits:
            granted.setdefault(p, []).append(t)
        want[i] = (not waits, max(waits, default=0.0))
    return want


def test_admission_matches_brute_force(spark):
    rng = random.Random(5)
    limits = {"a": {"rps": 2, "rpm": 5}, "b": {"rpm": 3, "rph": 7}, "c": {"rpd": 9}, "d": {}}
    rows = [(rng.choice("abcde"), i, rng.randrange(0, 7200) * 1_000_000 // rng.choice([1, 1, 60])) for i in range(900)]
    want = brute(rows, limits)
    assert {r.request_id: (r.granted, r.wait_s) for r in S.admit(requests(spark, rows).repartition(5), limits).collect()} == want
    assert not all(g for g, _ in want.values())


def test_contents_are_seen_once_in_all_runs(spark, tmp_path):
    for k, hashes in enumerate((["x", "y", "x"], ["y", "z"])):
        spark.createDataFrame([(f"/{k}/{i}", h) for i, h in enumerate(hashes)], "path string, sha1 string").coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    got = []
    for run in range(2):
        stream = spark.readStream.schema("path string, sha1 string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
        S.first_seen_stream(stream, str(tmp_path / "seen"), lambda df, _: got.extend(r.sha1 for r in df.collect()), str(tmp_path / "c"))
    assert sorted(got) == ["x", "y", "z"]
    # A new checkpoint forgets the stream, not the contents.
    more = spark.createDataFrame([("/2/0", "z"), ("/2/1", "w"), ("/2/2", "w")], "path string, sha1 string")
    more.coalesce(1).write.parquet(str(tmp_path / "in2" / "0"))
    late = []
    stream = spark.readStream.schema("path string, sha1 string").parquet(str(tmp_path / "in2" / "*"))
    S.first_seen_stream(stream, str(tmp_path / "seen"), lambda df, _: late.extend(r.sha1 for r in df.collect()), str(tmp_path / "c2"))
    assert late == ["w"]
    assert S.first_seen(spark.createDataFrame([("/n", "z"), ("/m", "w")], "path string, sha1 string"), spark.read.parquet(str(tmp_path / "seen"))).isEmpty()


def test_one_busy_provider_is_many_episodes(spark):
    rng = random.Random(6)
    rows = [("a", i, rng.randrange(0, 40) * 600_000_000 + rng.choice([0, 0, 1, 30_000_000, 61_000_000])) for i in range(600)]
    limits = {"a": {"rps": 1, "rpm": 3}, "b": {"rpd": 1}}
    found = S.episodes(requests(spark, rows).repartition(3), limits)
    assert found.select("episode").distinct().count() >= 30
    out = S.admit(requests(spark, rows), limits)
    assert {r.request_id: (r.granted, r.wait_s) for r in out.collect()} == brute(rows, limits)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the log is small
    assert out.where("provider = 'a'").select(F.spark_partition_id()).distinct().count() > 1
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    none = S.admit(requests(spark, rows), {})
    assert none.where("granted").count() == 600 and S.admit(requests(spark, []), limits).isEmpty()


LATER = 1_700_000_000_000_000


def streamed(spark, tmp_path, parts, make, name):
    """Each part in its turn: the query ends and begins again from its checkpoint. Times are after the epoch, at which watermarks begin."""
    got = []
    parts = [[(p, i, LATER + t) for p, i, t in part] for part in parts]
    schema = "provider string, request_id long, ts_us long"
    for k, part in enumerate(parts):
        requests(spark, part).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k:03d}"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*"))
        query = make(stream).writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        query.awaitTermination()
    return got


def test_admission_on_a_stream_equals_the_batch(spark, tmp_path):
    """Random logs with equal timestamps, cut between them, over restarts."""
    rng = random.Random(8)
    limits = {"a": {"rps": 2, "rpm": 5}, "b": {"rpm": 3, "rph": 7}, "c": {"rpd": 9}, "d": {}}
    log = sorted(((rng.choice("abcde"), i, rng.randrange(0, 900) * 4_000_000) for i in range(700)), key=lambda r: (r[2], r[1]))
    cuts = [0, 150, 151, 400, 700]
    got = streamed(spark, tmp_path, [log[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], lambda s: S.admit_stream(s, limits), "c")
    assert {r.request_id: (r.granted, r.wait_s) for r in got} == brute(log, limits)


def test_waits_end_by_a_timer_or_a_grant(spark, tmp_path):
    parts = [ROWS[:3], [("x", 20, 30_000_000)], [("x", 21, 200_000_000)], [("x", 22, 400_000_000)]]
    got = streamed(spark, tmp_path, parts, lambda s: S.waiting_stream(s, LIMITS), "w")
    assert [(r.provider, r.at_us - LATER, r.waiting, r.limit_name) for r in got] == [("g", 2_000_000, True, "rpm"), ("g", 60_000_000, False, None)]
    assert got[0].until_us == LATER + 60_000_000


def test_windows_on_a_stream(spark, tmp_path):
    rows = spark.range(100).select(F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("ts"), (F.col("id") % 2).alias("k"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for name, df in (("tumbling", S.tumbling_counts(stream, "ts", "k")), ("sessions", S.session_counts(stream, "ts", "k", "5 minutes"))):
        df.writeStream.format("memory").queryName(name).outputMode("complete" if name == "tumbling" else "append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start().awaitTermination()
    assert sorted(r.n for r in spark.table("tumbling").collect()) == sorted(r.n for r in S.tumbling_counts(rows, "ts", "k").collect())
    assert S.session_counts(rows, "ts", "k", "5 minutes").count() == 2


def test_scan_stream_is_idempotent(spark, tmp_path):
    seen = []
    spark.createDataFrame([("/a", "h")], "path string, sha1 string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("path string, sha1 string").parquet(str(tmp_path / "in"))
    apply = lambda df, batch: seen.extend(r.path for r in df.collect())
    S.scan_stream(stream, apply, str(tmp_path / "c"))
    S.scan_stream(stream, apply, str(tmp_path / "c"))
    assert seen == ["/a"]
