"""Camera metadata, cached snapshots, side tables that replace themselves, and jobs that are stopped."""

import struct

import pytest
from pyspark.sql import functions as F

from lumenframe.functions import exif as X
from lumenframe.operators import jobs as J
from lumenframe.sources import files
from lumenframe.sources.snapshots import Snapshot


def tiff(order: str) -> bytes:
    """A block with a name, an exposure, a width, a position and one entry that points outside."""
    e = "<" if order == "II" else ">"
    pack = lambda form, *v: struct.pack(e + form, *v)
    entry = lambda tag, kind, n, value: pack("HHI", tag, kind, n) + value
    long = lambda v: pack("I", v)
    main_at, photo_at, gps_at, data = 8, 80, 140, 220
    main = pack("H", 4) + entry(0x0110, 2, 9, long(data)) + entry(0x8769, 4, 1, long(photo_at)) + entry(0x8825, 4, 1, long(gps_at)) + entry(0x010F, 2, 50, long(9999)) + long(0)
    photo = pack("H", 3) + entry(0x829A, 5, 1, long(data + 10)) + entry(0xA002, 3, 1, pack("HH", 640, 0)) + entry(0x829D, 5, 1, long(data + 66)) + long(0)
    gps = pack("H", 4) + entry(1, 2, 2, b"S\0\0\0") + entry(2, 5, 3, long(data + 18)) + entry(3, 2, 2, b"E\0\0\0") + entry(4, 5, 3, long(data + 42)) + long(0)
    out = bytearray(300)
    out[0:8] = order.encode() + pack("H", 42) + long(main_at)
    for at, part in ((main_at, main), (photo_at, photo), (gps_at, gps), (data, b"Camera X\0")):
        out[at : at + len(part)] = part
    out[data + 10 : data + 74] = pack("II", 10, 2500) + pack("IIIIII", 10, 1, 30, 1, 0, 1) + pack("IIIIII", 20, 1, 0, 1, 36, 1) + pack("II", 28, 10)
    return bytes(out)


def wrapped(block: bytes) -> dict[str, bytes]:
    part = b"Exif\0\0" + block
    chunk = struct.pack(">I", len(block)) + b"eXIf" + block + b"\0" * 4
    return {
        "tiff": block,
        "jpeg": b"\xff\xd8\xff\xe0\0\x04ab" + b"\xff\xe1" + struct.pack(">H", len(part) + 2) + part + b"\xff\xda",
        "webp": b"RIFF\0\0\0\0WEBP" + b"VP8 \x03\0\0\0abc\0" + b"EXIF" + struct.pack("<I", len(block)) + block,
        "png": b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 2) + b"IHDRab\0\0\0\0" + chunk,
    }


@pytest.mark.parametrize("order", ["II", "MM"])
def test_exif(spark, order):
    rows = wrapped(tiff(order)) | {"none": None, "empty": b"", "text": b"hello", "cut": tiff(order)[:60], "no tags": b"\xff\xd8\xff\xda"}
    df = spark.createDataFrame([(k, v) for k, v in rows.items()], "name string, content binary")
    out = {r["name"]: r.f for r in df.select("name", X.fields(X.exif("content")).alias("f")).collect()}
    for name in ("tiff", "jpeg", "webp", "png"):
        f = out[name]
        assert (f.camera_model, f.exposure, f.width, f.f_number) == ("Camera X", "1/250", "640", "14/5"), name
        assert (f.gps_lat, f.gps_lon, f.camera_make) == (-10.5, 20.01, None), name
    for name in ("none", "empty", "text", "cut", "no tags"):
        assert set(out[name].asDict().values()) == {None}, name


def test_snapshot(spark):
    now, version, loads = [0.0], [1], []

    def load():
        loads.append(version[0])
        return spark.range(version[0])

    s = Snapshot(load, lambda: version[0], 5, lambda: now[0])
    assert s.get() is s.get() and loads == [1]
    version[0] = 2
    assert s.get().count() == 2 and loads == [1, 2]
    now[0] = 6.0
    s.get()
    assert loads == [1, 2, 2]
    s.clear()
    s.get()
    assert len(loads) == 4


def test_side_table_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "side")
    files.write_side_table(spark.range(3), path)
    table = files.read_side_table(spark, path, "id long")
    files.write_side_table(table.where("id > 0"), path)
    assert sorted(r.id for r in files.read_side_table(spark, path, "id long").collect()) == [1, 2]
    broken = spark.range(2).select(F.raise_error(F.lit("no")).alias("id"))
    with pytest.raises(Exception, match="no"):
        files.write_side_table(broken, path)
    assert files.read_side_table(spark, path, "id long").count() == 2


def test_stop_between_slices(spark, tmp_path):
    pending = spark.range(200).select(F.col("id").cast("string").alias("id"), F.lit("x").alias("value"))
    path, asked = str(tmp_path / "outcomes"), []

    def stop():
        asked.append(1)
        return len(asked) > 2

    assert not J.run_slices(pending, J.FakeCaptioner, path, 5, stop)
    left = J.still_pending(pending, path)
    assert 0 < left.count() < 200
    assert J.run_slices(left, J.FakeCaptioner, path, 5)
    assert J.still_pending(pending, path).isEmpty()
    done = spark.read.option("recursiveFileLookup", "true").parquet(path)
    assert done.count() == done.select("id").distinct().count() == 200


def test_cancelled_items_stay_pending(spark):
    class Stopping:
        calls = 0

        def __call__(self, items):
            Stopping.calls += 1
            if Stopping.calls == 3:
                raise J.Cancelled
            return J.FakeCaptioner()(items)

    pending = spark.range(10).coalesce(1).select("id", F.lit("x").alias("value"))
    assert J.run(pending, Stopping, batch=2).count() == 4


def test_recent_falls_back(spark):
    from lumenframe.operators.browse import recent_or_any

    media = spark.createDataFrame([(str(i), float(i)) for i in range(20)], "uid string, created_at double")
    vectors = spark.createDataFrame([("1",), ("2",)], "id string")
    assert [r.uid for r in recent_or_any(media, vectors, 3).collect()] == ["1", "2"]
    vectors = spark.createDataFrame([("1",), ("19",)], "id string")
    assert [r.uid for r in recent_or_any(media, vectors, 3).collect()] == ["19"]


def test_transcripts_of_unknown_sound(spark):
    rows = spark.createDataFrame([("a", "x", None), ("b", "x", False), ("c", "1", True), ("d", None, None)], "id string, value string, has_audio boolean")
    got = {r.id: (r.text, r.language) for r in J.transcripts(rows, J.FakeTranscriber).collect()}
    assert got == {"a": ("says x", "en"), "b": ("", None), "c": ("", None), "d": ("", None)}


def test_a_stop_reaches_into_a_slice(spark, tmp_path):
    """A worker that would take a minute is interrupted; nothing of its slice is there, and all of it is done later."""
    import time

    class Slow:
        def __call__(self, items):
            time.sleep(60)
            return []

    pending = spark.range(20).select("id", F.lit("x").alias("value"))
    began = time.time()
    path = str(tmp_path / "outcomes")
    assert not J.run_slices(pending, Slow, path, 2, interrupt=lambda: time.time() - began > 3)
    assert time.time() - began < 30
    assert J.run_slices(pending, J.FakeCaptioner, path, 2)
    done = spark.read.option("recursiveFileLookup", "true").parquet(path)
    assert done.count() == 20 and J.still_pending(pending, path).isEmpty()


def test_side_tables_are_never_missing(spark, tmp_path):
    path = str(tmp_path / "albums")
    schema = "id int, name string"
    assert files.read_side_table(spark, path, schema).isEmpty()
    for k in range(4):
        files.write_side_table(files.read_side_table(spark, path, schema).unionByName(spark.createDataFrame([(k, f"n{k}")], schema)), path)
        assert files.read_side_table(spark, path, schema).count() == k + 1
    import os

    assert sum(n.startswith("v-") for n in os.listdir(path)) == 2  # the one before stays for its readers
    old = files.read_side_table(spark, path, schema)
    files.write_side_table(spark.createDataFrame([(9, "z")], schema), path)
    assert old.count() == 4 and [r.id for r in files.read_side_table(spark, path, schema).collect()] == [9]


def test_queries_meet_only_the_active_models_vectors(spark):
    import pytest

    from lumenframe.plans.search import active_space

    registry = [{"model": "a", "dimension": 2, "is_active": False}, {"model": "b", "dimension": 2, "is_active": True}]
    vectors = spark.createDataFrame([("1", "a", [1.0, 0.0]), ("2", "b", [0.0, 1.0])], "id string, embedding_model string, embedding array<double>")
    rows, embed = active_space(registry, {"a": lambda t: [1.0, 0.0], "b": lambda t: [0.0, float(len(t))]}, vectors)
    assert [r.id for r in rows.collect()] == ["2"] and embed("xyz") == [0.0, 3.0]
    with pytest.raises(ValueError):
        active_space(registry, {"b": lambda t: [1.0]}, vectors)[1]("x")
    with pytest.raises(LookupError):
        active_space(registry, {"a": lambda t: [1.0, 0.0]}, vectors)
