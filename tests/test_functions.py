"""Scalar functions and small tables on literal fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from lumenframe.functions import captions as C
from lumenframe.functions import dates as D
from lumenframe.functions import geo as G
from lumenframe.functions import hashing as H
from lumenframe.functions import media as M
from lumenframe.functions import paths as P
from lumenframe.functions import vectors as V


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def values(spark, rows, schema, column):
    return [r.x for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema).orderBy("i").select(column.alias("x")).collect()]


def test_dates(spark):
    rows = [
        ("2015:06:20 10:00:00", "a.jpg", 0.0), (None, "IMG-20170511-WA0039.jpg", None), ("", "1559543971742.jpg", None), (None, "opaque.jpg", 1721000000.0),
        ("20", "m_8.jpg", 1721000000.0), (None, None, None), (None, "9999999999999.jpg", None), (None, "2019-13-40.jpg", None),
    ]
    got = values(spark, rows, "exif string, name string, created double", D.best_date("exif", "name", "created", 2026))
    assert got == ["2015:06:20 10:00:00", "2017:05:11 00:00:00", "2019:06:03 06:39:31", "2024:07:14 23:33:20", "2024:07:14 23:33:20", "", "", ""]
    assert one(spark, D.filename_date(F.lit("1559543971742"), 2018)) == ""
    assert [one(spark, D.duration_label(F.lit(s))) for s in (0, 59.6, 61, 3600, 3725)] == ["0:00", "1:00", "1:01", "1:00:00", "1:02:05"]
    assert [one(spark, D.month_label(F.lit(m))) for m in ("01", "12", "00", "x")] == ["January", "December", "Undated", "x"]


def test_stamps_of_any_year(spark):
    names = ["1798761601000.jpg", "2020101000000.jpg", "7500000000000.jpg", "301500000000000.jpg", "9999999999999999.jpg", "IMG-20170511-WA1.jpg", "1104537599000.jpg", "m_8.jpg", None]
    got = values(spark, [(x,) for x in names], "name string", D.filename_date("name", None))
    assert got == ["2027:01:01 00:00:01", "2034:01:05 19:10:00", "2207:09:01 13:20:00", "11524:02:27 08:00:00", "", "2017:05:11 00:00:00", "", "", ""]
    got = values(spark, [(x,) for x in names[:5]], "name string", D.filename_date("name", 2026))
    assert got == ["", "2020:10:10 00:00:00", "", "", ""]


def test_gps(spark):
    gps = lambda d, m, s, r: one(spark, G.gps_decimal(F.lit(d), F.lit(m), F.lit(s), F.lit(r)))
    assert gps(15.0, 21.0, 0.0, "N") == 15.35
    assert gps(15.0, 21.0, 0.0, "S") == -15.35
    assert gps(90.0, 0.0, 1.0, "N") is None
    assert gps(180.0, 0.0, 0.0, "W") == -180.0
    assert gps(float("nan"), 0.0, 0.0, "E") is None


def test_nearest_place_over_poles_and_date_line(spark):
    places = spark.createDataFrame([("A", "x", 89.0, 10.0), ("B", "", 0.0, 179.9), ("", "", -60.0, 0.0)], "name string, admin1 string, lat double, lon double")
    points = spark.createDataFrame([(88.0, -170.0), (0.0, -179.9), (-70.0, 5.0), (0.001, -179.9), (None, 1.0), (float("nan"), 1.0), (91.0, 0.0)], "lat double, lon double")
    got = {(r.lat_r, r.lon_r): r.place for r in G.nearest_places(points, places).collect()}
    assert got == {(88.0, -170.0): "A, x", (0.0, -179.9): "B", (-70.0, 5.0): None}


CAPTION = {
    "caption": "A dog", "scene": "outdoor", "person_count": "2", "objects": ["ball", 3, True, None], "animals": "dog", "vehicles": {"a": 1},
    "mood": ["calm", "happy"], "occasion": {"a": 1, "b": "x"}, "weather": None, "landmark": "unknown", "extra": 1,
}


def test_caption_attributes(spark):
    a = one(spark, C.attributes(F.lit(json.dumps(CAPTION)))).asDict()
    assert a["caption"] == "A dog" and a["scene"] == "outdoor" and a["person_count"] == 2
    assert a["objects"] == "ball, 3, True, None" and a["animals"] == "dog" and a["vehicles"] == ""
    assert a["mood"] == "calm, happy" and a["occasion"] == "a: 1, b: x" and a["weather"] is None and a["season"] == "unknown"
    for text in ("broken", "[1, 2]", '"x"', None):
        d = one(spark, C.attributes(F.lit(text).cast("string"))).asDict()
        assert d == C.DEFAULTS
    counts = [one(spark, C.attributes(F.lit(json.dumps({"person_count": v}))))["person_count"] for v in ("2", 2.7, True, "2.5", None, "many")]
    assert counts == [2, 2, 1, 0, 0, 0]


def test_table_of_attributes_parses_once(spark):
    texts = [json.dumps(CAPTION), json.dumps({"person_count": "3", "objects": None, "scene": False, "mood": 2}), "broken", "[1, 2]", '"x"', None, "{}"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id int, j string")
    table = C.with_attributes(df, "j").select("id", "a", C.embedding_text(F.col("a")).alias("text"))
    assert sorted(table.collect()) == sorted(df.select("id", C.attributes("j").alias("a"), C.embedding_text(C.attributes("j")).alias("text")).collect())
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parse_json") == 1 or plan.lower().count("parsejson") == 1


def test_embedding_text(spark):
    a = {"caption": "A dog", "animals": ["dog"], "mood": "happy", "weather": "unknown", "dominant_colors": ["red", "blue"], "text_in_image": "STOP"}
    assert one(spark, C.embedding_text(C.attributes(F.lit(json.dumps(a))))) == "A dog Animals: dog. Visible text: STOP. Tags: happy. Colors: red, blue."


def test_has_caption(spark):
    rows = [('{"caption": "", "scene": "indoor"}', None), ('{"caption": "x"}', None), ('{"c":"x"}', None), ("", "flat"), (None, None), ('{"caption": "  "}', None), ('{"caption":"" broken', None)]
    assert values(spark, rows, "j string, c string", C.has_caption("j", "c")) == [False, True, True, True, False, True, True]
    assert values(spark, rows, "j string, c string", C.caption_text("j", "c")) == ["", "x", "", "flat", "", "", ""]


def test_fences_and_salvage(spark):
    rows = [('```json\n{"a": 1}\n```',), ('text {"a": 1} more',), ('{"a": ',), ('{"a": 1}',)]
    assert values(spark, rows, "t string", C.salvage_json("t")) == ['{"a": 1}', '{"a": 1}', None, '{"a": 1}']
    assert one(spark, C.attach_transcript(F.lit("A dog "), F.lit("w" * 500))) == "A dog Spoken words: " + "w" * 400 + "…"
    assert one(spark, C.truncated(F.lit("MAX_TOKENS"))) and not one(spark, C.truncated(F.lit("stop")))


def test_validation_and_history(spark):
    full = {k: "x" for k in C.REQUIRED}
    assert one(spark, C.validation(F.lit(json.dumps(full)))).valid
    assert one(spark, C.validation(F.lit(json.dumps({**full, "error": "bad"})))).warning == "Model returned error: bad"
    assert one(spark, C.has_error(F.lit('{"error": "x"}'))) and not one(spark, C.has_error(F.lit('{"error": ""}')))
    h = C.record_history(C.record_history(C.record_history(F.lit(None), F.lit("a"), F.lit("1")), F.lit("b"), F.lit("2")), F.lit("a"), F.lit("3"))
    assert [(r.model, r.caption_json) for r in one(spark, h)] == [("b", "2"), ("a", "3")]


def test_hashes(spark):
    a, b = F.lit("00000000000000ff"), F.lit("fffffffffffffffe")
    assert one(spark, H.hash_long(b)) == -2
    assert one(spark, H.hash_hex(H.hash_long(b))) == "fffffffffffffffe"
    assert one(spark, H.hamming(H.hash_long(a), H.hash_long(b))) == 57
    assert one(spark, H.bands(H.hash_long(b), 4)) == [65534, 65535, 65535, 65535]
    row = F.array(*[F.lit(x) for x in (*range(9, 0, -1), *range(9)) * 4])
    assert one(spark, H.hash_hex(H.difference_hash(row))) == "ff00ff00ff00ff00"
    assert one(spark, V.fingerprint(F.array(F.lit(0.5), F.lit(-1.0)))) == __import__("hashlib").sha1(b"0.500000,-1.000000").hexdigest()


def test_fingerprints_round_the_binary_number_half_to_even(spark):
    sha = lambda text: __import__("hashlib").sha1(text.encode()).hexdigest()
    rows = [([0.0078125, -0.0234375, 0.0390625, -1e-7],), ([None, float("nan"), float("-inf"), 1e22],), ([],), (None,)]
    got = values(spark, rows, "v array<float>", V.fingerprint("v"))
    assert got == [sha("0.007812,-0.023438,0.039062,-0.000000"), sha("nan,-inf,9999999778196308361216.000000"), sha(""), None]



def test_paths(spark):
    under = lambda p, f: one(spark, P.under(F.lit(p), F.lit(f)))
    assert under("/a/b/c.jpg", "/a/b") and under("/a/b", "/a/b/") and under("/x", "/") and under("D:\\p\\q", "D:\\")
    assert not under("/a/bc", "/a/b") and not under("E:\\p", "D:\\") and not under("", "/a")
    assert one(spark, P.ancestors(F.lit("/a/b"))) == ["/", "/a", "/a/b"]
    rows = [("video", "/x/a.jpg"), ("image", "/x/a.mp4"), ("", "/x/clip.MP4"), (None, "/x/photo.jpg"), (None, "")]
    assert values(spark, rows, "m string, p string", P.is_video("m", "p")) == [True, False, True, False, False]
    ranges = [("bytes=0-9", 100), ("bytes=-10", 100), ("bytes=90-", 100), ("bytes=90-500", 100), ("bytes=100-", 100), ("bytes=-0", 5), ("x", 5), (None, 5)]
    got = [r and tuple(r) for r in values(spark, ranges, "h string, n long", P.byte_range("h", "n"))]
    assert got == [(0, 9), (90, 99), (90, 99), (90, 99), None, None, None, None]
    assert one(spark, P.mime_type(F.lit("/a/x.MKV"))) == "video/x-matroska" and one(spark, P.mime_type(F.lit("x"))) == "application/octet-stream"
    assert one(spark, P.is_system_name(F.lit(".Trash-1000"))) and not one(spark, P.is_system_name(F.lit("pictures")))
    assert one(spark, P.backup_label(F.lit("C:\\My\\Pics"))) == "C_My_Pics"


def test_media(spark):
    assert one(spark, M.crop_box(F.array(*map(F.lit, (10.0, 10.0, 20.0, 20.0))), F.lit(100), F.lit(22))) == [7, 7, 23, 22]
    assert one(spark, M.uniform_times(F.lit(10.0), 3)) == [2.5, 5.0, 7.5]
    assert one(spark, M.keyframe_times(F.array(F.lit(5.0), F.lit(0.0), F.lit(2.22)), F.lit(10.0), 12)) == [1.0, 2.2, 5.0, 9.0]
    assert one(spark, M.keyframe_times(F.array(F.lit(5.0), F.lit(2.22)), F.lit(10.0), 2)) == [1.0, 5.0]
    probe = F.lit("Duration: 00:01:02.50, start\n Stream Video: h264 (High), yuv420p, 1920x1080\n creation_time : 2020-01-02T03:04:05Z\npts_time:1.5 x pts_time:2")
    assert one(spark, M.probe_duration(probe)) == 62.5 and tuple(one(spark, M.probe_size(probe))) == (1920, 1080)
    assert one(spark, M.probe_codec(probe)) == "h264" and one(spark, M.scene_times(probe)) == [1.5, 2.0]
    assert one(spark, M.frame_rate(F.lit("30000/1001"))) == pytest.approx(29.97, abs=0.01) and one(spark, M.frame_rate(F.lit("1/0"))) is None
    assert one(spark, M.rotation(F.lit(-90))) == 270
    assert [one(spark, M.clamp_frames(F.lit(x))) for x in ("0", "20", "x", "7")] == [1, 12, 4, 7]
    assert one(spark, M.model_label(F.lit("lm"), F.lit("m"))) == "lm:m" and one(spark, M.model_label(F.lit("auto"), F.lit("m"))) is None
    assert one(spark, M.model_class(F.lit("x"), F.lit("vlm"), F.lit("loaded"))).type == "vision"
    assert one(spark, M.model_class(F.lit("embeddinggemma-300m"))).type == "embed"
    assert one(spark, M.is_connection_error(F.lit("Connection refused"))) and not one(spark, M.is_connection_error(F.lit("bad json")))


def test_quotas(spark):
    q = one(spark, M.suggested_quota(F.lit("gemini"), F.lit("g-flash-lite"), F.create_map(F.lit("rpm"), F.lit(7))))
    assert {k: tuple(v) for k, v in q.items()} == {"rpm": (7, "learned"), "rpd": (500, "published")}
    assert one(spark, M.suggested_quota(F.lit("other"), F.lit("x"))) is None
    body = {"error": {"details": [{"@type": "t/QuotaFailure", "violations": [{"quotaId": "ReqPerMinute", "quotaValue": "5", "quotaDimensions": {"model": "m"}}, {"quotaId": "PerDay", "quotaValue": "x"}, {"quotaId": "PerDay", "quotaValue": "9"}]}, {"@type": "other"}]}}
    rows = spark.createDataFrame([(json.dumps(body), "asked"), ("broken", "asked")], "body string, model string")
    assert sorted(map(tuple, M.learned_quotas(rows).collect())) == [("asked", "rpd", 9), ("m", "rpm", 5)]
