"""Operators on small literal tables, with the edge cases that the tables of the driver do not have."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe import schema
from lumenframe.functions import vectors as V
from lumenframe.operators import aggregate as A
from lumenframe.operators import browse as B
from lumenframe.operators import catalog as K
from lumenframe.operators import cluster as CL
from lumenframe.operators import dedupe as DD
from lumenframe.operators import ingest as I
from lumenframe.operators import jobs as J
from lumenframe.operators import pending as PE
from lumenframe.operators.components import connected_components
from lumenframe.plans import search as S
from lumenframe.sources import files


def table(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def tuples(df):
    return [tuple(r) for r in df.collect()]


# ---- search -----------------------------------------------------------------------------------------------------


def test_compile_filters():
    assert S.compile_filters({}) == {}
    assert S.compile_filters({"weather": "All", "scene": "", "mood": None, "person_count": 0}) == {}
    assert S.compile_filters({"weather": "sunny", "person_count": "2"}) == {"weather": "sunny", "person_count": 2}
    assert S.compile_filters({"person_count": "many"}) == {}
    assert S.compile_filters({"person_count": "0"}) == {"person_count": 0}


def vectors(spark, n=60):
    return table(spark, [(i, [float(i), 0.0], "sunny" if i % 2 else "rain") for i in range(n)], "id int, embedding array<double>, weather string")


def test_search_paths(spark):
    v, embed = vectors(spark), lambda text: [len(text) + 0.1, 0.0]
    people = {"p": table(spark, [(1,), (2,), (40,)], "id int")}
    run = lambda **k: S.search(v, S.Request(**k), embed, people)
    assert run(filters={"weather": "sunny"}, top_k=5)[0].count() == 30  # browsing ignores top_k
    assert {r.id for r in run(person="p", top_k=1)[0].collect()} == {1, 2, 40}
    assert [r.id for r in run(text="ab", top_k=3)[0].collect()] == [2, 3, 1]
    assert {r.id for r in run(text="ab", person="p", top_k=3)[0].collect()} == {1, 2}  # may return fewer
    assert {r.id for r in run(text="ab", person="p", top_k=3, person_prefilter=True)[0].collect()} == {1, 2, 40}
    assert [r.id for r in run(top_k=1)[0].collect()] == [5]  # the default text
    rows, flags = run(person="nobody")
    assert rows.count() == 0 and flags == {"person_not_found": True}
    rows, flags = run(text="ab", filters={"nope": "x"}, top_k=2)
    assert rows.count() == 2 and flags == {"filter_error": True}
    with pytest.raises(ValueError):
        run(top_k=501)


def test_similar_and_plan(spark):
    v = vectors(spark)
    out = S.similar(v, 5, [5.0, 0.0], 2)
    assert {r.id for r in out.collect()} == {4, 6}
    assert "TakeOrderedAndProject" in out._jdf.queryExecution().toString()


# ---- catalog ----------------------------------------------------------------------------------------------------


def test_upsert_delete_sync(spark):
    old = table(spark, [("a", 1), ("b", 2)], "uid string, v int")
    new = table(spark, [("b", 3), ("c", 4)], "uid string, v int")
    assert sorted(tuples(K.upsert(old, new))) == [("a", 1), ("b", 3), ("c", 4)]
    assert sorted(tuples(K.insert_only(old, new, "uid"))) == [("a", 1), ("b", 2), ("c", 4)]
    assert tuples(K.delete(old, new)) == [("a", 1)]
    assert tuples(K.sync(old, new)[1]) == [("a",)]
    log = table(spark, [("a", "upsert", 1, 5), ("a", "delete", 2, None), ("z", "upsert", 3, 7)], "uid string, op string, seq int, v int")
    assert sorted(tuples(K.apply_changes(old, log, "uid"))) == [("b", 2), ("z", 7)]


def test_trash_round_trip(spark):
    media = table(spark, [("a", 1), ("b", 2), ("c", 3)], "uid string, v int")
    bin_ = table(spark, [], "id string, entry struct<uid:string,v:int>, deleted_at double, file_deleted boolean")
    left, bin_ = K.trash(media, bin_, table(spark, [("a",), ("x",)], "uid string"), F.lit(1.0))
    left, bin_ = K.trash(left, bin_, table(spark, [("b",)], "uid string"), F.lit(2.0), True)
    assert [r.id for r in K.list_trash(bin_).collect()] == ["b", "a"]
    back, rest = K.restore(left, bin_, table(spark, [("a",), ("b",)], "uid string"))
    assert sorted(tuples(back)) == [("a", 1), ("c", 3)] and rest.count() == 0
    assert K.purge_trash(bin_).count() == 0


def test_albums(spark):
    a = table(spark, [("1", "n", "2", ["x", "y", "x"]), ("2", "m", "1", [])], "album_id string, name string, created_at string, image_ids array<string>")
    a = a.withColumn("image_ids", K.add_to_album("image_ids", F.array(F.lit("y"), F.lit("z"))))
    assert [(r.album_id, r["count"], r.cover) for r in K.album_list(a).collect()] == [("2", 2, "y"), ("1", 3, "x")]
    a = a.withColumn("image_ids", K.remove_from_album("image_ids", F.array(F.lit("y"))))
    assert [r["count"] for r in K.album_list(a).collect()] == [1, 2]


def test_people(spark):
    persons = table(spark, [("Alice", [1.0]), ("bob", [2.0])], "name string, embedding array<double>")
    relations = table(spark, [("Alice", "sister", True)], "name string, relation string, is_family boolean")
    p, r = K.rename_person(persons, relations, "Alice", "Alicia")
    assert [tuple(x) for x in K.people(p, r).collect()] == [("Alicia", "sister", True), ("bob", "", False)]
    with pytest.raises(KeyError):
        K.rename_person(persons, relations, "x", "y")
    with pytest.raises(ValueError):
        K.rename_person(persons, relations, "Alice", "bob")
    assert K.delete_person(persons, relations, "Alice")[2] and not K.delete_person(persons, relations, "x")[2]
    assert K.family(K.people(persons, K.set_relation(persons, relations, "bob", "Friend"))).count() == 1
    assert K.set_relation(persons, relations, "Alice").count() == 0
    with pytest.raises(ValueError):
        K.set_relation(persons, relations, "bob", "boss")
    assert K.register_person(persons, "bob", [3]).where("name = 'bob'").first().embedding == [3.0]


def test_registry_and_settings():
    r = K.register_model([], "m", "s", 4, "d1")
    r = K.register_model(r, "n", "s", 5, "d2")
    assert [x["is_active"] for x in r] == [True, False]
    assert [x["is_active"] for x in K.set_active(r, "n")] == [False, True]
    assert K.register_model(r, "m", "s", 4, "d9")[0]["last_used"] == "d9"
    with pytest.raises(ValueError):
        K.register_model(r, "m", "s", 5, "d3")
    with pytest.raises(KeyError):
        K.set_active(r, "x")
    assert K.merge_settings({"a": 1, "rate_limits": {"g": {"rpm": 1, "rpd": 2}, "l": {}}}, {"rate_limits": {"g": {"rpm": 5}}})["rate_limits"] == {"g": {"rpm": 5, "rpd": 2}, "l": {}}


def test_folders(spark):
    f = table(spark, [("/a/b", "included", "d"), ("/x", "included", "d")], "path string, kind string, added_at string")
    assert sorted(r.path for r in I.add_folder(f, "/a", "e").collect()) == ["/a", "/x"]
    assert I.add_folder(f, "/x/y", "e").count() == 2
    assert I.exclude_folder(I.exclude_folder(f, "/q", "e"), "/q", "e").count() == 3
    assert tuple(I.validate_dest(f, "/a").first()) == (False, "contains /a/b")
    assert I.validate_dest(f, "/z").first().ok


# ---- listings ---------------------------------------------------------------------------------------------------

LISTING = "path string, size bigint, mtime double, sha1 string"


def test_scan(spark):
    previous = table(spark, [("u1", "/a/1.jpg", "10:1.000"), ("u2", "/a/2.jpg", "10:1.000"), ("u3", "/a/3.jpg", "10:1.000"), ("gone", "/a/gone.jpg", "1:1.000")], "uid string, path string, sig string")
    listing = table(spark, [("/a/1.jpg", 10, 1.0, "u1"), ("/b/2.jpg", 10, 1.0, "u2"), ("/a/3.jpg", 11, 2.0, "edited"), ("/a/0.jpg", 10, 1.0, "u4"), ("/c/4.jpg", 10, 1.0, "u4"), ("/z/1.jpg", 10, 1.0, "u1")], LISTING)
    got = {r.uid: (r.path, r.dup_paths, r.action) for r in I.scan(listing, previous).collect()}
    assert got == {
        "u1": ("/a/1.jpg", ["/z/1.jpg"], "unchanged"), "u2": ("/b/2.jpg", [], "moved"), "u3": (None, None, "retired"),
        "edited": ("/a/3.jpg", [], "added"), "u4": ("/a/0.jpg", ["/c/4.jpg"], "added"),
    }
    assert sorted(r.path for r in I.to_hash(listing, previous).collect()) == ["/a/0.jpg", "/a/3.jpg", "/b/2.jpg", "/c/4.jpg", "/z/1.jpg"]
    assert tuple(I.scan_summary(I.scan(listing, previous)).first()) == (2, 1, 1, 1, ["u2"])


def test_ingest(spark):
    staged = table(spark, [("/i/a.jpg", "h1" + "0" * 8, "2023:06:15 00:00:00"), ("/i/b.jpg", "h1" + "0" * 8, "2023:06:15"), ("/i/c/a.jpg", "h2" + "1" * 8, "2023:06:15"), ("/i/d.jpg", "known", "2023:01:01"), ("/i/t.jpg", "h3" + "2" * 8, "2020:01:01")], "path string, sha1 string, date string")
    plan = I.ingest_plan(staged, table(spark, [("known",)], "sha1 string"), "/lib", table(spark, [("/lib/2020/01/t.jpg",)], "path string"))
    assert {r.path: (r.action, r.target) for r in plan.collect()} == {
        "/i/a.jpg": ("copy", "/lib/2023/06/a.jpg"), "/i/b.jpg": ("duplicate", None), "/i/c/a.jpg": ("copy", "/lib/2023/06/a-h2111111.jpg"),
        "/i/d.jpg": ("known", None), "/i/t.jpg": ("copy", "/lib/2020/01/t-h3222222.jpg"),
    }


def test_mirror_and_staging(spark):
    s = table(spark, [("a", 1, 1.0), ("b", 1, 1.0), ("c", 1, 1.0)], "path string, size bigint, mtime double")
    d = table(spark, [("a", 1, 3.0), ("b", 1, 3.1), ("x", 1, 1.0)], "path string, size bigint, mtime double")
    assert dict(tuples(I.mirror_plan(s, d))) == {"a": "unchanged", "b": "copy", "c": "copy", "x": "keep_extra"}
    listing = table(spark, [("/s/b.JPG", 1), ("/s/a.mp4", 2), ("/s/$RECYCLE.BIN/c.jpg", 4), ("/t/d.jpg", 8), ("/s/e.txt", 16)], "path string, size bigint")
    assert [r.path for r in I.staging_files(listing, "/s").collect()] == ["/s/a.mp4", "/s/b.JPG"]
    assert [r.path for r in I.staging_files(listing, "/s", "photos").collect()] == ["/s/b.JPG"]


def test_sources(spark, tmp_path):
    for name in ("a.jpg", "B.JPG", "x.txt", "sub/c.mp4", "skip/d.jpg", ".Trash-1/e.jpg"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(name.encode())
    rows = files.list_files(spark, str(tmp_path), [str(tmp_path / "skip")], content=True).collect()
    assert sorted(r.path.removeprefix(str(tmp_path)) for r in rows) == ["/B.JPG", "/a.jpg", "/sub/c.mp4"]
    assert {len(r.sha1) for r in rows} == {40}
    assert files.read_side_table(spark, str(tmp_path / "none.json"), schema.PERSONS).count() == 0
    (tmp_path / "p.json").write_text('{"name": "a", "embedding": [1.0]}\nbroken\n')
    assert files.read_side_table(spark, str(tmp_path / "p.json"), schema.PERSONS).count() == 1
    with pytest.raises(Exception):
        files.read_side_table(spark, str(tmp_path / "p.json"), schema.PERSONS, strict=True).collect()
    faces = tmp_path / "faces"
    faces.mkdir()
    (faces / "img1.json").write_text(json.dumps([{"bbox": [0, 0, 1, 1], "embedding": [1.0, 0.0]}, {"bbox": [0, 0, 1, 1], "embedding": []}]))
    (faces / "_index.json").write_text("[]")
    (faces / "bad.json").write_text("{")
    assert [(r.image_id, r.face_index) for r in files.load_faces(spark, str(faces)).collect()] == [("img1", 0)]


# ---- vectors, clusters, duplicates ---------------------------------------------------------------------------------


def test_components(spark):
    rng = random.Random(0)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(i, i + 1) for i in range(100, 140)]
    parent = {i: i for i in range(141)}

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = dict(tuples(connected_components(spark.range(141), table(spark, edges, "a long, b long"))))
    assert got == {i: root(i) for i in range(141)}


def test_dbscan_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(c, 0.15, (12, 3)) for c in np.eye(3)] + [rng.normal(0, 1, (10, 3)), np.zeros((1, 3))])
    df = table(spark, [(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, embedding array<double>")
    n = np.linalg.norm(x, axis=1, keepdims=True)
    u = x / np.where(n == 0, 1, n)
    near = 1 - u @ u.T <= 0.05
    np.fill_diagonal(near, True)
    core = near.sum(axis=1) >= 4
    label, k = np.full(len(x), -1), 0
    for i in np.flatnonzero(core):
        if label[i] < 0:
            todo = [i]
            while todo:
                j = todo.pop()
                if label[j] < 0 and core[j]:
                    label[j] = k
                    todo += np.flatnonzero(near[j]).tolist()
            k += 1
    for i in np.flatnonzero(~core):
        c = label[near[i] & core]
        label[i] = c.min() if len(c) else -1
    order = sorted(range(k), key=lambda c: (-(label == c).sum(), np.flatnonzero(label == c)[0]))
    want = {i: order.index(c) if c >= 0 else -1 for i, c in enumerate(label)}
    assert {r.id: r.cluster for r in CL.dbscan(df, "id", eps=0.05, min_samples=4).collect()} == want


def test_hamming_classes_with_a_hot_hash_and_hot_bands(spark, monkeypatch):
    """One hash holds a third of all rows, and one band's bits are the same in all of them."""
    monkeypatch.setattr(DD, "HOT", 5)
    rng = random.Random(4)
    base = [rng.getrandbits(52) << 10 | 77 for _ in range(40)]
    values = [b ^ sum(1 << rng.randrange(10, 62) for _ in range(rng.randrange(5))) for b in base for _ in range(3)] + [base[0]] * 60
    rows = [(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(values)] + [(999, None)]
    df = table(spark, rows, "id long, h long")
    got = {r.k: (r["class"], r.copies, r.links) for r in DD.near_counts(df, "id", "h", 5).collect()}
    first = {v: values.index(v) for v in values}
    assert got == {i: (first[v], values.count(v), sum(1 for w in values if w != v and (w ^ v).bit_count() <= 5)) for i, v in enumerate(values)}
    members, reps, links = DD.near_classes(df, "id", "h", 5)
    assert members.count() == len(values) and reps.count() == len(set(values))
    assert links.count() == sum(1 for a in set(values) for b in set(values) if a < b and (a ^ b).bit_count() <= 5)


def test_wide_hamming_distances_meet_in_blocks_not_in_bands(spark, monkeypatch):
    """At 16 bits a band's few codes would be shared by nearly all pairs; now each pair of values meets once, in a block or between two."""
    monkeypatch.setattr(DD, "BLOCK", 40)
    monkeypatch.setattr(DD, "TILE", 7)
    monkeypatch.setattr(DD, "_near", None)  # no join by bands
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(30)]
    values = [b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(14))) for b in base for _ in range(6)] + [base[0]] * 20 + [0, 1, (1 << 64) - 1, 1 << 63]
    df = table(spark, [*((i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(values)), (999, None)], "id long, h long")
    want = {(i, j, (v ^ w).bit_count()) for i, v in enumerate(values) for j, w in enumerate(values) if i < j and (v ^ w).bit_count() <= 16}
    got = [tuple(r) for r in DD.near_pairs(df, "id", "h", 16).collect()]
    assert len(got) == len(want) and set(got) == want
    group = list(range(len(values)))
    for i, j, _ in sorted(want):
        a, b = group[i], group[j]
        group = [min(a, b) if g in (a, b) else g for g in group]
    groups = {r.component: sorted(r.members) for r in DD.duplicate_groups(df, "id", "h", 16).collect()}
    assert groups == {g: [i for i, x in enumerate(group) if x == g] for g in set(group) if group.count(g) > 1}
    assert DD.near_pairs(df.where("id = 999"), "id", "h", 16).count() == 0


def test_a_dense_group_is_tied_by_a_forest(spark, monkeypatch):
    """150 values near each other have 11175 links; the groups need a row for each value and pair of blocks at most."""
    monkeypatch.setattr(DD, "BLOCK", 60)
    rng = random.Random(8)
    values = list({sum(1 << k for k in rng.sample(range(60), rng.randrange(9))) for _ in range(170)})[:150] + [(1 << 63) - 1]
    df = table(spark, list(enumerate(values)), "id long, h long")
    assert DD.near_values(df.select(F.col("h").alias("v")), 16).count() == 150 * 149 // 2
    forest = [tuple(r) for r in DD.near_forest(df.select(F.col("h").alias("v")), 16).collect()]
    assert 149 <= len(forest) <= 3 * len(values) and all(values[150] not in (a, b) for a, b in forest)
    assert [(r.component, r.n, sorted(r.members)) for r in DD.duplicate_groups(df, "id", "h", 16).collect()] == [(0, 150, list(range(150)))]


def test_identities_carry_over(spark):
    new = table(spark, [("a", 0), ("b", 0), ("c", 0), ("d", 1), ("e", 2)], "member string, cluster int")
    old = table(spark, [("a", 5), ("b", 5), ("x", 6)], "member string, cluster int")
    means = table(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0])], "cluster int, mean array<double>")
    old_means = table(spark, [(5, [1.0, 0.1]), (6, [0.01, 1.0])], "cluster int, mean array<double>")
    names = table(spark, [(5, "Alice", "named"), (6, None, "ignored")], "cluster int, name string, status string")
    got = {r.cluster_id: (r.name, r.status) for r in CL.carry_over(new, old, means, old_means, names).collect()}
    assert got == {0: ("Alice", "named"), 1: (None, "ignored"), 2: (None, "new")}


def test_cluster_means_and_staleness(spark):
    faces = table(spark, [("i", 0, [1.0, 0.0]), ("i", 1, [0.9, 0.1]), ("j", 0, [5.0, 5.0])], "image_id string, face_index int, embedding array<double>")
    fp = faces.withColumn("fp", V.fingerprint("embedding")).select("image_id", "face_index", "fp")
    members = fp.where("image_id = 'i'").withColumn("cluster_id", F.lit(1)).unionByName(fp.where("image_id = 'j'").withColumns({"cluster_id": F.lit(2), "fp": F.lit("old")}))
    got = {r.cluster_id: (r.state, r["mean"]) for r in CL.cluster_means(members, faces).collect()}
    assert got[2] == ("stale", None) and got[1][0] == "fresh" and got[1][1] == pytest.approx([0.95, 0.05])


def test_greedy_grouping(spark):
    faces = table(spark, [("v", 0, [0.0, 0.0, 10.0, 10.0], [1.0, 0.0, 0.0]), ("v", 1, [0.0, 0.0, 30.0, 30.0], [0.98, 0.02, 0.0]), ("v", 2, [0.0, 0.0, 20.0, 20.0], [0.95, 0.05, 0.0]), ("v", 3, None, [0.0, 0.0, 1.0]), ("v", 4, None, [])], "video_id string, face_index int, bbox array<double>, embedding array<double>")
    got = sorted((r.group, r.face_index, r.members) for r in CL.group_in_video(faces).collect())
    assert got == [(0, 1, 3), (1, 3, 1)]


def test_person_images_and_references(spark):
    faces = table(spark, [("a", 0, [1.0, 0.0]), ("b", 0, [0.0, 1.0]), ("c", 0, [0.8, 0.6]), ("z", 0, [0.0, 0.0])], "image_id string, face_index int, embedding array<double>")
    assert {r.image_id for r in CL.person_images(faces, [1.0, 0.0]).collect()} == {"a", "c"}
    refs = table(spark, [("P", "1", [1.0, 0.0]), ("P", "2", [0.0, 1.0]), ("P", "3", [9.0, 9.0]), ("P", "3", [8.0, 8.0])], "name string, image_id string, embedding array<double>")
    mean, skipped = K.mean_reference(refs)
    assert tuples(mean) == [("P", [0.5, 0.5])] and tuples(skipped) == [("P", "3", 2)]


def test_duplicates(spark):
    rows = [("a", 0xFF), ("b", 0xFE), ("c", -1), ("d", 0xFF), ("e", None)]
    df = table(spark, rows, "id string, h long")
    got = DD.duplicate_groups(df, "id", "h", 4).collect()
    assert [(sorted(r.members), r.n) for r in got] == [(["a", "b", "d"], 3)]
    rng = random.Random(5)
    base = [rng.getrandbits(63) for _ in range(10)]
    values = [(i, base[i % 10] ^ sum(1 << rng.randrange(63) for _ in range(rng.randrange(3)))) for i in range(120)]
    df = table(spark, values, "id int, h long")
    want = {(i, j) for i, x in values for j, y in values if i < j and bin(x ^ y).count("1") <= 5}
    assert {(r.a, r.b) for r in DD.near_pairs(df, "id", "h", 5).collect()} == want
    reference = {(r.a, r.b) for r in DD.near_pairs(df, "id", "h", 5, "reference").collect()}
    assert reference <= want
    assert DD.near_pairs(df, "id", "h", 5, "reference", bucket=1).count() == 0


# ---- browsing, aggregates, queues, jobs -------------------------------------------------------------------------------


def test_timeline(spark):
    df = table(spark, [(1, "2023:01:05 00:00:00"), (2, "2024:02:01"), (3, ""), (4, "2024:02:03"), (5, None)], "uid int, date string")
    got = [(r.year, r.months, r.total) for r in B.timeline_summary(df).collect()]
    assert got == [("2024", {"02": 2}, 2), ("2023", {"01": 1}, 1), ("Unknown", {"00": 2}, 2)]
    assert [r.uid for r in B.timeline_page(df, "2024").collect()] == [4, 2]
    with pytest.raises(ValueError):
        B.timeline_page(df, None, offset=5)
    with pytest.raises(ValueError):
        B.page(df, ["uid"], 0, 501)


def test_facets(spark):
    df = table(spark, [("b", 10), ("a", 2), ("unknown", 2), ("", None)], "scene string, person_count int")
    got = {r.attribute: r["values"] for r in B.facets(df, ["scene", "person_count"]).collect()}
    assert got == {"scene": ["a", "b"], "person_count": ["2", "10"]}


def test_aggregates(spark):
    df = table(spark, [("v", 0, "park", "x", ["Dog", "ball"]), ("v", 1, "field", "longer", ["dog", " grass "]), ("v", 2, "field", "", None), ("v", 3, "park", "sixsix", ["BALL"]), ("w", 0, "unknown", None, [])], "video_id string, pos int, scene string, caption string, objects array<string>")
    assert dict(tuples(A.majority_vote(df, ["video_id"], "scene", "pos"))) == {"v": "park", "w": "unknown"}
    assert dict(tuples(A.longest(df, ["video_id"], "caption", "pos"))) == {"v": "longer", "w": ""}
    assert dict(tuples(A.ordered_union(df, ["video_id"], "objects", "pos"))) == {"v": ["Dog", "ball", "grass"]}


def test_job_logs(spark):
    log = table(spark, [("j", i, s) for i, s in enumerate(["fail", "fail", "skipped", "ok", "fail", "skipped", "fail", "fail", "ok"])], "job_id string, item_id int, status string")
    assert [r.failures for r in A.failure_runs(log, ["job_id"], ["item_id"]).orderBy("item_id").collect()] == [1, 2, 2, 0, 1, 1, 2, 3, 0]
    assert [(r.item_id, r.aborted) for r in A.until_abort(log, ["job_id"], ["item_id"], 3).orderBy("item_id").collect()][-1] == (7, True)
    jobs = table(spark, [("a", True, 1, ["x", "y"]), ("b", True, 2, ["y"]), ("c", False, 3, ["y"])], "job_id string, running boolean, started_at int, resources array<string>")
    assert tuples(A.job_conflicts(jobs)) == [("a", "b")]
    assert A.primary_job(jobs).first().job_id == "b"


def test_enrichment(spark):
    pending = table(spark, [(str(i), None if i == 3 else f"v{i}") for i in range(10)], "id string, value string").coalesce(1)
    out = J.run(pending, J.FakeEmbedder, batch=4).collect()
    assert {r.status for r in out if r.id != "3"} == {"ok"} and next(r for r in out if r.id == "3").status == "skipped"

    def failing():
        def work(items):
            return [(None, "bad", "m") for _ in items]

        return work

    out = J.run(pending, failing, batch=1, max_fail=3).collect()
    assert [r.status for r in out] == ["fail"] * 3

    def crashing():
        def work(items):
            raise RuntimeError("down")

        return work

    assert {r.error for r in J.run(pending, crashing).collect() if r.status == "fail"} == {"down"}
    asked = []
    assert J.with_budget(lambda v, n: asked.append(n) or ("{}" if n > 5000 else "{"), 4096)("x") == "{}" and asked == [4096, 8192]
    assert J.fake_faces(table(spark, [(str(i),) for i in range(30)], "id string")).count() > 0


def test_queues(spark):
    m = table(spark, [("p1", "image", "/p1", "{}", None, None), ("v1", "video", "/v1", None, None, None), ("p2", "image", "/p2", None, None, "ff")], "uid string, media_type string, path string, caption_json string, caption string, dhash string")
    assert {r.uid for r in PE.vision_pending(m).collect()} == {"p2"}
    assert {r.uid for r in PE.video_vision_pending(m).collect()} == {"v1"}
    assert {r.uid for r in PE.missing(m, None).collect()} == {"p1", "p2"}
    assert {r.uid for r in PE.hash_pending(m).collect()} == {"p1"}
    stats = PE.stage_stats(m, table(spark, [("p1",), ("gone",), ("gone2",)], "id string")).first()
    assert (stats.total, stats.captioned, stats.embedded, stats.embed_pending) == (3, 1, 3, 0)
    keys = table(spark, [("p1",)], "uid string").select(F.sha1(F.col("uid").cast("binary")).alias("key"))
    assert {r.uid for r in PE.thumbs_pending(m, keys).collect()} == {"v1", "p2"}


def test_range_search_keeps_every_row_within_the_threshold(spark):
    rows = spark.range(10_500).select("id", F.array(F.lit(1.0), F.when(F.col("id") < 10_200, 0.0).otherwise(9.0)).alias("embedding"))
    assert V.range_search(rows, [1.0, 0.0], 0.5, "id").count() == 10_200
    assert V.range_search(rows, [1.0, 0.0], 0.5, "id", most=7).count() == 7


def test_person_range_search_has_no_limit(spark):
    from lumenframe import catalogue

    plan = catalogue.QUERIES["person_range_search"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan and "Limit" not in plan
