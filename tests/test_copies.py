"""Walks by frontier and copies with a commit protocol, on real folders."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lumenframe.operators import ingest as I
from lumenframe.sources import copies as CP
from lumenframe.sources.walk import walk


def tree(base, files):
    for rel, content in files.items():
        p = base / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(content)


def paths(df, root):
    return sorted(r.path[len(str(root)) + 1 :] for r in df.collect())


def test_walk_ends_at_cycles_and_skips_excluded(spark, tmp_path):
    root = tmp_path / "photos"
    tree(root, {"a.jpg": b"hello", "2023/05/b.MP4": b"v", "2023/notes.txt": b"t", "private/x.jpg": b"x", "private/deep/y.jpg": b"y", "$RECYCLE.BIN/z.jpg": b"z"})
    os.symlink(root, root / "2023" / "loop")
    os.symlink(root / "2023", root / "again")
    os.symlink(root / "private", root / "2023" / "way-in")
    os.symlink(root / "gone", root / "dangling.jpg")
    report = {}
    found = walk(spark, str(root), [str(root / "private")], media_only=True, skip_system=True, report=report)
    assert paths(found, root) == ["2023/05/b.MP4", "a.jpg"]
    assert report["directories"] == 3 and report["unreadable"] == 0
    sizes = {os.path.basename(r.path): (r.size, round(r.mtime, 3)) for r in found.collect()}
    assert sizes["a.jpg"] == (5, round(os.stat(root / "a.jpg").st_mtime, 3))
    assert paths(walk(spark, f"file://{root}"), root)[-1] == "private/x.jpg"
    assert walk(spark, str(tmp_path / "none")).isEmpty() and walk(spark, str(root), [str(tmp_path)]).isEmpty()


def test_walk_equals_a_plain_walk(spark, tmp_path):
    tree(tmp_path, {f"{i % 7}/{i % 5}/{'sub/' * (i % 3)}{i}.jpg": bytes(i) for i in range(120)})
    want = sorted(os.path.relpath(os.path.join(d, f), tmp_path) for d, _, names in os.walk(tmp_path) for f in names)
    assert paths(walk(spark, str(tmp_path)), tmp_path) == want


def test_mirror_copies_once_and_keeps_extras(spark, tmp_path):
    src, dst = tmp_path / "src", tmp_path / "dst"
    tree(src, {"2023/a.jpg": b"aa", "2023/clip.mp4": b"vv", "b.png": b"bb", "$RECYCLE.BIN/zombie.jpg": b"z"})
    tree(dst, {"old.mov": b"keep"})
    assert CP.mirror(spark, str(src), str(dst)) == {"copied": 3, "unchanged": 0, "removed": 0}
    assert (dst / "2023/clip.mp4").read_bytes() == b"vv" and (dst / "old.mov").exists() and not (dst / "$RECYCLE.BIN").exists()
    assert abs(os.stat(dst / "b.png").st_mtime - os.stat(src / "b.png").st_mtime) < 1e-3
    assert CP.mirror(spark, str(src), str(dst)) == {"copied": 0, "unchanged": 3, "removed": 0}
    (src / "b.png").write_bytes(b"longer")
    assert CP.mirror(spark, str(src), str(dst)) == {"copied": 1, "unchanged": 2, "removed": 0}


def test_mirror_purges_extras_and_empty_folders(spark, tmp_path):
    src, dst = tmp_path / "src", tmp_path / "dst"
    tree(src, {"keep.bin": b"k", "half/here.bin": b"h"})
    tree(dst, {"keep.bin": b"other", "gone/deep/stale.bin": b"s", "half/stale.bin": b"s"})
    assert CP.mirror(spark, str(src), str(dst), purge=True) == {"copied": 2, "unchanged": 0, "removed": 2}
    assert not (dst / "gone").exists() and (dst / "keep.bin").read_bytes() == b"k" and sorted(os.listdir(dst / "half")) == ["here.bin"]


def test_a_failure_raises_after_the_others_were_copied(spark, tmp_path):
    src, dst = tmp_path / "src", tmp_path / "dst"
    tree(src, {"a.jpg": b"aa", "b.jpg": b"bb"})
    tree(dst, {"b.jpg/in the way": b"x"})
    with pytest.raises(RuntimeError, match="1 files failed .*b.jpg"):
        CP.mirror(spark, str(src), str(dst))
    assert (dst / "a.jpg").read_bytes() == b"aa"
    files = spark.createDataFrame([(str(src / "a.jpg"), str(dst / "new/a.jpg")), (str(src / "missing.jpg"), str(dst / "new/m.jpg"))], "source string, target string")
    out = {os.path.basename(r.target): r.error for r in CP.copy_files(files, str(dst)).collect()}
    assert out["a.jpg"] is None and "missing.jpg" in out["m.jpg"] and not (dst / "new/m.jpg").exists()


def test_a_task_that_dies_leaves_nothing(tmp_path):
    tree(tmp_path, {"a.jpg": b"aa"})
    run = tmp_path / CP.RUNS / "one"
    writer = CP.CopyWriter(str(run))

    def rows():
        yield {"source": str(tmp_path / "a.jpg"), "target": str(tmp_path / "out/a.jpg")}
        raise MemoryError

    with pytest.raises(MemoryError):
        writer.write(rows())
    assert os.listdir(run / "staging") == [] and os.listdir(run / "manifests") == [] and not (tmp_path / "out").exists()
    writer.abort([])
    assert not run.exists()


def test_runs_that_were_cut_off(spark, tmp_path):
    """Committed: finished, also if some files were renamed already. Not committed, or an attempt that doesn't count: gone."""
    tree(tmp_path, {"a.jpg": b"aa", "b.jpg": b"bb"})
    run = tmp_path / "out" / CP.RUNS / "one"
    writer = CP.CopyWriter(str(run))
    message = writer.write([{"source": str(tmp_path / n), "target": str(tmp_path / "out" / n)} for n in ("a.jpg", "b.jpg")])
    writer.write([{"source": str(tmp_path / "a.jpg"), "target": str(tmp_path / "out/never.jpg")}])
    writer.commit([message])
    first = json.loads(open(message.manifest).readline())
    os.rename(first["staged"], first["target"])
    other = CP.CopyWriter(str(tmp_path / "out" / CP.RUNS / "two"))
    other.write([{"source": str(tmp_path / "a.jpg"), "target": str(tmp_path / "out/lost.jpg")}])
    assert CP.finish_runs(spark, str(tmp_path / "out")) == 1
    assert sorted(os.listdir(tmp_path / "out")) == [CP.RUNS, "a.jpg", "b.jpg"] and os.listdir(tmp_path / "out" / CP.RUNS) == ["one"]
    assert not (run / "staging").exists() and CP.finish_runs(spark, str(tmp_path / "out")) == 0


def test_import_carries_out_a_plan(spark, tmp_path):
    src, lib = tmp_path / "in", tmp_path / "lib"
    tree(src, {"x/p.jpg": b"1", "y/p.jpg": b"2", "z/q.jpg": b"1", "k.jpg": b"3"})
    staged = walk(spark, str(src)).withColumn("sha1", F.when(F.col("path").contains("y/"), "bbbbbbbbbb").when(F.col("path").contains("k."), "cc").otherwise("aaaaaaaaaa")).withColumn("date", F.lit("2024:03:02 10:00:00"))
    seen = spark.createDataFrame([("cc",)], "sha1 string")
    plan = I.ingest_plan(staged, seen, str(lib), spark.createDataFrame([], "path string"))
    out = CP.import_files(plan, str(lib))
    assert out.count() == 2 and sorted(os.listdir(lib / "2024/03")) == ["p-bbbbbbbb.jpg", "p.jpg"]
    assert (lib / "2024/03/p-bbbbbbbb.jpg").read_bytes() == b"2"
