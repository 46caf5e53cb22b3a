"""Incremental scans, staging, mirrors and folders, as set operations on listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions import paths as P
from lumenframe.functions.hashing import signature
from lumenframe.operators.components import with_least


def to_hash(listing: DataFrame, previous: DataFrame) -> DataFrame:
    """The files whose path is new or whose signature changed: only these need their content read."""
    old = previous.select("path", F.col("sig").alias("__sig"))
    now = signature("size", "mtime")
    return listing.join(old, "path", "left").where(F.col("__sig").isNull() | (F.col("__sig") != now)).drop("__sig")


def scan(listing: DataFrame, previous: DataFrame, lists: bool = True) -> DataFrame:
    """The change set of a scan: (uid, path, dup_paths, action).

    listing(path, size, mtime, sha1): live files; previous(uid, path, sig). Copies of the same content get the smallest
    live path as the canonical one and the others as copies. Actions: added (new content), moved (known content, other
    canonical path), unchanged, retired (its path now holds other content and no other live file has its own). Content
    whose file merely vanished stays in the catalog and is not in the change set.

    Without `lists` there is no dup_paths, and no row that holds all paths of one content (empty files are all one): `scan_copies` has them as rows.
    """
    live = listing.groupBy(F.col("sha1").alias("uid")).agg(F.min("path").alias("first"))
    old = previous.select("uid", F.col("path").alias("old_path"))
    j = live.join(old, "uid", "full_outer")
    kept = F.col("first").isNotNull()
    taken = listing.select(F.col("path").alias("old_path"), F.lit(True).alias("taken")).distinct()
    j = j.join(taken, "old_path", "left")
    action = F.when(F.col("old_path").isNull(), "added").when(F.col("first") == F.col("old_path"), "unchanged").when(kept, "moved").when(F.col("taken"), "retired")
    out = j.select("uid", F.col("first").alias("path"), action.alias("action")).where("action IS NOT NULL")
    if not lists:
        return out
    copies = scan_copies(listing).groupBy("uid").agg(F.array_sort(F.collect_set("copy")).alias("dup_paths"))
    empty = F.when(F.col("path").isNotNull(), F.array().cast("array<string>"))
    return out.join(copies, "uid", "left").select("uid", "path", F.coalesce("dup_paths", empty).alias("dup_paths"), "action")


def scan_copies(listing: DataFrame) -> DataFrame:
    """(uid, path, copy): the paths of each content besides the canonical one. A content's paths are dealt over salted keys."""
    rows = with_least(listing.select(F.col("sha1").alias("uid"), F.col("path").alias("copy")).distinct(), ["uid"], "copy", "path")
    return rows.where("copy <> path").select("uid", "path", "copy")


def scan_summary(changes: DataFrame) -> DataFrame:
    return changes.agg(*[F.count_if(F.col("action") == a).alias(a) for a in ("added", "moved", "unchanged", "retired")], F.array_sort(F.collect_list(F.when(F.col("action") == "moved", F.col("uid")))).alias("moved_ids"))


def staging_files(listing: DataFrame, source: str, media: str = "both") -> DataFrame:
    """Wanted files under a source, none inside system folders, by path."""
    parts = F.slice(F.split(P.slashes("path"), "/"), F.lit(1), F.greatest(F.size(F.split(P.slashes("path"), "/")) - 1, F.lit(0)))
    rows = listing.where(P.under("path", F.lit(source)) & P.wanted(P.extension("path"), media) & ~F.exists(parts, P.is_system_name))
    return rows.orderBy("path")


def source_stats(listing: DataFrame) -> DataFrame:
    """Counts by kind, and the bytes of media only."""
    e = P.extension("path")
    photo, video = e.isin(*P.IMAGES), e.isin(*P.VIDEOS)
    return listing.agg(F.count_if(photo).alias("photos"), F.count_if(video).alias("videos"), F.count_if(~(photo | video)).alias("other"), F.coalesce(F.sum(F.when(photo | video, F.col("size"))), F.lit(0)).alias("bytes"))


def ingest_plan(staged: DataFrame, seen: DataFrame, dest: str, taken: DataFrame) -> DataFrame:
    """(path, sha1, action, target): each new content once, from its first path, to dest/YYYY/MM/name; a name that is
    taken, or claimed by an earlier path, gets -{first 8 of the hash}. staged(path, sha1, date 'YYYY:MM:DD ..')."""
    first = F.row_number().over(Window.partitionBy("sha1").orderBy("path"))
    rows = staged.withColumn("n", first).join(seen.select("sha1", F.lit(True).alias("known")).distinct(), "sha1", "left")
    rows = rows.withColumn("action", F.when(F.col("known"), "known").when(F.col("n") > 1, "duplicate").otherwise("copy"))
    name = P.base_name("path")
    year, month = F.lpad(F.substring("date", 1, 4), 4, "0"), F.lpad(F.substring("date", 6, 2), 2, "0")
    plain = F.concat_ws("/", F.lit(dest), year, month, name)
    copies = rows.where("action = 'copy'").withColumn("plain", plain)
    copies = copies.join(taken.select(F.col("path").alias("plain"), F.lit(True).alias("taken")).distinct(), "plain", "left")
    claim = F.row_number().over(Window.partitionBy("plain").orderBy("path"))
    stem, ext = F.regexp_replace("plain", r"(\.[^./]*)$", ""), F.regexp_extract("plain", r"(\.[^./]*)$", 1)
    other = F.concat(stem, F.lit("-"), F.substring("sha1", 1, 8), ext)
    copies = copies.withColumn("target", F.when(F.col("taken") | (claim > 1), other).otherwise(F.col("plain")))
    rest = rows.where("action <> 'copy'").withColumn("target", F.lit(None).cast("string"))
    return copies.select("path", "sha1", "action", "target").unionByName(rest.select("path", "sha1", "action", "target"))


def mirror_plan(source: DataFrame, dest: DataFrame, purge: bool = False, slack: float = 2.0) -> DataFrame:
    """(path, action) of listings(path, size, mtime): copy if missing, of another size, or more than `slack` seconds apart."""
    s = source.select("path", F.col("size").alias("s1"), F.col("mtime").alias("m1"))
    d = dest.select("path", F.col("size").alias("s2"), F.col("mtime").alias("m2"))
    same = (F.col("s1") == F.col("s2")) & (F.abs(F.col("m1") - F.col("m2")) <= slack)
    action = F.when(F.col("s1").isNull(), "remove" if purge else "keep_extra").when(F.col("s2").isNull() | ~same, "copy").otherwise("unchanged")
    return s.join(d, "path", "full_outer").select("path", action.alias("action"))


def effective_roots(folders: DataFrame, path: str = "path") -> DataFrame:
    """Folders that lie under no other one: each folder's ancestors are looked up among the folders."""
    rows = folders.select(P.slashes(path).alias("p")).distinct()
    above = rows.select("p", F.explode(P.ancestors("p")).alias("a")).where("a <> p")
    nested = above.join(rows.select(F.col("p").alias("a")), "a", "left_semi").select("p").distinct()
    return rows.join(nested, "p", "left_anti").select(F.col("p").alias(path))


def add_folder(folders: DataFrame, new: str, today: str) -> DataFrame:
    """folders(path, kind, added_at, ..) with a folder included; those it contains are dropped, one inside another is not added."""
    inside = not folders.where((F.col("kind") == "included") & P.under(F.lit(new), F.col("path"))).isEmpty()
    if inside:
        return folders
    rest = folders.where(~((F.col("kind") == "included") & P.under("path", F.lit(new))))
    row = folders.sparkSession.createDataFrame([(new, "included", today)], "path string, kind string, added_at string")
    return rest.unionByName(row, allowMissingColumns=True)


def exclude_folder(folders: DataFrame, new: str, today: str) -> DataFrame:
    row = folders.sparkSession.createDataFrame([(new, "excluded", today)], "path string, kind string, added_at string")
    return folders.where(~((F.col("kind") == "excluded") & (F.col("path") == new))).unionByName(row, allowMissingColumns=True)


def is_excluded(path, excluded: list[str]) -> Column:
    out = F.lit(False)
    for e in excluded:
        out = out | P.under(path, F.lit(e))
    return out


def overlap(a: str, b: str) -> Column:
    """'inside', 'contains', 'same' or NULL for two folders."""
    x, y = F.lit(a), F.lit(b)
    return F.when(P.slashes(x) == P.slashes(y), "same").when(P.under(x, y), "inside").when(P.under(y, x), "contains")


def validate_dest(folders: DataFrame, dest: str) -> DataFrame:
    """(ok, reason): a destination must not be a library folder, inside one, or around one."""
    bad = folders.where("kind = 'included'").select("path", F.when(P.under(F.lit(dest), F.col("path")), "inside").when(P.under(F.col("path"), F.lit(dest)), "contains").alias("why")).where("why IS NOT NULL")
    return bad.agg((F.count(F.lit(1)) == 0).alias("ok"), F.min(F.concat_ws(" ", "why", "path")).alias("reason"))


def backup_roots(folders: DataFrame) -> DataFrame:
    """(path, label): a folder's own name, or its whole path where several share it."""
    n = F.count(F.lit(1)).over(Window.partitionBy("b"))
    rows = folders.select("path", P.base_name("path").alias("b"))
    return rows.select("path", F.when(n == 1, F.col("b")).otherwise(P.backup_label("path")).alias("label"))


#: What a folder may be used for: which overlaps with folders of which kind are refused, and whether it has to lie in the library.
PURPOSES = {
    "import_from": ({("excluded", "inside"), ("included", "inside")}, False),
    "import_into": ({("excluded", "inside")}, True),
    "backup": ({(k, how) for k in ("included", "excluded") for how in ("inside", "contains")}, False),
}


def check_paths(candidates: DataFrame, folders: DataFrame, purpose: str) -> DataFrame:
    """(path, ok, reason) of candidates(path) against folders(path, kind); a reason names the least overlap, excluded ones
    first, or says 'outside'. Overlaps are equi-joins on ancestors, in both directions."""
    refused, must_lie_inside = PURPOSES[purpose]
    c = candidates.select(P.slashes("path").alias("path")).distinct()
    f = folders.select(P.slashes("path").alias("folder"), "kind").distinct()
    inside = c.select("path", F.explode(P.ancestors("path")).alias("folder")).join(f, "folder").withColumn("how", F.lit("inside"))
    around = f.select("folder", "kind", F.explode(P.ancestors("folder")).alias("path")).where("path <> folder").join(c, "path", "left_semi").withColumn("how", F.lit("contains"))
    pairs = inside.select("path", "folder", "kind", "how").unionByName(around)
    bad = F.lit(False)
    for kind, how in sorted(refused):
        bad = bad | ((F.col("kind") == kind) & (F.col("how") == how))
    worst = F.min(F.when(bad, F.struct((F.col("kind") == "included").alias("rank"), F.concat_ws(" ", "kind", "how", "folder").alias("text"))))
    per = pairs.groupBy("path").agg(worst.getField("text").alias("bad"), F.bool_or((F.col("kind") == "included") & (F.col("how") == "inside")).alias("home"))
    j = c.join(per, "path", "left")
    homeless = ~F.coalesce("home", F.lit(False)) & F.lit(must_lie_inside)
    reason = F.coalesce(F.when(F.col("path") == "", "empty"), F.col("bad"), F.when(homeless, "outside"))
    return j.select("path", reason.isNull().alias("ok"), reason.alias("reason"))
