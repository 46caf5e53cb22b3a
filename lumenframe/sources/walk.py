"""Walk of a folder tree that all tasks see (a mounted share, or a store by its URI): directories are listed in tasks, level by level."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions.paths import IMAGES, VIDEOS, extension, is_system_name
from lumenframe.operators.ingest import is_excluded
from lumenframe.sources.shared import forget, written

ENTRIES = "path string, real string, is_dir boolean, size long, mtime double, error string"
#: Directories that one task lists.
A_TASK = 256


def _remote(path: str) -> bool:
    """Whether a path names a store, which has no links; a mounted folder may."""
    return "://" in path


def _local(folder: str) -> Iterator[tuple]:
    """The entries of a folder, links followed; a link that leads nowhere is left out."""
    with os.scandir(folder) as entries:
        for e in entries:
            try:
                stat = e.stat()
                is_dir = e.is_dir()
                yield e.path, os.path.realpath(e.path) if is_dir else None, is_dir, None if is_dir else stat.st_size, stat.st_mtime, None
            except OSError:
                continue


def _store(uri: str) -> Iterator[tuple]:
    from pyarrow.fs import FileSelector, FileSystem, FileType

    store, root = FileSystem.from_uri(uri)
    scheme = uri[: len(uri) - len(root)] if uri.endswith(root) else ""
    for e in store.get_file_info(FileSelector(root)):
        is_dir = e.type == FileType.Directory
        yield scheme + e.path, scheme + e.path if is_dir else None, is_dir, e.size, e.mtime.timestamp() if e.mtime else None, None


def _list(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in ENTRIES.split(", ")]
    for pdf in frames:
        for folder in pdf["path"]:
            rows = []
            try:
                rows.extend(_store(folder) if _remote(folder) else _local(folder))
            except OSError as e:
                rows.append((folder, None, True, None, None, str(e)))
            yield pd.DataFrame(rows, columns=columns).astype({"size": "Int64"})


def walk(spark: SparkSession, root: str, excluded: list[str] | None = None, media_only: bool = False, skip_system: bool = False, report: dict | None = None) -> DataFrame:
    """(path, size, mtime) of all files under a folder; file: URIs are walked as the folders they name.

    The directories of a level are the frontier: those whose real path was met before (links back to a parent, two links to one folder) or lies
    in an excluded folder drop out by an anti-join before they are listed, so a cycle ends and an excluded subtree is never read. Of several paths to
    one directory in a level the least is walked. A directory that can't be read is skipped and counted.
    report: levels, directories listed, directories that couldn't be read.
    """
    root = root.rstrip("/").removeprefix("file://") or "/"
    excluded = [e if _remote(e) else os.path.realpath(e.removeprefix("file://")) for e in excluded or []]
    real = root if _remote(root) else os.path.realpath(root)
    frontier = spark.createDataFrame([(root, real)], "path string, real string").where(~is_excluded("real", excluded))
    found, visited, levels, listed = [], None, 0, 0
    while True:
        new = frontier.groupBy("real").agg(F.min("path").alias("path")).where(~is_excluded("real", excluded))
        if visited is not None:
            new = new.join(visited, "real", "left_anti")
        new = written(new, "frontier")
        n = new.count()
        if not n:
            forget(new)
            break
        entries = written(new.select("path").repartition(-(-n // A_TASK)).mapInPandas(_list, ENTRIES), "entries")
        found.append(entries)
        visited = new.select("real") if visited is None else visited.unionByName(new.select("real"))
        frontier = entries.where("is_dir AND error IS NULL").select("path", "real")
        if skip_system:
            frontier = frontier.where(~is_system_name(F.element_at(F.split("path", "/"), -1)))
        levels, listed = levels + 1, listed + n
    schema = "path string, size long, mtime double"
    if not found:
        return spark.createDataFrame([], schema)
    every = found[0]
    for entries in found[1:]:
        every = every.unionByName(entries)
    if report is not None:
        report |= {"levels": levels, "directories": listed, "unreadable": every.where("error IS NOT NULL").count()}
    files = every.where("NOT is_dir").select("path", "size", "mtime")
    return files.where(extension("path").isin(*IMAGES, *VIDEOS)) if media_only else files
