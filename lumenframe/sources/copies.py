"""Copies of files as a sink with a commit protocol: mirrors and imports that survive lost tasks.

A run has a folder of its own at the destination. Tasks copy into its staging part under names of their own and list what they did in
a manifest. When all tasks have ended, the commit names the manifests that count; attempts that were lost or ran twice aren't
named. Only then are files renamed to their targets, in tasks again. Renaming twice does no harm, so a run that was cut off after its commit is finished
by the next one, and one cut off before leaves nothing. No reader meets a file that is half written.

Folders must be mounted on all executors. A file that can't be copied is reported and the others go on; at the end any failure raises.
"""

from __future__ import annotations

import contextlib
import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from lumenframe.functions.paths import ancestors
from lumenframe.operators.ingest import mirror_plan
from lumenframe.sources.shared import written
from lumenframe.sources.walk import walk

RUNS = ".lumenframe-runs"
MANIFEST = "source string, target string, staged string, size long, error string"
OUTCOME = "source string, target string, size long, error string"
#: Files that one task copies or renames.
A_TASK = 64


@dataclass
class Copied(WriterCommitMessage):
    manifest: str


class CopyWriter(DataSourceWriter):
    """Copies rows(source, target) into a run's staging folder."""

    def __init__(self, run: str):
        self.run = run

    def write(self, iterator) -> Copied:
        name = f"{TaskContext.get().partitionId() if TaskContext.get() else 0:05d}-{uuid.uuid4().hex}"
        staging = f"{self.run}/staging/{name}"
        os.makedirs(staging, exist_ok=True)
        os.makedirs(f"{self.run}/manifests", exist_ok=True)
        try:
            with open(f"{staging}/.manifest", "w") as out:
                for n, row in enumerate(iterator):
                    staged, error, size = f"{staging}/{n}", None, None
                    try:
                        shutil.copy2(row["source"], staged)  # with its time, by which the next run knows it
                        size = os.path.getsize(staged)
                    except OSError as e:
                        error = f"{row['source']}: {e}"
                    out.write(json.dumps({"source": row["source"], "target": row["target"], "staged": staged, "size": size, "error": error}) + "\n")
            os.replace(f"{staging}/.manifest", f"{self.run}/manifests/{name}.json")
        except BaseException:
            shutil.rmtree(staging, ignore_errors=True)
            raise
        return Copied(f"{self.run}/manifests/{name}.json")

    def commit(self, messages: list) -> None:
        with open(f"{self.run}/.commit", "w") as out:
            json.dump([m.manifest for m in messages if m], out)  # a name for each task
        os.replace(f"{self.run}/.commit", f"{self.run}/commit")

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.run, ignore_errors=True)


class CopySource(DataSource):
    """`df.write.format("file_copies").option("run", folder)` for df(source, target)."""

    @classmethod
    def name(cls) -> str:
        return "file_copies"

    def writer(self, schema, overwrite: bool) -> CopyWriter:
        return CopyWriter(self.options["run"])


def _rename(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        errors = []
        for r in pdf.itertuples():
            error = r.error
            if error is None:
                try:
                    os.makedirs(os.path.dirname(r.target), exist_ok=True)
                    if os.path.exists(r.staged):
                        os.replace(r.staged, r.target)
                    elif not os.path.isfile(r.target):
                        error = f"{r.target}: neither staged nor there"
                except OSError as e:
                    error = f"{r.target}: {e}"
            errors.append(error)
        yield pdf[["source", "target", "size"]].assign(error=errors)


def publish(spark: SparkSession, run: str) -> DataFrame:
    """Rename what a committed run has staged, and keep OUTCOME beside it."""
    with open(f"{run}/commit") as f:
        manifests = json.load(f)
    rows = spark.read.schema(MANIFEST).json(manifests) if manifests else spark.createDataFrame([], MANIFEST)
    rows = rows.repartition(max(1, -(-rows.count() // A_TASK)))
    rows.mapInPandas(_rename, OUTCOME).write.mode("overwrite").parquet(f"file://{run}/outcome")
    shutil.rmtree(f"{run}/staging", ignore_errors=True)
    os.replace(f"{run}/commit", f"{run}/done")
    return spark.read.schema(OUTCOME).parquet(f"file://{run}/outcome")


def finish_runs(spark: SparkSession, dest: str) -> int:
    """Finish runs that were cut off after their commit, remove those that were cut off before. Returns how many were finished."""
    folder, finished = f"{dest}/{RUNS}", 0
    for name in sorted(os.listdir(folder)) if os.path.isdir(folder) else ():
        run = f"{folder}/{name}"
        if os.path.exists(f"{run}/commit"):
            publish(spark, run)
            finished += 1
        elif not os.path.exists(f"{run}/done"):
            shutil.rmtree(run, ignore_errors=True)
    return finished


def copy_files(files: DataFrame, dest: str) -> DataFrame:
    """Copy files(source, target), each target under `dest`; OUTCOME of all of them."""
    spark = files.sparkSession
    run = f"{os.path.abspath(dest)}/{RUNS}/{uuid.uuid4().hex}"
    os.makedirs(run)
    spark.dataSource.register(CopySource)
    files = files.select("source", "target")
    files.repartition(max(1, -(-files.count() // A_TASK))).write.format("file_copies").option("run", run).mode("append").save()
    return publish(spark, run)


def _remove(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        errors = []
        for path in pdf["path"]:
            try:
                os.remove(path)
                errors.append(None)
            except FileNotFoundError:
                errors.append(None)
            except OSError as e:
                errors.append(f"{path}: {e}")
        yield pd.DataFrame({"path": pdf["path"], "error": pd.Series(errors, dtype=object)})


def _remove_empty(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        for here, there in zip(pdf["here"], pdf["there"], strict=True):
            if not os.path.isdir(there):
                with contextlib.suppress(OSError):  # it isn't empty
                    os.rmdir(here)
        yield pdf[["here"]].head(0)


def purge_files(extra: DataFrame, source: str, dest: str) -> DataFrame:
    """Remove the files extra(path) under `dest`, then folders above them that are empty and that `source` hasn't, the deepest first. (path, error)."""
    extra = written(extra.select("path"), "extra")
    paths = extra.select(F.concat(F.lit(f"{dest}/"), "path").alias("path"))
    done = written(paths.repartition(max(1, -(-extra.count() // A_TASK))).mapInPandas(_remove, "path string, error string"), "removed")
    folders = written(extra.select(F.explode(ancestors("path")).alias("folder"), "path").where("folder <> path AND folder <> ''").select("folder").distinct().withColumn("depth", F.size(F.split("folder", "/"))), "folders")
    for depth in range(folders.agg(F.max("depth")).first()[0] or 0, 0, -1):
        level = folders.where(F.col("depth") == depth).select(F.concat(F.lit(f"{dest}/"), "folder").alias("here"), F.concat(F.lit(f"{source}/"), "folder").alias("there"))
        level.mapInPandas(_remove_empty, "here string").count()
    return done


def mirror(spark: SparkSession, source: str, dest: str, purge: bool = False, slack: float = 2.0) -> dict[str, int]:
    """Copy what is new or changed under `source` to the same place under `dest`; with `purge` remove what only `dest` has, and folders left empty.

    Returns how many were copied, unchanged and removed. Raises if any file failed, after the others were copied.
    """
    source, dest = os.path.abspath(source), os.path.abspath(dest)
    os.makedirs(dest, exist_ok=True)
    finish_runs(spark, dest)

    def listing(root: str) -> DataFrame:
        rows = walk(spark, root, [f"{dest}/{RUNS}"], skip_system=True)
        return rows.withColumn("path", F.substring("path", len(root) + 2, 1 << 20))

    plan = written(mirror_plan(listing(source), listing(dest), purge, slack), "plan")
    copies = plan.where("action = 'copy'").select(F.concat(F.lit(f"{source}/"), "path").alias("source"), F.concat(F.lit(f"{dest}/"), "path").alias("target"))
    unchanged = plan.where("action = 'unchanged'").count()
    extra = written(plan.where("action = 'remove'").select("path"), "extra") if purge else None
    copied, failed, first = copy_files(copies, dest).agg(F.count(F.when(F.col("error").isNull(), 1)), F.count("error"), F.min("error")).first()
    removed = 0
    if purge:
        removed, more, error = purge_files(extra, source, dest).agg(F.count(F.when(F.col("error").isNull(), 1)), F.count("error"), F.min("error")).first()
        failed, first = failed + more, first or error
    if failed:
        raise RuntimeError(f"{failed} files failed (first: {first}); {copied} copied, {unchanged} unchanged")
    return {"copied": copied, "unchanged": unchanged, "removed": removed}


def import_files(plan: DataFrame, dest: str) -> DataFrame:
    """Carry out an ingest plan(path, action, target): OUTCOME of its copies. Any failure raises after the others were copied."""
    finish_runs(plan.sparkSession, os.path.abspath(dest))
    out = copy_files(plan.where("action = 'copy'").select(F.col("path").alias("source"), "target"), dest)
    failed, first = out.agg(F.count("error"), F.min("error")).first()
    if failed:
        raise RuntimeError(f"{failed} files failed (first: {first})")
    return out
