"""Files: listings, content ids, and side tables that may be missing or broken."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions.paths import IMAGES, VIDEOS, extension, is_system_name, slashes
from lumenframe.operators.ingest import is_excluded

#: Wanted endings in any case, for the scan's own file filter.
MEDIA_GLOB = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e[1:]) for e in (*IMAGES, *VIDEOS)) + "}"


def list_files(spark: SparkSession, root: str, excluded: list[str] | None = None, media_only: bool = True, content: bool = False) -> DataFrame:
    """(path, size, mtime[, sha1]) of the files under a folder, none in excluded or system folders.

    The content column is read only where its hash is asked for.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if media_only:
        reader = reader.option("pathGlobFilter", MEDIA_GLOB)
    path = F.regexp_replace("path", "^file:/+", "/")
    rows = reader.load(root).withColumn("path", path)
    inside = F.substring("path", len(root.rstrip("/")) + 2, 1 << 20)
    rows = rows.where(~is_excluded("path", excluded or []) & ~F.exists(F.slice(F.split(inside, "/"), F.lit(1), F.greatest(F.size(F.split(inside, "/")) - 1, F.lit(0))), is_system_name))
    columns = ["path", F.col("length").alias("size"), (F.unix_micros("modificationTime") / 1e6).alias("mtime")]
    return rows.select(*columns, F.sha1("content").alias("sha1")) if content else rows.select(*columns)


CURRENT = "_current"


def _version(spark: SparkSession, path: str) -> str | None:
    """The folder that holds a side table now: the one its pointer names, or the path itself where no pointer is."""
    paths = spark._jvm.org.apache.hadoop.fs.Path
    root, pointer = paths(path), paths(f"{path}/{CURRENT}")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(pointer):
        stream = fs.open(pointer)
        try:
            return f"{path}/{bytes(stream.readAllBytes()).decode()}"
        finally:
            stream.close()
    return path if fs.exists(root) else None


def read_side_table(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """A JSON-lines side table; missing files give no rows, and broken lines are skipped unless `strict`."""
    found = _version(spark, path)
    if found is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(found)


def write_side_table(df: DataFrame, path: str) -> None:
    """Replace a side table. The new one is written whole as a version of its own; then a pointer to it is renamed over the old
    pointer in one step. So readers meet the old table or the new one and never none, a table may replace itself, and a
    failed write leaves the old one. The version before stays for readers that have begun; older ones go."""
    spark, name = df.sparkSession, f"v-{uuid.uuid4().hex}"
    jvm, before = spark._jvm, _version(spark, path)
    paths, conf = jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    df.write.json(f"{path}/{name}")
    root, fresh, pointer = paths(path), paths(f"{path}/_{name}"), paths(f"{path}/{CURRENT}")
    fs = root.getFileSystem(conf)
    out = fs.create(fresh, True)
    out.write(name.encode())
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(context.makeQualified(fresh), context.makeQualified(pointer), options)
    kept = {name, CURRENT, before.rsplit("/", 1)[-1] if before else None}
    for status in fs.listStatus(root):
        if status.getPath().getName() not in kept and status.getPath().getName().startswith("v-"):
            fs.delete(status.getPath(), True)


def load_faces(spark: SparkSession, folder: str) -> DataFrame:
    """(image_id, face_index, bbox, embedding) of a folder with one JSON array of faces a file, named after its image.

    Files that begin with _, broken files and faces without an embedding are skipped.
    """
    kind = "array<struct<bbox:array<double>,embedding:array<double>>>"
    files = spark.read.option("wholetext", "true").option("pathGlobFilter", "[!_]*.json").text(folder).select("value", F.col("_metadata.file_name").alias("f"))
    rows = files.select(F.regexp_replace("f", "\\.json$", "").alias("image_id"), F.posexplode(F.from_json("value", kind)).alias("face_index", "x"))
    return rows.select("image_id", "face_index", "x.bbox", "x.embedding").where("size(embedding) > 0")


def by_ids(df: DataFrame, ids: list, key: str = "id", most: int = 500) -> DataFrame:
    """Rows of a few ids by a pushed filter, of many by a semi-join."""
    if len(ids) <= most:
        return df.where(F.col(key).isin(ids))
    table = df.sparkSession.createDataFrame([(i,) for i in ids], f"{key} {df.schema[key].dataType.simpleString()}")
    return df.join(table, key, "left_semi")


def media_fields(df: DataFrame, photo: Column, video: Column) -> DataFrame:
    """df with `fields` from the extractor that its file kind calls for."""
    return df.withColumn("fields", F.when(extension("path").isin(*VIDEOS), video).otherwise(photo))


__all__ = ["by_ids", "list_files", "load_faces", "media_fields", "read_side_table", "slashes", "write_side_table"]
