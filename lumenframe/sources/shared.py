"""Tables in the folder that the driver and all executors share: they cut lineage, so a lost executor rereads files."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where that is unset and all tasks run in this process."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lumenframe-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str = "table") -> DataFrame:
    """df, read back from a Parquet table."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Remove tables of `written` that are no longer read."""
    for table in tables:
        spark = table.sparkSession
        with contextlib.suppress(Exception):  # a leftover is harmless
            folder = spark._jvm.org.apache.hadoop.fs.Path(table.inputFiles()[0]).getParent()
            if folder.toString().rstrip("/").split(":")[-1].startswith(shared_folder(spark).split(":")[-1]):
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
