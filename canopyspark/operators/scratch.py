"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it; a folder of our own where it is unset and Spark runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return root.rstrip("/") if root else "/tmp/canopyspark-checkpoints"


def shared_dir(spark: SparkSession, prefix: str) -> str:
    """A fresh folder below the shared one."""
    return f"{checkpoint_root(spark)}/{prefix}-{uuid.uuid4().hex}"


@contextmanager
def _own_shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that runs in here go as soon as it has ended, not when the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, prefix: str) -> DataFrame:
    """df, written once to the shared folder and read back: runs a job, cuts lineage, frees its shuffle files, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, prefix)
    with _own_shuffles_freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete the folders of written frames that no later step reads."""
    for df in frames:
        for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
