"""Tile embeddings cached by date: what is cached stays, and a cache of another tile size is refused.

A cache is a Parquet table of date (partition), tile, embedding and tile_px.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "tile long, embedding array<double>, tile_px int, date string"


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path)


def cached(spark: SparkSession, folder: str) -> DataFrame:
    """The whole cache as it lies there; empty where there is none yet."""
    if not _exists(spark, folder):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(folder)


def missing(dates: DataFrame, folder: str) -> DataFrame:
    """Those of dates (a column date) that have no cached embedding."""
    have = cached(dates.sparkSession, folder).select("date").distinct()
    return dates.select("date").distinct().join(have, "date", "left_anti")


def save(embeddings: DataFrame, folder: str, tile_px: int, *, force: bool = False) -> None:
    """Add embeddings (date, tile, embedding) of dates that are not cached yet; with force, replace theirs."""
    rows = embeddings.select("tile", F.col("embedding").cast("array<double>").alias("embedding"), F.lit(tile_px).alias("tile_px"), "date")
    if not force:
        rows = rows.join(missing(rows, folder), "date", "left_semi").select("tile", "embedding", "tile_px", "date")
    writer = rows.repartition("date", F.pmod("tile", F.lit(64))).write.partitionBy("date")
    writer.mode("overwrite" if force else "append").option("partitionOverwriteMode", "dynamic").parquet(folder)


def load(spark: SparkSession, folder: str, tile_px: int) -> DataFrame:
    """date, tile and embedding; reading a row of another tile size fails."""
    other = F.concat(F.lit("cached with another tile size on "), F.col("date"))
    embedding = F.when(F.col("tile_px") == tile_px, F.col("embedding")).otherwise(F.raise_error(other))
    return cached(spark, folder).select("date", "tile", embedding.alias("embedding"))
