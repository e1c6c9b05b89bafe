"""Readers of the small text formats: placemarks, calibration tables, outlines."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyspark.sources import rasters

PLACEMARK = "name STRING, Point STRUCT<coordinates: STRING>, MultiGeometry STRUCT<Point: STRUCT<coordinates: STRING>>"
LINE = "ARRAY<ARRAY<DOUBLE>>"
#: The nesting of a geometry's coordinates, by its type.
NESTED = {"Point": "ARRAY<DOUBLE>", "LineString": LINE, "MultiPoint": LINE, "Polygon": f"ARRAY<{LINE}>", "MultiLineString": f"ARRAY<{LINE}>", "MultiPolygon": f"ARRAY<ARRAY<{LINE}>>"}


def stripped(text: Column) -> Column:
    """Without white space of any kind around it."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _unzipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
            with zipfile.ZipFile(io.BytesIO(content)) as packed:
                out += [{"path": path, "doc": packed.read(n).decode()} for n in packed.namelist() if n.lower().endswith(".kml")]
        yield pa.RecordBatch.from_pylist(out, pa.schema([("path", pa.string()), ("doc", pa.string())]))


def read_placemarks(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """name, lon, lat, source (file name) of all placemarks with a point, from .kml or, packed, .kmz files."""
    if packed:
        docs = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_unzipped, "path string, doc string")
        marks = docs.select(F.explode(F.regexp_extract_all("doc", F.lit("(?s)<Placemark.*?</Placemark>"), F.lit(0))).alias("x"), "path")
        marks = marks.select(F.from_xml("x", PLACEMARK).alias("m"), "path").select("m.*", "path")
    else:
        marks = spark.read.format("xml").option("rowTag", "Placemark").schema(PLACEMARK).load(path).select("*", F.input_file_name().alias("path"))
    at = F.split(stripped(F.coalesce("Point.coordinates", "MultiGeometry.Point.coordinates")), r"[,\s]+")
    found = marks.select(stripped(F.coalesce("name", F.lit(""))).alias("name"), F.get(at, F.lit(0)).cast("double").alias("lon"), F.get(at, F.lit(1)).cast("double").alias("lat"), F.substring_index("path", "/", -1).alias("source"))
    return found.where("lon IS NOT NULL")


def _calibration(docs: DataFrame) -> DataFrame:
    """product, date, look (from 0), offset, gain of documents (value, product)."""
    gains = F.split(stripped(F.expr("xpath_string(value, '//gains')")), r"\s+")
    dated = docs.select("product", F.regexp_extract("product", r"_(\d{8})_\d{6}_", 1).alias("day"), F.expr("CAST(xpath_string(value, '//offset') AS DOUBLE)").alias("offset"), gains.alias("gains"))
    dated = dated.withColumn("day", F.when(F.col("day") != "", F.col("day")).otherwise(F.raise_error(F.concat(F.lit("no acquisition date in "), "product"))))
    return dated.select("product", F.to_date("day", "yyyyMMdd").alias("date"), "offset", F.posexplode("gains").alias("look", "gain")).withColumn("gain", F.col("gain").cast("double"))


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """product, date, look (from 0), offset, gain of calibration tables; the date is in the product folder's name."""
    return _calibration(spark.read.text(path, wholetext=True).select("value", F.element_at(F.split(F.input_file_name(), "/"), -2).alias("product")))


def read_zipped_calibration(spark: SparkSession, path: str, name: str = "lutSigma.xml") -> DataFrame:
    """The same of the tables inside zip products, whose file names are the products' names; only the table is taken out of each."""
    spark.dataSource.register(rasters.ZippedText)
    docs = spark.read.format("zipped_text").option("inner", name).load(path)
    return _calibration(docs.select("value", F.regexp_replace(F.substring_index("path", "/", -1), r"\.zip$", "").alias("product")))


def read_outlines(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """source (file name), doc (a number for each document), feature, properties (as JSON), part, ring, i, lon, lat of GeoJSON: collections, features or bare geometries, one a file or one a line."""
    geometry = "STRUCT<type: STRING, coordinates: STRING>"
    schema = f"type STRING, coordinates STRING, properties STRING, geometry {geometry}, features ARRAY<STRUCT<properties: STRING, geometry: {geometry}>>"
    docs = spark.read.text(path, wholetext=not lines).select(F.from_json("value", schema).alias("d"), F.substring_index(F.input_file_name(), "/", -1).alias("source"), F.monotonically_increasing_id().alias("doc"))
    single = F.array(F.struct("d.properties", F.coalesce("d.geometry", F.struct("d.type", "d.coordinates")).alias("geometry")))
    each = docs.select("source", "doc", F.posexplode(F.coalesce("d.features", single)).alias("feature", "f")).select("source", "doc", "feature", "f.properties", "f.geometry.type", "f.geometry.coordinates")

    parts = None
    for kind, nested in NESTED.items():
        at = F.from_json("coordinates", nested)
        depth = nested.count("ARRAY")
        for _ in range(4 - depth):
            at = F.array(at)
        parts = F.when(F.col("type") == kind, at) if parts is None else parts.when(F.col("type") == kind, at)
    rings = each.select("source", "doc", "feature", "properties", F.posexplode(parts).alias("part", "rings")).select("source", "doc", "feature", "properties", "part", F.posexplode("rings").alias("ring", "at"))
    return rings.select("source", "doc", "feature", "properties", "part", "ring", F.posexplode("at").alias("i", "p")).select("source", "doc", "feature", "properties", "part", "ring", "i", F.get("p", F.lit(0)).alias("lon"), F.get("p", F.lit(1)).alias("lat"))
