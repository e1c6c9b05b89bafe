"""Queries through files: layers as GeoTIFF, tables as CSV and JSON, placemarks, calibration tables, outlines; the dense overlay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyspark.functions import geo
from canopyspark.operators import kernels, rules
from canopyspark.operators.scratch import shared_dir, written
from canopyspark.plans import queries as core
from canopyspark.plans.layers import HOLED, holed, scene
from canopyspark.plans.queries import LABELS, MIRROR, PIXELS, PLANTS, _px
from canopyspark.sources import files, geotiff
from canopyspark.sources.synthetic import height, labels

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def through(df: DataFrame, form: str, **options) -> DataFrame:
    """df, written to the shared folder in a text format and read back with its schema."""
    path = shared_dir(df.sparkSession, f"results-{form}")
    df.write.format(form).options(**options).save(path)
    return df.sparkSession.read.format(form).options(**options).schema(df.schema).load(path)


@query(HOLED + " SELECT r, c, v FROM v")
def geotiff_scene(spark, d):
    """A scene with holes through GeoTIFF files of floats: holes come back as NULL."""
    encoded = written(geotiff.layer_files(holed(spark, d), "sigma0_20200301"), "layer-files")
    return geotiff.file_pixels(encoded).select("r", "c", F.col("v").cast("long").alias("v"))


@query(LABELS + ", grid AS (SELECT i // 256 AS r, i % 256 AS c FROM (SELECT unnest(range(height * 256)) AS i FROM ht) t) SELECT r, c, coalesce(year, 0) AS year FROM grid LEFT JOIN lb USING (r, c)")
def geotiff_labels(spark, d):
    """The layer of label years through GeoTIFF files of integers: no label is 0."""
    grid = scene(spark, d).select("r", "c").join(labels(spark, d).hint("merge"), ["r", "c"], "left")
    encoded = written(geotiff.layer_files(grid.withColumnRenamed("year", "v"), "amw_year", "int16"), "layer-files")
    return geotiff.file_pixels(encoded).select("r", "c", F.col("v").cast("int").alias("year"))


@query(core.ORACLES["alerts_ranked"])
def results_alerts_csv(spark, d):
    """The alert table through a CSV file with a header."""
    return through(core.alerts_ranked(spark, d), "csv", header=True)


@query(core.ORACLES["crackdown_table"])
def results_crackdown_csv(spark, d):
    return through(core.crackdown_table(spark, d), "csv", header=True)


@query(core.ORACLES["evaluate4"])
def results_accuracy_json(spark, d):
    """The accuracy table through JSON; an undefined precision stays NULL."""
    return through(core.evaluate4(spark, d), "json")


@query(f"WITH {PLANTS} SELECT count(*) AS n, sum(mdb)::BIGINT AS total FROM sc WHERE k = 0")
def cache_kept(spark, d):
    """A cached layer is not written again: the first scene stays when the second comes for the same place."""
    path = shared_dir(spark, "cache")
    for k in (0, 1):
        scene(spark, d, k).write.mode("ignore").parquet(path)
    return spark.read.parquet(path).agg(F.count("*").alias("n"), F.sum("mdb").alias("total"))


PINS_A_FILE = 1000
_PIN_LON = "-(70000000 + c_custkey * 7919 % 900000) / 1000000"
_PIN_LAT = "-(12000000 + c_custkey * 104729 % 900000) / 1000000"


@query(f"SELECT CASE WHEN c_custkey % 11 = 0 THEN '' ELSE 'Pit & pond ' || c_custkey END AS name, round({_PIN_LON.replace('1000000', '1000000::DOUBLE')}, 6) AS lon, round({_PIN_LAT.replace('1000000', '1000000::DOUBLE')}, 6) AS lat FROM customer WHERE c_custkey % 7 <> 0")
def kml_pins(spark, d):
    """Placemarks through KML files: entities, padded text, marks without a name, and without a point (left out)."""
    name = F.when(F.col("c_custkey") % 11 != 0, F.concat(F.lit("<name> Pit &amp; pond "), "c_custkey", F.lit(" </name>"))).otherwise("")
    at = F.format_string("%.6f,%.6f,0", F.expr(_PIN_LON).cast("double"), F.expr(_PIN_LAT).cast("double"))
    point = F.concat(F.lit("<Point><coordinates>\n "), at, F.lit(" </coordinates></Point>"))
    shape = F.when(F.col("c_custkey") % 7 == 0, "<LineString/>").when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("<MultiGeometry>"), point, F.lit("</MultiGeometry>"))).otherwise(point)
    marks = spark.read.parquet(f"{d}/customer.parquet").select(F.floor(F.col("c_custkey") / PINS_A_FILE).alias("file"), F.concat(F.lit("<Placemark>"), name, shape, F.lit("</Placemark>")).alias("mark"))
    body = F.concat(F.lit('<kml xmlns="http://www.opengis.net/kml/2.2"><Document>\n'), F.array_join(F.collect_list("mark"), "\n"), F.lit("\n</Document></kml>"))
    path = shared_dir(spark, "pins")
    marks.groupBy("file").agg(body.alias("doc")).write.partitionBy("file").text(path)
    return files.read_placemarks(spark, path).select("name", "lon", "lat")


@query("SELECT date '2019-01-01' + (n_nationkey * 12)::INT AS date, i AS look, n_nationkey * 10 + 0.5::DOUBLE AS base, n_nationkey + i / 4 AS gain FROM nation, (SELECT unnest(range(8))::INT AS i)")
def calibration_lut(spark, d):
    """Calibration tables through XML files, dated by their product's folder."""
    key = F.col("n_nationkey")
    gains = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (key + i / 4).cast("string")), " ")
    doc = F.concat(F.lit("<lut><offset>"), (key * 10 + F.lit(0.5)).cast("string"), F.lit("</offset>\n<gains> "), gains, F.lit("\n</gains></lut>"))
    day = F.date_format(F.date_add(F.lit("2019-01-01").cast("date"), (key * 12).cast("int")), "yyyyMMdd")
    path = shared_dir(spark, "products")
    spark.read.parquet(f"{d}/nation.parquet").select(F.format_string("S_%s_101500_%d", day, key).alias("product"), doc.alias("doc")).write.partitionBy("product").text(path)
    return files.read_calibration(spark, path).select("date", "look", F.col("offset").alias("base"), "gain")


_X, _Y = geo.utm("lon", "lat")
_OUTLINED = "SELECT k, CAST('-70.' || lpad((k % 500)::VARCHAR, 3, '0') AS DOUBLE) AS w, CAST('-69.' || lpad((k % 500)::VARCHAR, 3, '0') AS DOUBLE) AS e, CAST('-13.' || lpad((k % 300)::VARCHAR, 3, '0') AS DOUBLE) AS s, CAST('-12.' || lpad((k % 300)::VARCHAR, 3, '0') AS DOUBLE) AS n FROM (SELECT c_custkey AS k FROM customer)"


@query(f"""WITH q AS ({_OUTLINED}), g AS (SELECT 0 AS feature, [{{'x': w, 'y': s}}, {{'x': e, 'y': s}}, {{'x': w, 'y': n}}, {{'x': w, 'y': s}}] AS pts FROM q WHERE k % 3 = 0
UNION ALL SELECT 0, [{{'x': w, 'y': s}}, {{'x': e, 'y': n}}] FROM q WHERE k % 3 = 1 UNION ALL SELECT 0, [{{'x': w, 'y': n}}] FROM q WHERE k % 3 = 2 UNION ALL SELECT 1, [{{'x': e, 'y': n}}, {{'x': w, 'y': s}}] FROM q WHERE k % 3 = 2),
v AS (SELECT feature, unnest(range(len(pts)))::INT AS i, unnest(pts) AS p FROM g), z AS (SELECT feature, i, p.x AS lon, p.y AS lat, count(*) AS n FROM v GROUP BY ALL)
SELECT feature, 0 AS part, 0 AS ring, i, lon, lat, n, round({_X}, 2) AS x, round({_Y}, 2) AS y FROM z""")
def geojson_outlines(spark, d):
    """Vertices of GeoJSON polygons, lines and points, from features, collections and bare geometries, on the metric grid."""
    k = F.col("c_custkey")
    w, e = (F.format_string(f"-{deg}.%03d", k % 500) for deg in (70, 69))
    s, n = (F.format_string(f"-{deg}.%03d", k % 300) for deg in (13, 12))

    def shape(kind: str, *places, nested: str = "%s"):
        form = nested % ", ".join(["[%s, %s]"] * len(places))
        return F.format_string(f'{{"type": "{kind}", "coordinates": {form}}}', *[x for place in places for x in place])

    def feature(geometry):
        return F.concat(F.lit('{"type": "Feature", "properties": {}, "geometry": '), geometry, F.lit("}"))

    polygon = feature(shape("Polygon", (w, s), (e, s), (w, n), (w, s), nested="[[%s]]"))
    line = shape("LineString", (w, s), (e, n), nested="[%s]")
    both = F.concat(F.lit('{"type": "FeatureCollection", "features": ['), feature(shape("Point", (w, n))), F.lit(", "), feature(shape("LineString", (e, n), (w, s), nested="[%s]")), F.lit("]}"))
    path = shared_dir(spark, "outlines")
    spark.read.parquet(f"{d}/customer.parquet").select(F.when(k % 3 == 0, polygon).when(k % 3 == 1, line).otherwise(both)).write.text(path)
    found = files.read_outlines(spark, path, lines=True).groupBy("feature", "part", "ring", "i", "lon", "lat").agg(F.count("*").alias("n"))
    return found.select("*", F.round(F.expr(_X), 2).alias("x"), F.round(F.expr(_Y), 2).alias("y"))


#: Fixed values of the published overlay: share of a 9 x 9 window, smallest patch.
DENSE_SHARE, PROMINENT_PX = 0.55, 400


@query(
    PIXELS
    + f""", o9 AS (SELECT unnest(range(-4, 5)) AS d), o5 AS (SELECT unnest(range(-2, 3)) AS d), hi AS (SELECT r, c FROM cf WHERE conf = 2),
z AS (SELECT px.r, px.c, {MIRROR.format(x="px.r + a.d", size="px.height")} AS r2, {MIRROR.format(x="px.c + b.d", size=256)} AS c2 FROM (SELECT r, c, height FROM px, ht) px, o9 a, o9 b),
core AS (SELECT z.r, z.c FROM z JOIN hi ON hi.r = z.r2 AND hi.c = z.c2 GROUP BY 1, 2 HAVING count(*) > {DENSE_SHARE} * 81),
wide AS (SELECT DISTINCT r + a.d AS r, c + b.d AS c FROM core, o5 a, o5 b WHERE r + a.d BETWEEN 0 AND (SELECT height - 1 FROM ht) AND c + b.d BETWEEN 0 AND 255),
cl AS (SELECT r + a.d AS r, c + b.d AS c FROM wide, o5 a, o5 b WHERE r + a.d BETWEEN 0 AND (SELECT height - 1 FROM ht) AND c + b.d BETWEEN 0 AND 255 GROUP BY 1, 2 HAVING count(*) = 25),
nb AS (SELECT a.r * 256 + a.c AS u, b.r * 256 + b.c AS v FROM cl a JOIN cl b ON abs(a.r - b.r) + abs(a.c - b.c) <= 1),
seed AS (SELECT u FROM nb GROUP BY u HAVING min(v) = u), cc AS (SELECT u AS s, u AS t FROM seed UNION SELECT cc.s, nb.v FROM cc JOIN nb ON nb.u = cc.t),
lab AS (SELECT t, min(s) AS label FROM cc GROUP BY t)
SELECT t // 256 AS r, t % 256 AS c, label FROM lab QUALIFY count(*) OVER (PARTITION BY label) >= {PROMINENT_PX}"""
)
def prominent_overlay(spark, d):
    """Changes that stand out: high confidence, dense in 9 x 9 windows, closed, in patches of PROMINENT_PX pixels and more."""
    high = _px(spark, d).select("r", "c", (F.col("conf") == 2).cast("long").alias("high"))
    core_cells = kernels.box_sums(high, 4, height(spark, d), "high").where(F.col("high") > DENSE_SHARE * 81)
    found = written(rules.patches(kernels.closing(core_cells, 2, height(spark, d)), diagonal=False), "prominent")
    large = found.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= PROMINENT_PX)
    return found.join(large, "label", "left_semi").select("r", "c", "label")
