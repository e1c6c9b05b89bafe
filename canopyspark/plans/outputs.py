"""Result files and tables of a run: comparison, points and timeline files, the aligned stack, the embedding cache, the page's payload."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyspark.config import CONFIG
from canopyspark.functions import geo
from canopyspark.functions.numbers import half_even
from canopyspark.operators import kernels
from canopyspark.operators.scratch import shared_dir, written
from canopyspark.plans import queries as core
from canopyspark.plans import reports
from canopyspark.plans.files import through
from canopyspark.plans.layers import POINTS, points, scene
from canopyspark.plans.queries import ALERTS, DATES, PIXELS, PLANTS, STATS, _px
from canopyspark.sources import cache, geotiff
from canopyspark.sources.synthetic import height, scenes

SIDE = CONFIG.side
QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(reports.ORACLES["model_compare"])
def comparison_csv(spark, d):
    """The comparison of all detectors through its CSV file."""
    return through(reports.model_compare(spark, d), "csv", header=True)


@query(reports.ORACLES["loss_timeline"])
def timeline_csv(spark, d):
    """The loss timeline through its CSV file."""
    return through(reports.loss_timeline(spark, d), "csv", header=True)


@query(reports.ORACLES["pin_classify_dedupe"].replace("SELECT place, name, lon", "SELECT place, nullif(name, '') AS name, lon"))
def check_points_csv(spark, d):
    """The points to check through their CSV file; a pin without a name comes back as NULL."""
    return through(reports.pin_classify_dedupe(spark, d), "csv", header=True, emptyValue="", nullValue="")


DETECTORS = ("rule", "model", "combined", "both")
_AROUND = "range(-5, 6)"


@query(
    reports.DETECTED
    + f""", {POINTS}, pn AS (SELECT pid, mining, r, c FROM pt WHERE r BETWEEN 0 AND (SELECT height - 1 FROM ht) AND c BETWEEN 0 AND {SIDE - 1}),
nb AS (SELECT pid, r + a.d AS r, c + b.d AS c FROM pn, (SELECT unnest({_AROUND}) AS d) a, (SELECT unnest({_AROUND}) AS d) b),
hit AS (SELECT pid, {', '.join(f"bool_or(detector = '{n}') AS hit_{n}" for n in DETECTORS)} FROM nb JOIN u USING (r, c) WHERE f GROUP BY pid)
SELECT pid, mining, round_even(x.mdb / 1000, 1) AS first_db, round_even(y.mdb / 1000, 1) AS last_db, {', '.join(f"coalesce(hit_{n}, false) AS hit_{n}" for n in DETECTORS)},
  coalesce(lb.year, 0) AS label_year, CASE WHEN (pn.r * 7 + pn.c * 13) % 21 > 0 THEN (pn.r * 7 + pn.c * 13) % 21 + 2000 ELSE 0 END AS loss_year
FROM pn JOIN sc x ON x.r = pn.r AND x.c = pn.c AND x.k = 0 JOIN sc y ON y.r = pn.r AND y.c = pn.c AND y.k = 5 LEFT JOIN hit USING (pid) LEFT JOIN lb ON lb.r = pn.r AND lb.c = pn.c"""
)
def point_results_csv(spark, d):
    """Every point with its first and last value, what each detector found within 5 pixels, label and loss year, through its CSV file."""
    pt = points(spark, d)
    fired = reports.detected(spark, d).where("f").select("r", "c", "detector")
    near = kernels.spread(pt.select("pid", "r", "c"), 5, "pid").hint("merge").join(fired, ["r", "c"])
    hits = near.groupBy("pid").agg(*[F.bool_or(F.col("detector") == n).alias(f"hit_{n}") for n in DETECTORS])
    ends = [scene(spark, d, k).select("r", "c", half_even(F.col("mdb") / 1000, 1).alias(name)) for k, name in ((0, "first_db"), (5, "last_db"))]
    years = reports.labels(spark, d).withColumnRenamed("year", "label_year")
    loss = reports.loss_layer(spark, d).select("r", "c", F.when(F.col("loss") > 0, F.col("loss") + 2000).otherwise(0).alias("loss_year"))
    out = pt.hint("merge")
    for layer in (*ends, loss):
        out = out.join(layer, ["r", "c"])
    out = out.join(years.hint("merge"), ["r", "c"], "left").join(hits.hint("merge"), "pid", "left")
    found = [F.coalesce(f"hit_{n}", F.lit(False)).alias(f"hit_{n}") for n in DETECTORS]
    return through(out.select("pid", "mining", "first_db", "last_db", *found, F.coalesce("label_year", F.lit(0)).alias("label_year"), "loss_year"), "csv", header=True)


@query(PIXELS + f", gd AS (SELECT i // {SIDE} AS r, i % {SIDE} AS c FROM (SELECT unnest(range(height * {SIDE})) AS i FROM ht) t) SELECT r, c, coalesce(conf, 0)::INT AS conf FROM gd LEFT JOIN (SELECT r, c, conf FROM cf) q USING (r, c)")
def confidence_geotiff(spark, d):
    """The confidence layer through GeoTIFF files of bytes."""
    conf = _px(spark, d).select("r", "c", F.coalesce("conf", F.lit(0)).alias("v"))
    return geotiff.file_pixels(written(geotiff.layer_files(conf, "confidence", "int16"), "layer-files")).select("r", "c", F.col("v").cast("int").alias("conf"))


STACK_FORM = "dates array<string>, crs string, pixel_size_m int, width long, height long, origin_x double, origin_y double, unit string, nodata string, valid array<long>"
CRS, UNIT = "EPSG:32719", "dB (sigma0)"


def save_stack(pixels: DataFrame, folder: str) -> None:
    """An aligned stack (date, r, c, db) as one Parquet folder per date, and its manifest, one JSON document.

    The manifest's lists have an entry a date, oldest first; a stack without rows gives none.
    """
    pixels.repartition("date", F.floor(F.col("r") / SIDE)).sortWithinPartitions("r", "c").write.partitionBy("date").parquet(f"{folder}/stack")
    each = pixels.groupBy("date").agg((F.max("r") + 1).alias("rows"), (F.max("c") + 1).alias("cols"), F.count("db").alias("valid"))
    listed = F.array_sort(F.collect_list(F.struct("date", "valid")))  # one entry a date
    about = each.agg(listed.alias("d"), F.max("cols").alias("width"), F.max("rows").alias("height")).where("width IS NOT NULL")
    form = about.select(
        F.col("d.date").alias("dates"), F.lit(CRS).alias("crs"), F.lit(10).alias("pixel_size_m"), "width", "height",
        F.lit(float(geo.LEFT)).alias("origin_x"), F.lit(float(geo.TOP)).alias("origin_y"), F.lit(UNIT).alias("unit"), F.lit("NaN").alias("nodata"), F.col("d.valid").alias("valid"),
    )
    form.write.json(f"{folder}/manifest")


def read_stack(spark, folder: str) -> DataFrame:
    """date, place (0 for the oldest), width, height, valid, r, c and db of the dates that the manifest names."""
    form = spark.read.schema(STACK_FORM).json(f"{folder}/manifest")
    dates = form.select(F.posexplode("dates").alias("place", "date"), "width", "height", "valid")
    dates = dates.select("date", "place", "width", "height", F.col("valid")[F.col("place")].alias("valid"))
    pixels = spark.read.schema("r long, c long, db double, date string").parquet(f"{folder}/stack")
    return pixels.join(F.broadcast(dates), "date")  # as many rows as scenes


@query(f"WITH {PLANTS} SELECT strftime(({DATES})[k + 1], '%Y%m%d') AS date, k::INT AS place, {SIDE}::BIGINT AS width, height, count(*) AS n, count_if((r * 31 + c * 17 + k) % 97 <> 0)::BIGINT AS valid, sum(CASE WHEN (r * 31 + c * 17 + k) % 97 <> 0 THEN mdb END)::BIGINT AS total FROM sc, ht GROUP BY k, height")
def aligned_stack(spark, d):
    """The whole stack through its folders by date and its manifest."""
    days = F.array(*[F.lit(x.replace("-", "")) for x in CONFIG.dates])
    hole = (F.col("r") * 31 + F.col("c") * 17 + F.col("k")) % 97 == 0
    px = scenes(spark, d).select(F.element_at(days, (F.col("k") + 1).cast("int")).alias("date"), "r", "c", F.when(~hole, F.col("mdb") / 1000).alias("db"))
    folder = shared_dir(spark, "aligned")
    save_stack(px, folder)
    found = read_stack(spark, folder).groupBy("date", "place", "width", "height", "valid")
    return found.agg(F.count("*").alias("n"), F.sum(F.round(F.col("db") * 1000).cast("long")).alias("total"))


TILE_PX = 64
_CACHED = "vec_id % 6 AS k, vec_id // 6 AS tile, floor(1024 * embedding[1]::DOUBLE)::BIGINT AS x"


@query(f"""WITH e AS (SELECT {_CACHED} FROM embeddings), a AS (SELECT k, count(*) AS tiles, sum(x)::BIGINT AS total FROM e WHERE k < 5 GROUP BY k)
SELECT strftime(({DATES})[i + 1], '%Y%m%d') AS date, tiles, total, tiles IS NOT NULL AS available FROM range(6) t(i) LEFT JOIN a ON a.k = i""")
def embedding_cache(spark, d):
    """Embeddings by date through their cache: a second run adds the dates that lack and leaves the others; one date is never embedded."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select((F.col("vec_id") % 6).alias("k"), F.floor(F.col("vec_id") / 6).alias("tile"), "embedding")
    days = F.array(*[F.lit(x.replace("-", "")) for x in CONFIG.dates])
    e = e.withColumn("date", F.element_at(days, (F.col("k") + 1).cast("int")))
    folder = shared_dir(spark, "embeddings")
    cache.save(e.where("k < 3"), folder, TILE_PX)
    later = e.where("k < 5").withColumn("embedding", F.when(F.col("k") < 3, F.transform("embedding", lambda x: x + 9)).otherwise(F.col("embedding")))
    cache.save(later, folder, TILE_PX)
    asked = spark.range(6).select(F.element_at(days, (F.col("id") + 1).cast("int")).alias("date"))
    lacking = cache.missing(asked, folder).withColumn("lacks", F.lit(True))
    first = F.floor(F.lit(1024.0) * F.get("embedding", F.lit(0))).cast("long")
    found = cache.load(spark, folder, TILE_PX).groupBy("date").agg(F.count("*").alias("tiles"), F.sum(first).alias("total"))
    return asked.join(lacking, "date", "left").join(found, "date", "left").select("date", "tiles", "total", F.col("lacks").isNull().alias("available"))


@query(STATS + " SELECT label, round(\"drop\" / nullif(valid, 0) / 1000, 6) AS mean_drop_db, round(wet / nullif(valid, 0), 6) AS wet_share FROM st")
def patch_shares(spark, d):
    """Mean fall in dB and share of water of every patch, over the pixels with both values; NULL without any."""
    share = lambda x: F.try_divide(F.col(x), F.col("valid"))
    return core.patch_stats(spark, d).select("label", F.round(share("drop") / 1000, 6).alias("mean_drop_db"), F.round(share("wet"), 6).alias("wet_share"))


#: The page's picture is so many units wide, and as high as its bounds ask.
WORLD_WIDTH = 1600
_LON = "-(70000000 + c_custkey * 7919 % 900000) / 1000000{f}"
_LAT = "-(12000000 + c_custkey * 104729 % 900000) / 1000000{f}"
_HIGH = f"round({WORLD_WIDTH} * (north - south) / ((east - west) * cos(radians((north + south) / 2))), 0)"
_WORLD = f"(lon - west) / (east - west) * {WORLD_WIDTH} AS x, (north - lat) / (north - south) * high AS y"
_BACK = f"round(west + x / {WORLD_WIDTH} * (east - west), 6) AS lon_back, round(north - y / high * (north - south), 6) AS lat_back"


@query(f"""WITH p AS (SELECT c_custkey AS pid, {_LON.format(f='::DOUBLE')} AS lon, {_LAT.format(f='::DOUBLE')} AS lat FROM customer),
b AS (SELECT min(lon) - 0.01::DOUBLE AS west, max(lon) + 0.01::DOUBLE AS east, min(lat) - 0.01::DOUBLE AS south, max(lat) + 0.01::DOUBLE AS north FROM p), h AS (SELECT *, {_HIGH} AS high FROM b), w AS (SELECT *, {_WORLD} FROM p, h)
SELECT pid, round(x, 4) AS x, round(y, 4) AS y, {_BACK} FROM w""")
def world_places(spark, d):
    """Places in degrees to units of the page's picture and back."""
    p = spark.read.parquet(f"{d}/customer.parquet").selectExpr("c_custkey AS pid", _LON.format(f="D") + " AS lon", _LAT.format(f="D") + " AS lat")
    b = p.selectExpr("min(lon) - 0.01D AS west", "max(lon) + 0.01D AS east", "min(lat) - 0.01D AS south", "max(lat) + 0.01D AS north").selectExpr("*", f"{_HIGH} AS high")
    return p.crossJoin(F.broadcast(b)).selectExpr("*", *_WORLD.split(", ")).selectExpr("pid", "round(x, 4) AS x", "round(y, 4) AS y", *_BACK.replace(" AS lon_back, ", " AS lon_back;").split(";"))  # b has one row


#: Alerts of a page of the list.
PAGE = 40
_ENTRY = """concat('{"id":', id, ',"type":"', type, '","confidence":"', confidence, '","first_seen":"', first_seen, '","area_px":', px, '}')"""


@query(ALERTS + f""", pg AS (SELECT (id - 1) // {PAGE} + 1 AS page, id, {_ENTRY} AS entry, px FROM al)
SELECT page::BIGINT AS page, count(*) AS n, sum(px)::BIGINT AS px, concat('{{"page":', page, ',"alerts":[', string_agg(entry, ',' ORDER BY id), ']}}') AS payload FROM pg GROUP BY page""")
def alert_pages(spark, d):
    """What the page is fed with: a JSON document for every page of the list, in the order of the ranks."""
    page = (F.floor((F.col("id") - 1) / PAGE) + 1).alias("page")
    entries = core.alerts_ranked(spark, d).select(page, F.struct("id", F.expr(_ENTRY).alias("entry")).alias("e"), "px")
    body = F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["entry"]), ",")  # PAGE entries at most
    pages = entries.groupBy("page").agg(F.count("*").alias("n"), F.sum("px").alias("px"), body.alias("body"))
    return pages.select("page", "n", "px", F.concat(F.lit('{"page":'), "page", F.lit(',"alerts":['), "body", F.lit("]}")).alias("payload"))


def earlier_first(before, after, changed):
    """The pair (before, after) with before the earlier: the one that was not changed moves next to the other."""
    wrong = before >= after
    return F.when(wrong & (changed != "before"), after - 1).otherwise(before), F.when(wrong & (changed == "before"), before + 1).otherwise(after)


_ASKED = "o_custkey % 6 AS b, o_orderkey % 6 AS a, CASE WHEN o_orderkey % 2 = 0 THEN 'before' ELSE 'after' END AS changed"


@query(f"""WITH q AS (SELECT {_ASKED} FROM orders), f AS (SELECT CASE WHEN b >= a AND changed = 'after' THEN a - 1 ELSE b END AS before, CASE WHEN b >= a AND changed = 'before' THEN b + 1 ELSE a END AS after FROM q)
SELECT before, after, count(*) AS n FROM f GROUP BY 1, 2""")
def compared_dates(spark, d):
    """Pairs of scenes that were asked for, with the earlier first, and how often."""
    q = spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_custkey % 6 AS b", "o_orderkey % 6 AS a", "CASE WHEN o_orderkey % 2 = 0 THEN 'before' ELSE 'after' END AS changed")
    before, after = earlier_first(F.col("b"), F.col("a"), F.col("changed"))
    return q.groupBy(before.alias("before"), after.alias("after")).agg(F.count("*").alias("n"))
