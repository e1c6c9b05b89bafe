"""Queries on layers, points, tiles and alerts beyond the core set, each with its DuckDB counterpart.

Scalar arithmetic that both engines spell alike is given once, as an SQL expression; joins, windows,
grouping and kernels are DataFrame code on one side and plain SQL on the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopyspark.config import CONFIG
from canopyspark.functions import geo
from canopyspark.functions.numbers import half_even
from canopyspark.operators import kernels, rules
from canopyspark.operators.scratch import written
from canopyspark.plans.queries import ALERTS, DATES, LABELS, OPENED, PIXELS, PLANTS, _px, alerts_ranked
from canopyspark.sources.synthetic import banded_scene, height, labels, scenes, stack

SIDE = CONFIG.side
QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    """Registers a query under its function's name, with its oracle where SQL can express it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def scene(spark, d, k: int = 5) -> DataFrame:
    return scenes(spark, d).where(F.col("k") == k).select("r", "c", "mdb")


#: A scene with holes in it, as a relation v (r, c, v).
HOLES = "(r * 31 + c * 17) % 97 = 0"
HOLED = f"WITH {PLANTS}, v AS (SELECT r, c, CASE WHEN NOT ({HOLES}) THEN mdb END AS v FROM sc WHERE k = 5)"


def holed(spark, d) -> DataFrame:
    return scene(spark, d).select("r", "c", F.expr(f"CASE WHEN NOT ({HOLES}) THEN mdb END AS v"))


#: Points in and around the whole grid, from the customer table: pid, x, y, mining; {rows}: the grid's height.
POINT = "c_custkey AS pid, CAST(391530 + (c_custkey * 7919 % 300 - 20) * 10 AS DOUBLE) + 3.5 AS x, CAST(8568230 - (c_custkey * 104729 % ({rows} + 44) - 20) * 10 AS DOUBLE) - 6.5 AS y, c_custkey % 3 = 0 AS mining"
_ROW, _COL = geo.pixel("x", "y")
_ROWS_SQL = "(SELECT (coalesce(max(s_suppkey), 0) // 28 + 1) * 256 FROM supplier)"
INSIDE = f"r BETWEEN 0 AND {_ROWS_SQL} - 1 AND c BETWEEN 0 AND {SIDE - 1}"
POINTS = f"pt AS (SELECT *, {_ROW} AS r, {_COL} AS c FROM (SELECT {POINT.format(rows=_ROWS_SQL)} FROM customer))"


def points(spark, d) -> DataFrame:
    """The points that lie in the grid."""
    rows = height(spark, d)
    found = spark.read.parquet(f"{d}/customer.parquet").selectExpr(*POINT.format(rows=rows).split(", "))
    return found.selectExpr("*", f"{_ROW} AS r", f"{_COL} AS c").where(F.col("r").between(0, rows - 1) & F.col("c").between(0, SIDE - 1))


@query(f"WITH {PLANTS}, b AS (SELECT CASE WHEN r < 4 THEN 0 ELSE 255 END AS alpha, CASE WHEN r < 4 THEN 0 ELSE trunc(least(greatest((mdb + 25000) * 255 / 25000, 0), 255))::INT END AS byte FROM sc WHERE k = 0) SELECT alpha, byte, count(*) AS n, CASE WHEN alpha > 0 THEN round(-25 + byte * 25 / 255.0::DOUBLE, 6) END AS db FROM b GROUP BY 1, 2")
def db_bytes(spark, d):
    """Decibels to bytes with a clear nodata pixel, and the decibels read back from each byte."""
    v = F.when(F.col("r") >= 4, F.col("mdb"))
    byte = F.coalesce(F.least(F.greatest((v + 25000) * 255 / 25000, F.lit(0)), F.lit(255)).cast("int"), F.lit(0))
    found = scene(spark, d, 0).groupBy(F.when(v.isNull(), 0).otherwise(255).alias("alpha"), byte.alias("byte")).agg(F.count("*").alias("n"))
    return found.withColumn("db", F.when(F.col("alpha") > 0, F.round(-25 + F.col("byte") * 25 / F.lit(255.0), 6)))


@query(f"WITH {PLANTS}, s AS (SELECT r // 4 AS row, c // 3 AS col, (mdb % 97) * (mdb % 97) + (mdb % 53) * (mdb % 53) AS power, 2 + c % 7 AS a FROM sc WHERE k = 5), b AS (SELECT row, col, sum(power + 40)::BIGINT AS total, count_if(power > 0)::BIGINT AS n_valid, avg(a) AS gain FROM s GROUP BY 1, 2) SELECT row, col, n_valid, CASE WHEN n_valid > 0 THEN round(total / greatest(n_valid, 1) / (gain * gain), 6) END AS power, CASE WHEN n_valid > 0 THEN round(10 * log10(total / greatest(n_valid, 1) / (gain * gain)), 6) END AS db FROM b")
def calibrate_intensity(spark, d):
    """Complex samples to calibrated multilooked power: (I^2 + Q^2 + offset) / A^2 over 4 x 3 looks, then decibels."""
    i, q = F.col("mdb") % 97, F.col("mdb") % 53
    samples = scene(spark, d).select("r", "c", (i * i + q * q).alias("power"))
    lut = spark.range(SIDE).select(F.col("id").alias("c"), (2 + F.col("id") % 7).alias("a"))
    blocks = samples.join(lut, "c").groupBy(F.floor(F.col("r") / 4).alias("row"), F.floor(F.col("c") / 3).alias("col"))
    found = blocks.agg(F.sum(F.col("power") + 40).alias("total"), F.count_if(F.col("power") > 0).alias("n_valid"), F.avg("a").alias("gain"))
    power = F.when(F.col("n_valid") > 0, F.col("total") / F.greatest("n_valid", F.lit(1)) / (F.col("gain") * F.col("gain")))
    return found.select("row", "col", "n_valid", F.round(power, 6).alias("power"), F.round(10 * F.log10(power), 6).alias("db"))


def _box_sql(columns: str) -> str:
    """CTE s (r, c, columns): sums of w over 5 x 5 windows with mirrored edges, in two one-dimensional passes."""
    names, sums = columns, ", ".join(f"sum({n}) OVER q AS {n}" for n in columns.split(", "))
    return f"""hx AS (SELECT r, c, {names} FROM w UNION ALL SELECT r, -1 - c, {names} FROM w WHERE c < 2 UNION ALL SELECT r, {2 * SIDE - 1} - c, {names} FROM w WHERE c >= {SIDE - 2}),
hs AS (SELECT r, c, {sums} FROM hx WINDOW q AS (PARTITION BY r ORDER BY c ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) QUALIFY c BETWEEN 0 AND {SIDE - 1}),
vx AS (SELECT r, c, {names} FROM hs UNION ALL SELECT -1 - r, c, {names} FROM hs WHERE r < 2 UNION ALL SELECT 2 * height - 1 - r, c, {names} FROM hs, ht WHERE r >= height - 2),
s AS (SELECT r, c, {sums} FROM vx WINDOW q AS (PARTITION BY c ORDER BY r ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) QUALIFY r BETWEEN 0 AND (SELECT height - 1 FROM ht))"""


@query(HOLED + f""", w AS (SELECT r, c, (v IS NOT NULL)::BIGINT AS n, coalesce(v + 30000, 0)::BIGINT AS s1, (coalesce(v + 30000, 0) * coalesce(v + 30000, 0))::BIGINT AS s2 FROM v), {_box_sql("n, s1, s2")},
m AS (SELECT r, c, s1 / n AS mean, greatest(s2 / n - (s1 / n) * (s1 / n), 0) / ((s1 / n) * (s1 / n)) AS ci2 FROM s)
SELECT r, c, round(mean + CASE WHEN ci2 > 0 THEN least(greatest((ci2 - 0.25::DOUBLE) / (ci2 * 1.25::DOUBLE), 0), 1) ELSE 0 END * (v + 30000 - mean), 4) AS value FROM m JOIN v USING (r, c)""")
def lee_filter(spark, d):
    """Lee speckle filter, 5 x 5 and 4 looks, on positive power with holes; holes stay."""
    v = holed(spark, d)
    x = F.coalesce(F.col("v") + 30000, F.lit(0))
    sums = kernels.box_sums(v.select("r", "c", F.col("v").isNotNull().cast("long").alias("n"), x.alias("s1"), (x * x).alias("s2")), 2, height(spark, d), "n", "s1", "s2")
    mean = F.col("s1") / F.col("n")
    ci2 = F.greatest(F.col("s2") / F.col("n") - mean * mean, F.lit(0.0)) / (mean * mean)
    looks = 4
    weight = F.when(ci2 > 0, F.least(F.greatest((ci2 - 1 / looks) / (ci2 * (1 + 1 / looks)), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return sums.join(v.hint("merge"), ["r", "c"]).select("r", "c", F.round(mean + weight * (F.col("v") + 30000 - mean), 4).alias("value"))


@query(HOLED + f", w AS (SELECT r, c, x AS s1, x * x AS s2 FROM (SELECT r, c, coalesce(v::DOUBLE, (SELECT avg(v) FROM v)) AS x FROM v) t), {_box_sql('s1, s2')} SELECT r, c, round(sqrt(greatest(s2 / 25 - (s1 / 25) * (s1 / 25), 0)), 2) AS texture FROM s")
def texture_std(spark, d):
    """Standard deviation in 5 x 5 windows; holes count as the scene's mean."""
    return texture_by_row(spark, d).select("r", F.posexplode("texture").alias("c", "texture")).select("r", F.col("c").cast("long").alias("c"), (F.col("texture") / 100).alias("texture"))


def texture_by_row(spark, d) -> DataFrame:
    """(r, texture): the same in hundredths, an array for every row."""
    mean = holed(spark, d).agg(F.avg("v").alias("m")).first()["m"]
    banded = banded_scene(spark, d, 5, kernels.BAND, 2).select("band", "r", "c", F.expr(f"CASE WHEN NOT ({HOLES}) THEN mdb END AS v"))
    return kernels.texture_rows(banded, 2, height(spark, d), SIDE, mean)


@query(PIXELS + f", o AS (SELECT unnest([-2, -1, 0, 1, 2]) AS d), wide AS (SELECT DISTINCT r + a.d AS r, c + b.d AS c FROM cf, o a, o b WHERE conf > 0 AND r + a.d BETWEEN 0 AND (SELECT height - 1 FROM ht) AND c + b.d BETWEEN 0 AND {SIDE - 1}) SELECT r + a.d AS r, c + b.d AS c FROM wide, o a, o b WHERE r + a.d BETWEEN 0 AND (SELECT height - 1 FROM ht) AND c + b.d BETWEEN 0 AND {SIDE - 1} GROUP BY 1, 2 HAVING count(*) = 25")
def closing5(spark, d):
    return kernels.closing(_px(spark, d).where("conf > 0"), 2, height(spark, d))


@query(OPENED + """, nb AS (SELECT a.r * 256 + a.c AS u, b.r * 256 + b.c AS v FROM op a JOIN op b ON abs(a.r - b.r) + abs(a.c - b.c) <= 1),
seed AS (SELECT u FROM nb GROUP BY u HAVING min(v) = u), cc AS (SELECT u AS s, u AS t FROM seed UNION SELECT cc.s, nb.v FROM cc JOIN nb ON nb.u = cc.t)
SELECT t // 256 AS r, t % 256 AS c, min(s) AS label FROM cc GROUP BY t""")
def patch_components4(spark, d):
    """Patches of pixels that touch at their sides."""
    return rules.patches(rules.opening3(_px(spark, d).where("conf > 0")), diagonal=False)


@query(HOLED + " SELECT r // 8 AS row, c // 8 AS col, round(avg(v), 4) AS mean, max(v) AS high, count(v) AS n FROM v GROUP BY 1, 2")
def downsample(spark, d):
    """Average and maximum of 8 x 8 cells, holes left out."""
    return holed(spark, d).groupBy(F.floor(F.col("r") / 8).alias("row"), F.floor(F.col("c") / 8).alias("col")).agg(F.round(F.avg("v"), 4).alias("mean"), F.max("v").alias("high"), F.count("v").alias("n"))


SQUARED = LABELS + f", grid AS (SELECT i // {SIDE} AS r, i % {SIDE} AS c FROM (SELECT unnest(range(height * {SIDE})) AS i FROM ht) t), col AS (SELECT g.r, g.c, min(abs(g.r - lb.r)) AS g FROM grid g JOIN lb ON lb.c = g.c GROUP BY 1, 2), edt AS (SELECT a.r, a.c, min((a.c - b.c) * (a.c - b.c) + b.g * b.g)::BIGINT AS d2 FROM grid a JOIN col b ON a.r = b.r GROUP BY 1, 2)"


def label_rows(spark, d) -> DataFrame:
    """(r, d2, year): squared distance to the nearest labelled pixel, and the label, an array by column for every row."""
    return kernels.distance_rows(labels(spark, d), height(spark, d), SIDE, "year")


@query(SQUARED + " SELECT r, c, d2 FROM edt")
def edt_distance(spark, d):
    """Exact squared distance, in pixels, to the nearest labelled pixel."""
    return label_rows(spark, d).select("r", F.posexplode("d2").alias("c", "d2")).select("r", F.col("c").cast("long").alias("c"), "d2")


_CLASSES = "CASE WHEN year IS NOT NULL THEN 1 WHEN (first > -11000 AND first - min_later < 3000) AND d2 > 25 OR change_idx IS NOT NULL AND d2 > 10000 THEN 0 END"
CLASSED = PIXELS + ", " + SQUARED.partition("), lb AS")[2].join(["lb AS", ""]) + f", kl AS (SELECT px.*, year, d2, {_CLASSES} AS mining FROM px JOIN edt USING (r, c) LEFT JOIN lb USING (r, c))"


def classes(spark, d, *beside: DataFrame) -> DataFrame:
    """The pixel table with year, d2 and mining: 1 labelled, 0 far enough from labels to be a negative, else NULL; and the columns of tables beside it. Made from rows: no pixel is shuffled."""
    px = rules.confidence(rules.of_stack(stack(spark, d, label_rows(spark, d), *beside)))
    return px.withColumn("year", F.col("year").cast("int")).withColumn("mining", F.expr(_CLASSES))


def classed(spark, d) -> DataFrame:
    return written(classes(spark, d), "classed")


@query(CLASSED + " SELECT r // 32 * 8 + c // 32 AS block, count_if(mining = 1)::BIGINT AS positives, count_if(mining = 0)::BIGINT AS negatives, count_if(mining IS NULL)::BIGINT AS neither FROM kl GROUP BY 1")
def negatives(spark, d):
    """Training classes by distance rule, counted per block."""
    block = (F.floor(F.col("r") / 32) * 8 + F.floor(F.col("c") / 32)).alias("block")
    return classed(spark, d).groupBy(block).agg(F.count_if(F.col("mining") == 1).alias("positives"), F.count_if(F.col("mining") == 0).alias("negatives"), F.count_if(F.col("mining").isNull()).alias("neither"))


SAMPLE_CAP = 2000


def sampled(px: DataFrame, cap: int = SAMPLE_CAP) -> DataFrame:
    """As many pixels of either class, cap at most, in an order by a fixed hash; none if a class is empty."""
    n = px.agg(F.count_if(F.col("mining") == 1).alias("p"), F.count_if(F.col("mining") == 0).alias("n")).first()
    size = min(n["p"], n["n"], cap)
    place = F.col("r") * SIDE + F.col("c")
    top = [px.where(F.col("mining") == m).orderBy(place * 7919 % 104729, place).limit(size) for m in (1, 0)]
    return top[0].unionByName(top[1])


@query(CLASSED + f" SELECT r, c, mining FROM kl WHERE mining IS NOT NULL QUALIFY row_number() OVER (PARTITION BY mining ORDER BY (r * {SIDE} + c) * 7919 % 104729, r * {SIDE} + c) <= least((SELECT count(*) FROM kl WHERE mining = 1), (SELECT count(*) FROM kl WHERE mining = 0), {SAMPLE_CAP})")
def balanced_sample(spark, d):
    return sampled(classed(spark, d)).select("r", "c", "mining")


@query(f"WITH {PLANTS}, {POINTS} SELECT pid, pt.r, pt.c, mining, mdb FROM pt JOIN sc ON sc.r = pt.r AND sc.c = pt.c AND k = 5")
def points_sample(spark, d):
    """The scene's value at every point; points outside the grid are dropped."""
    return points(spark, d).hint("merge").join(scene(spark, d), ["r", "c"]).select("pid", "r", "c", "mining", "mdb")


def near_points(spark, d) -> DataFrame:
    """The points inside the grid, with near: whether anything was detected within 5 pixels."""
    pt = points(spark, d)
    hit = kernels.spread(pt, 5, "pid").hint("merge").join(_px(spark, d).where("conf > 0").select("r", "c"), ["r", "c"], "left_semi").select("pid").distinct()
    return pt.join(hit.withColumn("near", F.lit(True)).hint("merge"), "pid", "left").withColumn("near", F.coalesce("near", F.lit(False)))


NEAR = PIXELS + f", {POINTS}, np AS (SELECT *, EXISTS (SELECT 1 FROM cf WHERE conf > 0 AND cf.r BETWEEN pt.r - 5 AND pt.r + 5 AND cf.c BETWEEN pt.c - 5 AND pt.c + 5) AS near FROM pt WHERE {INSIDE})"


@query(NEAR + " SELECT pid, mining, near FROM np")
def points_near11(spark, d):
    return near_points(spark, d).select("pid", "mining", "near")


@query(NEAR + " SELECT count_if(mining AND near)::BIGINT AS hits, count_if(mining AND NOT near)::BIGINT AS misses, count_if(NOT mining AND near)::BIGINT AS false_alarms, count_if(mining AND near) / nullif(count_if(near), 0) AS precision, count_if(mining AND near) / nullif(count_if(mining), 0) AS recall FROM np")
def points_evaluate(spark, d):
    """Detections scored on points, with a tolerance of 5 pixels."""
    n = near_points(spark, d).agg(F.count_if(F.col("mining") & F.col("near")).alias("hits"), F.count_if(F.col("mining") & ~F.col("near")).alias("misses"), F.count_if(~F.col("mining") & F.col("near")).alias("false_alarms"))
    return n.select("*", F.try_divide("hits", F.col("hits") + F.col("false_alarms")).alias("precision"), F.try_divide("hits", F.col("hits") + F.col("misses")).alias("recall"))


@query(HOLED + f", {POINTS} SELECT pid, round_even(avg(v) / 1000, 1) AS mean_db, count(v) AS n FROM pt LEFT JOIN v ON v.r BETWEEN pt.r - 1 AND pt.r + 1 AND v.c BETWEEN pt.c - 1 AND pt.c + 1 WHERE pt.{INSIDE.replace('AND c', 'AND pt.c')} GROUP BY pid")
def points_mean3(spark, d):
    """Mean of the 3 x 3 pixels around every point, without holes and what lies outside; NULL if nothing is left."""
    around = kernels.spread(points(spark, d), 1, "pid").hint("merge").join(holed(spark, d), ["r", "c"], "left")
    return around.groupBy("pid").agg(half_even(F.avg("v") / 1000, 1).alias("mean_db"), F.count("v").alias("n"))


@query(f"WITH {PLANTS}, t AS (SELECT k, r, c, mdb FROM sc WHERE k < 3 AND c BETWEEN k * 80 AND k * 80 + 119 AND (r + c) % 5 <> k) SELECT r, c, arg_min(mdb, k) AS mdb, min(k) AS tile FROM t GROUP BY r, c")
def mosaic_first(spark, d):
    """Overlapping tiles with holes to one layer: the first tile, by number, that has a value."""
    tiles = scenes(spark, d).where("k < 3 AND c BETWEEN k * 80 AND k * 80 + 119 AND (r + c) % 5 <> k")
    return tiles.groupBy("r", "c").agg(F.min_by("mdb", "k").alias("mdb"), F.min("k").alias("tile"))


_WANTED = f"SELECT i, j, i * 2.5::DOUBLE + 0.3::DOUBLE AS sr, j * 2.5::DOUBLE + 0.7::DOUBLE AS sc FROM range(104) a(i), range(104) b(j)"


def wanted(spark) -> DataFrame:
    """Places of an output grid in pixels of the source, some beyond its edge."""
    ij = spark.range(104 * 104).select(F.floor(F.col("id") / 104).alias("i"), (F.col("id") % 104).alias("j"))
    return ij.select("i", "j", (F.col("i") * 2.5 + 0.3).alias("sr"), (F.col("j") * 2.5 + 0.7).alias("sc"))


@query(HOLED + f" SELECT i, j, v.v AS v FROM ({_WANTED}) w LEFT JOIN v ON v.r = floor(w.sr + 0.5)::BIGINT AND v.c = floor(w.sc + 0.5)::BIGINT")
def warp_nearest(spark, d):
    at = wanted(spark).select("i", "j", F.floor(F.col("sr") + 0.5).alias("r"), F.floor(F.col("sc") + 0.5).alias("c"))
    return at.join(holed(spark, d), ["r", "c"], "left").select("i", "j", "v")


def _bilinear_sql(places: str) -> str:
    return HOLED + f""", n AS (SELECT i, j, CASE a WHEN 1 THEN sr - floor(sr) ELSE 1 - (sr - floor(sr)) END * CASE b WHEN 1 THEN sc - floor(sc) ELSE 1 - (sc - floor(sc)) END AS w, v.v
FROM ({places}) q CROSS JOIN (SELECT unnest([0, 1]) AS a) CROSS JOIN (SELECT unnest([0, 1]) AS b) LEFT JOIN v ON v.r = floor(sr)::BIGINT + a AND v.c = floor(sc)::BIGINT + b)
SELECT i, j, CASE WHEN count_if(w > 0 AND v IS NULL) = 0 THEN round(sum(CASE WHEN w > 0 THEN w * v END), 4) END AS v FROM n GROUP BY i, j"""


@query(_bilinear_sql(_WANTED))
def warp_bilinear(spark, d):
    return kernels.bilinear(holed(spark, d), wanted(spark), "v").select("i", "j", F.round("v", 4).alias("v"))


@query(_bilinear_sql(f"SELECT p // {SIDE} AS i, p % {SIDE} AS j, p // {SIDE} + 0.75::DOUBLE AS sr, p % {SIDE} - 0.5::DOUBLE AS sc FROM (SELECT unnest(range(height * {SIDE})) AS p FROM ht) t"))
def shift_apply(spark, d):
    """A scene moved by a fraction of a pixel, as after an estimated shift; nothing is made up beyond the edge."""
    at = scene(spark, d).select(F.col("r").alias("i"), F.col("c").alias("j"), (F.col("r") + 0.75).alias("sr"), (F.col("c") - 0.5).alias("sc"))
    return kernels.bilinear(holed(spark, d), at, "v").select("i", "j", F.round("v", 4).alias("v"))


TILED = HOLED + ", x AS (SELECT r, c, r // 60 AS tr, c // 60 AS tc, v FROM v), t AS (SELECT tr, tc, count(v) AS n, count(v) / 3600 >= 0.5::DOUBLE AS valid, avg(v) AS mean, stddev_pop(v) AS std FROM x GROUP BY 1, 2)"


def tiles(v: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pixels with their tile (60 x 60, padded with nodata), and each tile's statistics."""
    x = v.select("r", "c", F.floor(F.col("r") / 60).alias("tr"), F.floor(F.col("c") / 60).alias("tc"), "v")
    return x, x.groupBy("tr", "tc").agg(F.count("v").alias("n"), (F.count("v") / 3600 >= 0.5).alias("valid"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


@query(TILED + " SELECT tr, tc, n, valid, round(mean, 4) AS mean, round(std, 4) AS std FROM t")
def tile_valid(spark, d):
    return tiles(holed(spark, d))[1].select("tr", "tc", "n", "valid", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


@query(TILED + " SELECT r, count(*) AS n, round(sum(CASE WHEN valid THEN mean END), 2) AS spread_mean, round(sum(CASE WHEN valid THEN coalesce((v - mean) / std, 0) END), 2) AS z FROM x JOIN t USING (tr, tc) GROUP BY r")
def tile_to_pixel(spark, d):
    """Tile values back at their pixels, and pixels standardised by their tile (holes 0), summed by row."""
    x, t = tiles(holed(spark, d))
    px = x.join(t, ["tr", "tc"])
    z = F.when(F.col("valid"), F.coalesce((F.col("v") - F.col("mean")) / F.col("std"), F.lit(0.0)))
    return px.groupBy("r").agg(F.count("*").alias("n"), F.round(F.sum(F.when(F.col("valid"), F.col("mean"))), 2).alias("spread_mean"), F.round(F.sum(z), 2).alias("z"))
