"""Queries on the raster's geometry: registration, control points, map projection, overviews, outlines to pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyspark.config import CONFIG
from canopyspark.functions import geo
from canopyspark.operators import burn, spectral, spline, tiles
from canopyspark.operators.scratch import shared_dir, written
from canopyspark.plans.layers import HOLED, holed, scene
from canopyspark.plans.queries import PLANTS
from canopyspark.sources import files
from canopyspark.sources.synthetic import height

SIDE = CONFIG.side
QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Two acquisitions of the same ground in cells of LOOKS x LOOKS pixels, the second's cells begun so many pixels earlier.
LOOKS, AHEAD = 4, (3, 2)
#: Registered further apart than this, a scene is moved.
SHIFT_FIX = 0.5
_BEFORE_CELLS = f"a AS (SELECT r // {LOOKS} AS r, c // {LOOKS} AS c, avg(mdb) AS v FROM sc WHERE k = 4 GROUP BY 1, 2)"
_AFTER_CELLS = f"b AS (SELECT (r + {AHEAD[0]}) // {LOOKS} AS r, (c + {AHEAD[1]}) // {LOOKS} AS c, avg(mdb) AS v FROM sc, ht WHERE k = 5 AND (r + {AHEAD[0]}) // {LOOKS} < height // {LOOKS} AND (c + {AHEAD[1]}) // {LOOKS} < {SIDE // LOOKS} GROUP BY 1, 2)"
_DY, _DX = (-a / LOOKS for a in AHEAD)


def acquisitions(spark, d) -> tuple[DataFrame, DataFrame]:
    """Two scenes in cells, the second displaced by AHEAD / LOOKS of a cell."""

    def cells(k: int, ahead: tuple[int, int]) -> DataFrame:
        at = [F.floor((F.col(x) + n) / LOOKS).alias(x) for x, n in zip("rc", ahead, strict=True)]
        found = scene(spark, d, k).groupBy(*at).agg(F.avg("mdb").alias("v"))
        return found.where((F.col("r") < height(spark, d) // LOOKS) & (F.col("c") < SIDE // LOOKS))

    return cells(4, (0, 0)), cells(5, AHEAD)


def estimated(spark, d) -> tuple[float, float]:
    before, after = acquisitions(spark, d)
    pair = spectral.filled(before, "v").withColumnRenamed("v", "a").join(spectral.filled(after, "v").withColumnRenamed("v", "b").hint("merge"), ["r", "c"])
    return spectral.shift_estimate(pair, height(spark, d) // LOOKS, SIDE // LOOKS)


@query(f"SELECT {_DY}::DOUBLE AS dy, {_DX}::DOUBLE AS dx, true AS moved FROM (SELECT count(*) FROM supplier) t")
def scene_shift(spark, d):
    """The shift that lays the second of two acquisitions on the first, and whether it is worth moving; the SQL states the displacement that was planted."""
    dy, dx = estimated(spark, d)
    return spark.createDataFrame([(dy, dx, max(abs(dy), abs(dx)) > SHIFT_FIX)], "dy double, dx double, moved boolean")


@query(f"""WITH {PLANTS}, {_AFTER_CELLS}, n AS (SELECT o.r, o.c, x.u, y.w, abs(1 - x.u - {-_DY % 1}::DOUBLE) * abs(1 - y.w - {-_DX % 1}::DOUBLE) AS weight, b.v FROM (SELECT r, c FROM b) o
CROSS JOIN (SELECT unnest([0, 1]) AS u) x CROSS JOIN (SELECT unnest([0, 1]) AS w) y LEFT JOIN b ON b.r = o.r + {int(-_DY // 1)} + x.u AND b.c = o.c + {int(-_DX // 1)} + y.w)
SELECT r, c, CASE WHEN count_if(weight > 0 AND v IS NULL) = 0 THEN round(sum(CASE WHEN weight > 0 THEN weight * v END), 3) END AS v FROM n GROUP BY r, c""")
def aligned_scene(spark, d):
    """The second acquisition moved onto the first by the estimated shift; nothing is made up beyond its edge."""
    dy, dx = estimated(spark, d)
    after = acquisitions(spark, d)[1]
    if max(abs(dy), abs(dx)) <= SHIFT_FIX:
        return after.select("r", "c", F.round("v", 3).alias("v"))
    wanted = after.select(F.col("r").alias("i"), F.col("c").alias("j"), (F.col("r") - dy).alias("sr"), (F.col("c") - dx).alias("sc"))
    return tiles.resample(after, wanted, "v").select(F.col("i").alias("r"), F.col("j").alias("c"), F.round("v", 3).alias("v"))


#: Control points of an image in its own, curved geometry: a lattice of CONTROL rows and columns over the whole image.
CONTROL = (12, 6)
_CONTROL = f"""row * 1.0 AS row, col * 1.0 AS col,
  {geo.LEFT} + 10 * col + 60 * (row / {{rows}}) * (col / {SIDE}) + 25 * (row / {{rows}}) * (row / {{rows}}) AS x,
  {geo.TOP} - 10 * row - 45 * (col / {SIDE}) * (col / {SIDE}) + 30 * (row / {{rows}}) * (col / {SIDE}) AS y"""


def control_points(spark, d) -> DataFrame:
    rows = height(spark, d)
    at = spark.range(CONTROL[0] * CONTROL[1]).select((F.floor(F.col("id") / CONTROL[1]) * rows / (CONTROL[0] - 1)).alias("row"), (F.col("id") % CONTROL[1] * SIDE / (CONTROL[1] - 1)).alias("col"))
    return at.selectExpr(*[e.strip() for e in _CONTROL.format(rows=f"{rows}D").replace(" * 1.0 AS row, ", " AS row;").replace(" * 1.0 AS col,", " AS col;").replace(" AS x,", " AS x;").split(";")])


@query(f"""WITH h AS (SELECT ((coalesce(max(s_suppkey), 0) // 28 + 1) * 256)::DOUBLE AS height FROM supplier), q AS (SELECT (a * height / {CONTROL[0] - 1})::DOUBLE AS row, (b * {SIDE} / {CONTROL[1] - 1})::DOUBLE AS col, height FROM h, range({CONTROL[0]}) t(a), range({CONTROL[1]}) u(b))
SELECT round(row, 5) AS row, round(col, 5) AS col, true AS inside FROM q""")
def spline_control(spark, d):
    """Control points through their own spline: each comes back to its image place (to 1e-6, rounded to 5 decimals)."""
    control = written(control_points(spark, d), "control")
    found = spline.evaluated(spline.fitted(control.select("x", "y", F.col("row").alias("u"), F.col("col").alias("v"))), control.select("x", "y", "row", "col"), "u", "v")
    near = (F.abs(F.col("u") - F.col("row")) < 1e-6) & (F.abs(F.col("v") - F.col("col")) < 1e-6)
    return found.select(F.round("u", 5).alias("row"), F.round("v", 5).alias("col"), near.alias("inside"))


@query(None)
def spline_geocode(spark, d):
    """A scene of an image in its own geometry, put on the map grid through control points: linear power, then decibels."""
    x, y = geo.centre("r", "c")
    grid = scene(spark, d).select(F.col("r").alias("i"), F.col("c").alias("j"), F.expr(x).alias("x"), F.expr(y).alias("y"))
    power = holed(spark, d).select("r", "c", F.pow(F.lit(10.0), F.col("v") / 10000).alias("power"))
    found = spline.geocoded(power, "power", written(control_points(spark, d), "control"), grid)
    return found.select("i", "j", F.round(10 * F.log10(F.when(F.col("power") > 0, F.col("power"))), 4).alias("db"))


#: A raster in degrees: its north-west corner and cell sizes.
WEST, NORTH, DLON, DLAT = -70.0005, -12.9485, 0.0000925, 0.0000905
_LON, _LAT = geo.lonlat(*geo.centre("r", "c"))
_SR, _SC = f"(CAST({NORTH} AS DOUBLE) - ({_LAT})) / CAST({DLAT} AS DOUBLE) - 0.5", f"(({_LON}) - CAST({WEST} AS DOUBLE)) / CAST({DLON} AS DOUBLE) - 0.5"
_PLACES = f"o AS (SELECT r AS i, c AS j, {_SR.replace('- 0.5', '- 0.5::DOUBLE')} AS sr, {_SC.replace('- 0.5', '- 0.5::DOUBLE')} AS sc FROM (SELECT r, c FROM sc WHERE k = 0) g)"


def in_degrees(spark, d) -> DataFrame:
    """The places of all grid cells in a raster of degrees, in its pixels from the first centre."""
    at = geo.with_lonlat(scene(spark, d, 0).select("r", "c"), *geo.centre("r", "c"))
    return at.select(F.col("r").alias("i"), F.col("c").alias("j"), ((NORTH - F.col("lat")) / DLAT - 0.5).alias("sr"), ((F.col("lon") - WEST) / DLON - 0.5).alias("sc"))


@query(HOLED + f", {_PLACES} SELECT i, j, v.v::DOUBLE AS v FROM o LEFT JOIN v ON v.r = floor(sr + 0.5::DOUBLE)::BIGINT AND v.c = floor(sc + 0.5::DOUBLE)::BIGINT")
def reproject_nearest(spark, d):
    """A whole raster in degrees on the metric grid, by nearest cells."""
    return tiles.resample(holed(spark, d), in_degrees(spark, d), "v", "nearest")


@query(HOLED + f""", {_PLACES}, n AS (SELECT i, j, CASE a WHEN 1 THEN sr - floor(sr) ELSE 1 - (sr - floor(sr)) END * CASE b WHEN 1 THEN sc - floor(sc) ELSE 1 - (sc - floor(sc)) END AS w, v.v
FROM o CROSS JOIN (SELECT unnest([0, 1]) AS a) CROSS JOIN (SELECT unnest([0, 1]) AS b) LEFT JOIN v ON v.r = floor(sr)::BIGINT + a AND v.c = floor(sc)::BIGINT + b)
SELECT i, j, CASE WHEN count_if(w > 0 AND v IS NULL) = 0 THEN round(sum(CASE WHEN w > 0 THEN w * v END), 3) END AS v FROM n GROUP BY i, j""")
def reproject_bilinear(spark, d):
    """A whole raster in degrees on the metric grid, by weighted means of four cells."""
    return tiles.resample(holed(spark, d), in_degrees(spark, d), "v").select("i", "j", F.round("v", 3).alias("v"))


#: Cells across an overview; a raster of 256 columns has no whole number of pixels in each.
OVERVIEW = 100


@query(HOLED + f""", o AS (SELECT v.v, a.k AS i, b.k AS j, (least((r + 1) * rows, (a.k + 1) * height) - greatest(r * rows, a.k * height)) * (least((c + 1) * {OVERVIEW}, (b.k + 1) * {SIDE}) - greatest(c * {OVERVIEW}, b.k * {SIDE})) AS w, height
FROM (SELECT v.*, height, height * {OVERVIEW} // {SIDE} AS rows FROM v, ht WHERE v IS NOT NULL) v, LATERAL (SELECT unnest(range(r * rows // height, ((r + 1) * rows - 1) // height + 1)) AS k) a, LATERAL (SELECT unnest(range(c * {OVERVIEW} // {SIDE}, ((c + 1) * {OVERVIEW} - 1) // {SIDE} + 1)) AS k) b)
SELECT i, j, round(sum(w * v)::DOUBLE / sum(w), 4) AS mean, max(v) AS high, round(sum(w)::DOUBLE / (any_value(height) * {SIDE}), 6) AS weight FROM o GROUP BY i, j""")
def overview_area(spark, d):
    """An overview of any ratio: means weighted by overlapping area, the highest value, and the share of a cell that has values."""
    rows = height(spark, d)
    found = tiles.area_downsample(holed(spark, d), "v", rows, SIDE, rows * OVERVIEW // SIDE, OVERVIEW)
    return found.select("i", "j", F.round("mean", 4).alias("mean"), "high", F.round("weight", 6).alias("weight"))


#: Fixed values of the published page: pixels on the long side of a picture at most, points along an edge.
PAGE_PX, EDGE_POINTS = 2000, 21
_EDGE_LON, _EDGE_LAT = geo.lonlat("x", "y")
_SIZE = f"""CAST(least(CASE WHEN ratio >= 1 THEN {PAGE_PX} ELSE greatest(1, {{half}}({PAGE_PX} * ratio)) END, {SIDE}) AS BIGINT) AS out_w;
CAST(least(CASE WHEN ratio >= 1 THEN greatest(1, {{half}}({PAGE_PX} / ratio)) ELSE {PAGE_PX} END, rows) AS BIGINT) AS out_h"""


@query(f"""WITH {PLANTS}, t AS (SELECT unnest(range({EDGE_POINTS + 2}))::DOUBLE / {EDGE_POINTS + 1} AS f), box AS (SELECT {geo.LEFT} AS x0, {geo.LEFT + SIDE * geo.RES} AS x1, {geo.TOP} AS y1, {geo.TOP} - height * {geo.RES} AS y0, height AS rows FROM ht),
e AS (SELECT (x0 + f * (x1 - x0))::DOUBLE AS x, y::DOUBLE AS y, rows FROM box, t, LATERAL (SELECT unnest([y0, y1]) AS y) UNION ALL SELECT x::DOUBLE, (y0 + f * (y1 - y0))::DOUBLE, rows FROM box, t, LATERAL (SELECT unnest([x0, x1]) AS x)),
b AS (SELECT min({_EDGE_LON}) AS west, min({_EDGE_LAT}) AS south, max({_EDGE_LON}) AS east, max({_EDGE_LAT}) AS north, any_value(rows) AS rows FROM e), q AS (SELECT *, (east - west) * cos(radians((south + north) / 2)) / (north - south) AS ratio FROM b)
SELECT round(west, 6) AS west, round(south, 6) AS south, round(east, 6) AS east, round(north, 6) AS north, {_SIZE.format(half='round_even').replace('ratio))', 'ratio, 0))').replace('ratio) ', 'ratio, 0) ').replace(';', ',')} FROM q""")
def page_grid(spark, d):
    """The grid's bounds in degrees, its edges followed in steps, and the size of a picture of it with the right aspect."""
    rows = height(spark, d)
    f = F.col("id") / (EDGE_POINTS + 1)
    x0, x1, y0, y1 = geo.LEFT, geo.LEFT + SIDE * geo.RES, geo.TOP - rows * geo.RES, geo.TOP
    along = [F.struct((x0 + f * (x1 - x0)).alias("x"), F.lit(y).alias("y")) for y in (y0, y1)] + [F.struct(F.lit(x).alias("x"), (y0 + f * (y1 - y0)).alias("y")) for x in (x0, x1)]
    edge = spark.range(EDGE_POINTS + 2).select(F.explode(F.array(*along)).alias("p")).selectExpr("p.x AS x", "p.y AS y").selectExpr(f"{_EDGE_LON} AS lon", f"{_EDGE_LAT} AS lat")
    box = edge.agg(F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north")).withColumn("rows", F.lit(rows))
    box = box.withColumn("ratio", F.expr("(east - west) * cos(radians((south + north) / 2)) / (north - south)"))
    return box.selectExpr("round(west, 6) AS west", "round(south, 6) AS south", "round(east, 6) AS east", "round(north, 6) AS north", *_SIZE.format(half="bround").split(";"))


#: Outlines of every customer: a quadrangle, every third with a triangular hole, or an open line of three edges; offsets in metres from a place on the grid.
_PLACE = "{LEFT} + (k * 7919 % 2400) + 80 AS x0, {TOP} - (k * 104729 % (CAST({rows} AS BIGINT) * 10 - 160)) - 80 AS y0"
_RINGS = {
    ("polygon", 0): "-61 - k % 7 * 10, -52; 43, -81 - k % 5 * 9; 92 + k % 6 * 10, 33; -34, 71 + k % 4 * 8; -61 - k % 7 * 10, -52",
    ("polygon", 1): "-14, -11; 17, -9; 3, 22; -14, -11",
    ("line", 0): "-70, 65; 15 + k % 90, -45; 400 + k % 800, -30; 410 + k % 800, 300 + k % 500",
}
_RING_SQL = {key: [tuple(p.split(", ", 1)) for p in text.split("; ")] for key, text in _RINGS.items()}
_WHEN = {("polygon", 0): "k % 2 = 0", ("polygon", 1): "k % 6 = 0", ("line", 0): "k % 2 = 1"}


def _vertex(dx: str, dy: str) -> tuple[str, str]:
    return geo.lonlat(f"CAST(x0 + ({dx}) AS DOUBLE)", f"CAST(y0 + ({dy}) AS DOUBLE)")


def outlines(spark, d, kind: str) -> DataFrame:
    """Vertices of the customers' outlines (doc, key: the customer, ring, i, x, y: in pixels), through GeoJSON in degrees."""
    place = _PLACE.format(LEFT=geo.LEFT, TOP=geo.TOP, rows=height(spark, d))
    rows = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("k")).selectExpr("k", *place.replace(" AS x0, ", " AS x0;").split(";"))
    rows = rows.where("k % 2 = 0" if kind == "polygon" else "k % 2 = 1")

    corners = [F.struct(F.lit(n).alias("ring"), F.lit(i).alias("i"), F.expr(dx).cast("long").alias("dx"), F.expr(dy).cast("long").alias("dy")) for (kind_, n), points in _RING_SQL.items() if kind_ == kind for i, (dx, dy) in enumerate(points)]
    points = rows.select("k", "x0", "y0", F.explode(F.array(*corners)).alias("p")).select("k", "x0", "y0", "p.*").where("ring = 0 OR k % 6 = 0")
    points = geo.with_lonlat(points, "CAST(x0 + dx AS DOUBLE)", "CAST(y0 + dy AS DOUBLE)").select("k", "ring", "i", F.format_string("[%.6f, %.6f]", "lon", "lat").alias("at"))

    def joined(df: DataFrame, order: str, *by: str) -> DataFrame:
        in_order = F.transform(F.array_sort(F.collect_list(F.struct(order, "at"))), lambda x: x["at"])
        return df.groupBy(*by).agg(F.concat(F.lit("["), F.array_join(in_order, ", "), F.lit("]")).alias("at"))

    rows = joined(points, "i", "k", "ring")
    if kind == "polygon":
        rows, coordinates = joined(rows, "ring", "k"), F.concat(F.lit('"Polygon", "coordinates": '), "at")
    else:
        coordinates = F.concat(F.lit('"LineString", "coordinates": '), "at")
    path = shared_dir(spark, f"outlines-{kind}")
    rows.select(F.concat(F.lit('{"type": "Feature", "properties": {"key": '), "k", F.lit('}, "geometry": {"type": '), coordinates, F.lit("}}"))).write.text(path)
    found = geo.with_utm(files.read_outlines(spark, path, lines=True), "lon", "lat")
    return found.select("doc", F.get_json_object("properties", "$.key").cast("long").alias("key"), "ring", "i", ((F.col("x") - geo.LEFT) / geo.RES).alias("x"), ((geo.TOP - F.col("y")) / geo.RES).alias("y"))


def _edges_sql(kind: str) -> str:
    """CTE e (k, x1, y1, x2, y2): the edges of the outlines in pixels, of degrees with 6 decimals."""
    place = _PLACE.format(LEFT=geo.LEFT, TOP=geo.TOP, rows="(SELECT (coalesce(max(s_suppkey), 0) // 28 + 1) * 256 FROM supplier)")
    rings = []
    for key in (k for k in _RING_SQL if k[0] == kind):
        points = ", ".join(f"{{'lon': {lon}, 'lat': {lat}}}" for lon, lat in (_vertex(*p) for p in _RING_SQL[key]))
        rings.append(f"SELECT k, {key[1]} AS ring, [{points}] AS ps FROM q WHERE {_WHEN[key]}")
    x, y = geo.utm("lon", "lat")
    return f"""q AS (SELECT k, {place} FROM (SELECT c_custkey AS k FROM customer)), rg AS ({' UNION ALL '.join(rings)}),
vx AS (SELECT k, ring, unnest(range(len(ps))) AS i, unnest(ps) AS p FROM rg), vd AS (SELECT k, ring, i, printf('%.6f', p.lon)::DOUBLE AS lon, printf('%.6f', p.lat)::DOUBLE AS lat FROM vx),
vp AS (SELECT k, ring, i, ({x} - {geo.LEFT}::DOUBLE) / {geo.RES}::DOUBLE AS x, ({geo.TOP}::DOUBLE - {y}) / {geo.RES}::DOUBLE AS y FROM vd),
e AS (SELECT k, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM vp WINDOW w AS (PARTITION BY k, ring ORDER BY i) QUALIFY x2 IS NOT NULL)"""


_INSIDE = f"r BETWEEN 0 AND (SELECT height - 1 FROM ht) AND c BETWEEN 0 AND {SIDE - 1}"


@query(f"""WITH {PLANTS}, {_edges_sql('polygon')}, bb AS (SELECT k, floor(min(least(x1, x2)))::BIGINT - 1 AS c0, floor(max(greatest(x1, x2)))::BIGINT + 1 AS c1, floor(min(least(y1, y2)))::BIGINT - 1 AS r0, floor(max(greatest(y1, y2)))::BIGINT + 1 AS r1 FROM e GROUP BY k),
rr AS (SELECT k, c0, c1, unnest(range(r0, r1 + 1)) AS r FROM bb), cell AS (SELECT k, r, unnest(range(c0, c1 + 1)) AS c FROM rr),
hit AS (SELECT cell.k, r, c FROM cell JOIN e ON e.k = cell.k AND (y1 <= r + 0.5::DOUBLE) <> (y2 <= r + 0.5::DOUBLE) AND x1 + (r + 0.5::DOUBLE - y1) * (x2 - x1) / (y2 - y1) <= c + 0.5::DOUBLE GROUP BY cell.k, r, c HAVING count(*) % 2 = 1)
SELECT r, c, count(*) AS n FROM hit WHERE {_INSIDE} GROUP BY r, c""")
def outlines_burn(spark, d):
    """Cells whose centre lies in an outline, holes left out, with the number of outlines there."""
    found = burn.edges(written(outlines(spark, d, "polygon"), "outline-vertices"), "doc", "ring", closed=False)
    return burn.polygon_cells(found, "doc", height=height(spark, d), width=SIDE).groupBy("r", "c").agg(F.count("*").alias("n"))


@query(f"""WITH {PLANTS}, {_edges_sql('line')}, rr AS (SELECT *, unnest(range(floor(least(y1, y2))::BIGINT, floor(greatest(y1, y2))::BIGINT + 1)) AS r FROM e),
sp AS (SELECT k, r, CASE WHEN y1 = y2 THEN x1 ELSE x1 + (greatest(r::DOUBLE, least(y1, y2)) - y1) * (x2 - x1) / (y2 - y1) END AS a, CASE WHEN y1 = y2 THEN x2 ELSE x1 + (least(r + 1.0::DOUBLE, greatest(y1, y2)) - y1) * (x2 - x1) / (y2 - y1) END AS b FROM rr),
cell AS (SELECT DISTINCT k, r, unnest(range(floor(least(a, b))::BIGINT, floor(greatest(a, b))::BIGINT + 1)) AS c FROM sp) SELECT r, c, count(*) AS n FROM cell WHERE {_INSIDE} GROUP BY r, c""")
def lines_burn(spark, d):
    """Cells that a line passes through, with the number of lines there."""
    found = burn.edges(written(outlines(spark, d, "line"), "line-vertices"), "doc", closed=False)
    return burn.line_cells(found, "doc", height=height(spark, d), width=SIDE).groupBy("r", "c").agg(F.count("*").alias("n"))


@query(f"""WITH {PLANTS}, {_edges_sql('polygon')}, bb AS (SELECT k, floor(min(least(x1, x2)))::BIGINT - 1 AS c0, floor(max(greatest(x1, x2)))::BIGINT + 1 AS c1, floor(min(least(y1, y2)))::BIGINT - 1 AS r0, floor(max(greatest(y1, y2)))::BIGINT + 1 AS r1 FROM e GROUP BY k),
rr AS (SELECT k, c0, c1, unnest(range(r0, r1 + 1)) AS r FROM bb), cell AS (SELECT k, r, unnest(range(c0, c1 + 1)) AS c FROM rr),
hit AS (SELECT cell.k, r, c FROM cell JOIN e ON e.k = cell.k AND (y1 <= r + 0.5::DOUBLE) <> (y2 <= r + 0.5::DOUBLE) AND x1 + (r + 0.5::DOUBLE - y1) * (x2 - x1) / (y2 - y1) <= c + 0.5::DOUBLE GROUP BY cell.k, r, c HAVING count(*) % 2 = 1)
SELECT k AS poly, count(*) AS n, min(r) AS top, max(r) AS bottom, sum(c)::BIGINT AS place FROM hit WHERE {_INSIDE} GROUP BY k""")
def polygon_burn(spark, d):
    """Every outline's cells on the grid: how many, its first and last row, the sum of their columns."""
    found = burn.edges(written(outlines(spark, d, "polygon"), "outline-vertices"), "key", "ring", closed=False)
    cells = burn.polygon_cells(found, "key", height=height(spark, d), width=SIDE)
    return cells.groupBy(F.col("key").alias("poly")).agg(F.count("*").alias("n"), F.min("r").alias("top"), F.max("r").alias("bottom"), F.sum("c").alias("place"))


@query(f"""WITH {PLANTS}, {_edges_sql('line')}, rr AS (SELECT *, unnest(range(floor(least(y1, y2))::BIGINT, floor(greatest(y1, y2))::BIGINT + 1)) AS r FROM e),
sp AS (SELECT k, r, CASE WHEN y1 = y2 THEN x1 ELSE x1 + (greatest(r::DOUBLE, least(y1, y2)) - y1) * (x2 - x1) / (y2 - y1) END AS a, CASE WHEN y1 = y2 THEN x2 ELSE x1 + (least(r + 1.0::DOUBLE, greatest(y1, y2)) - y1) * (x2 - x1) / (y2 - y1) END AS b FROM rr),
cell AS (SELECT DISTINCT k, r, unnest(range(floor(least(a, b))::BIGINT, floor(greatest(a, b))::BIGINT + 1)) AS c FROM sp) SELECT k AS line, count(*) AS n, min(r) AS top, max(r) AS bottom, sum(c)::BIGINT AS place FROM cell WHERE {_INSIDE} GROUP BY k""")
def line_burn(spark, d):
    """The same of the cells that every line touches."""
    found = burn.edges(written(outlines(spark, d, "line"), "line-vertices"), "key", closed=False)
    cells = burn.line_cells(found, "key", height=height(spark, d), width=SIDE)
    return cells.groupBy(F.col("key").alias("line")).agg(F.count("*").alias("n"), F.min("r").alias("top"), F.max("r").alias("bottom"), F.sum("c").alias("place"))
