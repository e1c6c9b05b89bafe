"""Report queries: rates, timelines, scores, labels, names and dates, page queries and exports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from canopyspark.config import CONFIG
from canopyspark.functions import geo
from canopyspark.functions.text import QUOTES, XML, csv_field, escaped, number_or_null
from canopyspark.operators.nearest import nearest
from canopyspark.operators.scratch import written
from canopyspark.plans.layers import INSIDE, POINTS, points
from canopyspark.plans.queries import ALERTS, CRACK, LABELS, PIXELS, PLANTS, _px, alerts_ranked, crackdown_table
from canopyspark.sources.synthetic import labels, scenes

SIDE = CONFIG.side
QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def values(spark, rows: list[tuple], schema: str):
    return spark.createDataFrame(rows, schema)


def sql_values(rows: list[tuple], names: str) -> str:
    def cell(v) -> str:
        return "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return f"(VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) t({names})"


def _split_columns(columns: str) -> list[str]:
    """The expressions of a list of columns, cut at commas outside brackets and quotes."""
    out, depth, quoted = [""], 0, False
    for ch in columns:
        quoted ^= ch == "'"
        depth += 0 if quoted else (ch == "(") - (ch == ")")
        if ch == "," and not depth and not quoted:
            out.append("")
        else:
            out[-1] += ch
    return [x.strip() for x in out]


_RATES = "days, greatest(days, 1) / 30.4375 AS months, inside_px / 100 AS inside_ha, outside_px / 100 AS outside_ha"


@query(CRACK + " SELECT i, phase, days, round(greatest(days, 1) / 30.4375::DOUBLE, 4) AS months, inside_px / 100 AS inside_ha, outside_px / 100 AS outside_ha, round(inside_px / 100 / (greatest(days, 1) / 30.4375::DOUBLE), 4) AS inside_rate, round(outside_px / 100 / (greatest(days, 1) / 30.4375::DOUBLE), 4) AS outside_rate FROM ct")
def crackdown_rates(spark, d):
    """Hectares and hectares a month per period, inside and outside the zone."""
    months = F.greatest("days", F.lit(1)) / F.lit(CONFIG.days_per_month)
    ha = {s: F.col(f"{s}_px") / 100 for s in ("inside", "outside")}
    return crackdown_table(spark, d).select("i", "phase", "days", F.round(months, 4).alias("months"), *[ha[s].alias(f"{s}_ha") for s in ha], *[F.round(ha[s] / months, 4).alias(f"{s}_rate") for s in ha])


@query(CRACK + " SELECT p.phase, count(ct.i) AS periods, round(sum(inside_px) / 100 / (sum(days) / 30.4375::DOUBLE), 4) AS inside_rate, round(sum(outside_px) / 100 / (sum(days) / 30.4375::DOUBLE), 4) AS outside_rate FROM (SELECT unnest(['before', 'after']) AS phase) p LEFT JOIN ct ON ct.phase = p.phase GROUP BY p.phase")
def crackdown_phases(spark, d):
    """Monthly rates before and after the event; a phase without periods has no rate, but a row."""
    spine = values(spark, [("before",), ("after",)], "phase string")
    found = spine.join(crackdown_table(spark, d), "phase", "left").groupBy("phase")
    rate = [F.round(F.try_divide(F.sum(f"{s}_px") / 100, F.sum("days") / F.lit(CONFIG.days_per_month)), 4).alias(f"{s}_rate") for s in ("inside", "outside")]
    return found.agg(F.count("i").alias("periods"), *rate)


#: A loss layer: year of loss (0 none), tree cover in 2000, data mask.
LOSS = "r, c, (r * 7 + c * 13) % 21 AS loss, (r * 3 + c * 5) % 100 >= 30 AND CASE WHEN c % 50 = 0 THEN 2 ELSE 1 END = 1 AS forest2000"
LOSS_SQL = f"WITH {PLANTS}, ls AS (SELECT {LOSS}, mdb FROM sc WHERE k = 5)"
TIMELINE = LOSS_SQL + f", tl AS (SELECT y AS year, round(count_if(forest2000 AND c < {SIDE // 2}) / 100, 1) AS inside_ha, round(count_if(forest2000 AND c >= {SIDE // 2}) / 100, 1) AS outside_ha FROM range(2001, 2021) t(y) LEFT JOIN ls ON loss = y - 2000 GROUP BY y)"


def loss_layer(spark, d):
    return scenes(spark, d).where("k = 5").selectExpr(*["r", "c"], "(r * 7 + c * 13) % 21 AS loss", LOSS.split(", ", 3)[3], "mdb")


@query(TIMELINE + " SELECT * FROM tl")
def loss_timeline(spark, d):
    """Hectares of forest lost per year, inside and outside; years without loss are zero."""
    lost = loss_layer(spark, d).where("forest2000 AND loss > 0").groupBy((F.col("loss") + 2000).alias("year"))
    counts = lost.agg(F.count_if(F.col("c") < SIDE // 2).alias("inside"), F.count_if(F.col("c") >= SIDE // 2).alias("outside"))
    spine = spark.range(2001, 2021).select(F.col("id").alias("year"))
    return spine.join(counts, "year", "left").select("year", *[F.round(F.coalesce(s, F.lit(0)) / 100, 1).alias(f"{s}_ha") for s in ("inside", "outside")])


@query(TIMELINE + " SELECT round(avg(inside_ha) FILTER (year BETWEEN 2015 AND 2018), 4) AS inside_before, round(avg(inside_ha) FILTER (year BETWEEN 2019 AND 2020), 4) AS inside_after, round(avg(outside_ha) FILTER (year BETWEEN 2015 AND 2018), 4) AS outside_before, round(avg(outside_ha) FILTER (year BETWEEN 2019 AND 2020), 4) AS outside_after FROM tl")
def timeline_means(spark, d):
    spans = {"before": F.col("year").between(2015, 2018), "after": F.col("year").between(2019, 2020)}
    return loss_timeline(spark, d).agg(*[F.round(F.avg(F.when(when, F.col(f"{s}_ha"))), 4).alias(f"{s}_{n}") for s in ("inside", "outside") for n, when in spans.items()])


@query(LOSS_SQL + " SELECT forest2000, loss BETWEEN 1 AND 20 AS lost_by, forest2000 AND mdb < -11000 AS fired, count(*) AS n FROM ls GROUP BY 1, 2, 3")
def single_date_rule(spark, d):
    """Forest in 2000 that is dark now, against the loss layer up to the scene's year."""
    fired = F.col("forest2000") & (F.col("mdb") < CONFIG.forest_min)
    return loss_layer(spark, d).groupBy("forest2000", F.col("loss").between(1, 20).alias("lost_by"), fired.alias("fired")).agg(F.count("*").alias("n"))


_LB = LABELS.partition(", lb AS")[1] + LABELS.partition(", lb AS")[2]
DETECTED = PIXELS + _LB + ", e AS (SELECT px.r, px.c, coalesce(lb.year, 0) AS year, change_idx IS NOT NULL AS ru, first - min_later >= 2500 AS mo FROM px LEFT JOIN lb USING (r, c)), u AS (SELECT r, c, year, unnest(['rule', 'model', 'combined', 'both']) AS detector, unnest([ru, mo, ru OR mo, ru AND mo]) AS f FROM e)"
COMPARED = DETECTED + f", mc AS (SELECT detector, count_if(f AND year > 0) / nullif(count_if(f), 0) AS precision, count_if(f AND year > 0) / nullif(count_if(year > 0), 0) AS recall, count_if(f AND year >= 2020) / nullif(count_if(f AND (year >= 2020 OR year = 0)), 0) AS new_precision, count_if(f AND year >= 2020) / nullif(count_if(year >= 2020), 0) AS new_recall, count_if(f) / 100 AS flagged_ha, round(count_if(f AND c < {SIDE // 2}) / greatest(count_if(f), 1), 3) AS share_inside FROM u GROUP BY detector)"


def detected(spark, d):
    """r, c, year (0 where unlabelled), detector, f: whether it fired."""
    px = _px(spark, d).join(labels(spark, d).hint("merge"), ["r", "c"], "left")
    rule, model = F.col("change_idx").isNotNull(), F.col("first") - F.col("min_later") >= 2500
    each = [F.struct(F.lit(n).alias("detector"), f.alias("f")) for n, f in (("rule", rule), ("model", model), ("combined", rule | model), ("both", rule & model))]
    return px.select("r", "c", F.coalesce("year", F.lit(0)).alias("year"), F.explode(F.array(*each)).alias("s")).select("r", "c", "year", "s.*")


@query(COMPARED + " SELECT * FROM mc")
def model_compare(spark, d):
    """Every detector on all labels and on new ones, its area, and its share inside the zone."""
    n = lambda when: F.count_if(when)
    f, old, new = F.col("f"), F.col("year") > 0, F.col("year") >= 2020
    return detected(spark, d).groupBy("detector").agg(
        F.try_divide(n(f & old), n(f)).alias("precision"), F.try_divide(n(f & old), n(old)).alias("recall"),
        F.try_divide(n(f & new), n(f & (new | (F.col("year") == 0)))).alias("new_precision"), F.try_divide(n(f & new), n(new)).alias("new_recall"),
        (n(f) / 100).alias("flagged_ha"), F.round(n(f & (F.col("c") < SIDE // 2)) / F.greatest(n(f), F.lit(1)), 3).alias("share_inside"),
    )


@query(COMPARED + ", f1 AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1, list_position(['rule', 'model', 'combined', 'both'], detector) AS place FROM mc) SELECT detector, round(f1, 6) AS f1 FROM f1 ORDER BY f1 DESC, place LIMIT 1")
def best_model(spark, d):
    """The detector with the highest F1; the first of equals."""
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    place = F.array_position(F.array(*map(F.lit, ("rule", "model", "combined", "both"))), F.col("detector"))
    return model_compare(spark, d).select("detector", f1.alias("f1"), place.alias("place")).orderBy(F.desc("f1"), "place").limit(1).select("detector", F.round("f1", 6).alias("f1"))


@query(DETECTED + " SELECT detector, count_if(f) / 100 AS flagged_ha, round(count_if(f AND year > 0) / greatest(count_if(f), 1), 4) AS confirmed, count_if(f AND year > 0) / 100 AS both_ha, count_if(f AND year = 0) / 100 AS only_detected_ha, count_if(NOT f AND year > 0) / 100 AS only_labelled_ha FROM u GROUP BY detector")
def agreement_parts(spark, d):
    """Three disjoint parts, in hectares, and the confirmed share of what is flagged."""
    f, known = F.col("f"), F.col("year") > 0
    ha = lambda when: F.count_if(when) / 100
    confirmed = F.round(F.count_if(f & known) / F.greatest(F.count_if(f), F.lit(1)), 4)
    return detected(spark, d).groupBy("detector").agg(ha(f).alias("flagged_ha"), confirmed.alias("confirmed"), ha(f & known).alias("both_ha"), ha(f & ~known).alias("only_detected_ha"), ha(~f & known).alias("only_labelled_ha"))


@query(LABELS + ", raw AS (SELECT r, c, CASE WHEN r % 2 = 0 THEN year * 10 + 1 + c % 4 ELSE year END AS v FROM lb), n AS (SELECT CASE WHEN v > 9999 THEN v // 10 ELSE v END AS year FROM raw), b AS (SELECT greatest(2018 + 1, min(year) + 1) AS first_year FROM n WHERE year > 0) SELECT year, count(*) AS n, year BETWEEN 1 AND 2019 AS mining, year BETWEEN first_year AND 2020 AS is_new FROM n, b GROUP BY 1, 3, 4")
def year_labels(spark, d):
    """Quarter codes to years, counted, with the mining and new-mining masks."""
    v = F.when(F.col("r") % 2 == 0, F.col("year") * 10 + 1 + F.col("c") % 4).otherwise(F.col("year"))
    years = labels(spark, d).select(F.when(v > 9999, F.floor(v / 10)).otherwise(v).cast("long").alias("year")).groupBy("year").agg(F.count("*").alias("n"))
    first = years.where("year > 0").agg(F.greatest(F.lit(2018 + 1), F.min("year") + 1).alias("f")).first()["f"] or 0
    return years.select("year", "n", F.col("year").between(1, 2019).alias("mining"), F.col("year").between(first, 2020).alias("is_new"))


#: Pins from the customer table: every place comes several times, its text spaced in another way.
_PIN = """c_custkey AS place, CASE j % 6 WHEN 0 THEN 'Mine A' WHEN 1 THEN concat('Pond ', j % 50) WHEN 2 THEN 'NOT MINING 3' WHEN 3 THEN 'Settlement' WHEN 4 THEN NULL ELSE 'mining camp' END AS plain,
  concat('-70.', lpad(CAST(j * 7 % 1000 AS {text}), 3, '0')) AS lon_text, concat('-12.', lpad(CAST(j * 13 % 1000 AS {text}), 3, '0')) AS lat_text"""
_PIN_TEXT = "place, CASE WHEN place % 3 = 0 THEN concat(' ', plain, ' ') ELSE plain END AS name, concat(CASE WHEN place % 2 = 0 THEN ' ' ELSE '' END, lon_text, CASE place % 4 WHEN 0 THEN ',' WHEN 1 THEN ' , ' WHEN 2 THEN ' ' ELSE ', ' END, lat_text, CASE WHEN place % 5 = 0 THEN ',0' ELSE '' END) AS coords"
_PIN_MINING = "CAST((contains(upper(name), 'MIN') OR contains(upper(name), 'POND')) AND NOT contains(upper(name), 'NOT') AS INT)"


@query(f"WITH r AS (SELECT {_PIN.format(text='VARCHAR')} FROM (SELECT c_custkey, c_custkey % 400 AS j FROM customer)), t AS (SELECT {_PIN_TEXT} FROM r), p AS (SELECT place, trim(coalesce(name, '')) AS name, regexp_split_to_array(trim(coords), '[,\\s]+') AS a FROM t), q AS (SELECT place, name, a[1]::DOUBLE AS lon, a[2]::DOUBLE AS lat FROM p) SELECT place, name, lon, lat, {_PIN_MINING} AS mining FROM q QUALIFY row_number() OVER (PARTITION BY name, lon, lat ORDER BY place) = 1")
def pin_classify_dedupe(spark, d):
    """Placemarks to check points: coordinates from text, class from the name, the first of equal pins."""
    raw = spark.read.parquet(f"{d}/customer.parquet").selectExpr("c_custkey", "c_custkey % 400 AS j").select(F.expr("c_custkey AS place"), *[F.expr(e) for e in _split_columns(_PIN.format(text="STRING"))[1:]])
    p = raw.selectExpr(*_split_columns(_PIN_TEXT))
    a = F.split(F.trim("coords"), r"[,\s]+")
    p = p.select("place", F.trim(F.coalesce("name", F.lit(""))).alias("name"), a[0].cast("double").alias("lon"), a[1].cast("double").alias("lat"))
    first = F.row_number().over(Window.partitionBy("name", "lon", "lat").orderBy("place"))
    return p.withColumn("n", first).where("n = 1").selectExpr("place", "name", "lon", "lat", f"{_PIN_MINING} AS mining")


#: File names from the orders' days: scenes, products, and names that are neither.
_FILE = "CASE WHEN o_orderkey % 7 < 4 THEN concat('sigma0_', day, '.tif') WHEN o_orderkey % 7 = 4 THEN concat('sigma0_', substr(day, 1, 4), '.tif') WHEN o_orderkey % 7 = 5 THEN concat('sigma0_', day, '.tif.aux.xml') ELSE concat('S1A_IW_SLC__1SDV_', day, '_101112_x.zip') END"
_LABEL_DAY = "19960301"


@query(rf"WITH n AS (SELECT DISTINCT {_FILE} AS name FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS day FROM orders)), f AS (SELECT name, coalesce(nullif(regexp_extract(name, '^sigma0_(\d{{8}})\.tif$', 1), ''), nullif(regexp_extract(name, '_(\d{{8}})_\d{{6}}_', 1), '')) AS day FROM n) SELECT name, strftime(strptime(day, '%Y%m%d'), '%Y-%m-%d') AS iso, day[:4]::INT AS year, (row_number() OVER (ORDER BY day, name) - 1)::INT AS k, day = max(day) OVER () AS is_last, coalesce(max(CASE WHEN day <= '{_LABEL_DAY}' THEN day END) OVER (), min(day) OVER ()) AS label_day FROM f WHERE day IS NOT NULL")
def scene_files(spark, d):
    """Scenes from file names, oldest first, with the latest one and the last one not after the label date; a row for each file of an archive."""
    name = F.col("name")
    day = F.coalesce(F.nullif(F.regexp_extract(name, r"^sigma0_(\d{8})\.tif$", 1), F.lit("")), F.nullif(F.regexp_extract(name, r"_(\d{8})_\d{6}_", 1), F.lit("")))
    names = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.date_format("o_orderdate", "yyyyMMdd").alias("day")).selectExpr(f"{_FILE} AS name").distinct()
    f = names.select("name", day.alias("day")).where("day IS NOT NULL")
    every = f.agg(F.max("day").alias("last"), F.coalesce(F.max(F.when(F.col("day") <= _LABEL_DAY, F.col("day"))), F.min("day")).alias("label_day")).first()
    k = (F.row_number().over(Window.orderBy("day", "name")) - 1).alias("k")
    return f.select("name", F.date_format(F.to_date("day", "yyyyMMdd"), "yyyy-MM-dd").alias("iso"), F.substring("day", 1, 4).cast("int").alias("year"), k, (F.col("day") == every["last"]).alias("is_last"), F.lit(every["label_day"]).alias("label_day"))


_LAYERS = [(n,) for n in ("slope", "worldcover", "buffer", "dist_road")]


@query(f"WITH {PLANTS}, h AS (SELECT 'slope' AS name, CASE WHEN c % 11 > 0 THEN (r % 30)::DOUBLE ELSE 'nan'::DOUBLE END AS v FROM sc WHERE k = 0 UNION ALL SELECT 'worldcover', CASE WHEN c < 200 THEN 10 ELSE 60 END FROM sc WHERE k = 0) SELECT t.name, count(h.v) > 0 AS present, sum(CASE WHEN isnan(coalesce(v, 0)) THEN 0 ELSE coalesce(v, 0) END) AS total, count_if(t.name = 'worldcover' AND v = 10)::BIGINT AS forest_px, coalesce(bool_or(v > 0 AND NOT isnan(v)), false) AS any_positive FROM {sql_values(_LAYERS, 'name')} LEFT JOIN h ON h.name = t.name GROUP BY t.name")
def helper_layers(spark, d):
    """Helper layers by name: there or zeros, NaN as zero, any positive pixel, pixels of forest cover."""
    px = scenes(spark, d).where("k = 0")
    kept = F.create_map(F.lit("slope"), F.when(F.col("c") % 11 > 0, (F.col("r") % 30).cast("double")).otherwise(F.lit(float("nan"))), F.lit("worldcover"), F.when(F.col("c") < 200, 10.0).otherwise(60.0))
    rows = px.select(F.explode(kept).alias("name", "v"))
    clean = F.coalesce(F.nanvl("v", F.lit(0.0)), F.lit(0.0))
    # two names hold all pixels: each task adds up its own, and only the sums meet the names
    sums = rows.groupBy("name").agg(F.count("v").alias("n"), F.sum(clean).alias("total"), F.count_if(F.col("v") == 10).alias("ten"), F.bool_or(clean > 0).alias("positive"))
    met = values(spark, _LAYERS, "name string").join(sums, "name", "left")
    forest = F.when(F.col("name") == "worldcover", F.coalesce("ten", F.lit(0))).otherwise(F.lit(0)).cast("long")
    return met.select("name", F.coalesce(F.col("n") > 0, F.lit(False)).alias("present"), F.coalesce("total", F.lit(0.0)).alias("total"), forest.alias("forest_px"), F.coalesce("positive", F.lit(False)).alias("any_positive"))


_DAYS = ", ".join(f"('{x}')" for x in CONFIG.dates)


@query(f"WITH {PLANTS}, {POINTS}, s AS (SELECT pid, k, CASE WHEN (pid + k) % 4 <> 0 THEN mdb END AS v FROM pt JOIN sc ON sc.r = pt.r AND sc.c = pt.c), b AS (SELECT pid, arg_min(v, k) FILTER (v IS NOT NULL) AS base FROM s GROUP BY pid), dt AS (SELECT (row_number() OVER ())::INT - 1 AS k, d FROM (VALUES {_DAYS}) t(d)) SELECT s.pid, max(base) AS base, count_if(v <= base - 3000)::BIGINT AS n_hits, min(s.k) FILTER (v <= base - 3000) AS first_hit, min(s.k) FILTER (v < -18000) AS dark, max(v) FILTER (s.k = 1) AS before, max(v) FILTER (s.k = 5) AS after, max(v) FILTER (s.k = 5) - max(v) FILTER (s.k = 1) AS change, coalesce(min(s.k) FILTER (dt.d >= strftime(DATE '2018-12-01' + (s.pid % 500)::INT, '%Y-%m-%d')), 5) AS scene_of FROM s JOIN b ON b.pid = s.pid JOIN dt ON dt.k = s.k GROUP BY s.pid")
def point_series(spark, d):
    """A point's series over the scenes: base (first value), hits 3 dB below it, dark scene, change, and the scene of a date."""
    s = points(spark, d).hint("merge").join(scenes(spark, d), ["r", "c"])
    s = s.select("pid", "k", F.when((F.col("pid") + F.col("k")) % 4 != 0, F.col("mdb")).alias("v"))
    s = s.groupBy("pid").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("series"))
    base = F.get(F.filter("series", lambda v: v.isNotNull()), F.lit(0))
    hit = F.transform("series", lambda v: F.coalesce(v <= base - CONFIG.drop_min, F.lit(False)))
    dark = F.transform("series", lambda v: F.coalesce(v < CONFIG.water_max, F.lit(False)))
    at = lambda flags: F.nullif(F.array_position(flags, F.lit(True)), F.lit(0)) - 1
    seen = F.date_format(F.date_add(F.lit(CONFIG.dates[0]).cast("date"), (F.col("pid") % 500).cast("int")), "yyyy-MM-dd")
    later = F.transform(F.array(*map(F.lit, CONFIG.dates)), lambda day: day >= seen)
    before, after = F.get("series", F.lit(1)), F.get("series", F.lit(5))
    return s.select("pid", base.alias("base"), F.size(F.filter(hit, lambda x: x)).cast("long").alias("n_hits"), at(hit).alias("first_hit"), at(dark).alias("dark"), before.alias("before"), after.alias("after"), (after - before).alias("change"), F.coalesce(at(later), F.lit(5)).alias("scene_of"))


_AT = "c_custkey AS id, c_custkey * 7919 % 10007 * 10 AS x, c_custkey * 104729 % 10009 * 10 AS y"


@query(f"WITH a AS (SELECT {_AT} FROM customer) SELECT a.id, b.id AS other, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 3) AS metres, row_number() OVER (PARTITION BY a.id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.id)::INT AS place FROM a JOIN a b ON a.id <> b.id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 25000000 QUALIFY place <= 3")
def nearby5(spark, d):
    """The three nearest other places within 5 km, by cells that grow as they need."""
    a = spark.read.parquet(f"{d}/customer.parquet").selectExpr(*_AT.split(", "))
    return nearest(a, 3, 5000).select("id", "other", F.round(F.sqrt("d2"), 3).alias("metres"), "place")


_CARD = "CASE WHEN before <> 0 THEN concat(CAST(CAST(round((after - before) * 100.0 / before) AS INT) AS {text}), '%') END AS change, CASE WHEN after < before THEN 'fell' WHEN after > before THEN 'rose' ELSE 'stayed level' END AS word, CASE WHEN after > 1.1 * before THEN 'up' WHEN after < 0.9 * before THEN 'down' ELSE 'steady' END AS trend, CAST(ceil(top / power(10, floor(log10(top)))) * power(10, floor(log10(top))) AS BIGINT) AS axis, low_year"


@query(f"WITH y AS (SELECT o_custkey % 2 = 0 AS inside, year(o_orderdate)::INT AS year, count(*) AS n FROM orders GROUP BY 1, 2), s AS (SELECT inside, sum(n) FILTER (year <= 1994)::BIGINT AS before, sum(n) FILTER (year > 1994)::BIGINT AS after, greatest(1, max(n)) AS top, arg_min(year, n * 10000 + year) AS low_year FROM y GROUP BY inside) SELECT inside, before, after, {_CARD.format(text='VARCHAR')} FROM s")
def card_text(spark, d):
    """A card's words and bars: change in percent, direction, trend, a round axis end and the lowest year."""
    years = spark.read.parquet(f"{d}/orders.parquet").groupBy((F.col("o_custkey") % 2 == 0).alias("inside"), F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))
    s = years.groupBy("inside").agg(F.sum(F.when(F.col("year") <= 1994, F.col("n"))).alias("before"), F.sum(F.when(F.col("year") > 1994, F.col("n"))).alias("after"), F.greatest(F.lit(1), F.max("n")).alias("top"), F.min_by("year", F.struct("n", "year")).alias("low_year"))
    return s.selectExpr("inside", "before", "after", *[e.strip() for e in _CARD.format(text="STRING").replace(", CASE", ";CASE").replace(", CAST(ceil", ";CAST(ceil").replace(", low_year", ";low_year").split(";")])


#: What people said, with characters that need care around it.
_SAID = "concat('<', role, '> \"', conv_id, '\", </i> & ', coalesce(text, ''))"


@query(f"WITH t AS (SELECT conv_id, turn, {_SAID} AS s FROM conversations) SELECT conv_id, turn, md5({escaped('s')}) AS xml, md5({escaped(escaped('s'), QUOTES)}) AS html, md5({csv_field('s')}) AS csv, md5(replace(s, '</', '<\\/')) AS page, md5(base64(encode(s))) AS b64 FROM t")
def escape_text(spark, d):
    """Text made safe for XML, HTML, CSV and a script in a page, and as base64; hashes of each form."""
    t = spark.read.parquet(f"{d}/conversations.parquet").selectExpr("conv_id", "turn", f"{_SAID} AS s")
    html = F.col("s")
    for plain, safe in XML + QUOTES:
        html = F.replace(html, F.lit(plain), F.lit(safe))
    forms = {"xml": F.expr(escaped("s")), "html": html, "csv": F.expr(csv_field("s")), "page": F.replace("s", F.lit("</"), F.lit("<\\/")), "b64": F.translate(F.base64(F.encode("s", "utf-8")), "\r\n", "")}  # Spark breaks its lines
    return t.select("conv_id", "turn", *[F.md5(x.cast("binary")).alias(n) for n, x in forms.items()])


_KINDS = {"all": "true", "high": "o_orderstatus = 'F'", "medium": "o_orderstatus <> 'F'", "pond": "o_custkey % 3 = 0", "bare": "o_custkey % 3 = 1", "clearing": "o_custkey % 3 = 2", "buffer": "o_custkey % 5 = 0", "indigenous": "o_custkey % 7 = 0"}
_BEFORE, _AFTER = (0, 2), "1997-06-01"


def _pool(before: int, text: str) -> str:
    pool = f"o_orderdate <= CAST('{_AFTER}' AS {text})" + (f" AND o_orderdate > CAST('1995-01-01' AS {text})" if before else "")
    return f"({pool})"


@query("SELECT before, q, kind, n FROM (" + " UNION ALL ".join(f"SELECT {b} AS before, '{q}' AS q, '{k}' AS kind, count_if({_pool(b, 'TIMESTAMP')} AND ({w}) AND ({'true' if not q.strip() else chr(39) + q.strip().lower() + chr(39) + ' <> chr(0) AND contains(lower(concat_ws(chr(32), o_orderpriority, o_orderstatus)), ' + chr(39) + q.strip().lower() + chr(39) + ')'}))::BIGINT AS n FROM orders" for b in _BEFORE for q in ("", " High ") for k, w in _KINDS.items()) + ")")
def pool_filters(spark, d):
    """Counts of all eight named filters over pools with and without a first date and a search text, in one pass."""
    orders = spark.read.parquet(f"{d}/orders.parquet")
    text = F.lower(F.concat_ws(" ", "o_orderpriority", "o_orderstatus"))
    each = []
    for before in _BEFORE:
        for q in ("", " High "):
            needle = q.strip().lower()
            found = F.expr(_pool(before, "TIMESTAMP_NTZ")) & (F.contains(text, F.lit(needle)) if needle else F.lit(True))
            each += [F.struct(F.lit(before).alias("before"), F.lit(q).alias("q"), F.lit(k).alias("kind"), F.count_if(found & F.expr(w)).alias("n")) for k, w in _KINDS.items()]
    return orders.agg(F.array(*each).alias("a")).select(F.explode("a").alias("s")).select("s.*")


_LON, _LAT = geo.lonlat("x", "y")
PLACED = f"WITH {POINTS}, f AS (SELECT pid, mining, r, c, round({_LON}, 5) AS lon, round({_LAT}, 5) AS lat, CASE WHEN pid % 4 > 0 THEN pid / 10 END AS metres, concat('Point <', CAST(pid AS VARCHAR), '>') AS name FROM pt WHERE {INSIDE})"


def placed(spark, d):
    return points(spark, d).selectExpr("pid", "mining", "r", "c", f"round({_LON}, 5) AS lon", f"round({_LAT}, 5) AS lat", "CASE WHEN pid % 4 > 0 THEN pid / 10 END AS metres", "concat('Point <', CAST(pid AS STRING), '>') AS name")


def _feature(form: str) -> str:
    return f"""concat('{{"type":"Feature","geometry":{{"type":"Point","coordinates":[', {form}('%.5f', lon), ',', {form}('%.5f', lat), ']}},"properties":{{"id":', {form}('%d', pid), ',"dist":', {number_or_null('metres', 1, form)}, '}}}}')"""


def _placemark(form: str) -> str:
    return f"concat('<Placemark><name>', {escaped('name')}, '</name><Point><coordinates>', {form}('%.5f', lon), ',', {form}('%.5f', lat), '</coordinates></Point></Placemark>')"


def _line(form: str) -> str:
    return f"concat_ws(',', {form}('%d', pid), {form}('%.5f', lon), {form}('%.5f', lat), {csv_field('name')}, CASE WHEN metres IS NULL THEN '' ELSE {form}('%.1f', metres) END, concat('https://maps.google.com/?q=', {form}('%.5f', lat), '%2C', {form}('%.5f', lon)))"


@query(PLACED + f" SELECT pid, {_feature('printf')} AS feature FROM f")
def export_geojson(spark, d):
    return placed(spark, d).selectExpr("pid", f"{_feature('format_string')} AS feature")


@query(PLACED + f" SELECT pid, {_placemark('printf')} AS placemark FROM f")
def export_kml(spark, d):
    return placed(spark, d).selectExpr("pid", f"{_placemark('format_string')} AS placemark")


@query(PLACED + f" SELECT pid, {_line('printf')} AS line FROM f")
def export_csv(spark, d):
    return placed(spark, d).selectExpr("pid", f"{_line('format_string')} AS line")


_BOX = (-70.0, -13.03, -69.9, -12.95)
_PLON, _PLAT = geo.lonlat(*geo.centre("r", "c"))
_ZONE = f"({_PLON} BETWEEN -69.997 AND -69.985 AND {_PLAT} BETWEEN -12.965 AND -12.955)"


@query(f"WITH {PLANTS}, z AS (SELECT r, c, CASE WHEN r >= 200 THEN c % 2 END AS layer, {_ZONE} AS box FROM sc WHERE k = 0) SELECT r, count_if(CASE WHEN layer IS NOT NULL THEN layer > 0 ELSE box END)::BIGINT AS inside, count_if(NOT CASE WHEN layer IS NOT NULL THEN layer > 0 ELSE box END)::BIGINT AS outside FROM z GROUP BY r")
def zone_mask(spark, d):
    """Pixels inside a zone by row: by the zone layer where there is one, else by a box in degrees."""
    px = scenes(spark, d).where("k = 0").select("r", "c", F.when(F.col("r") >= 200, F.col("c") % 2).alias("layer"), F.expr(_ZONE).alias("box"))
    inside = F.when(F.col("layer").isNotNull(), F.col("layer") > 0).otherwise(F.col("box"))
    return px.groupBy("r").agg(F.count_if(inside).alias("inside"), F.count_if(~inside).alias("outside"))


_W, _S, _E, _N = _BOX
_UX, _UY = geo.utm("lon", "lat")
#: Boxes in degrees, one a nation, around its customers' places.
_AOI = "c_nationkey AS box, min({lon}) AS w, min({lat}) AS s, max({lon}) AS e, max({lat}) AS n"
_CUSTOMER_LON, _CUSTOMER_LAT = "-(70000000 + c_custkey * 7919 % 900000) / {million}", "-(12000000 + c_custkey * 104729 % 900000) / {million}"
_GRID = "CAST(floor(x0 / 10) * 10 AS BIGINT) AS left_m, CAST(ceil(y1 / 10) * 10 AS BIGINT) AS top_m, CAST(ceil(x1 / 10) - floor(x0 / 10) AS BIGINT) AS width, CAST(ceil(y1 / 10) - floor(y0 / 10) AS BIGINT) AS height"


@query(f"WITH b AS (SELECT {_AOI.format(lon=_CUSTOMER_LON.format(million='1000000::DOUBLE'), lat=_CUSTOMER_LAT.format(million='1000000::DOUBLE'))} FROM customer GROUP BY c_nationkey), e AS (SELECT box, unnest([w + t * (e - w) / 21, w + t * (e - w) / 21, w, e]) AS lon, unnest([s, n, s + t * (n - s) / 21, s + t * (n - s) / 21]) AS lat FROM b, (SELECT i::DOUBLE AS t FROM range(22) r(i))), u AS (SELECT box, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM (SELECT box, {_UX} AS x, {_UY} AS y FROM e) GROUP BY box) SELECT box, {_GRID} FROM u")
def grid_bounds(spark, d):
    """The grids of boxes in degrees: metric bounds over densified edges, snapped outward to whole pixels."""
    lon, lat = (x.format(million="1000000D") for x in (_CUSTOMER_LON, _CUSTOMER_LAT))
    return grids_of(spark.read.parquet(f"{d}/customer.parquet").groupBy("c_nationkey").agg(*[F.expr(x) for x in _split_columns(_AOI.format(lon=lon, lat=lat))[1:]]).withColumnRenamed("c_nationkey", "box"))


def grids_of(boxes):
    """box, left_m, top_m, width and height of boxes (box, w, s, e, n)."""
    t = F.explode(F.sequence(F.lit(0), F.lit(21))).alias("t")
    lon, lat = F.col("w") + F.col("t") * (F.col("e") - F.col("w")) / 21, F.col("s") + F.col("t") * (F.col("n") - F.col("s")) / 21
    at = F.explode(F.array(*[F.struct(a.alias("lon"), b.alias("lat")) for a, b in ((lon, F.col("s")), (lon, F.col("n")), (F.col("w"), lat), (F.col("e"), lat))]))
    edge = geo.with_utm(boxes.select("*", t).select("box", at.alias("p")).select("box", "p.*"), "lon", "lat")
    return edge.groupBy("box").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).selectExpr("box", *_split_columns(_GRID))


#: An overlay of 1000 pixels' width over the box, its height by the cosine of the middle latitude.
_OVER = f"least(greatest(CAST(floor((lon - {_W}) / {_E - _W!r} * 1000) AS INT), 0), 999) AS px, least(greatest(CAST(floor(({_N} - lat) / {_N - _S!r} * 821) AS INT), 0), 820) AS py, round(CAST({_E - _W!r} AS DOUBLE) * 111320 * cos(radians({(_N + _S) / 2!r})) / 1000, 6) AS metres_per_unit, round(greatest(4, sqrt(pid * 10000 / pi()) / (CAST({_E - _W!r} AS DOUBLE) * 111320 * cos(radians({(_N + _S) / 2!r})) / 1000) * 1.5 + 3), 4) AS radius"
_OVER_PARTS = [p if " AS " in p else p for p in _OVER.replace(" AS px, ", " AS px;").replace(" AS py, ", " AS py;").replace(" AS metres_per_unit, ", " AS metres_per_unit;").split(";")]


@query(PLACED + f" SELECT pid, lon, lat, {_OVER} FROM f")
def overlay_points(spark, d):
    """Points on a map overlay: degrees, pixels clipped to the picture, metres per unit and a marker's radius."""
    return placed(spark, d).selectExpr("pid", "lon", "lat", *_OVER_PARTS)


_ALON, _ALAT = geo.lonlat(*geo.centre("row_c", "col_c"))
_TITLE = "concat(CASE type WHEN 'pond' THEN 'Mining pond' WHEN 'bare' THEN 'Bare sand or tailings' ELSE 'Fresh clearing' END, CASE WHEN dist_river <= 300 THEN ' near a river' WHEN dist_road <= 1000 THEN ' near a road' ELSE '' END)"
_WORDS = f"{_TITLE} AS title, CASE WHEN in_buffer = 1 AND in_indigenous = 1 THEN 'Buffer zone, Indigenous land' WHEN in_buffer = 1 THEN 'Buffer zone' WHEN in_indigenous = 1 THEN 'Indigenous land' ELSE 'None' END AS flags"
_PAINT = "CASE confidence WHEN 'high' THEN 'ff3b30e6' ELSE 'ffb020d9' END AS colour"


def _detail(form: str, half_even: str) -> str:
    return f"{form}('%.5f', {_ALAT}) AS lat, {form}('%.5f', {_ALON}) AS lon"


@query(ALERTS.replace("al0 AS (SELECT *,", "al0 AS (SELECT *, round_even(sum_r / px, 0)::BIGINT AS row_c, round_even(sum_c / px, 0)::BIGINT AS col_c,").replace("SELECT row_number() OVER (ORDER BY priority", "SELECT row_c, col_c, row_number() OVER (ORDER BY priority") + f" SELECT id, row_c, col_c, {_detail('printf', 'round_even')}, {_WORDS}, {_PAINT}, CASE WHEN dist_road >= 1000 THEN printf('%d.%d km', (dist_road + 50) // 1000, (dist_road + 50) // 100 % 10) ELSE printf('%d m', dist_road) END AS road_text, (ceil(id / 40) * 40)::BIGINT AS page_end FROM al")
def alert_details(spark, d):
    """Alerts with centroid pixel and place, title, flag words, colour, distance text and the page that shows them."""
    from canopyspark.plans.queries import alerts, patch_stats

    stats = written(patch_stats(spark, d), "patch-stats")
    centre = stats.select("label", F.bround(F.col("sum_r") / F.col("px")).cast("long").alias("row_c"), F.bround(F.col("sum_c") / F.col("px")).cast("long").alias("col_c"))
    a = alerts(stats).join(centre, "label")
    words = [w for w in (_TITLE + " AS title", _WORDS[len(_TITLE) + 11 :])]
    road = F.when(F.col("dist_road") >= 1000, F.format_string("%d.%d km", F.floor((F.col("dist_road") + 50) / 1000), F.floor((F.col("dist_road") + 50) / 100) % 10)).otherwise(F.format_string("%d m", "dist_road"))
    return a.selectExpr("id", "row_c", "col_c", f"format_string('%.5f', {_ALAT}) AS lat", f"format_string('%.5f', {_ALON}) AS lon", *words, _PAINT, "dist_road").select("*", road.alias("road_text"), (F.ceil(F.col("id") / 40) * 40).cast("long").alias("page_end")).drop("dist_road")


@query(None)
def emb_pca_change(spark, d):
    """Distance of two dates' embeddings in the space of the first four principal components."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    e = spark.read.parquet(f"{d}/embeddings.parquet").where("embedding IS NOT NULL").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    found = PCA(k=4, inputCol="v", outputCol="p").fit(e).transform(e).select("vec_id", vector_to_array("p").alias("p"))
    after = found.select((F.col("vec_id") - 250).alias("vec_id"), F.col("p").alias("q"))
    gap = F.aggregate(F.zip_with("p", "q", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return found.join(after, "vec_id").select("vec_id", F.round(F.sqrt(gap), 6).alias("distance"))
