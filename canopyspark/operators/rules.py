"""Change rules on a pixel table; nodata is NULL and no comparison with it is ever true."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopyspark.config import CONFIG
from canopyspark.operators.components import connected_components
from canopyspark.operators.scratch import written


def true(pred: Column) -> Column:
    return F.coalesce(pred, F.lit(False))


def water(after: Column) -> Column:
    return true(after < CONFIG.water_max)


def changed(before: Column, after: Column) -> Column:
    return true(before - after >= CONFIG.drop_min) | water(after)


def detect(before: Column, after: Column, confirm: Column | None = None) -> Column:
    """0 none, 1 cleared, 2 water; confirm is the next scene, where there is one."""
    hit, wet = changed(before, after), water(after)
    if confirm is not None:
        hit, wet = hit & changed(before, confirm), wet & water(confirm)
    return F.when(true(before > CONFIG.forest_min) & hit, F.when(wet, 2).otherwise(1)).otherwise(0)


def pixels(scenes: DataFrame) -> DataFrame:
    """One row per pixel: first, last, min_later, change_idx (first scene that fired, else NULL).

    A single shuffle by pixel, with map-side combine: one aggregate a scene, then every rule is an
    expression over the array of them. A missing scene is NULL.
    """
    values = [F.max(F.when(F.col("k") == i, F.col("mdb"))) for i in range(len(CONFIG.dates))]
    return of_stack(scenes.groupBy("r", "c").agg(F.array(*values).alias("s")))


def of_stack(stack: DataFrame) -> DataFrame:
    """The pixel table of a stack that has its scenes side by side (r, c, s), and what other columns it has."""
    n = len(CONFIG.dates)
    first = F.get("s", F.lit(0))
    fired = [F.when(detect(first, F.get("s", F.lit(i)), F.get("s", F.lit(i + 1)) if i + 1 < n else None) > 0, i) for i in range(1, n)]
    return stack.select("r", "c", first.alias("first"), F.get("s", F.lit(n - 1)).alias("last"), F.array_min(F.slice("s", 2, n - 1)).alias("min_later"), F.coalesce(*fired).cast("long").alias("change_idx"), *stack.columns[3:])


def model_gate(model: Column, first: Column, last: Column) -> Column:
    return model & (true(first - last >= CONFIG.model_drop_min) | water(last))


def confidence(px: DataFrame) -> DataFrame:
    """px plus conf: rule and gated model each add one. The model is a fixed proxy: a later drop of 2.5 dB."""
    model = true(F.col("first") - F.col("min_later") >= 2500)
    gate = model_gate(model, F.col("first"), F.col("last"))
    return px.withColumn("conf", F.col("change_idx").isNotNull().cast("int") + gate.cast("int"))


def opening3(cells: DataFrame) -> DataFrame:
    """3x3 opening of a set of (r, c): erosion by counting all nine neighbours, then dilation."""
    shift = F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))

    def spread(d: DataFrame) -> DataFrame:
        return d.select("r", "c", shift.alias("o")).select((F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c"))

    core = spread(cells.select("r", "c")).groupBy("r", "c").agg(F.count("*").alias("n")).where("n = 9").select("r", "c")
    return spread(core).distinct()


def patches(cells: DataFrame, diagonal: bool = True) -> DataFrame:
    """(r, c, label) of 8-neighbour patches (4-neighbour without diagonal); label is the smallest r * side + c.

    Far more rows than the table of runs that they are made from, whose size is all the planner sees: joins with it carry a hint.

    Rows are cut into runs first (gaps and islands), so the graph has a node per run, and adjacent
    rows' runs meet in an equi-join on the row number.
    """
    by_row = Window.partitionBy("r").orderBy("c")
    runs = cells.withColumn("g", F.col("c") - F.row_number().over(by_row)).groupBy("r", "g").agg(F.min("c").alias("a"), F.max("c").alias("b"))
    # the runs are read four times; written once, so that the raster is not made again for each
    runs = written(runs.withColumn("id", F.col("r") * CONFIG.side + F.col("a")), "runs")
    below = runs.select((F.col("r") - 1).alias("r"), F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("id").alias("id2"))
    edges = runs.join(below.hint("merge"), "r").where((F.col("a") <= F.col("b2") + int(diagonal)) & (F.col("a2") <= F.col("b") + int(diagonal))).select(F.col("id").alias("a"), F.col("id2").alias("b"))
    found = connected_components(edges).select(F.col("node").alias("id"), F.col("component").alias("label"))
    named = runs.join(found.hint("merge"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    return named.select("r", F.explode(F.sequence("a", "b")).alias("c"), "label")
