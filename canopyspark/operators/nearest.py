"""Nearest places within a reach, by cells that grow until every place has enough neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopyspark.operators.scratch import discard, written

#: Places of a cell at first, on the mean over places; halvings of the reach at most.
FULL, HALVINGS = 8, 20


def _cells(df: DataFrame, size: float) -> DataFrame:
    return df.withColumns({f"c{a}": F.floor(F.col(a) / F.lit(float(size))) for a in "xy"})


def _first_size(places: DataFrame, reach: float) -> float:
    """The reach, halved until a place shares its cell with FULL others at most, on the mean."""
    size = float(reach)
    for _ in range(HALVINGS):
        n = _cells(places, size).groupBy("cx", "cy").agg(F.count("*").cast("double").alias("n")).agg(F.sum(F.col("n") * F.col("n")).alias("s"), F.sum("n").alias("n")).first()
        if not n["n"] or n["s"] <= FULL * n["n"]:
            break
        size /= 2
    return size


def nearest(points: DataFrame, k: int, reach: float) -> DataFrame:
    """id, other, d2, place: the k nearest other points (id, x, y) of every point within reach, ties to the smaller id.

    Points at one place are one question, and k + 1 of them are enough of an answer. A place asks its own cell and the eight
    around it; it is done when k + 1 answers lie within the cell's size, for then none beyond those cells is nearer. The
    others ask again in cells of twice the size, so the work grows with the points, not with their pairs. The rounds run when this is called.
    """
    known = points.where("id IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL").select("id", "x", "y")
    at_place = F.row_number().over(Window.partitionBy("x", "y").orderBy("id"))
    answers = written(known.withColumn("n", at_place).where(F.col("n") <= k + 1).select(F.col("id").alias("other"), F.col("x").alias("x2"), F.col("y").alias("y2"), "n"), "answers")
    asked = written(answers.where("n = 1").select(F.col("x2").alias("x"), F.col("y2").alias("y")), "asked")
    size = _first_size(asked, reach)
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    dx, dy = F.col("x") - F.col("x2"), F.col("y") - F.col("y2")
    best = Window.partitionBy("x", "y").orderBy("d2", "other")
    parts = []
    while True:
        left = _cells(asked, size).select("x", "y", "cx", "cy", around.alias("o")).select("x", "y", (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"))
        right = answers.select("other", "x2", "y2", *[F.floor(F.col(f"{a}2") / F.lit(float(size))).alias(f"c{a}") for a in "xy"])
        met = left.join(right.hint("merge"), ["cx", "cy"]).select("x", "y", "other", (dx * dx + dy * dy).alias("d2")).where(F.col("d2") <= size * size)
        met = written(met.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1), "met")
        if size >= reach:
            parts.append(met)
            break
        done = met.where(F.col("n") == k + 1).select("x", "y")
        parts.append(met.join(done.hint("merge"), ["x", "y"], "left_semi"))
        old, asked = asked, written(asked.join(done.hint("merge"), ["x", "y"], "left_anti"), "asked")
        discard(old)
        if asked.isEmpty():
            break
        size = min(2 * size, float(reach))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    each = known.join(found.select("x", "y", "other", "d2").hint("merge"), ["x", "y"]).where(F.col("id") != F.col("other"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("d2", "other"))
    return each.select("id", "other", "d2", place.alias("place")).where(F.col("place") <= k)
