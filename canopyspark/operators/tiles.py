"""Tiles: bounded groups of a dense pixel table for windows and resampling, whatever the raster's size.

A tile holds TILE x TILE pixels, and copies of those around it that its own pixels' windows reach (a halo). Each tile
is worked on by itself, after one shuffle of the pixels.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TILE = 64


def _with_halo(px: DataFrame, at: str, tile: str, side: int, reach: int, size: int) -> DataFrame:
    """px with a row for every tile along one axis that needs it; rows beyond the raster's edges are mirrored ones."""
    last = (side - 1) // size
    p = F.col(at)
    inner = (p % size >= reach) & (p % size < size - reach) & (p >= reach) & (p < side - reach)
    places = F.filter(F.array(p, F.when(p < reach, -1 - p), F.when(p >= side - reach, 2 * side - 1 - p)), lambda v: v.isNotNull())

    def tiles(v: Column) -> Column:
        first, end = F.greatest(F.lit(0), F.floor((v - reach) / size)), F.least(F.lit(last), F.floor((v + reach) / size))
        return F.transform(F.sequence(first, end), lambda t: F.struct(t.cast("long").alias("tile"), v.cast("long").alias("at")))

    own = F.array(F.struct(F.floor(p / size).alias("tile"), p.cast("long").alias("at")))
    spread = F.explode(F.when(inner, own).otherwise(F.flatten(F.transform(places, tiles))))
    rest = [c for c in px.columns if c != at]
    return px.select(*rest, spread.alias("s")).select(*rest, F.col("s.tile").alias(tile), F.col("s.at").alias(at))


def box_sums(px: DataFrame, reach: int, height: int, width: int, *columns: str, tile: int = TILE) -> DataFrame:
    """r, c and the sums of columns over square windows with mirrored edges (reach < height, width), of a dense pixel table.

    Both one-dimensional passes run inside tiles, on one shuffle: a window's group is a line of a tile.
    """
    wide = _with_halo(_with_halo(px.select("r", "c", *columns), "r", "tr", height, reach, tile), "c", "tc", width, reach, tile)
    dealt = wide.repartition("tr", "tc")
    for by, at, index, side in (("r", "c", "tc", width), ("c", "r", "tr", height)):
        line = Window.partitionBy("tr", "tc", by).orderBy(at).rowsBetween(-reach, reach)
        dealt = dealt.select("tr", "tc", "r", "c", *[F.sum(c).over(line).alias(c) for c in columns])
        own = F.col(index) * tile
        dealt = dealt.where((F.col(at) >= own) & (F.col(at) < F.least(own + tile, F.lit(side))))
    return dealt.select("r", "c", *columns)


def column_distance(px: DataFrame, seed: str, *carry: str, tile: int = TILE) -> DataFrame:
    """r, c, g: rows to the nearest pixel of the same column where seed is true; NULL in columns without one; and the columns named in carry.

    A tile's part of a column knows the first and the last seed of its own; those of the parts above and below are carried
    over a table of one row for each part, so a window's group is a part, and the work is linear in the height.
    """
    rows = px.select("r", "c", *carry, F.when(F.col(seed), F.col("r")).alias("at"), F.floor(F.col("r") / tile).alias("part"))
    parts = rows.groupBy("c", "part").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    before = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("c").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select("c", "part", F.last("high", ignorenulls=True).over(before).alias("above"), F.last("low", ignorenulls=True).over(after).alias("below"))
    own = Window.partitionBy("c", "part")
    up = own.orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    down = own.orderBy(F.desc("r")).rowsBetween(Window.unboundedPreceding, 0)
    met = rows.join(carried.hint("merge"), ["c", "part"])
    high, low = F.coalesce(F.last("at", ignorenulls=True).over(up), "above"), F.coalesce(F.last("at", ignorenulls=True).over(down), "below")
    return met.select("r", "c", *carry, F.least(F.col("r") - high, low - F.col("r")).alias("g"))


def _at(px: DataFrame, value: str, tile: int) -> DataFrame:
    """Pixels with every tile that reads them: their own, and those that end just above or left of them."""
    beside = lambda at: F.explode(F.when(F.col(at) % tile == 0, F.array(F.floor(F.col(at) / tile), F.floor(F.col(at) / tile) - 1)).otherwise(F.array(F.floor(F.col(at) / tile))))
    rows = px.select("r", "c", F.col(value).cast("double").alias("v"), beside("r").alias("tr"))
    return rows.select("r", "c", "v", "tr", beside("c").alias("tc"))


def nearest(block: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Values of a block at the nearest pixel centres; y and x count from the first centre."""
    return block[np.floor(y + 0.5).astype(int), np.floor(x + 0.5).astype(int)]


def bilinear(block: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The weighted mean of four pixels; NaN if one that counts is missing."""
    r, c = np.floor(y).astype(int), np.floor(x).astype(int)
    out = np.zeros(len(y))
    for dr in (0, 1):
        for dc in (0, 1):
            weight = np.abs(1 - dr - (y - r)) * np.abs(1 - dc - (x - c))
            used = weight > 0
            out[used] += weight[used] * block[np.minimum(r + dr, len(block) - 1), np.minimum(c + dc, block.shape[1] - 1)][used]
    return out


METHODS: dict[str, Callable] = {"nearest": nearest, "bilinear": bilinear}


def resample(px: DataFrame, wanted: DataFrame, value: str, method: str = "bilinear", tile: int = TILE) -> DataFrame:
    """i, j and value of every row of wanted (i, j, sr, sc: its place in px, in pixels from the first centre).

    Places meet the source tile of their upper left neighbour, and only there; a tile holds the pixels that follow it as well. NULL where
    a pixel that counts has no row or no value, and where sr or sc is NULL.
    """
    kernel, size = METHODS[method], tile + 1
    shift = 0.5 if method == "nearest" else 0.0
    known = F.coalesce(~F.isnan(F.col("sr") + F.col("sc")), F.lit(False))
    # rows without a place go to groups of their own, far from the source's
    place = lambda s, i: F.when(known, F.floor(F.floor(F.col(s) + shift) / tile)).otherwise(F.floor(F.col(i) / tile) - (1 << 40))
    asked = wanted.select("i", "j", "sr", "sc", place("sr", "i").alias("tr"), place("sc", "j").alias("tc"))

    def one(key: tuple, places: pa.Table, source: pa.Table) -> pa.Table:
        found = np.full(len(places), np.nan)
        if len(source) and len(places):
            tr, tc = (k.as_py() for k in key)
            block = np.full((size, size), np.nan)
            block[source["r"].to_numpy() - tr * tile, source["c"].to_numpy() - tc * tile] = source["v"].to_numpy(zero_copy_only=False)
            found = kernel(block, places["sr"].to_numpy() - tr * tile, places["sc"].to_numpy() - tc * tile)
        return pa.table({"i": places["i"], "j": places["j"], value: pa.array(found, pa.float64(), mask=np.isnan(found))})

    return asked.groupBy("tr", "tc").cogroup(_at(px, value, tile).groupBy("tr", "tc")).applyInArrow(one, f"i long, j long, {value} double")


def overlaps(at: str, side: int, out: int) -> Column:
    """The cells of an axis of out cells that a pixel of an axis of side pixels overlaps, with the overlap in units of 1 / (side * out)."""
    p = F.col(at)
    first, last = F.floor(p * out / side), F.floor(((p + 1) * out - 1) / side)
    share = lambda k: F.least((p + 1) * out, (k + 1) * side) - F.greatest(p * out, k * side)
    return F.explode(F.transform(F.sequence(first, last), lambda k: F.struct(k.alias("k"), share(k).cast("long").alias("w"))))


def area_downsample(px: DataFrame, value: str, height: int, width: int, rows: int, cols: int) -> DataFrame:
    """i, j, mean (weighted by the overlapping area), high and weight (1 for a cell that is covered whole) of rows x cols cells of any ratio; pixels without a value do not count."""
    cut = px.where(F.col(value).isNotNull()).select("r", "c", F.col(value).alias("v"))
    cut = cut.select("c", "v", overlaps("r", height, rows).alias("a")).select("v", F.col("a.k").alias("i"), F.col("a.w").alias("wr"), overlaps("c", width, cols).alias("b"))
    cut = cut.select("i", F.col("b.k").alias("j"), "v", (F.col("wr") * F.col("b.w")).alias("w"))
    sums = cut.groupBy("i", "j").agg(F.sum(F.col("w") * F.col("v")).alias("s"), F.sum("w").alias("n"), F.max("v").alias("high"))
    return sums.select("i", "j", (F.col("s") / F.col("n")).alias("mean"), "high", (F.col("n") / (height * width)).alias("weight"))
