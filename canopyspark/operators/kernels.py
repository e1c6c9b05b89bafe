"""Neighbourhood operators on sparse cells and dense pixel tables, keyed by (r, c)."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopyspark.config import CONFIG
from canopyspark.operators import tiles


def shifts(reach: int):
    """All (dr, dc) of a square window, to explode."""
    span = range(-reach, reach + 1)
    return F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a in span for b in span]))


def spread(cells: DataFrame, reach: int, *carry: str) -> DataFrame:
    """Every cell at all places of its window, with the columns named in carry."""
    moved = cells.select("r", "c", *carry, shifts(reach).alias("o"))
    return moved.select((F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c"), *carry)


def closing(cells: DataFrame, reach: int, height: int) -> DataFrame:
    """Dilation, then erosion, of a set of cells; outside the grid there are none."""
    inside = F.col("r").between(0, height - 1) & F.col("c").between(0, CONFIG.side - 1)
    wide = spread(cells.select("r", "c"), reach).where(inside).distinct()
    return spread(wide, reach).where(inside).groupBy("r", "c").agg(F.count("*").alias("n")).where(F.col("n") == (2 * reach + 1) ** 2).select("r", "c")


def box_sums(px: DataFrame, reach: int, height: int, *columns: str) -> DataFrame:
    """Sums of columns over square windows with mirrored edges, tile by tile."""
    return tiles.box_sums(px, reach, height, CONFIG.side, *columns)


def _envelope(height: np.ndarray) -> np.ndarray:
    """min over j of (i - j)^2 + height[j] for every i, by the lower envelope of parabolas."""
    n = len(height)
    known = np.flatnonzero(np.isfinite(height)).tolist()
    out = np.full(n, np.inf)
    if not known:
        return out
    apex, start = [known[0]], [-np.inf]
    for j in known[1:]:
        while True:
            k = apex[-1]
            cross = (height[j] + j * j - height[k] - k * k) / (2.0 * (j - k))
            if cross > start[-1]:
                break
            apex.pop()
            start.pop()
        apex.append(j)
        start.append(cross)
    which = np.array(apex)[np.searchsorted(np.array(start), np.arange(n), side="right") - 1]
    return (np.arange(n) - which) ** 2 + height[which]


ROWS_A_GROUP = 16


def squared_distance(px: DataFrame, seed: str, *carry: str) -> DataFrame:
    """r, c, d2: exact squared distance in pixels to the nearest pixel where seed is true; NULL without seeds; and the columns named in carry.

    Columns first, in parts with carried seeds; then each row by its lower envelope, a few rows a group. Linear in
    the number of pixels; a group is as long as the raster is wide.
    """
    columns = tiles.column_distance(px, seed, *carry)

    def rows(group: pa.Table) -> pa.Table:
        r, c = group["r"].to_numpy(), group["c"].to_numpy()
        g = group["g"].cast(pa.float64()).to_numpy(zero_copy_only=False)  # NULL is NaN
        low = r.min()
        height = np.full((r.max() - low + 1, c.max() + 1), np.inf)
        height[r - low, c] = np.where(np.isnan(g), np.inf, g * g)
        d2 = np.stack([_envelope(line) for line in height])[r - low, c]
        near = np.where(np.isfinite(d2), d2, 0).astype(np.int64)
        return pa.table({"r": r, "c": c, "d2": pa.array(near, mask=~np.isfinite(d2)), **{name: group[name] for name in carry}})

    return columns.groupBy(F.floor(F.col("r") / ROWS_A_GROUP)).applyInArrow(rows, ", ".join(["r long, c long, d2 long", *(f"{name} {px.schema[name].dataType.simpleString()}" for name in carry)]))


#: Rows of a band: a group of distance_rows and texture_rows.
BAND = 64


def _lists(grid: np.ndarray, known: np.ndarray | None = None) -> pa.Array:
    """The rows of a grid as lists; NULL where not known."""
    flat = pa.array(grid.ravel(), mask=None if known is None else ~known.ravel())
    return pa.ListArray.from_arrays(np.arange(0, grid.size + 1, grid.shape[1], dtype=np.int32), flat)


def _row_distance(g2: np.ndarray) -> np.ndarray:
    """min over j of (i - j)^2 + g2[:, j] for every i, all rows at once, by growing steps until none can be nearer."""
    out = g2.copy()
    for step in range(1, g2.shape[1]):
        if step * step >= out.max():
            break
        out[:, step:] = np.minimum(out[:, step:], g2[:, :-step] + step * step)
        out[:, :-step] = np.minimum(out[:, :-step], g2[:, step:] + step * step)
    return out


def distance_rows(seeds: DataFrame, height: int, width: int, carry: str) -> DataFrame:
    """(r, d2, carry) for every row of the raster, arrays by column: the exact squared distance to the nearest seed (r, c, carry: a long), NULL without seeds, and the seeds' own values of carry.

    Seeds alone are shuffled, to bands of BAND rows; a band knows the last seed above and the first one below it in every column,
    carried over a table of one row for each column of a band. So the work is linear in the height and no pixel is shuffled.
    """
    spark, bands = seeds.sparkSession, -(-height // BAND)
    marked = seeds.select(F.floor(F.col("r") / BAND).alias("band"), "r", "c", carry)
    ends = marked.groupBy("c", "band").agg(F.min("r").alias("low"), F.max("r").alias("high"))
    places = spark.range(bands * width).select((F.col("id") % width).alias("c"), F.floor(F.col("id") / width).alias("band"))
    before = Window.partitionBy("c").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("c").orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    around = places.join(ends.hint("merge"), ["c", "band"], "left").select("c", "band", F.last("high", ignorenulls=True).over(before).alias("above"), F.last("low", ignorenulls=True).over(after).alias("below"))
    far = 1 << 40  # its square and those of any distances can be added

    def one(cells: pa.Table, ends: pa.Table) -> pa.Table:
        low = ends["band"][0].as_py() * BAND
        n = min(BAND, height - low)
        at, values = np.full((n, width), -1, np.int64), np.zeros((n, width), np.int64)
        r, c = cells["r"].to_numpy() - low, cells["c"].to_numpy()
        at[r, c], values[r, c] = r, cells[carry].to_numpy()
        seeded = at >= 0
        above, below = (np.full(width, fill, np.int64) for fill in (-far, far))
        for side, name in ((above, "above"), (below, "below")):
            known = ends[name].is_valid().to_numpy(zero_copy_only=False)
            side[ends["c"].to_numpy()[known]] = ends[name].drop_null().to_numpy() - low
        up = np.maximum.accumulate(np.maximum(np.where(seeded, at, -far), above), axis=0)
        down = np.minimum.accumulate(np.minimum(np.where(seeded, at, far), below)[::-1], axis=0)[::-1]
        rows = np.arange(n)[:, None]
        g = np.minimum(np.minimum(rows - up, down - rows), 1 << 30)
        d2 = _row_distance(g * g)
        return pa.table({"r": np.arange(low, low + n), "d2": _lists(d2, d2 < 1 << 60), carry: _lists(values, seeded)})

    return marked.groupBy("band").cogroup(around.groupBy("band")).applyInArrow(one, f"r long, d2 array<bigint>, {carry} array<bigint>")


def _hundredths(x: np.ndarray) -> np.ndarray:
    """x rounded to hundredths, halves of its decimal form up, as Spark rounds."""
    out = np.floor(x * 100 + 0.5)
    for at in zip(*np.nonzero(np.abs(x * 100 - np.floor(x * 100) - 0.5) < 1e-4), strict=True):  # too near for doubles
        out[at] = float(Decimal(repr(float(x[at]))).quantize(Decimal("0.01"), ROUND_HALF_UP) * 100)
    return out.astype(np.int32)


def texture_rows(banded: DataFrame, reach: int, height: int, width: int, fill: float) -> DataFrame:
    """(r, texture) for every row of the raster, an array by column, in hundredths: the standard deviation in square windows with mirrored edges, of a scene (band, r, c, v) that has the rows within reach of every band of BAND rows; fill is for holes."""
    size = (2 * reach + 1) ** 2

    def sums(grid: np.ndarray, axis: int) -> np.ndarray:
        n = grid.shape[axis] - 2 * reach
        total = np.take(grid, range(n), axis)
        for k in range(1, 2 * reach + 1):  # from the first to the last, as a window adds them
            total = total + np.take(grid, range(k, k + n), axis)
        return total

    def one(cells: pa.Table) -> pa.Table:
        low = cells["band"][0].as_py() * BAND
        n, first, last = min(BAND, height - low), max(low - reach, 0), min(low + BAND + reach, height)
        v = np.full((last - first, width), np.nan)
        v[cells["r"].to_numpy() - first, cells["c"].to_numpy()] = cells["v"].cast(pa.float64()).to_numpy(zero_copy_only=False)
        v[np.isnan(v)] = fill
        v = np.pad(v, ((reach - (low - first), reach - (last - low - n)), (reach, reach)), "symmetric")
        mean, square = (sums(sums(x, 1), 0) / size for x in (v, v * v))
        return pa.table({"r": np.arange(low, low + n), "texture": _lists(_hundredths(np.sqrt(np.maximum(square - mean * mean, 0))))})

    return banded.select("band", "r", "c", "v").groupBy("band").applyInArrow(one, "r long, texture array<int>")


def bilinear(px: DataFrame, wanted: DataFrame, value: str) -> DataFrame:
    """wanted (i, j, sr, sc: source place in pixels) to the weighted mean of four neighbours; NULL if one is missing."""
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a in (0, 1) for b in (0, 1)]))
    rows = wanted.select("i", "j", "sr", "sc", F.floor("sr").alias("r0"), F.floor("sc").alias("c0"), corner.alias("o"))
    fr, fc = F.col("sr") - F.col("r0"), F.col("sc") - F.col("c0")
    weight = F.when(F.col("o.dr") == 1, fr).otherwise(1 - fr) * F.when(F.col("o.dc") == 1, fc).otherwise(1 - fc)
    rows = rows.select("i", "j", (F.col("r0") + F.col("o.dr")).alias("r"), (F.col("c0") + F.col("o.dc")).alias("c"), weight.alias("w"))
    met = rows.join(px.select("r", "c", F.col(value).alias("v")), ["r", "c"], "left")
    return met.groupBy("i", "j").agg(F.when(F.count_if((F.col("w") > 0) & F.col("v").isNull()) == 0, F.sum(F.when(F.col("w") > 0, F.col("w") * F.col("v")))).alias(value))
