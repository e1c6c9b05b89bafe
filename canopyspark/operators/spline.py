"""Thin-plate splines through control points, and layers put on a grid with them.

The weights solve one dense system of MAX_CONTROL + 3 unknowns at most, which a product's few hundred control points never reach; more are an
error, not a sample. Evaluating the spline is one task's matrix product for every block of output pixels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyspark.operators import tiles

MAX_CONTROL = 2000
#: Output pixels whose kernel is held at a time.
CHUNK = 4096


class Spline:
    """u, v as smooth functions of x, y that go through all control points (rows of x, y, u, v)."""

    def __init__(self, control: np.ndarray):
        control = np.unique(np.asarray(control, float).reshape(-1, 4), axis=0)
        if len(control) < 3:
            raise ValueError("a thin-plate spline needs three control points or more")
        self.centre, self.scale = control[:, :2].mean(axis=0), max(1e-300, float(np.ptp(control[:, :2], axis=0).max()))
        self.at = (control[:, :2] - self.centre) / self.scale
        n = len(control)
        system = np.zeros((n + 3, n + 3))
        system[:n, :n] = self._kernel(self.at)
        system[:n, n], system[:n, n + 1 :] = 1, self.at
        system[n:, :n] = system[:n, n:].T
        try:
            self.weights = np.linalg.solve(system, np.vstack([control[:, 2:], np.zeros((3, 2))]))
        except np.linalg.LinAlgError as error:
            raise ValueError("the control points lie on one line, or one place has two values") from error

    def _kernel(self, at: np.ndarray) -> np.ndarray:
        d2 = ((at[:, None, :] - self.at[None, :, :]) ** 2).sum(axis=2)
        return d2 * np.log(np.where(d2 > 0, d2, 1))

    def __call__(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = (np.stack([x, y], axis=1) - self.centre) / self.scale
        out = np.empty((len(at), 2))
        for k in range(0, len(at), CHUNK):
            part = at[k : k + CHUNK]
            out[k : k + CHUNK] = np.hstack([self._kernel(part), np.ones((len(part), 1)), part]) @ self.weights
        return out[:, 0], out[:, 1]


def fitted(control: DataFrame) -> Spline:
    """The spline through control (x, y, u, v); rows with a NULL do not count."""
    rows = control.select(*[F.col(c).cast("double") for c in ("x", "y", "u", "v")]).na.drop().distinct().limit(MAX_CONTROL + 1).collect()
    if len(rows) > MAX_CONTROL:
        raise ValueError(f"more than {MAX_CONTROL} control points")
    return Spline(np.array([tuple(r) for r in rows], float))


def evaluated(spline: Spline, points: DataFrame, u: str, v: str) -> DataFrame:
    """points (x, y and more) with the spline's u and v."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = spline(*(batch[c].to_numpy(zero_copy_only=False) for c in "xy"))
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, found)], [*batch.schema.names, u, v])

    return points.mapInArrow(each, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in points.schema), f"{u} double, {v} double"]))


def geocoded(px: DataFrame, value: str, control: DataFrame, grid: DataFrame, method: str = "bilinear") -> DataFrame:
    """i, j and value of every cell of grid (i, j, x, y: its centre), from px (r, c, value) by control points (row, col, x, y).

    Control points count rows and columns from the first pixel's corner, so the first centre is at 0.5. The spline maps the map's places back to the image, so that
    every cell has one source place; NULL beyond the image or next to a gap.
    """
    back = fitted(control.select("x", "y", F.col("row").alias("u"), F.col("col").alias("v")))
    places = evaluated(back, grid.select("i", "j", "x", "y"), "row", "col")
    return tiles.resample(px, places.select("i", "j", (F.col("row") - 0.5).alias("sr"), (F.col("col") - 0.5).alias("sc")), value, method)
