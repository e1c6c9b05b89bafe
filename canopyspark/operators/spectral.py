"""Shift between two layers by cross-correlation, the Fourier transform in two distributed one-dimensional passes.

The peak of the correlation of whole pixels comes first; around it, the correlation is then evaluated on a grid
FINE times finer by a matrix product with the spectrum (Guizar-Sicairos, Thurman and Fienup, 2008), which every block of the
spectrum does for itself; the small grids are summed. High frequencies count less in it: edges sharper than a pixel fold back
into them and draw the peak away by a step, whatever the size of the layers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyspark.operators.scratch import discard, written

FINE = 20
#: Values of one block of rows or of columns.
BLOCK = 1 << 18


def filled(layer: DataFrame, value: str) -> DataFrame:
    """r, c and value with gaps filled by the layer's median (to 1e-6 of the ranks), so that they carry no structure; all NULL if there is no value."""
    middle = layer.agg(F.percentile_approx(value, 0.5, 1_000_000).alias("m")).first()["m"]
    return layer.select("r", "c", F.coalesce(F.col(value).cast("double"), F.lit(middle).cast("double")).alias(value))


def _packed(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, np.complex128).tobytes()


def _stacked(table: pa.Table, order: str, wide: bool) -> list[np.ndarray]:
    """The parts of a block side by side, for each of its layers."""
    rows = sorted(table.to_pylist(), key=lambda x: x[order])
    join = np.concatenate
    return [join([np.frombuffer(x[k], np.complex128).reshape(x["rows"], x["cols"]) for x in rows], axis=int(wide)) for k in ("a", "b") if rows[0][k] is not None]


_PART = "rb long, cb long, rows long, cols long, a binary, b binary"


def _parts(rb: list[int], cb: list[int], a: list[np.ndarray], b: list[np.ndarray | None]) -> pa.Table:
    return pa.table({
        "rb": pa.array(rb, pa.int64()), "cb": pa.array(cb, pa.int64()), "rows": pa.array([x.shape[0] for x in a], pa.int64()), "cols": pa.array([x.shape[1] for x in a], pa.int64()),
        "a": pa.array([_packed(x) for x in a], pa.binary()), "b": pa.array([None if x is None else _packed(x) for x in b], pa.binary()),
    })


def spectrum(pair: DataFrame, height: int, width: int, block: int = BLOCK) -> DataFrame:
    """Blocks of columns (cb, rows, cols, a) of the cross spectrum of the layers a and b of pair (r, c, a, b; dense)."""
    high, wide = max(1, block // width), max(1, block // height)
    edges = list(range(wide, width, wide))

    def along_rows(key: tuple, cells: pa.Table) -> pa.Table:
        rb = key[0].as_py()
        rows = min(high, height - rb * high)
        layers = []
        for name in ("a", "b"):
            x = np.zeros((rows, width))
            x[cells["r"].to_numpy() - rb * high, cells["c"].to_numpy()] = cells[name].to_numpy()
            layers.append(np.split(np.fft.fft(x, axis=1), edges, axis=1))
        n = len(layers[0])
        return _parts([rb] * n, list(range(n)), *layers)

    def along_columns(key: tuple, parts: pa.Table) -> pa.Table:
        a, b = (np.fft.fft(x, axis=0) for x in _stacked(parts, "rb", False))
        return _parts([0], [key[0].as_py()], [a * b.conj()], [None])

    rows = pair.groupBy(F.floor(F.col("r") / high).alias("rb")).applyInArrow(along_rows, _PART)
    return rows.groupBy("cb").applyInArrow(along_columns, _PART)


def _whole_peak(product: DataFrame, height: int, width: int, block: int) -> tuple[int, int]:
    """Row and column of the largest correlation at whole pixels; the first in order of rows among equal ones."""
    high = max(1, block // width)
    edges = list(range(high, height, high))

    def back_columns(key: tuple, parts: pa.Table) -> pa.Table:
        (x,) = _stacked(parts, "rb", False)
        split = np.split(np.fft.ifft(x, axis=0), edges, axis=0)
        return _parts(list(range(len(split))), [key[0].as_py()] * len(split), split, [None] * len(split))

    def back_rows(key: tuple, parts: pa.Table) -> pa.Table:
        (x,) = _stacked(parts, "cb", True)
        size = np.abs(np.fft.ifft(x, axis=1))
        r, c = np.unravel_index(np.argmax(size), size.shape)
        return pa.table({"size": [float(size[r, c])], "r": [int(r) + key[0].as_py() * high], "c": [int(c)]})

    peaks = product.groupBy("cb").applyInArrow(back_columns, _PART).groupBy("rb").applyInArrow(back_rows, "size double, r long, c long")
    best = peaks.agg(F.max(F.struct("size", (-F.col("r")).alias("r"), (-F.col("c")).alias("c"))).alias("p")).first()["p"]
    return -best["r"], -best["c"]


def shift_estimate(pair: DataFrame, height: int, width: int, fine: int = FINE, block: int = BLOCK) -> tuple[float, float]:
    """Rows and columns by which layer b of pair (r, c, a, b; dense, without gaps) must move to lie on layer a, to 1 / fine of a pixel."""
    product = written(spectrum(pair, height, width, block), "spectrum")
    whole = np.array(_whole_peak(product, height, width, block), float)
    size = np.array((height, width))
    whole[whole > np.fix(size / 2)] -= size[whole > np.fix(size / 2)]
    around = int(np.ceil(1.5 * fine))
    places = [w + (np.arange(around) - np.fix(around / 2)) / fine for w in whole]
    wide = max(1, block // height)

    def waves(at: np.ndarray, n: int) -> np.ndarray:
        """exp(2 pi i f x) for places x and the frequencies f of n samples, tapered to 0 at the highest."""
        return np.exp(2j * np.pi * np.outer(at, np.fft.fftfreq(n))) * np.cos(np.pi * np.fft.fftfreq(n)) ** 2

    def near_peak(batches):
        for batch in batches:
            total = np.zeros((around, around), complex)
            for x in batch.to_pylist():
                part = np.frombuffer(x["a"], np.complex128).reshape(x["rows"], x["cols"])
                columns = waves(places[1], width)[:, x["cb"] * wide : x["cb"] * wide + x["cols"]]
                total += waves(places[0], height) @ part @ columns.T
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_pydict({"i": i.ravel(), "j": j.ravel(), "re": total.real.ravel(), "im": total.imag.ravel()})

    sums = product.mapInArrow(near_peak, "i long, j long, re double, im double").groupBy("i", "j").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    size2 = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    best = sums.agg(F.max(F.struct(size2.alias("s"), (-F.col("i")).alias("i"), (-F.col("j")).alias("j"))).alias("p")).first()["p"]
    discard(product)
    return tuple(round(float(p[-k]), 9) if n > 1 else 0.0 for p, k, n in zip(places, (best["i"], best["j"]), size, strict=True))
