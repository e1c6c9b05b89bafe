"""Map projection and grid arithmetic as SQL expressions: UTM zone 19 south by the Krueger series."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The WGS84 ellipsoid and the zone's parameters.
AXIS, FLATTENING, SCALE, FALSE_EAST, FALSE_NORTH, MERIDIAN = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0, -69.0
_N = FLATTENING / (2 - FLATTENING)
_RADIUS = AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
_E = math.sqrt(FLATTENING * (2 - FLATTENING))

#: The grid: left and top in metres, pixel size.
LEFT, TOP, RES = 391530.0, 8568230.0, 10.0


def _d(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def lonlat(x: str, y: str) -> tuple[str, str]:
    """Expressions of longitude and latitude in degrees of easting x and northing y."""
    xi, eta = f"(({y}) - {_d(FALSE_NORTH)}) / {_d(SCALE * _RADIUS)}", f"(({x}) - {_d(FALSE_EAST)}) / {_d(SCALE * _RADIUS)}"
    xi1 = f"({xi}" + "".join(f" - {_d(b)} * sin({2 * j} * ({xi})) * cosh({2 * j} * ({eta}))" for j, b in enumerate(_BETA, 1)) + ")"
    eta1 = f"({eta}" + "".join(f" - {_d(b)} * cos({2 * j} * ({xi})) * sinh({2 * j} * ({eta}))" for j, b in enumerate(_BETA, 1)) + ")"
    chi = f"asin(sin({xi1}) / cosh({eta1}))"
    lat = f"degrees({chi}" + "".join(f" + {_d(d)} * sin({2 * j} * {chi})" for j, d in enumerate(_DELTA, 1)) + ")"
    return f"({_d(MERIDIAN)} + degrees(atan(sinh({eta1}) / cos({xi1}))))", lat


def with_lonlat(df: DataFrame, x: str, y: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """df with longitude and latitude of the expressions x and y, step by step, so that no part is computed twice."""
    stages = [
        {"_xi": f"(({y}) - {_d(FALSE_NORTH)}) / {_d(SCALE * _RADIUS)}", "_eta": f"(({x}) - {_d(FALSE_EAST)}) / {_d(SCALE * _RADIUS)}"},
        {
            "_xi1": "_xi" + "".join(f" - {_d(b)} * sin({2 * j} * _xi) * cosh({2 * j} * _eta)" for j, b in enumerate(_BETA, 1)),
            "_eta1": "_eta" + "".join(f" - {_d(b)} * cos({2 * j} * _xi) * sinh({2 * j} * _eta)" for j, b in enumerate(_BETA, 1)),
        },
        {"_chi": "asin(sin(_xi1) / cosh(_eta1))", lon: f"{_d(MERIDIAN)} + degrees(atan(sinh(_eta1) / cos(_xi1)))"},
        {lat: "degrees(_chi" + "".join(f" + {_d(d)} * sin({2 * j} * _chi)" for j, d in enumerate(_DELTA, 1)) + ")"},
    ]
    for stage in stages:
        df = df.withColumns({name: F.expr(e) for name, e in stage.items()})
    return df.drop("_xi", "_eta", "_xi1", "_eta1", "_chi")


def with_utm(df: DataFrame, lon: str, lat: str, x: str = "x", y: str = "y") -> DataFrame:
    """df with easting and northing of the expressions lon and lat in degrees, step by step."""
    stages = [
        {"_s": f"sin(radians({lat}))", "_off": f"radians(({lon}) - {_d(MERIDIAN)})"},
        {"_t": f"sinh(atanh(_s) - {_d(_E)} * atanh({_d(_E)} * _s))"},
        {"_xi": "atan(_t / cos(_off))", "_eta": "atanh(sin(_off) / sqrt(1 + _t * _t))"},
        {
            y: f"{_d(FALSE_NORTH)} + {_d(SCALE * _RADIUS)} * (_xi" + "".join(f" + {_d(a)} * sin({2 * j} * _xi) * cosh({2 * j} * _eta)" for j, a in enumerate(_ALPHA, 1)) + ")",
            x: f"{_d(FALSE_EAST)} + {_d(SCALE * _RADIUS)} * (_eta" + "".join(f" + {_d(a)} * cos({2 * j} * _xi) * sinh({2 * j} * _eta)" for j, a in enumerate(_ALPHA, 1)) + ")",
        },
    ]
    for stage in stages:
        df = df.withColumns({name: F.expr(e) for name, e in stage.items()})
    return df.drop("_s", "_off", "_t", "_xi", "_eta")


def utm(lon: str, lat: str) -> tuple[str, str]:
    """Expressions of easting and northing of longitude and latitude in degrees."""
    s, off = f"sin(radians({lat}))", f"radians(({lon}) - {_d(MERIDIAN)})"
    t = f"sinh(atanh({s}) - {_d(_E)} * atanh({_d(_E)} * {s}))"
    xi, eta = f"atan({t} / cos({off}))", f"atanh(sin({off}) / sqrt(1 + {t} * {t}))"
    north = f"({xi}" + "".join(f" + {_d(a)} * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, a in enumerate(_ALPHA, 1)) + ")"
    east = f"({eta}" + "".join(f" + {_d(a)} * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})" for j, a in enumerate(_ALPHA, 1)) + ")"
    return f"({_d(FALSE_EAST)} + {_d(SCALE * _RADIUS)} * {east})", f"({_d(FALSE_NORTH)} + {_d(SCALE * _RADIUS)} * {north})"


def centre(row: str, col: str) -> tuple[str, str]:
    """Easting and northing of a pixel's centre."""
    return f"({_d(LEFT)} + (({col}) + 0.5) * {_d(RES)})", f"({_d(TOP)} - (({row}) + 0.5) * {_d(RES)})"


def pixel(x: str, y: str) -> tuple[str, str]:
    """Row and column that hold a point."""
    return f"CAST(floor(({_d(TOP)} - ({y})) / {_d(RES)}) AS BIGINT)", f"CAST(floor((({x}) - {_d(LEFT)}) / {_d(RES)}) AS BIGINT)"
