import math
import random
from pathlib import Path

import duckdb
import numpy as np
import pytest

import __spark_entry__
from canopyspark.functions import geo
from canopyspark.operators import burn, kernels, spectral, spline, tiles
from canopyspark.plans import geometry

DATA = Path("/root/testdata/sf0.001")
SQL = sorted(geometry.ORACLES)
#: Registration needs ground enough: with the few plants of the smallest raster it is a few steps off what was planted.
LARGER = {"scene_shift", "aligned_scene"}


def plain(rows):
    return sorted(tuple(str(round(float(v), 3)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", SQL)
def test_against_sql(spark, name):
    data = DATA.with_name("sf0.01") if name in LARGER else DATA
    con = duckdb.connect()
    for f in data.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    found = __spark_entry__.queries()[name](spark, str(data))
    names = sorted(found.columns)
    wanted = con.execute(f"SELECT {', '.join(names)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert plain(found.select(*names).collect()) == plain(wanted)


def table(spark, x, names="r long, c long, v double"):
    rows = [(int(r), int(c), None if math.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(x)]
    return spark.createDataFrame(rows, names)


def array(df, shape, value="v", at=("r", "c")):
    out = np.full(shape, np.nan)
    for row in df.collect():
        out[row[at[0]], row[at[1]]] = np.nan if row[value] is None else row[value]
    return out


@pytest.mark.parametrize("shape, tile", [((19, 23), 8), ((9, 5), 4), ((17, 8), 8), ((6, 6), 64)])
def test_box_sums_in_tiles(spark, shape, tile):
    x = np.random.default_rng(1).integers(0, 1000, shape).astype(float)
    for reach in (1, 2, 4):
        wide = np.pad(x, reach, mode="symmetric")
        want = sum(wide[a : a + shape[0], b : b + shape[1]] for a in range(2 * reach + 1) for b in range(2 * reach + 1))
        found = tiles.box_sums(table(spark, x), reach, *shape, "v", tile=tile)
        assert (array(found, shape) == want).all()
        assert found.count() == x.size


def test_windows_are_lines_of_tiles(spark):
    plan = tiles.box_sums(table(spark, np.ones((40, 40))), 2, 40, 40, "v", tile=8)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(tr") == 1 and plan.count("Exchange") == 1


@pytest.mark.parametrize("seeds", [[(0, 0)], [(39, 2), (11, 7), (12, 7), (25, 0)], []])
def test_distance_in_parts(spark, seeds):
    at = set(seeds)
    rows = [(r, c, (r, c) in at) for r in range(40) for c in range(9)]
    px = spark.createDataFrame(rows, "r long, c long, seed boolean")
    want = {(r, c): min(((r - a) ** 2 + (c - b) ** 2 for a, b in at), default=None) for r, c, _ in rows}
    assert {(x.r, x.c): x.d2 for x in kernels.squared_distance(px, "seed").collect()} == want
    column = {(r, c): min((abs(r - a) for a, b in at if b == c), default=None) for r, c, _ in rows}
    for tile in (1, 7, 64):
        assert {(x.r, x.c): x.g for x in tiles.column_distance(px, "seed", tile=tile).collect()} == column


def moved(x, dy, dx):
    """x moved by a fraction of a pixel, through its spectrum."""
    waves = np.exp(-2j * np.pi * (np.fft.fftfreq(x.shape[0])[:, None] * dy + np.fft.fftfreq(x.shape[1])[None, :] * dx))
    return np.fft.ifft2(np.fft.fft2(x) * waves).real


@pytest.mark.parametrize("planted", [(0.35, -1.7), (-3.0, 2.25), (0.0, 0.0), (-0.5, 7.8)])
def test_planted_shift_is_found(spark, planted):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(48, 40))
    for axis in (0, 1):
        x = sum(np.roll(x, k, axis) for k in range(-2, 3))
    pair = table(spark, x).withColumnRenamed("v", "a").join(table(spark, moved(x, *planted) + draw.normal(0, 0.05, x.shape)).withColumnRenamed("v", "b"), ["r", "c"])
    for block in (spectral.BLOCK, 100):
        found = spectral.shift_estimate(pair, *x.shape, block=block)
        assert np.abs(np.array(found) + planted).max() < 0.051


def test_sharp_edges_do_not_draw_the_peak_away(spark):
    draw = np.random.default_rng(1)
    ground = draw.normal(0, 400, (2048, 256))
    for r, c, size in zip(draw.integers(0, 2000, 240), draw.integers(0, 230, 240), draw.integers(12, 22, 240), strict=True):
        ground[r : r + size, c : c + size] = -6500
    ahead = np.pad(ground, ((3, 0), (2, 0)))[:2048, :256]
    cells = [x.reshape(512, 4, 64, 4).mean(axis=(1, 3)) for x in (ground, ahead)]
    pair = table(spark, cells[0]).withColumnRenamed("v", "a").join(table(spark, cells[1]).withColumnRenamed("v", "b"), ["r", "c"])
    assert spectral.shift_estimate(pair, 512, 64) == (-0.75, -0.5)


def test_spectrum_is_the_two_dimensional_transform(spark):
    draw = np.random.default_rng(4)
    a, b = draw.normal(size=(2, 20, 12))
    pair = table(spark, a).withColumnRenamed("v", "a").join(table(spark, b).withColumnRenamed("v", "b"), ["r", "c"])
    rows = sorted(spectral.spectrum(pair, 20, 12, block=30).collect(), key=lambda x: x.cb)
    found = np.concatenate([np.frombuffer(x.a, complex).reshape(x.rows, x.cols) for x in rows], axis=1)
    assert len(rows) > 3 and np.allclose(found, np.fft.fft2(a) * np.fft.fft2(b).conj())


def test_shift_of_the_smallest_raster_is_near(spark):
    row = geometry.scene_shift(spark, str(DATA)).first()
    assert abs(row.dy - geometry._DY) <= 0.25 and abs(row.dx - geometry._DX) <= 0.25 and row.moved


def test_gaps_are_filled_by_the_median(spark):
    x = np.arange(25.0).reshape(5, 5)
    x[0, 0] = x[4, 4] = np.nan
    assert array(spectral.filled(table(spark, x), "v"), (5, 5))[0, 0] == 12


def curved(row, col):
    return 100 + 3 * col + 0.02 * row * col / 10, 900 - 2 * row - 0.03 * col * col / 10


def test_spline_goes_through_control_points_and_is_exact_for_planes():
    draw = np.random.default_rng(5)
    at = draw.uniform(0, 1000, (60, 2))
    control = np.column_stack([at, np.sin(at[:, 0] / 90) * 40, at[:, 0] * 0.2 - at[:, 1]])
    u, v = spline.Spline(control)(at[:, 0], at[:, 1])
    assert max(np.abs(u - control[:, 2]).max(), np.abs(v - control[:, 3]).max()) < 1e-6
    plane = spline.Spline(np.column_stack([at, 3 + 2 * at[:, 0], at.sum(axis=1)]))
    x, y = draw.uniform(-500, 1500, (2, 9000))
    u, v = plane(x, y)
    assert max(np.abs(u - 3 - 2 * x).max(), np.abs(v - x - y).max()) < 1e-6


def test_spline_errors(spark):
    with pytest.raises(ValueError, match="three"):
        spline.Spline(np.ones((5, 4)))
    with pytest.raises(ValueError, match="line"):
        spline.Spline(np.array([[0, 0, 1, 1], [0, 0, 2, 2], [1, 0, 1, 1], [0, 1, 1, 1]]))
    many = spark.range(spline.MAX_CONTROL + 1).selectExpr("id AS x", "id * id AS y", "id AS u", "id AS v")
    with pytest.raises(ValueError, match="more than"):
        spline.fitted(many)


def test_geocoded_layer_against_brute_force(spark):
    draw = np.random.default_rng(6)
    image = draw.normal(size=(30, 26))
    image[7, 9] = np.nan
    lattice = [(r, c) for r in np.linspace(0, 30, 7) for c in np.linspace(0, 26, 6)]
    control = [(float(r), float(c), *map(float, curved(r, c))) for r, c in lattice]
    cells = [(i, j, 90.0 + 2.5 * j, 905.0 - 2.5 * i) for i in range(30) for j in range(40)]
    found = spline.geocoded(table(spark, image), "v", spark.createDataFrame(control, "row double, col double, x double, y double"), spark.createDataFrame(cells, "i long, j long, x double, y double"))
    got = array(found, (30, 40), at=("i", "j"))
    back = spline.Spline(np.array([(x, y, r, c) for r, c, x, y in control]))
    for i, j, x, y in cells:
        (row,), (col,) = back(np.array([x]), np.array([y]))
        y0, x0 = math.floor(row - 0.5), math.floor(col - 0.5)
        fy, fx = row - 0.5 - y0, col - 0.5 - x0
        inside = 0 <= y0 and y0 + (fy > 0) < 30 and 0 <= x0 and x0 + (fx > 0) < 26
        want = sum(abs(1 - a - fy) * abs(1 - b - fx) * image[min(y0 + a, 29), min(x0 + b, 25)] for a in (0, 1) for b in (0, 1)) if inside else math.nan
        assert (math.isnan(want) and math.isnan(got[i, j])) or abs(want - got[i, j]) < 1e-9
    assert 300 < np.isfinite(got).sum() < 1200


@pytest.mark.parametrize("method", ["nearest", "bilinear"])
def test_resample_meets_tiles_at_their_borders(spark, method):
    draw = np.random.default_rng(7)
    x = draw.normal(size=(21, 18))
    wanted = [(k, 0, float(a), float(b)) for k, (a, b) in enumerate(draw.uniform(-2, 23, (400, 2)).tolist() + [[0, 0], [20, 17], [7, 8], [8, 7.5], [19.999, 17], [-0.5, 0], [20.5, 3]])]
    rows = spark.createDataFrame([*wanted, (900, 0, None, 1.0)], "i long, j long, sr double, sc double")
    found = {r.i: r.v for r in tiles.resample(table(spark, x), rows, "v", method, tile=8).collect()}
    assert len(found) == len(wanted) + 1 and found[900] is None
    for k, _, a, b in wanted:
        if method == "nearest":
            r, c = math.floor(a + 0.5), math.floor(b + 0.5)
            want = x[r, c] if 0 <= r < 21 and 0 <= c < 18 else None
        else:
            r, c = math.floor(a), math.floor(b)
            corners = [(abs(1 - u - (a - r)) * abs(1 - w - (b - c)), r + u, c + w) for u in (0, 1) for w in (0, 1)]
            used = [p for p in corners if p[0] > 0]
            want = sum(p * x[u, w] for p, u, w in used) if all(0 <= u < 21 and 0 <= w < 18 for _, u, w in used) else None
        assert (found[k] is None) == (want is None) and (want is None or abs(found[k] - want) < 1e-12)


def test_area_downsample_of_any_ratio(spark):
    x = np.random.default_rng(8).normal(size=(13, 10))
    x[2, 3] = np.nan
    fine = np.kron(x, np.ones((5, 7)))  # 65 x 70, cells of 13 x 10
    found = {(r.i, r.j): r for r in tiles.area_downsample(table(spark, x), "v", 13, 10, 5, 7).collect()}
    for i in range(5):
        for j in range(7):
            part = fine[i * 13 : i * 13 + 13, j * 10 : j * 10 + 10]
            assert abs(found[i, j].mean - np.nanmean(part)) < 1e-9 and found[i, j].high == np.nanmax(part)
            assert abs(found[i, j].weight - np.isfinite(part).mean()) < 1e-12


def test_polygons_with_holes(spark):
    ring = [(1.2, 1.1), (17.3, 2.4), (14.8, 15.9), (2.2, 12.7), (1.2, 1.1)]
    hole = [(6.1, 5.2), (10.3, 5.9), (8.4, 9.6), (6.1, 5.2)]
    vertices = [(1, n, i, float(x), float(y)) for n, points in enumerate((ring, hole)) for i, (x, y) in enumerate(points)]
    found = burn.polygon_cells(burn.edges(spark.createDataFrame(vertices, "id long, ring long, i long, x double, y double"), "id", "ring", closed=False), "id", height=14, width=16)

    def inside(x, y, points):
        crossed = False
        for (x1, y1), (x2, y2) in zip(points, points[1:], strict=False):
            if (y1 <= y) != (y2 <= y) and x1 + (y - y1) * (x2 - x1) / (y2 - y1) <= x:
                crossed = not crossed
        return crossed

    want = {(r, c) for r in range(14) for c in range(16) if inside(c + 0.5, r + 0.5, ring) and not inside(c + 0.5, r + 0.5, hole)}
    assert {(x.r, x.c) for x in found.collect()} == want


def test_closed_edges_join_the_last_vertex(spark):
    square = spark.createDataFrame([(1, i, x, y) for i, (x, y) in enumerate([(1.0, 1.0), (4.0, 1.0), (4.0, 4.0), (1.0, 4.0)])], "id long, i long, x double, y double")
    assert burn.edges(square, "id", closed=True).count() == 4
    assert burn.polygon_cells(burn.edges(square, "id", closed=True), "id").count() == 9


def test_lines_touch_every_cell_of_any_length(spark):
    draw = random.Random(9)
    lines = [(k, *(draw.uniform(-5, 60) for _ in range(4))) for k in range(40)] + [(98, 3.5, 2.0, 3.5, 2.0), (99, 0.5, 7.25, 30.5, 7.25), (100, 4.25, 1.5, 4.25, 30.5), (101, 0.1, 0.3, 20000.7, 9000.9)]
    found = burn.line_cells(spark.createDataFrame(lines, "id long, x1 double, y1 double, x2 double, y2 double"), "id")
    got = {}
    for x in found.collect():
        got.setdefault(x.id, set()).add((x.r, x.c))
    for k, x1, y1, x2, y2 in lines:
        # where the line crosses whole numbers; between two crossings it is inside one cell
        cuts = {0.0, 1.0}
        for a, b in ((x1, x2), (y1, y2)):
            if a != b:
                cuts |= {(n - a) / (b - a) for n in range(math.ceil(min(a, b)), math.floor(max(a, b)) + 1)}
        cuts = sorted(cuts)
        middles = [(s + t) / 2 for s, t in zip(cuts, cuts[1:], strict=False)]
        want = {(math.floor(y1 + m * (y2 - y1)), math.floor(x1 + m * (x2 - x1))) for m in middles}
        assert want <= got[k] and len(got[k] - want) <= 2 + len(want) // 1000


def test_grid_bounds_are_those_of_its_edges(spark):
    row = geometry.page_grid(spark, str(DATA)).first()
    lon, lat = geo.lonlat("x", "y")
    corner = spark.sql(f"SELECT {lon} AS lon, {lat} AS lat FROM VALUES (391530.0D, 8568230.0D) AS t(x, y)").first()
    assert row.west <= corner.lon + 1e-6 and row.north >= corner.lat - 1e-6 and (row.out_w, row.out_h) == (256, 256)
