import random
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from canopyspark.functions import geo
from canopyspark.operators.components import connected_components
from canopyspark.operators.rules import opening3
from canopyspark.plans import reports
from canopyspark.sources import synthetic

DATA = Path("/root/testdata/sf0.001")


def plain(rows):
    def cell(v):
        return str(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(cell(v) for v in r) for r in rows)


@pytest.mark.skipif(not DATA.exists(), reason="needs the generated tables")
@pytest.mark.parametrize("name", ["lee_filter", "closing5", "edt_distance", "points_mean3", "warp_bilinear", "mosaic_first", "loss_timeline", "model_compare", "point_series", "nearby5", "pool_filters", "export_geojson", "export_csv", "polygon_burn", "line_burn", "grid_bounds", "scene_files", "pin_classify_dedupe", "escape_text", "rule_detect", "opening3", "patch_stats", "alerts_ranked", "crackdown_table", "evaluate4", "texture5", "order_pool_filters"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    found = __spark_entry__.queries()[name](spark, str(DATA))
    names = sorted(found.columns)
    wanted = con.execute(f"SELECT {', '.join(names)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert plain(found.select(*names).collect()) == plain(wanted)


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_grid_of_the_published_box(spark):
    box = spark.createDataFrame([(1, *reports._BOX)], "box int, w double, s double, e double, n double")
    assert tuple(reports.grids_of(box).first()) == (1, 391530, 8568230, 1089, 890)


def test_projection_round_trip(spark):
    x, y = geo.utm(*geo.lonlat("x", "y"))
    row = spark.sql(f"SELECT {x} AS x, {y} AS y FROM VALUES (391530.0D, 8568230.0D) AS t(x, y)").first()
    assert abs(row.x - 391530) < 0.001 and abs(row.y - 8568230) < 0.001


def test_connected_components(spark):
    draw = random.Random(4)
    edges = [(draw.randrange(60), draw.randrange(60)) for _ in range(45)] + [(None, 3), (7, 7)]
    group = {n: n for e in edges if None not in e and e[0] != e[1] for n in e}
    for _ in range(60):
        for a, b in edges:
            if a in group and b in group:
                group[a] = group[b] = min(group[a], group[b])
    found = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in found.collect()} == group
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_opening_keeps_what_a_square_covers(spark):
    cells = {(r, c) for r in range(5, 9) for c in range(5, 8)} | {(5, 9), (20, 20)}
    found = opening3(spark.createDataFrame(sorted(cells), "r long, c long"))
    assert {(x.r, x.c) for x in found.collect()} == {(r, c) for r in range(5, 9) for c in range(5, 8)}


def test_raster_grows_with_the_suppliers(spark, tmp_path):
    for n, rows in ((0, 256), (28, 256), (29, 512), (70, 768)):
        table = spark.range(n).selectExpr("id AS s_suppkey", "id % 25 AS s_nationkey")
        table.write.parquet(f"{tmp_path}/{n}/supplier.parquet")
        assert synthetic.height(spark, f"{tmp_path}/{n}") == rows
    assert synthetic.scenes(spark, f"{tmp_path}/70").count() == 6 * 768 * 256
    assert synthetic.plants(spark, f"{tmp_path}/70").where("r0 >= 512").count() == 14
