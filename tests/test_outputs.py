from pathlib import Path

import duckdb
import pytest

from canopyspark.plans import outputs as plans
from canopyspark.sources import cache

from test_queries import plain

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="needs the generated tables")
@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    found = plans.QUERIES[name](spark, str(DATA))
    names = sorted(found.columns)
    wanted = con.execute(f"SELECT {', '.join(names)} FROM ({plans.ORACLES[name]})").fetchall()
    assert wanted
    assert plain(found.select(*names).collect()) == plain(wanted)


def embedded(spark, rows):
    return spark.createDataFrame(rows, "date string, tile long, embedding array<double>")


def test_cache_keeps_what_it_has(spark, tmp_path):
    folder = str(tmp_path / "emb")
    asked = embedded(spark, [("20200101", 0, None), ("20200201", 0, None)])
    assert {r.date for r in cache.missing(asked, folder).collect()} == {"20200101", "20200201"}
    cache.save(embedded(spark, [("20200101", 0, [1.0]), ("20200101", 1, [2.0])]), folder, 64)
    cache.save(embedded(spark, [("20200101", 0, [9.0]), ("20200201", 0, None)]), folder, 64)
    got = {(r.date, r.tile): r.embedding for r in cache.load(spark, folder, 64).collect()}
    assert got == {("20200101", 0): [1.0], ("20200101", 1): [2.0], ("20200201", 0): None}
    assert cache.missing(asked, folder).count() == 0
    cache.save(embedded(spark, [("20200101", 0, [9.0])]), folder, 64, force=True)
    got = {(r.date, r.tile): r.embedding for r in cache.load(spark, folder, 64).collect()}
    assert got == {("20200101", 0): [9.0], ("20200201", 0): None}


def test_cache_of_another_tile_size_is_refused(spark, tmp_path):
    folder = str(tmp_path / "emb")
    cache.save(embedded(spark, [("20200101", 0, [1.0])]), folder, 32)
    with pytest.raises(Exception, match="another tile size on 20200101"):
        cache.load(spark, folder, 64).collect()


def test_stack_of_no_rows_and_of_holes(spark, tmp_path):
    px = spark.createDataFrame([("20200201", 0, 0, 1.5), ("20200201", 2, 1, None), ("20200101", 0, 0, None)], "date string, r long, c long, db double")
    plans.save_stack(px, str(tmp_path / "a"))
    got = sorted((r.date, r.place, r.width, r.height, r.valid, r.r, r.c, r.db) for r in plans.read_stack(spark, str(tmp_path / "a")).where("db IS NOT NULL OR r = 2").collect())
    assert got == [("20200201", 1, 2, 3, 1, 0, 0, 1.5), ("20200201", 1, 2, 3, 1, 2, 1, None)]
    plans.save_stack(px.limit(0), str(tmp_path / "b"))
    assert plans.read_stack(spark, str(tmp_path / "b")).count() == 0
