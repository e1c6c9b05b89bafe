import struct
import zipfile
from pathlib import Path

import duckdb
import numpy as np
import pytest

from canopyspark.functions import geo
from canopyspark.plans import files as plans
from canopyspark.sources import files, geotiff

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
    assert plain(found.select(*names).collect()) == plain(wanted)


def test_layer_files_on_disk(spark, tmp_path):
    """Negative places, a hole, and a tile that is not full."""
    cells = [(0, 0, 1.5), (63, 64, -7.25), (64, 0, None), (-1, 130, 2.0)]
    geotiff.save_files(geotiff.layer_files(spark.createDataFrame(cells, "r long, c long, v double"), "layer"), str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("*.tif"))) == 4
    found = geotiff.read_geotiff(spark, str(tmp_path / "out"))
    assert {(x.r, x.c, x.v) for x in found.where("v IS NOT NULL").collect()} == {c for c in cells if c[2] is not None}
    assert found.count() == 4 * geotiff.TILE**2


def big_endian_tiff(values, nodata):
    """Plain strips of two rows, two bands side by side, integers."""
    rows, cols = values.shape
    both = np.stack([values, values + 1], axis=2).astype(">i2")
    strips = [both[i : i + 2].tobytes() for i in range(0, rows, 2)]
    n = len(strips)
    note = str(nodata).encode() + b"\0"
    fields = [(256, 3, cols), (257, 3, rows), (258, 3, 16), (277, 3, 2), (278, 3, 2), (339, 3, 2)]
    at = 8
    places = []
    for s in strips:
        places.append(at)
        at += len(s)
    tail = struct.pack(f">{n}I{n}I", *places, *map(len, strips)) + struct.pack(">3d6d", 10.0, 10.0, 0, 0, 0, 0, geo.LEFT + 20, geo.TOP - 30, 0) + note
    out = [(t, k, 1, struct.pack(">HH", v, 0)) for t, k, v in fields]
    out += [(273, 4, n, struct.pack(">I", at)), (279, 4, n, struct.pack(">I", at + 4 * n)), (33550, 12, 3, struct.pack(">I", at + 8 * n)), (33922, 12, 6, struct.pack(">I", at + 8 * n + 24)), (42113, 2, len(note), struct.pack(">I", at + 8 * n + 72))]
    directory = struct.pack(">H", len(out)) + b"".join(struct.pack(">HHI", t, k, c) + v for t, k, c, v in sorted(out)) + b"\0" * 4
    body = b"".join(strips) + tail
    return struct.pack(">2sHI", b"MM", 42, 8 + len(body)) + body + directory


def test_strips_of_another_writer(spark, tmp_path):
    values = np.arange(15).reshape(5, 3) * 100 - 300
    (tmp_path / "a.tif").write_bytes(big_endian_tiff(values, -1000))
    (tmp_path / "note.txt").write_text("not read")
    found = {(x.r, x.c): x.v for x in geotiff.read_geotiff(spark, str(tmp_path)).collect()}
    assert found == {(r + 3, c + 2): float(values[r, c]) for r in range(5) for c in range(3)}


def test_what_is_not_read():
    with pytest.raises(ValueError):
        list(geotiff.decode(b"no picture at all"))
    lzw = geotiff.encode(np.zeros((2, 2), "int16"), 0, 0, 10).replace(struct.pack("<HHIHH", 259, 3, 1, 8, 0), struct.pack("<HHIHH", 259, 3, 1, 5, 0))
    with pytest.raises(ValueError):
        list(geotiff.decode(lzw))


def test_packed_placemarks(spark, tmp_path):
    mark = "<Placemark id='1'><name>A &amp; B</name><Point><coordinates>-70.5,-12.25,0</coordinates></Point></Placemark>"
    with zipfile.ZipFile(tmp_path / "pins.kmz", "w") as z:
        z.writestr("doc.kml", f"<kml><Document><Folder>{mark}<Placemark><name>no point</name></Placemark></Folder></Document></kml>")
        z.writestr("icon.png", "x")
    found = files.read_placemarks(spark, str(tmp_path / "pins.kmz"), packed=True).collect()
    assert [tuple(x) for x in found] == [("A & B", -70.5, -12.25, "pins.kmz")]


def test_calibration_without_a_date(spark, tmp_path):
    (tmp_path / "product").mkdir()
    (tmp_path / "product" / "lut.xml").write_text("<lut><offset>1</offset><gains>1 2</gains></lut>")
    with pytest.raises(Exception, match="no acquisition date"):
        files.read_calibration(spark, str(tmp_path / "product")).collect()
