import sqlite3
import struct
import zipfile

import numpy as np
import pytest

from panelforge.sources import files as S
from panelforge.sources import gpkg as K
from panelforge.sources import sinks as W
from panelforge.sources.writers import dbf_bytes as dbf, put, shp_bytes as shp, tiff_bytes


FIELDS = [("Summer_day", "N", 8, 3), ("Code", "N", 6, 0), ("Name", "C", 10, 0), ("hasPlace", "L", 1, 0)]
ROWS = [(" ", 1.25, 7, "Alpha", "T"), ("*", 9.0, 8, "gone", "F"), (" ", None, 9, "Beta", "?")]


def test_dbf_header_and_rows():
    data = dbf(FIELDS, ROWS)
    info = S.dbf_header(data)
    assert info["records"] == 3
    assert info["fields"] == FIELDS
    assert list(S.dbf_rows(data)) == [{"Summer_day": 1.25, "Code": 7, "Name": "Alpha", "hasPlace": True}, {"Summer_day": None, "Code": 9, "Name": "Beta", "hasPlace": None}]
    with pytest.raises(ValueError, match="within a record"):
        list(S.dbf_rows(data[:-3]))
    with pytest.raises(ValueError, match="not a DBF"):
        S.dbf_header(b"x")


def test_shapefile(spark, tmp_path):
    square = [(0, 0), (0, 4), (4, 4), (4, 0), (0, 0)]
    hole = [(1, 1), (3, 1), (3, 3), (1, 3), (1, 1)]
    (tmp_path / "a.dbf").write_bytes(dbf(FIELDS[1:3], [(" ", 1, "x"), (" ", 2, "y")]))
    (tmp_path / "a.shp").write_bytes(shp([[square, hole], None]))
    df = S.read_shapefile(spark, f"file://{tmp_path}/a")
    rows = {r["Code"]: r for r in df.collect()}
    from panelforge.operators import spatial as G

    assert len(G.rings_of_wkb(bytes(rows[1]["wkb"]))) == 2 and rows[2]["wkb"] is None
    assert df.where("Code = 1").select(G.area(G.wkb_rings("wkb"))).first()[0] == 12.0
    only = S.read_shapefile(spark, f"file://{tmp_path}/a", ["Name"], geometry=False)
    assert only.columns == ["Name"] and only.count() == 2
    with pytest.raises(ValueError, match="missing columns"):
        S.read_shapefile(spark, f"file://{tmp_path}/a", ["Nope"])


@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff(spark, tmp_path, order):
    values = np.arange(12, dtype=float).reshape(3, 4)
    values[0, 0] = -9999
    (tmp_path / "r.tif").write_bytes(tiff_bytes(values, 10.0, 50.0, 0.5, 0.5, order=order))
    (tmp_path / "bad.tif").write_bytes(b"not a tiff at all")
    files = S.binary(spark, f"file://{tmp_path}")
    meta = {r["path"].rsplit("/", 1)[-1]: r for r in S.raster_metadata(files).collect()}
    m = meta["r.tif"]
    assert (m["width"], m["height"], m["x0"], m["y0"], m["dx"], m["nodata"]) == (4, 3, 10.0, 50.0, 0.5, -9999.0)
    assert not meta["bad.tif"]["ok"] and "not a TIFF" in meta["bad.tif"]["error"]
    pixels = S.raster_pixels(files.where("path LIKE '%r.tif'"))
    got = {(r["row"], r["col"]): r for r in pixels.collect()}
    assert got[(0, 0)]["value"] is None and got[(2, 3)]["value"] == 11.0
    assert (got[(2, 3)]["x"], got[(2, 3)]["y"]) == (11.75, 48.75)
    d = S.value_diagnostic(pixels).first()
    assert (d["n_valid"], d["min"], d["max"]) == (11, 1.0, 11.0)


def test_put(spark, tmp_path):
    assert put(spark, f"file://{tmp_path}/a/b.bin", b"\0x") .endswith("b.bin")
    assert (tmp_path / "a" / "b.bin").read_bytes() == b"\0x"


def test_tiff_refusals():
    data = tiff_bytes(np.zeros((2, 2)), 0, 0, 1, 1)
    with pytest.raises(ValueError, match="beyond"):
        S.tiff_tags(data[:20])
    with pytest.raises(ValueError, match="BigTIFF"):
        S.tiff_tags(b"II" + struct.pack("<HI", 43, 8))


def test_zip_inventory(spark, tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.writestr("d/LST_2018_01_01.tif", b"hello world")
        z.writestr("x.shp", b"123")
    data = bytearray(path.read_bytes())
    data[data.index(b"hello")] ^= 255
    (tmp_path / "broken.zip").write_bytes(bytes(data))
    (tmp_path / "no.zip").write_bytes(b"nothing")
    rows = S.archive_members(S.binary(spark, f"file://{tmp_path}", "*.zip")).collect()
    got = sorted((r["path"].rsplit("/", 1)[-1], r["name"] or "", r["ok"]) for r in rows)
    assert got == [("a.zip", "d/LST_2018_01_01.tif", True), ("a.zip", "x.shp", True), ("broken.zip", "d/LST_2018_01_01.tif", False), ("broken.zip", "x.shp", True), ("no.zip", "", False)]
    (tmp_path / "out").mkdir()
    assert S.extract_flat(str(path), ["d/LST_2018_01_01.tif"], str(tmp_path / "out"))[0].endswith("out/LST_2018_01_01.tif")
    for bad in ("../x", "/etc/x", "a/../../b"):
        with pytest.raises(ValueError, match="unsafe"):
            S.extract_flat(str(path), [bad], str(tmp_path))


def test_text_tables(spark, tmp_path):
    (tmp_path / "r.csv").write_bytes(' name ,Founded _2025,pop\nMÃ©xico,"1,990","1,234,567"\nTokyo,,nan\n'.encode("latin-1"))
    rows = S.read_registry(spark, f"file://{tmp_path}/r.csv", ["name"], ["Founded _2025", "pop"]).collect()
    assert [tuple(r) for r in rows] == [("México", 1990.0, 1234567.0), ("Tokyo", None, None)]
    (tmp_path / "l.csv").write_text("object_type,unit_id,iou,valid,country\nlink,1,0.5, True ,x\nnode,2,0.1,True,y\nlink,3.0,,0,\n")
    rows = S.read_links(spark, f"file://{tmp_path}/l.csv", ["unit_id"], ["iou"], ["valid"], ["country"]).collect()
    assert [tuple(r) for r in rows] == [(1, 0.5, True, "x"), (3, None, False, None)]
    with pytest.raises(ValueError, match="missing columns"):
        S.read_csv(spark, f"file://{tmp_path}/l.csv", columns=["nope"])


def test_response_columns():
    names = ["Annual_nig", "Annual_day", "Summer_day", "hasPlace"]
    assert S.only_response_column(names, "Summer", "day") == "Summer_day"
    for columns in (names[:2], [*names, "summer_day"]):
        with pytest.raises(ValueError, match="columns for"):
            S.only_response_column(columns, "Summer", "day")


def test_verify_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "e.csv").write_text("")
    (tmp_path / "n.zip").write_bytes(b"no")
    (tmp_path / "d.dbf").write_bytes(dbf(FIELDS, ROWS))
    rows = S.verify_files(S.binary(spark, f"file://{tmp_path}"), {"a.csv": "00"}, required_columns=["x"], expected=["a.csv", "e.csv", "gone.csv"]).collect()
    got = {(r["path"].rsplit("/", 1)[-1], r["check"]): r["ok"] for r in rows}
    assert got[("a.csv", "csv_rows")] and got[("a.csv", "columns")] and not got[("a.csv", "sha256")]
    assert got[("e.csv", "exists")] is False and got[("gone.csv", "exists")] is False and ("a.csv", "exists") not in got
    assert not got[("n.zip", "zip")] and got[("d.dbf", "dbf")] and not got[("d.dbf", "columns")]


@pytest.fixture
def geopackage(tmp_path):
    path = str(tmp_path / "g.gpkg")
    db = sqlite3.connect(path)
    db.executescript(
        "CREATE TABLE gpkg_contents (table_name TEXT, data_type TEXT); CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT);"
        "CREATE TABLE uc_boundaries (fid INTEGER PRIMARY KEY, geom BLOB, ID INTEGER, name TEXT, pop REAL); CREATE TABLE urban_points (fid INTEGER PRIMARY KEY, geom BLOB, ID INTEGER); CREATE TABLE other_polys (fid INTEGER PRIMARY KEY, geom BLOB, ID INTEGER);"
    )
    for t, k in (("uc_boundaries", "MULTIPOLYGON"), ("urban_points", "POINT"), ("other_polys", "POLYGON")):
        db.execute("INSERT INTO gpkg_contents VALUES (?, 'features')", (t,))
        db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', ?)", (t, k))
    blob = b"GP\0\1" + struct.pack("<i", 4326) + S.wkb([[[(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 0.0)]]])
    db.executemany("INSERT INTO uc_boundaries (geom, ID, name, pop) VALUES (?, ?, ?, ?)", [(blob, i, f"c{i}", None if i == 3 else i / 2) for i in range(10)])
    db.commit()
    db.close()
    return path


def test_geopackage(spark, geopackage):
    assert K.best_layer(geopackage, "ID") == "uc_boundaries"
    with pytest.raises(ValueError, match="no polygon layer"):
        K.best_layer(geopackage, "nope")
    df = K.read_layer(spark, geopackage, "uc_boundaries", ["ID", "pop"])
    assert df.columns == ["ID", "pop"]
    rows = {r["ID"]: r["pop"] for r in df.collect()}
    assert len(rows) == 10 and rows[3] is None and rows[4] == 2.0
    spark.dataSource.register(K.GeoPackage)
    assert spark.read.format("gpkg").option("path", geopackage).option("layer", "uc_boundaries").option("rows", "3").load().rdd.getNumPartitions() == 4
    some = K.polygons_of(spark, geopackage, "uc_boundaries", "ID", spark.createDataFrame([(2,), (5,), (99,)], "ID long"))
    from panelforge.operators import spatial as G

    assert [G.rings_of_wkb(bytes(r["wkb"])) for r in some.collect()] == [[[(0.0, 0.0), (2.0, 0.0), (2.0, 2.0)]]] * 2
    with pytest.raises(ValueError, match="none of the ids"):
        K.polygons_of(spark, geopackage, "uc_boundaries", "ID", spark.createDataFrame([(99,)], "ID long"))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "b")], "x int, y string")
    W.write_csv(df, f"file://{tmp_path}/c", ["y", "x", "z"])
    rows = spark.read.option("header", True).csv(f"file://{tmp_path}/c").orderBy("x").collect()
    assert [(r["y"], r["x"], r["z"]) for r in rows] == [(None, "1", None), ("b", "2", None)]
    from pyspark.errors import AnalysisException

    with pytest.raises(AnalysisException):
        W.write_csv(df, f"file://{tmp_path}/c")
    W.write_json(df, f"file://{tmp_path}/j")
    assert spark.read.json(f"file://{tmp_path}/j").count() == 2
    assert [r["text"] for r in W.markdown(df.na.fill("-"), ["x"], {"x": "%03d"}).collect()] == ["| x | y |", "|---|---|", "| 001 | - |", "| 002 | b |"]


def test_seal(spark, tmp_path):
    (tmp_path / "out.csv").write_text("a,b\n")
    paths, marker = [f"file://{tmp_path}/out.csv"], f"file://{tmp_path}/seal"
    with pytest.raises(RuntimeError, match="aren't sealed"):
        W.assert_sealed(spark, paths, marker)
    W.seal(spark, paths, marker)
    W.assert_sealed(spark, paths, marker)
    (tmp_path / "out.csv").write_text("a,c\n")
    with pytest.raises(RuntimeError, match="changed since sealing"):
        W.assert_sealed(spark, paths, marker)


def test_markers(spark, tmp_path):
    W.end_run(spark, str(tmp_path), "boom")
    assert (tmp_path / "FAILED").read_text() == "boom"
    W.start_run(spark, str(tmp_path))
    assert not (tmp_path / "FAILED").exists()
    W.end_run(spark, str(tmp_path))
    assert (tmp_path / "DONE").exists()
    assert '"seed": 7' in W.run_metadata(spark, 7, 0.0)
