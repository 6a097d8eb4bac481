import hashlib
import io
import os
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators import spatial as G
from panelforge.sources import files as S
from panelforge.sources import ranged as R
from panelforge.sources.writers import dbf_bytes, shp_bytes, shx_bytes, tiff_bytes, tiled_tiff_bytes


def square(k, hole=False):
    ring = [(k, 0.0), (k, 5.0), (k + 4.0, 5.0), (k + 4.0, 0.0), (k, 0.0)]
    return [ring, [(k + 1, 1.0), (k + 2, 1.0), (k + 2, 2.0), (k + 1, 2.0), (k + 1, 1.0)]] if hole else [ring]


@pytest.fixture(scope="module")
def stem(tmp_path_factory):
    to = tmp_path_factory.mktemp("shp")
    rings = [None if i % 7 == 3 else square(float(i), i % 2 == 0) for i in range(101)]
    rows = [("*" if i % 10 == 9 else " ", i, f"é{i}", None if i == 5 else f"{i / 8:.3f}") for i in range(101)]
    (to / "a.dbf").write_bytes(dbf_bytes([("KEY", "N", 6, 0), ("NAME", "C", 12, 0), ("V", "N", 10, 3)], rows))
    (to / "a.shp").write_bytes(shp_bytes(rings))
    (to / "a.shx").write_bytes(shx_bytes(rings))
    return f"{to}/a"


@pytest.mark.parametrize("records", [7, 1000])
def test_shapefile_by_ranges(spark, stem, records):
    df = R.scan_shapefile(spark, stem, ["KEY", "V"], boxes=True, records=records)
    assert df.rdd.getNumPartitions() == -(-101 // records)
    rows = {r["KEY"]: r for r in df.withColumn("area", G.area(G.wkb_rings("wkb"))).collect()}
    assert sorted(rows) == [i for i in range(101) if i % 10 != 9]
    for i, r in rows.items():
        assert r["V"] == (None if i == 5 else i / 8)
        assert (r["wkb"], r["x0"]) == (None, None) if i % 7 == 3 else (r["x0"], r["area"]) == (i, 19 if i % 2 == 0 else 20)
    assert R.scan_shapefile(spark, [stem, stem], geometry=False, records=records).where("NAME = 'é8'").count() == 2


def test_box_filters_are_pushed(spark, stem):
    df = R.scan_shapefile(spark, stem, ["KEY"], boxes=True, records=20).where((F.col("x1") >= 30) & (F.col("x0") < 34.5) & (F.col("KEY") > 0))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "x1" not in plan.split("Filter")[1].split("\n")[0] or "PythonScan" in plan or "BatchScan" in plan
    assert sorted(r["KEY"] for r in df.collect()) == [i for i in range(26, 35) if i % 7 != 3 and i % 10 != 9]
    reader = R._ShapeReader([stem], ["KEY"], False, True, 50, "utf-8")
    from pyspark.sql.datasource import GreaterThan

    left = list(reader.pushFilters([GreaterThan(("x0",), 40.0), GreaterThan(("KEY",), 1)]))
    assert [f.attribute for f in left] == [("KEY",)]
    assert [r[0] for r in reader.read(R._Range(stem, 30, 50))] == [i for i in range(41, 50) if i % 7 != 3 and i % 10 != 9]


def test_broken_shapefiles(spark, stem, tmp_path):
    with pytest.raises(Exception, match="missing columns"):
        R.scan_shapefile(spark, stem, ["NONE"]).collect()
    for end in ("dbf", "shp", "shx"):
        (tmp_path / f"b.{end}").write_bytes(open(f"{stem}.{end}", "rb").read()[: 300 if end == "shx" else None])
    with pytest.raises(Exception, match="fewer records"):
        R.scan_shapefile(spark, f"{tmp_path}/b", ["KEY"]).collect()
    for end, data in (("dbf", dbf_bytes([("KEY", "N", 6, 0)], [])), ("shp", shp_bytes([])), ("shx", shx_bytes([]))):
        (tmp_path / f"c.{end}").write_bytes(data)
    assert R.scan_shapefile(spark, f"{tmp_path}/c", ["KEY"]).count() == 0


def lzw_packed(data: bytes) -> bytes:
    """The coder that `lzw` undoes."""
    codes, table, last = [256], {bytes([i]): i for i in range(256)}, b""
    fresh, bits, n = 258, 0, 0
    widths = []

    def emit(code):
        widths.append((code, 9 if fresh < 512 else 10 if fresh < 1024 else 11 if fresh < 2048 else 12))

    emit(256)
    for b in data:
        own = last + bytes([b])
        if own in table:
            last = own
            continue
        emit(table[last])
        table[own] = fresh
        fresh += 1
        if fresh == 4094:
            emit(256)
            table, fresh = {bytes([i]): i for i in range(256)}, 258
        last = bytes([b])
    if last:
        emit(table[last])
        fresh += 1
    emit(257)
    out, held = bytearray(), 0
    for code, width in widths:
        held, n = held << width | code, n + width
        while n >= 8:
            n -= 8
            out.append(held >> n & 255)
            held &= (1 << n) - 1
    if n:
        out.append(held << (8 - n) & 255)
    assert codes and bits == 0
    return bytes(out)


def test_lzw():
    rng = np.random.default_rng(2)
    for data in (b"", b"a", b"abababababab" * 50, bytes(rng.integers(0, 4, 30_000).astype(np.uint8)), bytes(rng.integers(0, 256, 9000).astype(np.uint8))):
        assert R.lzw(lzw_packed(data)) == data


GRID = np.arange(45 * 70 * 2).reshape(45, 70, 2)


@pytest.mark.parametrize("kind, compression, predictor, planar, tile, order", [
    ("i2", 8, 2, 1, (16, 32), "<"), ("u1", 1, 1, 1, None, ">"), ("f4", 8, 3, 1, (16, 16), "<"), ("f8", 8, 3, 2, None, "<"), ("u4", 8, 2, 2, (32, 16), ">"), ("f4", 1, 1, 1, (16, 16), ">"),
])
def test_raster_blocks(spark, tmp_path, kind, compression, predictor, planar, tile, order):
    values = (GRID % 251).astype(kind) if kind != "f4" else (GRID / 7).astype("f4")
    values[3, 4, 0] = 99 if kind == "u1" else values[3, 4, 0]
    path = f"{tmp_path}/r.tif"
    open(path, "wb").write(tiled_tiff_bytes(values, 10.0, 50.0, 0.5, 0.25, tile, compression, predictor, planar, order, nodata=99))
    got = R.scan_raster(spark, path, blocks=3).collect()
    assert len(got) == values.size
    for r in got:
        v = values[r["row"], r["col"], r["band"] - 1]
        assert r["value"] == (None if v == 99 else v)
    assert next((r["x"], r["y"]) for r in got if (r["row"], r["col"]) == (2, 3)) == (11.75, 49.375)
    some = {(r["row"], r["col"], r["band"]) for r in R.scan_raster(spark, path, window=(5, 10, 40, 66), every=7).collect()}
    assert some == {(r, c, b) for r in range(5, 40, 7) for c in range(10, 66, 7) for b in (1, 2)}


def test_only_blocks_of_the_window_are_read(tmp_path):
    path = f"{tmp_path}/r.tif"
    open(path, "wb").write(tiled_tiff_bytes(GRID.astype("i4"), 0.0, 0.0, 1.0, 1.0, (16, 16)))
    reader = R._RasterReader(path, [17, 20, 30, 30], 1, 100)
    assert [b[3] for p in reader.partitions() for b in p.value] == [6]
    assert sum(len(p.value) for p in R._RasterReader(path, None, 40, 100).partitions()) == 2 * 2
    assert R._RasterReader(path, [50, 0, 60, 10], 1, 9).partitions()[0].value == ()


def test_rasters_without_tiles_and_others(spark, tmp_path):
    path = f"{tmp_path}/r.tif"
    open(path, "wb").write(tiff_bytes(np.array([[1.0, -9999.0], [3.0, 4.0]]), 0.0, 2.0, 1.0, 1.0))
    assert sorted((r["row"], r["col"], r["value"]) for r in R.scan_raster(spark, path).where("value IS NOT NULL").collect()) == [(0, 0, 1.0), (1, 0, 3.0), (1, 1, 4.0)]
    open(path, "wb").write(b"no raster at all")
    with pytest.raises(Exception, match="TIFF"):
        R.scan_raster(spark, path).collect()


def test_archives_by_members(spark, tmp_path):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.mkdir("d")
        for i in range(30):
            z.writestr(f"d/{i}.txt", f"text {i}" * i)
    data = bytearray(out.getvalue())
    (tmp_path / "a.zip").write_bytes(data)
    (tmp_path / "b.zip").write_bytes(b"none")
    df = R.scan_archives(spark, [f"{tmp_path}/a.zip", f"file://{tmp_path}/b.zip"], members=4)
    assert df.rdd.getNumPartitions() == 9
    rows = {r["name"]: r for r in df.collect()}
    assert len(rows) == 31 and rows[None]["ok"] is False and rows["d/7.txt"]["sha256"] == hashlib.sha256(b"text 7" * 7).hexdigest()
    at = data.index(b"d/9.txt") + len("d/9.txt") + 2
    data[at] ^= 0xFF
    (tmp_path / "a.zip").write_bytes(data)
    assert [r["name"] for r in R.scan_archives(spark, [f"{tmp_path}/a.zip"], 4).where("NOT ok").collect()] == ["d/9.txt"]


def test_files_beyond_two_gigabytes(spark, tmp_path):
    """A hole of 2.5 GB before an archive: no value of Spark holds such a file, ranges of it are read."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "far behind")
    path = f"{tmp_path}/large.zip"
    with open(path, "wb") as f:
        f.seek(2_500_000_000)
        f.write(out.getvalue())
    assert os.path.getsize(path) > 2**31
    row = R.scan_archives(spark, [path]).first()
    assert row["ok"] and row["sha256"] == hashlib.sha256(b"far behind").hexdigest()


def test_digests(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"x" * 5_000_000)
    rows = {os.path.basename(r["path"]): r for r in R.file_digests(spark, [f"{tmp_path}/a", f"{tmp_path}/none"]).collect()}
    assert (rows["a"]["size"], rows["a"]["sha256"]) == (5_000_000, hashlib.sha256(b"x" * 5_000_000).hexdigest()) and rows["none"]["size"] is None
    assert R.written(f"file://{tmp_path}/deep/er/b", b"abc").endswith("b") and (tmp_path / "deep/er/b").read_bytes() == b"abc"


def test_whole_file_readers_agree(spark, stem):
    whole = S.dbf_rows(open(f"{stem}.dbf", "rb").read(), ["KEY", "NAME"])
    assert [r["KEY"] for r in whole] == [i for i in range(101) if i % 10 != 9] and struct.calcsize("<i4d") == R._HEAD.size


def test_many_ranges_share_tasks():
    """All records once and in order, in a bounded number of tasks; few ranges have a task each."""
    from panelforge.sources.ranged import _shared_tasks

    ranges = [(f"s{i}", a, min(a + 64, 500)) for i in range(300) for a in range(0, 500, 64)]
    tasks = _shared_tasks(ranges)
    assert len(tasks) <= 1024
    assert [(s, k) for own in tasks for s, a, b in own for k in range(a, b)] == [(s, k) for s, a, b in ranges for k in range(a, b)]
    assert _shared_tasks(ranges[:9]) == [[r] for r in ranges[:9]] and _shared_tasks([]) == []
