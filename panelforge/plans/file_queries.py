"""Queries of file sources and sinks. Each writes files made from a table into the shared folder and reads them back: a small one from the driver, or one per range of keys from tasks."""

from __future__ import annotations

import atexit
import io
import json
import shutil
import tempfile
import uuid
import zipfile

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.operators import spatial as G
from panelforge.operators import summaries as A
from panelforge.plans.base import t
from panelforge.sources import files as S
from panelforge.sources import gpkg as K
from panelforge.sources import ranged as RG
from panelforge.sources import sinks as W
from panelforge.sources.ranged import written
from panelforge.sources.writers import dbf_bytes, gpkg_bytes, put, shp_bytes, shx_bytes, tiff_bytes, tiled_tiff_bytes

Q_ = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q_[name] = (f, sql)
        return f

    return add


def folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; a temporary one where that is unset, on a local master."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="panelforge-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        shared = f"file://{own}"
    return f"{shared}/files-{uuid.uuid4().hex}"


def nations(spark: SparkSession, sf: str) -> list:
    """The 25 rows of a table whose size is fixed."""
    return t(spark, sf, "nation").orderBy("n_nationkey").collect()


def lines(spark: SparkSession, sf: str, name: str, head: str, row, encoding: str = "utf-8") -> str:
    return put(spark, f"{folder(spark)}/{name}", "\n".join([head, *map(row, nations(spark, sf))]).encode(encoding))


@query("sc3_csv_scan", "SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS name FROM nation")
def _(spark, sf):
    return S.read_csv(spark, lines(spark, sf, "a.csv", " key , name ", lambda r: f"{r['n_nationkey']},{r['n_name']}"))


@query("sc4_latin1_registry", "SELECT n_name || ' é' AS name, CAST(n_nationkey * 1000.5 AS DOUBLE) AS pop FROM nation")
def _(spark, sf):
    path = lines(spark, sf, "a.csv", "name, pop", lambda r: f'{r["n_name"]} é,"{r["n_nationkey"] * 1000.5:,.1f}"')
    return S.read_registry(spark, path, ["name"], ["pop"])


@query("sc5_link_rows", "SELECT CAST(n_nationkey AS BIGINT) AS unit_id, n_nationkey / 4 AS iou, n_nationkey % 2 = 0 AS valid, n_name AS country FROM nation WHERE n_nationkey % 3 <> 0")
def _(spark, sf):
    path = lines(spark, sf, "a.csv", "object_type,unit_id,iou,valid,country,more", lambda r: f"{'link' if r['n_nationkey'] % 3 else 'node'},{r['n_nationkey']},{r['n_nationkey'] / 4},{r['n_nationkey'] % 2 == 0},{r['n_name']},x")
    return S.read_links(spark, path, ["unit_id"], ["iou"], ["valid"], ["country"])


def _shapefile(spark: SparkSession, sf: str) -> str:
    rows, to = nations(spark, sf), folder(spark)
    put(spark, f"{to}/n.dbf", dbf_bytes([("KEY", "N", 6, 0), ("NAME", "C", 20, 0), ("Summer_day", "N", 10, 3)], [(" ", r["n_nationkey"], r["n_name"], None if r["n_nationkey"] == 3 else f"{r['n_nationkey'] / 8:.3f}") for r in rows]))
    square = lambda k: [[(k, 0.0), (k, k + 1.0), (k + 2.0, k + 1.0), (k + 2.0, 0.0), (k, 0.0)]]
    put(spark, f"{to}/n.shp", shp_bytes([None if r["n_nationkey"] == 4 else square(float(r["n_nationkey"])) for r in rows]))
    return f"{to}/n"


@query("sc7_shapefile", 'SELECT CAST(n_nationkey AS BIGINT) AS "KEY", CASE WHEN n_nationkey <> 4 THEN 2.0 * (n_nationkey + 1) END::DOUBLE AS area FROM nation')
def _(spark, sf):
    return S.read_shapefile(spark, _shapefile(spark, sf), ["KEY"]).select("KEY", G.area(G.wkb_rings("wkb")).alias("area"))


@query("sc8_shapefile_attributes", 'SELECT CAST(n_nationkey AS BIGINT) AS "KEY", n_name AS "NAME", CASE WHEN n_nationkey <> 3 THEN n_nationkey / 8 END AS "Summer_day" FROM nation')
def _(spark, sf):
    return S.read_shapefile(spark, _shapefile(spark, sf), geometry=False)


def _stems(spark: SparkSession, sf: str) -> list[str]:
    """A shapefile of customers per 500 keys, each written by a task: squares, with a hole where the key is even; every seventh shape is null, every tenth record deleted."""
    to = folder(spark)

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("c_custkey")
        square = lambda k: [(k, 0.0), (k, 5.0), (k + 4.0, 5.0), (k + 4.0, 0.0), (k, 0.0)]
        hole = lambda k: [(k + 1.0, 1.0), (k + 2.0, 1.0), (k + 2.0, 2.0), (k + 1.0, 2.0), (k + 1.0, 1.0)]
        keys = pdf["c_custkey"].tolist()
        rings = [None if k % 7 == 3 else [square(float(k)), hole(float(k))] if k % 2 == 0 else [square(float(k))] for k in keys]
        rows = [("*" if k % 10 == 9 else " ", k, n, f"{b:.2f}") for k, n, b in zip(keys, pdf["c_name"], pdf["c_acctbal"], strict=True)]
        stem = f"{to}/customers-{int(pdf['file'].iloc[0])}"
        written(f"{stem}.dbf", dbf_bytes([("KEY", "N", 12, 0), ("NAME", "C", 25, 0), ("BALANCE", "N", 14, 2)], rows))
        written(f"{stem}.shp", shp_bytes(rings))
        written(f"{stem}.shx", shx_bytes(rings))
        return pd.DataFrame({"stem": [stem]})

    rows = t(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", F.floor(F.col("c_custkey") / 500).alias("file"))
    # A stated number of partitions: few bytes would otherwise be written by one task. One name per file reaches the driver, which plans the scan.
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file")
    return sorted(r["stem"] for r in rows.groupBy("file").applyInPandas(write, "stem string").collect())


@query("sc7_shapefile_ranges", 'SELECT CAST(c_custkey AS BIGINT) AS "KEY", CAST(c_acctbal AS DOUBLE) AS "BALANCE", CASE WHEN c_custkey % 7 <> 3 THEN 20.0 - CAST(c_custkey % 2 = 0 AS INTEGER) END::DOUBLE AS area, CASE WHEN c_custkey % 7 <> 3 THEN c_custkey END::DOUBLE AS x0 FROM customer WHERE c_custkey % 10 <> 9')
def _(spark, sf):
    rows = RG.scan_shapefile(spark, _stems(spark, sf), ["KEY", "BALANCE"], boxes=True, records=64)
    return rows.select("KEY", "BALANCE", G.area(G.wkb_rings("wkb")).alias("area"), "x0")


@query("sc8_shapefile_box", "SELECT c_name AS \"NAME\" FROM customer WHERE c_custkey % 10 <> 9 AND c_custkey % 7 <> 3 AND c_custkey + 4 >= (SELECT max(c_custkey) FROM customer) / 2 AND c_custkey <= (SELECT max(c_custkey) FROM customer) * 0.9")
def _(spark, sf):
    """The box test is pushed to the scan, which skips records by their heads."""
    top = t(spark, sf, "customer").agg(F.max("c_custkey")).first()[0]
    rows = RG.scan_shapefile(spark, _stems(spark, sf), ["NAME"], geometry=False, boxes=True, records=64)
    return rows.where((F.col("x1") >= float(top / 2)) & (F.col("x0") <= float(top * 0.9))).select("NAME")


@query("sc9_dbf_header", "SELECT count(*) AS records, 3 AS fields, 'KEY:N:6:0' AS first FROM nation")
def _(spark, sf):
    data = S.binary(spark, f"{_shapefile(spark, sf)}.dbf").select(F.substring("content", 1, 1 << 16).alias("h")).first()["h"]
    info = S.dbf_header(bytes(data))
    return spark.createDataFrame([(info["records"], len(info["fields"]), ":".join(map(str, info["fields"][0])))], "records long, fields int, first string")


def _raster(spark: SparkSession, sf: str) -> DataFrame:
    keys = np.array([r["n_nationkey"] for r in nations(spark, sf)], float)
    grid = np.where(keys == 7, -9999.0, keys).reshape(5, 5)
    return S.binary(spark, put(spark, f"{folder(spark)}/r.tif", tiff_bytes(grid, 10.0, 50.0, 0.5, 0.5)))


@query("sc13_tiff_tags", "SELECT true AS ok, 5::BIGINT AS width, 5::BIGINT AS height, 10.0::DOUBLE AS x0, 50.0::DOUBLE AS y0, 0.5::DOUBLE AS dx, -9999.0::DOUBLE AS nodata")
def _(spark, sf):
    return S.raster_metadata(_raster(spark, sf)).select("ok", "width", "height", "x0", "y0", "dx", "nodata")


@query("sc14_raster_pixels", "SELECT CAST(n_nationkey // 5 AS BIGINT) AS row, CAST(n_nationkey % 5 AS BIGINT) AS col, 10 + (n_nationkey % 5 + 0.5) * 0.5::DOUBLE AS x, 50 - (n_nationkey // 5 + 0.5) * 0.5::DOUBLE AS y, CASE WHEN n_nationkey <> 7 THEN n_nationkey END::DOUBLE AS value FROM nation")
def _(spark, sf):
    return S.raster_pixels(_raster(spark, sf)).drop("path")


_ROWS, _COLUMNS = 150, 220


@query(
    "sc14_raster_blocks",
    """WITH g AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(o_custkey % 150 AS BIGINT) AS row, CAST(o_orderkey % 220 AS BIGINT) AS col, count(*) AS n FROM orders GROUP BY 1, 2, 3),
    w AS (SELECT year, r.row, c.col FROM (SELECT DISTINCT year FROM g), range(10, 130, 3) r(row), range(7, 200, 3) c(col))
    SELECT w.year, w.row, w.col, CAST(10 + (w.col + 0.5) * 0.5 AS DOUBLE) AS x, CAST(50 - (w.row + 0.5) * 0.25 AS DOUBLE) AS y, CAST(n AS DOUBLE) AS value FROM w LEFT JOIN g USING (year, row, col)""",
)
def _(spark, sf):
    """Orders per cell and year as tiled, deflated rasters with a predictor, each written by a task; every third pixel of a window is read back, from the tiles that hold one."""
    to = folder(spark)
    cells = t(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year"), (F.col("o_custkey") % _ROWS).cast("int").alias("row"), (F.col("o_orderkey") % _COLUMNS).cast("int").alias("col")).agg(F.count(F.lit(1)).alias("n"))

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        year, grid = int(pdf["year"].iloc[0]), np.full((_ROWS, _COLUMNS, 1), -9999, np.int32)
        grid[pdf["row"], pdf["col"], 0] = pdf["n"]
        written(f"{to}/{year}.tif", tiled_tiff_bytes(grid, 10.0, 50.0, 0.5, 0.25, (32, 48), 8, 2))
        return pd.DataFrame({"year": [year]})

    out = None
    for year in sorted(r["year"] for r in cells.groupBy("year").applyInPandas(write, "year int").collect()):
        own = RG.scan_raster(spark, f"{to}/{year}.tif", window=(10, 7, 130, 200), every=3, blocks=2).withColumn("year", F.lit(year))
        out = own if out is None else out.unionByName(own)
    return out.select("year", "row", "col", "x", "y", "value")


def _archives(spark: SparkSession, sf: str) -> list[str]:
    """An archive per 400 suppliers, each written by a task, a member per supplier."""
    to = folder(spark)

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        made = io.BytesIO()
        with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as z:
            for key, name in sorted(zip(pdf["s_suppkey"], pdf["s_name"], strict=True)):
                z.writestr(f"d/{key}.txt", name * 3)
        return pd.DataFrame({"path": [written(f"{to}/{int(pdf['file'].iloc[0])}.zip", made.getvalue())]})

    rows = t(spark, sf, "supplier").select("s_suppkey", "s_name", F.floor(F.col("s_suppkey") / 400).alias("file"))
    return sorted(r["path"] for r in rows.groupBy("file").applyInPandas(write, "path string").collect())


@query("sc15_archive_members", "SELECT 'd/' || CAST(s_suppkey AS VARCHAR) || '.txt' AS name, CAST(3 * length(s_name) AS BIGINT) AS size, true AS ok, sha256(repeat(s_name, 3)) AS sha256 FROM supplier")
def _(spark, sf):
    return RG.scan_archives(spark, _archives(spark, sf), members=50).select("name", "size", "ok", "sha256")


@query("sc20_streamed_digests", "SELECT CAST(s_suppkey // 400 AS BIGINT) AS file, count(*) AS members, true AS same FROM supplier GROUP BY 1")
def _(spark, sf):
    """Digests of whole files, read in chunks, against those of their contents as one value."""
    paths = _archives(spark, sf)
    name = lambda c: F.regexp_extract(c, r"([0-9]+)\.zip$", 1).cast("long")
    streamed = RG.file_digests(spark, paths).select(name(F.col("path")).alias("file"), "sha256")
    whole = S.binary(spark, paths).select(name(F.col("path")).alias("file"), F.sha2("content", 256).alias("_whole"))
    members = RG.scan_archives(spark, paths).groupBy(name(F.col("path")).alias("file")).agg(F.count(F.lit(1)).alias("members"))
    return streamed.join(whole, "file").join(members, "file").select("file", "members", (F.col("sha256") == F.col("_whole")).alias("same"))


def _archive(spark: SparkSession, sf: str) -> DataFrame:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for r in nations(spark, sf):
            z.writestr(f"d/{r['n_name']}.txt", r["n_name"] * 3)
    return S.binary(spark, put(spark, f"{folder(spark)}/a.zip", out.getvalue()))


@query("sc15_zip_members", "SELECT 'd/' || n_name || '.txt' AS name, CAST(3 * length(n_name) AS BIGINT) AS size, true AS ok FROM nation")
def _(spark, sf):
    return S.archive_members(_archive(spark, sf)).select("name", "size", "ok")


@query("sc20_verify_files", 'SELECT * FROM (VALUES (\'size\', true), (\'sha256\', false), (\'zip\', true), (\'exists\', false)) v("check", ok)')
def _(spark, sf):
    return S.verify_files(_archive(spark, sf), {"a.zip": "0" * 64}, expected=["a.zip", "b.zip"]).select("check", "ok")


def _geopackage(spark: SparkSession, sf: str) -> str:
    """Layers of nations: boundaries with places, a climate layer that lacks every fifth, points, and a table without geometry."""
    rows = nations(spark, sf)
    square = lambda k: S.wkb([[[(k, 0.0), (k, k + 1.0), (k + 2.0, k + 1.0), (k + 2.0, 0.0), (k, 0.0)]]])
    layers = {
        "uc_boundaries": ("MULTIPOLYGON", [("ID", "INTEGER"), ("name", "TEXT"), ("region", "MEDIUMINT"), ("area", "REAL")], [(r["n_nationkey"], r["n_name"], r["n_regionkey"], r["n_nationkey"] / 4, square(float(r["n_nationkey"]))) for r in rows]),
        "climate": ("MULTIPOLYGON", [("ID", "INTEGER"), ("temp", "DOUBLE")], [(r["n_nationkey"], r["n_nationkey"] / 8, None) for r in rows if r["n_nationkey"] % 5]),
        "centres": ("POINT", [("ID", "INTEGER")], []), "notes": ("", [("ID", "INTEGER"), ("note", "TEXT")], [(1, "x")]), "other_boundaries": ("POLYGON", [("code", "TEXT")], []),
    }
    return put(spark, f"{folder(spark)}/a.gpkg", gpkg_bytes(layers))


@query("sc1_gpkg_scan", 'SELECT CAST(n_nationkey AS BIGINT) AS "ID", n_name AS name, n_nationkey / 4 AS area FROM nation')
def _(spark, sf):
    return K.read_layer(spark, _geopackage(spark, sf), "uc_boundaries", ["ID", "name", "area"])


@query("sc6_climate_layer", 'SELECT CAST(n_nationkey AS BIGINT) AS "ID", n_name AS name, CASE WHEN n_nationkey % 5 <> 0 THEN n_nationkey / 8 END AS temp FROM nation')
def _(spark, sf):
    path = _geopackage(spark, sf)
    return K.read_layer(spark, path, "uc_boundaries", ["ID", "name"]).join(K.read_layer(spark, path, "climate", ["ID", "temp"]), "ID", "left")


@query("sc10_polygon_layers", "SELECT * FROM (VALUES ('climate', 'MULTIPOLYGON', true, false), ('other_boundaries', 'POLYGON', false, false), ('uc_boundaries', 'MULTIPOLYGON', true, true)) v(layer, type, has_id, best)")
def _(spark, sf):
    path = _geopackage(spark, sf)
    best = K.best_layer(path, "ID")
    rows = [(x["layer"], x["type"], "ID" in x["columns"], x["layer"] == best) for x in K.layers(path) if "POLYGON" in x["type"]]
    return spark.createDataFrame(rows, "layer string, type string, has_id boolean, best boolean")


@query("sc11_polygon_subset", 'SELECT CAST(n_nationkey AS BIGINT) AS "ID", 2.0 * (n_nationkey + 1)::DOUBLE AS area FROM nation WHERE n_regionkey = 2')
def _(spark, sf):
    path = _geopackage(spark, sf)
    ids = K.read_layer(spark, path, "uc_boundaries", ["ID", "region"]).where("region = 2")
    return K.polygons_of(spark, path, "uc_boundaries", "ID", ids).select("ID", G.area(G.wkb_rings("wkb")).alias("area"))


@query(
    "sc16_completeness",
    """SELECT lower(c_mktsegment) || '_' || CAST(c_custkey AS VARCHAR) AS stem, c_custkey % 7 <> 0 AS complete, CASE WHEN c_custkey % 7 = 0 THEN ['.dbf'] ELSE []::VARCHAR[] END AS missing, CASE WHEN c_custkey % 3 = 0 THEN ['.prj'] ELSE []::VARCHAR[] END AS optional
    FROM customer""",
)
def _(spark, sf):
    k = F.col("c_custkey")
    stem = F.concat(F.col("c_mktsegment"), F.lit("_"), k.cast("string"))
    ends = F.array_compact(F.array(F.lit(".SHP"), F.lit(".shx"), F.when(k % 7 != 0, ".Dbf"), F.when(k % 3 == 0, ".prj"), F.lit(".txt")))
    return A.completeness(t(spark, sf, "customer").select(stem.alias("stem"), F.explode(ends).alias("end")).select(F.concat("stem", "end").alias("name")))


@query("sc21_result_documents", "SELECT r_name AS stage, CAST(count(*) AS BIGINT) AS n, CAST(min(n_nationkey) AS DOUBLE) / 4 AS low FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def _(spark, sf):
    to, rows = folder(spark), t(spark, sf, "nation").join(t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count(F.lit(1)).alias("n"), F.min("n_nationkey").alias("low"))
    for i, r in enumerate(rows.orderBy("r_name").collect()):
        put(spark, f"{to}/{i}.json", json.dumps({"stage": r["r_name"], "figures": {"n": r["n"], "low": r["low"] / 4}, "more": [1]}, indent=1).encode())
    return S.read_result(spark, to, "stage string, figures struct<n: long, low: double>").select("stage", "figures.n", "figures.low")


@query("sk1_csv", "SELECT r_name AS name, CAST(r_regionkey AS VARCHAR) AS key FROM region")
def _(spark, sf):
    path = f"{folder(spark)}/out"
    W.write_csv(t(spark, sf, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("key")), path)
    return spark.read.option("header", True).csv(path)


@query("sk2_json", "SELECT CAST(r_regionkey AS BIGINT) AS key, r_name AS name FROM region")
def _(spark, sf):
    path = f"{folder(spark)}/out"
    W.write_json(t(spark, sf, "region").select(F.col("r_regionkey").alias("key"), F.struct("r_name").alias("more")), path)
    return spark.read.json(path).select("key", F.col("more.r_name").alias("name"))


@query("sk3_dict_rows", "SELECT CAST(s_suppkey AS VARCHAR) AS key, s_name AS name, NULL AS note FROM supplier")
def _(spark, sf):
    """Exactly the fields asked for, in their order; one that rows don't have is empty."""
    path = f"{folder(spark)}/out"
    W.write_csv(t(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("more")), path, ["key", "name", "note"], single=False)
    return spark.read.option("header", True).csv(path)


@query("sk6_markers", "SELECT n_regionkey AS run, CASE WHEN n_regionkey % 2 = 0 THEN 'DONE' ELSE 'FAILED' END AS marker, count(*) AS nations FROM nation GROUP BY 1")
def _(spark, sf):
    """A run per region clears the markers of one before it and leaves its own."""
    to, rows = folder(spark), t(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("run")).agg(F.count(F.lit(1)).alias("nations"))
    runs = [r["run"] for r in rows.orderBy("run").collect()]
    for run in runs:
        W.end_run(spark, f"{to}/{run}", None if run % 2 else "an earlier run")
        W.start_run(spark, f"{to}/{run}")
        W.end_run(spark, f"{to}/{run}", "it failed" if run % 2 else None)
    found = S.binary(spark, [f"{to}/{run}" for run in runs]).select(F.element_at(F.split("path", "/"), -2).cast("int").alias("run"), F.element_at(F.split("path", "/"), -1).alias("marker"))
    return found.join(rows, "run")


@query("sk7_refused_folder", "SELECT r_name AS name, count(*) OVER () AS kept, true AS refused FROM region")
def _(spark, sf):
    """A second run into the folder of a first one is refused, and the first one's rows stay."""
    path, rows = f"{folder(spark)}/out", t(spark, sf, "region").select(F.col("r_name").alias("name"))
    W.write_csv(rows, path)
    try:
        W.write_csv(t(spark, sf, "nation").select(F.col("n_name").alias("name")), path)
        refused = False
    except AnalysisException:
        refused = True
    kept = spark.read.option("header", True).csv(path)
    return kept.join(F.broadcast(kept.agg(F.count(F.lit(1)).alias("kept")))).withColumn("refused", F.lit(refused))


@query("sk9_frozen_hashes", "SELECT CAST(s_suppkey // 400 AS VARCHAR) || '.zip' AS name, s_suppkey // 400 = 0 AS changed FROM supplier GROUP BY ALL")
def _(spark, sf):
    """Archives are sealed, one is written anew, and the check before a run names it."""
    paths, marker = _archives(spark, sf), f"{folder(spark)}/seal"
    W.seal(spark, paths, marker)
    W.assert_sealed(spark, paths, marker)
    written(next(p for p in paths if p.endswith("/0.zip")), b"changed since")
    try:
        W.assert_sealed(spark, paths, marker)
        said = ""
    except RuntimeError as e:
        said = str(e)
    return spark.read.schema("name string, sha256 string").json(marker).select("name", F.lit(said).contains(F.concat(F.lit("'"), "name", F.lit("'"))).alias("changed"))


@query("sc22_period_columns", "SELECT CAST(o_orderdate AS VARCHAR)[1:4] AS period, 'day' AS diurnal, CAST(o_orderdate AS VARCHAR)[1:4] || '_day' AS found, count(*) AS n FROM orders GROUP BY ALL")
def _(spark, sf):
    """Of the columns that the years of the orders make, exactly one answers to each period by day."""
    years = t(spark, sf, "orders").groupBy(F.year("o_orderdate").cast("string").alias("period")).agg(F.count(F.lit(1)).alias("n"))
    # One row per year.
    names = [r["period"] for r in years.select("period").collect()]
    columns = [f"{y}_{d}" for y in names for d in ("day", "night")] + ["id"]
    found = spark.createDataFrame([(y, "day", S.only_response_column(columns, y, "day")) for y in names], "period string, diurnal string, found string")
    return found.join(years, "period")


@query("so4_column_subsets", "SELECT n_name AS name, n_nationkey % 3 <> 0 AS complete FROM nation")
def _(spark, sf):
    """Headers of tables, one per nation, that hold all required columns or don't."""
    to = folder(spark)
    for r in nations(spark, sf):
        put(spark, f"{to}/{r['n_name']}.csv", ("id,name,area\n1,a,2\n" if r["n_nationkey"] % 3 else "id,area\n1,2\n").encode())
    checked = S.verify_files(S.binary(spark, to, "*.csv"), required_columns=["id", "name"]).where(F.col("check") == "columns")
    return checked.select(F.regexp_extract("path", r"([^/]+)\.csv$", 1).alias("name"), F.col("ok").alias("complete")).withColumn("name", F.regexp_replace("name", "%20", " "))


@query("sk4_markdown", "SELECT 0 AS line, '| r_name |' AS text UNION ALL SELECT 1, '|---|' UNION ALL SELECT CAST(row_number() OVER (ORDER BY r_name) + 1 AS INTEGER), '| ' || r_name || ' |' FROM region")
def _(spark, sf):
    return W.markdown(t(spark, sf, "region").select("r_name"), ["r_name"])


@query("sk8_seal", "SELECT 'a.csv' AS name, sha256('name' || chr(10) || (SELECT string_agg(n_name, chr(10) ORDER BY n_nationkey) FROM nation)) AS sha256")
def _(spark, sf):
    path = lines(spark, sf, "a.csv", "name", lambda r: r["n_name"])
    marker = f"{folder(spark)}/seal"
    W.seal(spark, [path], marker)
    W.assert_sealed(spark, [path], marker)
    return spark.read.schema("name string, sha256 string").json(marker)
