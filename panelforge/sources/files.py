"""File decoding: DBF, shapefiles, TIFF headers and pixels, ZIP archives, checks of files, text tables.

Bytes come through Spark's readers (`binaryFile`, `csv`), so any store Spark reaches will do; decoding runs on the workers.
"""

from __future__ import annotations

import io
import os
import re
import struct
import zipfile
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.functions.scalars import parse_flag, parse_number, repair_mojibake

# ------------------------------------------------------------------ DBF and shapefiles


#: The layout of a DBF's head and of its field descriptors, 32 bytes each, and the byte that ends the descriptors.
_DBF_HEAD = np.dtype([("version", "u1"), ("changed", "u1", 3), ("records", "<u4"), ("header", "<u2"), ("record", "<u2"), ("reserved", "V20")])
_DBF_FIELD = np.dtype([("name", "V11"), ("kind", "S1"), ("address", "<u4"), ("width", "u1"), ("decimals", "u1"), ("reserved", "V14")])
_DBF_END = 0x0D


def dbf_header(data: bytes) -> dict:
    """Record count, header and record sizes, fields as (name, type, width, decimals)."""
    if len(data) <= _DBF_HEAD.itemsize:
        raise ValueError("not a DBF: too short")
    head = np.frombuffer(data, _DBF_HEAD, count=1)[0]
    area = np.frombuffer(data[_DBF_HEAD.itemsize : int(head["header"])], np.uint8)
    whole = len(area) // _DBF_FIELD.itemsize
    # Descriptors start at whole steps, so the end mark counts only there.
    marks = np.flatnonzero(area[:: _DBF_FIELD.itemsize] == _DBF_END)
    table = area[: _DBF_FIELD.itemsize * min([whole, *marks[:1].tolist()])].view(_DBF_FIELD)
    if not len(table):
        raise ValueError("not a DBF: no fields")
    name = lambda f: f["name"].tobytes().partition(bytes(1))[0].decode("latin-1")
    return {
        "records": int(head["records"]), "header": int(head["header"]), "size": int(head["record"]),
        "fields": [(name(f), f["kind"].decode("latin-1"), int(f["width"]), int(f["decimals"])) for f in table],
    }


def dbf_rows(data: bytes, columns: Sequence[str] | None = None, encoding: str = "utf-8") -> Iterator[dict]:
    """Records as typed values; deleted ones are left out; blank and overflowing numbers are None."""
    info = dbf_header(data)
    names = [n for n, *_ in info["fields"] if columns is None or n in columns]
    records = data[info["header"] : info["header"] + info["records"] * info["size"]]
    if len(records) < info["records"] * info["size"]:
        raise ValueError("DBF ends within a record")
    for _, row in dbf_records(records, info, columns, encoding):
        yield dict(zip(names, row, strict=True))


def dbf_records(data: bytes, info: dict, columns: Sequence[str] | None = None, encoding: str = "utf-8", keep: Sequence[bool] | None = None) -> Iterator[tuple[int, tuple]]:
    """(number, typed values) of whole records that lie one after the other in `data`, without deleted ones and those not to keep."""
    places, at = [], 1
    for name, kind, width, decimals in info["fields"]:
        if columns is None or name in columns:
            places.append((slice(at, at + width), kind, decimals))
        at += width
    for i in range(len(data) // info["size"]):
        own = data[i * info["size"] : (i + 1) * info["size"]]
        if own[0] != 42 and (keep is None or keep[i]):
            yield i, tuple(_dbf_value(own[s].decode(encoding, "replace").strip("\0 ").strip(), kind, decimals) for s, kind, decimals in places)


def _dbf_value(said: str, kind: str, decimals: int):
    if kind in "NF":
        try:
            return (int(said) if kind == "N" and not decimals else float(said)) if said else None
        except ValueError:
            return None
    if kind == "L":
        return {"T": True, "Y": True, "F": False, "N": False}.get(said[:1].upper())
    return said or None


def dbf_schema(info: dict, columns: Sequence[str] | None = None) -> str:
    kind = lambda t, d: "boolean" if t == "L" else ("double" if d or t == "F" else "long") if t in "NF" else "string"
    return ", ".join(f"`{n}` {kind(t, d)}" for n, t, _, d in info["fields"] if columns is None or n in columns)


def shapes(data: bytes) -> Iterator[bytes | None]:
    """WKB of each polygon record: one multipolygon part per outer ring, holes with the ring before them; None for null shapes."""
    if len(data) < 100 or struct.unpack_from(">i", data)[0] != 9994:
        raise ValueError("not a shapefile")
    at = 100
    while at + 8 <= len(data):
        words = struct.unpack_from(">ii", data, at)[1]
        body = data[at + 8 : at + 8 + 2 * words]
        at += 8 + 2 * words
        yield polygon_wkb(body)


def polygon_wkb(body: bytes) -> bytes | None:
    """WKB of one polygon record's content."""
    kind = struct.unpack_from("<i", body)[0]
    if kind == 0:
        return None
    if kind not in (5, 15, 25):
        raise ValueError(f"shape type {kind} is not a polygon")
    parts, points = struct.unpack_from("<ii", body, 36)
    starts = [*struct.unpack_from(f"<{parts}i", body, 44), points]
    flat = struct.unpack_from(f"<{2 * points}d", body, 44 + 4 * parts)
    polygons: list[list] = []
    for a, b in zip(starts, starts[1:], strict=False):
        ring = [(flat[2 * i], flat[2 * i + 1]) for i in range(a, b)]
        turn = sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:], strict=False))
        if turn <= 0 or not polygons:
            polygons.append([ring])
        else:
            polygons[-1].append(ring)
    return wkb(polygons)


def wkb(polygons: list) -> bytes:
    part = lambda rings: struct.pack("<BII", 1, 3, len(rings)) + b"".join(struct.pack("<I", len(r)) + struct.pack(f"<{2 * len(r)}d", *[c for p in r for c in p]) for r in rings)
    return part(polygons[0]) if len(polygons) == 1 else struct.pack("<BII", 1, 6, len(polygons)) + b"".join(map(part, polygons))


def binary(spark: SparkSession, path: str | Sequence[str], glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path if isinstance(path, str) else list(path))


def read_shapefile(spark: SparkSession, stem: str, columns: Sequence[str] | None = None, geometry: bool = True, encoding: str = "utf-8") -> DataFrame:
    """Records of `stem`.dbf, with a `wkb` column from `stem`.shp unless `geometry` is off. The schema comes from the DBF's header.

    The two files meet in one row, for their records pair by place; the format's 32-bit offsets bound either at 2 GB."""
    head = binary(spark, f"{stem}.dbf").select(F.substring("content", 1, 1 << 16).alias("h")).first()
    info = dbf_header(bytes(head["h"]))
    if columns is not None and (gone := set(columns) - {f[0] for f in info["fields"]}):
        raise ValueError(f"missing columns: {sorted(gone)}")
    schema = dbf_schema(info, columns) + (", wkb binary" if geometry else "")
    names = [n for n, *_ in info["fields"] if columns is None or n in columns] + ["wkb"] * geometry
    both = binary(spark, [f"{stem}.dbf"] + [f"{stem}.shp"] * geometry).groupBy().agg(F.max(F.when(F.lower("path").endswith(".dbf"), F.col("content"))).alias("dbf"), F.max(F.when(F.lower("path").endswith(".shp"), F.col("content"))).alias("shp"))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for d, s in zip(pdf["dbf"], pdf["shp"], strict=True):
                rows = list(dbf_rows(bytes(d), columns, encoding))
                if geometry:
                    for row, g in zip(rows, shapes(bytes(s)), strict=True):
                        row["wkb"] = g
                yield pd.DataFrame(rows, columns=names).astype(object).where(lambda x: x.notna(), None)

    return both.mapInPandas(run, schema)


# ------------------------------------------------------------------ TIFF

TIFF_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
TIFF_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
#: The tags that describe a grid and its layout.
TAGS = {256: "width", 257: "height", 258: "bits", 259: "compression", 262: "photometric", 273: "strip_offsets", 277: "bands", 278: "rows_per_strip", 279: "strip_bytes", 284: "planar", 317: "predictor", 322: "tile_width", 323: "tile_height", 324: "tile_offsets", 325: "tile_bytes", 339: "sample_format", 33550: "pixel_scale", 33922: "tiepoint", 34735: "geo_keys", 42112: "metadata", 42113: "nodata"}


def tiff_tags(data: bytes) -> dict:
    """Selected tags of the first directory of a classic TIFF, of either byte order. Tags whose values lie beyond the bytes given are left out; other files, and a
    directory beyond the bytes, raise."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8:
        raise ValueError("not a TIFF")
    magic, at = struct.unpack_from(order + "HI", data, 2)
    if magic == 43:
        raise ValueError("BigTIFF is not supported")
    if magic != 42:
        raise ValueError("not a TIFF")
    if at + 2 > len(data):
        raise ValueError("the directory lies beyond the bytes given")
    n = struct.unpack_from(order + "H", data, at)[0]
    if at + 2 + 12 * n > len(data):
        raise ValueError("the directory lies beyond the bytes given")
    out = {"order": order}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        if tag not in TAGS or kind not in TIFF_SIZES:
            continue
        size = TIFF_SIZES[kind] * count
        where = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * i)[0]
        if where + size > len(data):
            continue
        if kind in (2, 7):
            out[TAGS[tag]] = data[where : where + count].rstrip(b"\0").decode("latin-1")
        elif kind in TIFF_CODES:
            values = struct.unpack_from(f"{order}{count}{TIFF_CODES[kind]}", data, where)
            out[TAGS[tag]] = values[0] if count == 1 else list(values)
    return out


def grid_of(tags: dict) -> dict:
    scale, tie = tags.get("pixel_scale"), tags.get("tiepoint")
    out = {"width": tags.get("width"), "height": tags.get("height"), "dx": None, "dy": None, "x0": None, "y0": None}
    if scale and tie:
        out |= {"dx": scale[0], "dy": scale[1], "x0": tie[3] - tie[0] * scale[0], "y0": tie[4] + tie[1] * scale[1]}
    return out


_META = "path string, ok boolean, error string, width long, height long, x0 double, y0 double, dx double, dy double, bands long, bits long, compression long, nodata double, metadata string, crs string"


def raster_metadata(files: DataFrame, prefix: int = 1 << 16) -> DataFrame:
    """One row per raster file, from its first bytes only."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _META.split(", ")]
        for pdf in it:
            rows = []
            for path, head in zip(pdf["path"], pdf["head"], strict=True):
                row = dict.fromkeys(names) | {"path": path, "ok": True}
                try:
                    tags = tiff_tags(bytes(head))
                    first = lambda v: v[0] if isinstance(v, list) else v
                    keys = tags.get("geo_keys") or []
                    codes = [keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i] in (2048, 3072)]
                    try:
                        gone = float(tags["nodata"])
                    except (KeyError, ValueError):
                        gone = None
                    row |= grid_of(tags) | {"bands": tags.get("bands", 1), "bits": first(tags.get("bits")), "compression": tags.get("compression", 1), "nodata": gone, "metadata": tags.get("metadata"), "crs": f"EPSG:{codes[-1]}" if codes else None}
                except ValueError as e:
                    row |= {"ok": False, "error": str(e)}
                rows.append(row)
            yield pd.DataFrame(rows, columns=names).astype(object).where(lambda x: x.notna(), None)

    return files.select("path", F.substring("content", 1, prefix).alias("head")).mapInPandas(run, _META)


def raster_pixels(files: DataFrame, every: int = 1) -> DataFrame:
    """(path, row, col, x, y, value) of uncompressed one-band strips, or of every n-th row and column; no-data values are NULL. Compressed files raise."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                data = bytes(content)
                t = tiff_tags(data)
                if t.get("compression", 1) != 1 or t.get("bands", 1) != 1 or "tile_width" in t:
                    raise ValueError(f"{path}: only uncompressed strips of one band are supported")
                bits = t["bits"][0] if isinstance(t["bits"], list) else t["bits"]
                kind = {1: "u", 2: "i", 3: "f"}[t.get("sample_format", 1)]
                as_list = lambda v: v if isinstance(v, list) else [v]
                raw = b"".join(data[o : o + n] for o, n in zip(as_list(t["strip_offsets"]), as_list(t["strip_bytes"]), strict=True))
                grid, g = np.frombuffer(raw, f"{t['order']}{kind}{bits // 8}").astype(float).reshape(t["height"], t["width"]), grid_of(t)
                if t.get("nodata"):
                    grid[grid == float(t["nodata"])] = np.nan
                r, c = (v.ravel() for v in np.meshgrid(np.arange(0, t["height"], every), np.arange(0, t["width"], every), indexing="ij"))
                dx, dy, x0, y0 = (g["dx"] or 1.0, g["dy"] or 1.0, g["x0"] or 0.0, g["y0"] if g["y0"] is not None else 0.0)
                yield pd.DataFrame({"path": path, "row": r, "col": c, "x": x0 + (c + 0.5) * dx, "y": y0 - (r + 0.5) * dy, "value": grid[r, c]})

    return files.select("path", "content").mapInPandas(run, "path string, row long, col long, x double, y double, value double").withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def value_diagnostic(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("path").agg(F.count("value").alias("n_valid"), F.min("value").alias("min"), F.percentile("value", F.lit(0.5)).alias("median"), F.max("value").alias("max"))


# ------------------------------------------------------------------ archives


def archive_members(files: DataFrame) -> DataFrame:
    """(path, name, size, crc, ok): members of each ZIP, each read through to test its checksum; a file that is no ZIP gives one row with a NULL name."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                        for m in z.infolist():
                            if m.is_dir():
                                continue
                            try:
                                with z.open(m) as f:
                                    while f.read(1 << 20):
                                        pass
                                ok = True
                            except (zipfile.BadZipFile, OSError, ValueError, RuntimeError):
                                ok = False
                            rows.append((path, m.filename, m.file_size, m.CRC, ok))
                except (zipfile.BadZipFile, ValueError):
                    rows.append((path, None, None, None, False))
            yield pd.DataFrame(rows, columns=["path", "name", "size", "crc", "ok"]).astype(object)

    return files.select("path", "content").mapInPandas(run, "path string, name string, size long, crc long, ok boolean")


def extract_flat(archive: str, members: Sequence[str], to: str) -> list[str]:
    """Members of a local archive into one folder; absolute names and those that climb out are refused. A utility of the driver."""
    out = []
    with zipfile.ZipFile(archive) as z:
        for name in members:
            parts = re.split(r"[/\\]", name)
            if name.startswith(("/", "\\")) or re.match(r"^[A-Za-z]:", name) or ".." in parts:
                raise ValueError(f"unsafe member name: {name}")
            path = os.path.join(to, parts[-1])
            with z.open(name) as source, open(path, "wb") as f:
                while chunk := source.read(1 << 20):
                    f.write(chunk)
            out.append(path)
    return out


# ------------------------------------------------------------------ text tables


def read_csv(spark: SparkSession, path: str, encoding: str = "UTF-8", columns: Sequence[str] | None = None) -> DataFrame:
    """CSV with a header whose names are trimmed; all columns as text."""
    df = spark.read.option("header", True).option("encoding", encoding).csv(path)
    df = df.toDF(*[c.strip() for c in df.columns])
    if columns is not None and (gone := set(columns) - set(df.columns)):
        raise ValueError(f"missing columns: {sorted(gone)}")
    return df if columns is None else df.select(*columns)


def read_result(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents of an earlier stage, one a file over any number of lines; a document that doesn't parse, or lacks all of the fields, raises."""
    found = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    if not found.where(F.coalesce(*[F.col(c).cast("string") for c in found.columns]).isNull()).isEmpty():
        raise ValueError(f"a document of {path} has none of the fields")
    return found


def read_registry(spark: SparkSession, path: str, texts: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """A Latin-1 table: texts repaired, numbers with thousands commas parsed."""
    df = read_csv(spark, path, "ISO-8859-1", [*texts, *numbers])
    return df.select(*[repair_mojibake(F.col(f"`{c}`")).alias(c) for c in texts], *[parse_number(F.col(f"`{c}`")).alias(c) for c in numbers])


def read_links(spark: SparkSession, path: str, longs: Sequence[str], doubles: Sequence[str], flags: Sequence[str], texts: Sequence[str], kind: str = "object_type", keep: str = "link") -> DataFrame:
    """Rows of one kind from a mixed table, columns projected and typed."""
    df = read_csv(spark, path, columns=[kind, *longs, *doubles, *flags, *texts]).where(F.col(kind) == keep)
    return df.select(*[F.col(c).try_cast("double").cast("long").alias(c) for c in longs], *[F.col(c).try_cast("double").alias(c) for c in doubles], *[parse_flag(F.col(c)).alias(c) for c in flags], *texts)


def only_response_column(columns: Sequence[str], period: str, diurnal: str) -> str:
    """The one column of that period and part of the day; raises unless there is exactly one."""
    found = [c for c in columns if re.fullmatch(rf"{period}_{diurnal}(?:ht)?", c, re.I)]
    if len(found) != 1:
        raise ValueError(f"{len(found)} columns for {period} {diurnal}: {found}")
    return found[0]


def verify_files(files: DataFrame, expected_sha256: dict[str, str] | None = None, least_bytes: int = 1, required_columns: Sequence[str] = (), expected: Sequence[str] = ()) -> DataFrame:
    """(path, check, ok, error): size, digest, and by extension the CSV header and rows, ZIP integrity, DBF columns. Names in `expected` that aren't among the files, or
    are empty (Spark's readers skip empty files), fail the check `exists`."""
    known = expected_sha256 or {}

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for pdf in it:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                data, name = bytes(content), path.rsplit("/", 1)[-1]
                add = lambda check, ok, error="": rows.append((path, check, bool(ok), None if ok else error))  # noqa: B023, E731
                add("size", len(data) >= least_bytes, f"{len(data)} bytes, at least {least_bytes} expected")
                if name in known:
                    add("sha256", hashlib.sha256(data).hexdigest() == known[name].lower(), "digest differs")
                ext, columns = name.rsplit(".", 1)[-1].lower(), None
                if ext == "csv":
                    lines = data.decode("utf-8-sig", "replace").splitlines()
                    columns = [c.strip().strip('"') for c in lines[0].split(",")] if lines else []
                    add("csv_header", bool(columns and any(columns)), "no header")
                    add("csv_rows", len(lines) > 1, "no rows")
                elif ext == "zip":
                    try:
                        bad = zipfile.ZipFile(io.BytesIO(data)).testzip()
                        add("zip", bad is None, f"damaged member {bad}")
                    except zipfile.BadZipFile as e:
                        add("zip", False, str(e))
                elif ext == "dbf":
                    try:
                        columns = [f[0] for f in dbf_header(data)["fields"]]
                        add("dbf", True)
                    except ValueError as e:
                        add("dbf", False, str(e))
                if columns is not None and required_columns:
                    gone = sorted(set(required_columns) - set(columns))
                    add("columns", not gone, f"missing {gone}")
            yield pd.DataFrame(rows, columns=["path", "check", "ok", "error"])

    done = files.select("path", "content").mapInPandas(run, "path string, check string, ok boolean, error string")
    if not expected:
        return done
    there = files.select(F.element_at(F.split("path", "/"), -1).alias("name"))
    gone = files.sparkSession.createDataFrame([(n,) for n in expected], "name string").join(there, "name", "left_anti")
    return done.unionByName(gone.select(F.col("name").alias("path"), F.lit("exists").alias("check"), F.lit(False).alias("ok"), F.lit("missing or empty").alias("error")))
