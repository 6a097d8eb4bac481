"""Sources that read parts of large files: shapefiles by records, rasters by blocks, archives by members, digests by chunks.

Each is a Spark data source whose partitions are ranges. Planning reads heads and directories only; a task seeks to its range and reads that. Files are opened by
URI through Arrow's file systems (a plain path is a local one), so they must lie where all workers see them; a store that only Spark's readers know
is served by the whole-file readers in `files`.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from panelforge.sources.files import TAGS, TIFF_CODES, TIFF_SIZES, dbf_header, dbf_records, dbf_schema, grid_of, polygon_wkb


def opened(path: str) -> pa.NativeFile:
    """A file that can be read at any place."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file(path)
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def written(path: str, content: bytes) -> str:
    """Writes a file from a task, under another name first, so that a retry or a second attempt leaves it whole. Its path."""
    local = "://" not in path and not path.startswith("file:")
    store, inner = (fs.LocalFileSystem(), path if local else "/" + path.removeprefix("file:").lstrip("/")) if local or path.startswith("file:") else fs.FileSystem.from_uri(path)
    folder = inner.rpartition("/")[0]
    store.create_dir(folder, recursive=True)
    part = f"{inner}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as out:
        out.write(content)
    store.move(part, inner)
    return path


def part_of(file: pa.NativeFile, start: int, size: int) -> bytes:
    file.seek(start)
    return file.read(max(0, size))


class _Range(InputPartition):
    def __init__(self, *value):
        super().__init__(value)


def _pushed(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


# ------------------------------------------------------------------ shapefiles

#: Columns of a record's box, read from the record's head.
BOX = ("x0", "y0", "x1", "y1")
_HEAD = struct.Struct("<i4d")


class Shapefile(DataSource):
    """Options: stems (one per line, of equal fields), columns (comma-separated; all if left out), geometry (true to add `wkb`), boxes (true to add x0, y0, x1, y1), records (per partition), encoding.

    Comparisons of box columns with numbers are pushed down: records that fail them are skipped by their heads, before attributes or rings are decoded."""

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def _flag(self, name: str) -> bool:
        return self.options.get(name, "false").lower() == "true"

    def schema(self) -> str:
        with opened(f"{self.options['stems'].split(chr(10))[0]}.dbf") as f:
            info = dbf_header(f.read(1 << 16))
        want = [c for c in self.options.get("columns", "").split(",") if c]
        if gone := set(want) - {f[0] for f in info["fields"]}:
            raise ValueError(f"missing columns: {sorted(gone)}")
        columns = dbf_schema(info, want or None)
        return columns + ", x0 double, y0 double, x1 double, y1 double" * self._flag("boxes") + ", wkb binary" * self._flag("geometry")

    def reader(self, schema: StructType) -> DataSourceReader:
        want = [c for c in self.options.get("columns", "").split(",") if c]
        return _ShapeReader(self.options["stems"].split("\n"), want or None, self._flag("geometry"), self._flag("boxes"), int(self.options.get("records", "50000")), self.options.get("encoding", "utf-8"))


_TESTS = {GreaterThan: np.greater, GreaterThanOrEqual: np.greater_equal, LessThan: np.less, LessThanOrEqual: np.less_equal, EqualTo: np.equal}


def _shared_tasks(ranges: list[tuple[str, int, int]], most: int = 1024) -> list[list[tuple[str, int, int]]]:
    """The ranges of each task: one, or as many neighbours as make up `most` tasks at most; those of one file are read as one."""
    together, out = max(1, -(-len(ranges) // most)), []
    for at in range(0, len(ranges), together):
        own: list[tuple[str, int, int]] = []
        for stem, low, high in ranges[at : at + together]:
            if own and own[-1][0] == stem and own[-1][2] == low:
                own[-1] = (stem, own[-1][1], high)
            else:
                own.append((stem, low, high))
        out.append(own)
    return out


class _ShapeReader(DataSourceReader):
    def __init__(self, stems: list[str], columns: list[str] | None, geometry: bool, boxes: bool, records: int, encoding: str):
        self.stems, self.columns, self.geometry, self.boxes, self.records, self.encoding = stems, columns, geometry, boxes, records, encoding
        self.tests: list[tuple[int, str, float]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if type(f) in _TESTS else None
            if self.boxes and name in BOX and len(f.attribute) == 1:
                self.tests.append((BOX.index(name), type(f).__name__, float(f.value)))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        out = []
        for stem in self.stems:
            with opened(f"{stem}.dbf") as f:
                n = dbf_header(f.read(1 << 16))["records"]
            out += [(stem, a, min(a + self.records, n)) for a in range(0, n, self.records)]
        return [_Range(*own) for own in _shared_tasks(out)] or [_Range()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        # Several ranges of a task, or one.
        own = partition.value
        for stem, low, high in [own] if own and isinstance(own[0], str) else own:
            yield from self._read(stem, low, high)

    def _read(self, stem: str, low: int, high: int) -> Iterator[tuple]:
        places = _places(stem, low, high) if self.geometry or self.boxes else None
        with opened(f"{stem}.dbf") as dbf:
            info = dbf_header(dbf.read(1 << 16))
            size = info["size"]
            shp = opened(f"{stem}.shp") if places is not None else None
            step = max(1, (8 << 20) // size)
            for a in range(low, high, step):
                b = min(a + step, high)
                keep, shapes = (np.ones(b - a, bool), None) if places is None else self._shapes(shp, places[a - low : b - low])
                rows = dbf_records(part_of(dbf, info["header"] + a * size, (b - a) * size), info, self.columns, self.encoding, keep)
                for i, row in rows:
                    more = () if shapes is None else shapes(i)
                    yield (*row, *more)
            if shp is not None:
                shp.close()

    def _shapes(self, shp: pa.NativeFile, places: np.ndarray):
        """Which records pass the box tests, and how to get the extra columns of one of them."""
        heads = np.full((len(places), 4), np.nan)
        # Contents lie one after the other, so runs of them are read at once, up to 8 MB.
        ends = places[:, 0] + places[:, 1]
        runs = np.flatnonzero(np.r_[True, (places[1:, 0] != ends[:-1] + 8) | ((ends[1:] - places[0, 0]) // (8 << 20) != (ends[:-1] - places[0, 0]) // (8 << 20))])
        bodies: list[bytes | None] = [None] * len(places)
        for a, b in zip(runs, [*runs[1:], len(places)], strict=True):
            raw = part_of(shp, int(places[a, 0]), int(ends[b - 1] - places[a, 0]))
            for i in range(a, b):
                own = raw[places[i, 0] - places[a, 0] : ends[i] - places[a, 0]]
                if len(own) >= _HEAD.size and own[:4] != b"\0\0\0\0":
                    heads[i] = _HEAD.unpack_from(own)[1:]
                    bodies[i] = own
        keep = np.ones(len(places), bool)
        by_name = {t.__name__: f for t, f in _TESTS.items()}
        for at, test, value in self.tests:
            keep &= by_name[test](heads[:, at], value)

        def more(i: int) -> tuple:
            box = tuple(None if np.isnan(v) else float(v) for v in heads[i]) if self.boxes else ()
            return box + ((None if bodies[i] is None else polygon_wkb(bodies[i]),) if self.geometry else ())

        return keep, more


def _places(stem: str, low: int, high: int) -> np.ndarray:
    """Offset and length in bytes of each record's content, from the index file."""
    with opened(f"{stem}.shx") as f:
        raw = np.frombuffer(part_of(f, 100 + 8 * low, 8 * (high - low)), ">i4").reshape(-1, 2).astype(np.int64)
    if len(raw) != high - low:
        raise ValueError(f"{stem}: the index has fewer records than the table")
    return raw * 2 + np.array([8, 0])


def scan_shapefile(spark: SparkSession, stem: str | Sequence[str], columns: Sequence[str] | None = None, geometry: bool = True, boxes: bool = False, records: int = 50_000, encoding: str = "utf-8") -> DataFrame:
    """Records of `stem`.dbf with geometries of `stem`.shp by the offsets in `stem`.shx: `records` of them per task, or more where that made over 1,024 tasks. Several stems are read as one table."""
    spark.dataSource.register(Shapefile)
    _pushed(spark)
    reader = spark.read.format("shapefile").option("stems", stem if isinstance(stem, str) else "\n".join(stem)).option("geometry", str(geometry).lower()).option("boxes", str(boxes).lower())
    reader = reader.option("records", records).option("encoding", encoding)
    return (reader.option("columns", ",".join(columns)) if columns else reader).load()


# ------------------------------------------------------------------ rasters by blocks


def lzw(data: bytes) -> bytes:
    """LZW as TIFF uses it: codes of 9 to 12 bits, high bits first, each width left one code early."""
    out, table, width, bits, held, last = bytearray(), [bytes([i]) for i in range(256)] + [b"", b""], 9, 0, 0, b""
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            del table[258:]
            width, last = 9, b""
            continue
        own = table[code] if code < len(table) else last + last[:1]
        out += own
        if last:
            table.append(last + own[:1])
        last = own
        width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
    return bytes(out)


def decoded_block(raw: bytes, t: dict, rows: int, columns: int, samples: int) -> np.ndarray:
    """(rows, columns, samples) of one strip or tile: decompressed, and with its predictor undone."""
    kind = {1: "u", 2: "i", 3: "f"}[_first(t.get("sample_format", 1))] + str(_first(t["bits"]) // 8)
    how = t.get("compression", 1)
    if how not in (1, 5, 8, 32946):
        raise ValueError(f"compression {how} is not supported")
    data = raw if how == 1 else lzw(raw) if how == 5 else zlib.decompress(raw)
    width, predictor = int(kind[1:]), t.get("predictor", 1)
    full = np.frombuffer(data[: len(data) - len(data) % (columns * samples * width)], np.uint8)
    rows = min(rows, len(full) // (columns * samples * width))
    full = full[: rows * columns * samples * width]
    if predictor == 3:
        # Bytes of all values of a row by place, highest first, as differences to the byte `samples` before.
        grid = np.cumsum(full.reshape(rows, -1, samples), axis=1, dtype=np.uint8).reshape(rows, width, columns * samples)
        return np.ascontiguousarray(grid.transpose(0, 2, 1)).view(f">{kind}").reshape(rows, columns, samples)
    grid = full.view(f"{t['order']}{kind}").reshape(rows, columns, samples)
    return np.cumsum(grid, axis=1, dtype=grid.dtype.newbyteorder("=")) if predictor == 2 else grid


def _first(v):
    return v[0] if isinstance(v, list) else v


def _all(v) -> list:
    return v if isinstance(v, list) else [v]


class Raster(DataSource):
    """Pixels of a classic TIFF as (row, col, band, x, y, value). Options: path, window (row0,col0,row1,col1; ends exclusive), every (of rows and columns), blocks (per partition).

    Partitions are strips or tiles that hold an asked-for pixel; others aren't read. Strips and tiles, one or more bands, together or apart; none, LZW or deflate; all predictors."""

    @classmethod
    def name(cls) -> str:
        return "tiff"

    def schema(self) -> str:
        return "row long, col long, band int, x double, y double, value double"

    def reader(self, schema: StructType) -> DataSourceReader:
        window = [int(v) for v in self.options["window"].split(",")] if self.options.get("window") else None
        return _RasterReader(self.options["path"], window, int(self.options.get("every", "1")), int(self.options.get("blocks", "16")))


class _RasterReader(DataSourceReader):
    def __init__(self, path: str, window: list[int] | None, every: int, blocks: int):
        self.path, self.every, self.blocks = path, every, blocks
        with opened(path) as f:
            self.tags = t = tiff_directory(f)
        height, width = t["height"], t["width"]
        self.window = window or [0, 0, height, width]
        self.window = [max(0, self.window[0]), max(0, self.window[1]), min(height, self.window[2]), min(width, self.window[3])]
        self.tiled = "tile_width" in t
        self.size = (t["tile_height"], t["tile_width"]) if self.tiled else (t.get("rows_per_strip", height), width)
        self.bands = t.get("bands", 1)
        self.apart = t.get("planar", 1) == 2 and self.bands > 1

    def _asked(self, low: int, high: int, start: int, end: int) -> np.ndarray:
        """Every n-th place from `start` on that lies in both ranges."""
        first = start + max(0, -(-(low - start) // self.every)) * self.every
        return np.arange(first, min(high, end), self.every)

    def partitions(self) -> Sequence[InputPartition]:
        r0, c0, r1, c1 = self.window
        h, w = self.size
        across, down = -(-self.tags["width"] // w), -(-self.tags["height"] // h)
        rows = [i for i in range(r0 // h, -(-r1 // h)) if len(self._asked(i * h, (i + 1) * h, r0, r1))] if r1 > r0 else []
        columns = [j for j in range(c0 // w, -(-c1 // w)) if len(self._asked(j * w, (j + 1) * w, c0, c1))] if c1 > c0 else []
        wanted = [(b, i, j, (b * down + i) * across + j) for b in (range(self.bands) if self.apart else [0]) for i in rows for j in columns]
        return [_Range(*wanted[a : a + self.blocks]) for a in range(0, len(wanted), self.blocks)] or [_Range()]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        t, g = self.tags, grid_of(self.tags)
        dx, dy, x0, y0 = g["dx"] or 1.0, g["dy"] or 1.0, g["x0"] or 0.0, g["y0"] if g["y0"] is not None else 0.0
        starts, sizes = (_all(t["tile_offsets" if self.tiled else "strip_offsets"]), _all(t["tile_bytes" if self.tiled else "strip_bytes"]))
        try:
            gone = float(t["nodata"])
        except (KeyError, ValueError):
            gone = None
        (r0, c0, r1, c1), (h, w) = self.window, self.size
        samples = 1 if self.apart else self.bands
        with opened(self.path) as f:
            for band, i, j, at in partition.value:
                grid = decoded_block(part_of(f, starts[at], sizes[at]), t, h, w, samples)
                rows, columns = self._asked(i * h, min((i + 1) * h, i * h + len(grid)), r0, r1), self._asked(j * w, (j + 1) * w, c0, c1)
                values = grid[rows - i * h][:, columns - j * w].astype(float)
                r, c, b = (v.ravel() for v in np.meshgrid(rows, columns, np.arange(samples), indexing="ij"))
                flat = values.ravel()
                missing = np.isnan(flat) | (flat == gone if gone is not None else False)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r), pa.array(c), pa.array((b + band + 1).astype(np.int32)), pa.array(x0 + (c + 0.5) * dx), pa.array(y0 - (r + 0.5) * dy), pa.array(flat, mask=missing)],
                    names=["row", "col", "band", "x", "y", "value"],
                )


def tiff_directory(file: pa.NativeFile) -> dict:
    """The tags of the first directory of a classic TIFF, wherever it and its values lie."""
    head = part_of(file, 0, 8)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or len(head) < 8 or struct.unpack_from(order + "H", head, 2)[0] != 42:
        raise ValueError("not a classic TIFF")
    at = struct.unpack_from(order + "I", head, 4)[0]
    n = struct.unpack(order + "H", part_of(file, at, 2))[0]
    entries, out = part_of(file, at + 2, 12 * n), {"order": order}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", entries, 12 * i)
        if tag not in TAGS or kind not in TIFF_SIZES:
            continue
        size, inline = TIFF_SIZES[kind] * count, entries[12 * i + 8 : 12 * i + 12]
        raw = inline[:size] if size <= 4 else part_of(file, struct.unpack(order + "I", inline)[0], size)
        if kind in (2, 7):
            out[TAGS[tag]] = raw.rstrip(b"\0").decode("latin-1")
        elif kind in TIFF_CODES:
            values = struct.unpack(f"{order}{count}{TIFF_CODES[kind]}", raw)
            out[TAGS[tag]] = values[0] if count == 1 else list(values)
    return out


def scan_raster(spark: SparkSession, path: str, window: Sequence[int] | None = None, every: int = 1, blocks: int = 16) -> DataFrame:
    spark.dataSource.register(Raster)
    reader = spark.read.format("tiff").option("path", path).option("every", every).option("blocks", blocks)
    return (reader.option("window", ",".join(map(str, window))) if window else reader).load()


# ------------------------------------------------------------------ archives and digests


class Archive(DataSource):
    """Members of ZIP archives as (path, name, size, crc, ok, sha256). Options: paths (one per line), members (per partition).

    Planning reads the central directories; a task reads its members through, in chunks, which tests their checksums. A file that is no ZIP has one row with a NULL name."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return "path string, name string, size long, crc long, ok boolean, sha256 string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _ArchiveReader(self.options["paths"].split("\n"), int(self.options.get("members", "64")))


class _ArchiveReader(DataSourceReader):
    def __init__(self, paths: list[str], members: int):
        self.paths, self.members = paths, members

    def partitions(self) -> Sequence[InputPartition]:
        out = []
        for path in self.paths:
            try:
                with opened(path) as f, zipfile.ZipFile(f) as z:
                    n = len(z.infolist())
                out += [_Range(path, a, min(a + self.members, n)) for a in range(0, n, self.members)]
            except (zipfile.BadZipFile, pa.ArrowInvalid):
                out.append(_Range(path, 0, -1))
        return out or [_Range("", 0, 0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        path, low, high = partition.value
        if high < 0:
            yield path, None, None, None, False, None
        if high <= low:
            return
        with opened(path) as f, zipfile.ZipFile(f) as z:
            for m in z.infolist()[low:high]:
                if m.is_dir():
                    continue
                digest = hashlib.sha256()
                try:
                    with z.open(m) as inner:
                        while chunk := inner.read(1 << 20):
                            digest.update(chunk)
                    yield path, m.filename, m.file_size, m.CRC, True, digest.hexdigest()
                except (zipfile.BadZipFile, zlib.error, EOFError, OSError, ValueError, RuntimeError, NotImplementedError):
                    yield path, m.filename, m.file_size, m.CRC, False, None


class Digests(DataSource):
    """(path, size, sha256) of files, read in chunks, one task each. Options: paths (one per line). A missing file has NULLs."""

    @classmethod
    def name(cls) -> str:
        return "file_digests"

    def schema(self) -> str:
        return "path string, size long, sha256 string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _DigestReader(self.options["paths"].split("\n"))


class _DigestReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> Sequence[InputPartition]:
        return [_Range(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        (path,) = partition.value
        digest, size = hashlib.sha256(), 0
        try:
            with opened(path) as f:
                while chunk := f.read(4 << 20):
                    digest.update(chunk)
                    size += len(chunk)
            yield path, size, digest.hexdigest()
        except FileNotFoundError:
            yield path, None, None


def scan_archives(spark: SparkSession, paths: Sequence[str], members: int = 64) -> DataFrame:
    spark.dataSource.register(Archive)
    return spark.read.format("zip_members").option("paths", "\n".join(paths)).option("members", members).load()


def file_digests(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    spark.dataSource.register(Digests)
    return spark.read.format("file_digests").option("paths", "\n".join(paths)).load()
