"""Small binary writers: DBF, shapefile records, one-band TIFF, and bytes to any of Spark's file systems."""

from __future__ import annotations

import sqlite3
import struct
import zlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import SparkSession


def dbf_bytes(fields: Sequence[tuple[str, str, int, int]], rows: Sequence[Sequence]) -> bytes:
    """A DBF of fields (name, type, width, decimals); each row starts with its deletion mark, a blank or `*`."""
    size, head = 1 + sum(f[2] for f in fields), 32 + 32 * len(fields) + 1
    out = struct.pack("<4BIHH20x", 3, 120, 1, 1, len(rows), head, size)
    out += b"".join(n.encode().ljust(11, b"\0") + k.encode() + b"\0" * 4 + bytes([w, d]) + b"\0" * 14 for n, k, w, d in fields) + b"\r"
    for mark, *values in rows:
        out += mark.encode()
        for v, (_, k, w, _d) in zip(values, fields, strict=True):
            raw = ("" if v is None else str(v)).encode()
            out += (raw.ljust(w) if k == "C" else raw.rjust(w))[:w]
    return out


def shp_bytes(rings_of: Sequence) -> bytes:
    """Polygon records; None for a null shape. Outer rings run clockwise, holes the other way."""
    body = b""
    for i, rings in enumerate(rings_of):
        if rings is None:
            content = struct.pack("<i", 0)
        else:
            pts = [p for r in rings for p in r]
            starts = np.cumsum([0] + [len(r) for r in rings])[:-1]
            xs, ys = [p[0] for p in pts], [p[1] for p in pts]
            content = struct.pack("<i4dii", 5, min(xs), min(ys), max(xs), max(ys), len(rings), len(pts)) + struct.pack(f"<{len(rings)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in pts)
        body += struct.pack(">ii", i + 1, len(content) // 2) + content
    return struct.pack(">i20xi", 9994, (100 + len(body)) // 2) + struct.pack("<ii", 1000, 5) + b"\0" * 64 + body


def shx_bytes(rings_of: Sequence) -> bytes:
    """The index of `shp_bytes`: offset and length of each record in 16-bit words."""
    at, body = 50, b""
    for rings in rings_of:
        words = 2 if rings is None else (44 + 4 * len(rings) + 16 * sum(map(len, rings))) // 2
        body += struct.pack(">ii", at, words)
        at += 4 + words
    return struct.pack(">i20xi", 9994, (100 + len(body)) // 2) + struct.pack("<ii", 1000, 5) + b"\0" * 64 + body


def tiled_tiff_bytes(
    values: np.ndarray, x0: float, y0: float, dx: float, dy: float, tile: tuple[int, int] | None = (16, 16), compression: int = 8, predictor: int = 1, planar: int = 1, order: str = "<", nodata: float = -9999, strip: int = 8
) -> bytes:
    """A grid (rows, columns, bands) of whole or floating-point numbers in tiles, or in strips where `tile` is None, uncompressed (1) or deflated (8)."""
    h, w, bands = values.shape
    kind = values.dtype.kind + str(values.dtype.itemsize)
    th, tw = tile or (strip, w)
    grids = [values[:, :, b : b + 1] for b in range(bands)] if planar == 2 else [values]
    blocks = []
    for grid in grids:
        for r in range(0, h, th):
            for c in range(0, w, tw):
                own = grid[r : r + th, c : c + tw]
                if tile:
                    own = np.pad(own, ((0, th - own.shape[0]), (0, tw - own.shape[1]), (0, 0)))
                blocks.append(_block_bytes(own, predictor, order, kind, compression))
    many = lambda v: [v] * bands
    place, size = (324, 325) if tile else (273, 279)
    shape = [(322, 3, [tw]), (323, 3, [th])] if tile else [(278, 3, [th])]
    tags = sorted([
        (256, 4, [w]), (257, 4, [h]), (258, 3, many(8 * values.dtype.itemsize)), (259, 3, [compression]), (277, 3, [bands]), (284, 3, [planar]), (317, 3, [predictor]), *shape, (place, 4, [0] * len(blocks)),
        (size, 4, [len(b) for b in blocks]), (339, 3, many({"u": 1, "i": 2, "f": 3}[values.dtype.kind])), (33550, 12, [dx, dy, 0.0]), (33922, 12, [0.0, 0.0, 0.0, x0, y0, 0.0]), (42113, 2, f"{nodata:g}".encode() + b"\0"),
    ])
    pack = lambda kind, v: v if kind == 2 else struct.pack(order + str(len(v)) + {3: "H", 4: "I", 12: "d"}[kind], *v)
    # Blocks first, the directory behind them.
    starts = (8 + np.cumsum([0, *map(len, blocks)])[:-1]).tolist()
    data = b"".join(blocks)
    data += b"\0" * (len(data) % 2)
    at = 8 + len(data)
    entries, rest, beyond = b"", b"", at + 2 + 12 * len(tags) + 4
    for tag, k, v in tags:
        raw = pack(k, starts if tag == place else v)
        entries += struct.pack(order + "HHI", tag, k, len(v)) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(order + "I", beyond + len(rest)))
        rest += raw if len(raw) > 4 else b""
    return {"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, at) + data + struct.pack(order + "H", len(tags)) + entries + b"\0" * 4 + rest


def _block_bytes(own: np.ndarray, predictor: int, order: str, kind: str, compression: int) -> bytes:
    rows, columns, samples = own.shape
    if predictor == 3:
        octets = own.astype(f">{kind}").reshape(rows, columns * samples, 1).view(np.uint8).transpose(0, 2, 1).reshape(rows, -1, samples)
        raw = np.diff(octets, axis=1, prepend=np.zeros((rows, 1, samples), np.uint8)).tobytes()
    else:
        own = np.diff(own, axis=1, prepend=np.zeros((rows, 1, samples), own.dtype)) if predictor == 2 else own
        raw = own.astype(f"{order}{kind}").tobytes()
    return zlib.compress(raw) if compression == 8 else raw


def tiff_bytes(values: np.ndarray, x0: float, y0: float, dx: float, dy: float, nodata: float = -9999, order: str = "<") -> bytes:
    """An uncompressed 32-bit float grid in one strip."""
    h, w = values.shape
    data = values.astype(f"{order}f4").tobytes()
    tags = [
        (256, 3, [w]), (257, 3, [h]), (258, 3, [32]), (259, 3, [1]), (273, 4, [0]), (277, 3, [1]), (278, 3, [h]), (279, 4, [len(data)]), (339, 3, [3]), (33550, 12, [dx, dy, 0.0]), (33922, 12, [0.0, 0.0, 0.0, x0, y0, 0.0]),
        (42113, 2, f"{nodata:g}".encode() + b"\0"),
    ]
    pack = lambda kind, v: v if kind == 2 else struct.pack(order + str(len(v)) + {3: "H", 4: "I", 12: "d"}[kind], *v)
    start = 8 + 2 + 12 * len(tags) + 4
    extra = sum(len(pack(k, v)) for _, k, v in tags if len(pack(k, v)) > 4)
    entries = rest = b""
    for tag, kind, v in tags:
        raw = pack(kind, [start + extra] if tag == 273 else v)
        entries += struct.pack(order + "HHI", tag, kind, len(v))
        entries += raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(order + "I", start + len(rest))
        rest += raw if len(raw) > 4 else b""
    return {"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HIH", 42, 8, len(tags)) + entries + b"\0" * 4 + rest + data


def gpkg_bytes(layers: dict[str, tuple[str, Sequence[tuple[str, str]], Sequence[Sequence]]]) -> bytes:
    """A GeoPackage: per layer the type of its geometry column `geom` (empty: a table of attributes), its other columns with their SQL types, and its rows, geometries (WKB) last."""
    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT)")
    db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT)")
    for name, (kind, columns, rows) in layers.items():
        own = [f'"{c}" {t}' for c, t in columns] + (["geom BLOB"] if kind else [])
        db.execute(f'CREATE TABLE "{name}" ({", ".join(own)})')
        db.execute("INSERT INTO gpkg_contents VALUES (?, ?)", (name, "features" if kind else "attributes"))
        if kind:
            db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', ?)", (name, kind))
        # A blob is a header of eight bytes without an envelope, then WKB.
        made = ((*r[:-1], None if r[-1] is None else b"GP\0\1\0\0\0\0" + bytes(r[-1])) if kind else tuple(r) for r in rows)
        db.executemany(f'INSERT INTO "{name}" VALUES ({", ".join("?" * len(own))})', made)
    db.commit()
    return db.serialize()


def put(spark: SparkSession, path: str, content: bytes) -> str:
    """Writes a small file through Hadoop's file systems; its path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(content))
    out.close()
    return path
