"""GeoPackage layers as a Spark data source. A GeoPackage is an SQLite file; layers are read by ranges of row ids, one partition each."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

_TYPES = {"INT": "long", "BOOL": "boolean", "REAL": "double", "DOUB": "double", "FLOA": "double", "BLOB": "binary"}


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path.removeprefix('file://')}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def layers(path: str) -> list[dict]:
    """Feature layers with their geometry column and type."""
    with _open(path) as db:
        rows = db.execute("SELECT c.table_name, g.column_name, g.geometry_type_name FROM gpkg_contents c JOIN gpkg_geometry_columns g USING (table_name) WHERE c.data_type = 'features' ORDER BY 1").fetchall()
        return [{"layer": r[0], "geometry": r[1], "type": r[2], "columns": [c[1] for c in db.execute(f"PRAGMA table_info({_quoted(r[0])})")]} for r in rows]


def best_layer(path: str, id_column: str) -> str:
    """The polygon layer with the id column whose name speaks most for boundaries; ties by name."""
    fit = [x["layer"] for x in layers(path) if "POLYGON" in x["type"].upper() and id_column in x["columns"]]
    if not fit:
        raise ValueError(f"no polygon layer has {id_column}")
    score = lambda n: 10 * ("bound" in n) + 7 * ("uc" in n) + 3 * ("urban" in n)
    return min(fit, key=lambda n: (-score(n.lower()), n))


def polygon_wkb(blob: bytes) -> bytes:
    """WKB inside a GeoPackage geometry blob."""
    envelope = (0, 32, 48, 48, 64)[(blob[3] >> 1) & 7]
    return blob[8 + envelope :]


class _Rows(InputPartition):
    def __init__(self, low: int, high: int):
        super().__init__((low, high))


class GeoPackage(DataSource):
    """Options: path, layer, columns (comma-separated; all but the geometry if left out), geometry (true to add `wkb`), rows (per partition)."""

    @classmethod
    def name(cls) -> str:
        return "gpkg"

    def _columns(self) -> list[tuple[str, str]]:
        own = {x["layer"]: x["geometry"] for x in layers(self.options["path"])}
        layer = self.options["layer"]
        with _open(self.options["path"]) as db:
            info = [(c[1], c[2].upper()) for c in db.execute(f"PRAGMA table_info({_quoted(layer)})")]
        if not info:
            raise ValueError(f"no layer {layer}")
        want = [c for c in self.options.get("columns", "").split(",") if c]
        if gone := set(want) - {n for n, _ in info}:
            raise ValueError(f"missing columns: {sorted(gone)}")
        kinds = {n: next((s for t, s in _TYPES.items() if k.startswith(t) or t in k), "string") for n, k in info if n != own.get(layer)}
        return [(n, kinds[n]) for n in (want or kinds)]

    def schema(self) -> str:
        geometry = ", wkb binary" if self.options.get("geometry", "false").lower() == "true" else ""
        return ", ".join(f"`{n}` {k}" for n, k in self._columns()) + geometry

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, self._columns())


class _Reader(DataSourceReader):
    def __init__(self, options, columns):
        self.path, self.layer, self.columns = options["path"], options["layer"], columns
        self.rows = int(options.get("rows", "50000"))
        own = {x["layer"]: x["geometry"] for x in layers(self.path)}
        self.geometry = own.get(self.layer) if options.get("geometry", "false").lower() == "true" else None

    def partitions(self) -> Sequence[InputPartition]:
        with _open(self.path) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.layer)}").fetchone()
        return [_Rows(0, 0)] if low is None else [_Rows(a, min(a + self.rows, high + 1)) for a in range(low, high + 1, self.rows)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        low, high = partition.value
        names = ", ".join(_quoted(n) for n, _ in self.columns) + (f", {_quoted(self.geometry)}" if self.geometry else "")
        cast = [{"long": int, "double": float, "boolean": bool, "binary": bytes}.get(k, str) for _, k in self.columns]
        with _open(self.path) as db:
            for row in db.execute(f"SELECT {names} FROM {_quoted(self.layer)} WHERE rowid >= ? AND rowid < ?", (low, high)):
                values = tuple(None if v is None else c(v) for v, c in zip(row, cast, strict=False))
                yield (*values, None if row[-1] is None else polygon_wkb(row[-1])) if self.geometry else values


def read_layer(spark: SparkSession, path: str, layer: str, columns: Sequence[str] = (), geometry: bool = False) -> DataFrame:
    spark.dataSource.register(GeoPackage)
    reader = spark.read.format("gpkg").option("path", path).option("layer", layer).option("geometry", str(geometry).lower())
    return (reader.option("columns", ",".join(columns)) if columns else reader).load()


def polygons_of(spark: SparkSession, path: str, layer: str, id_column: str, ids: DataFrame) -> DataFrame:
    """Polygons of the listed ids (column of the same name); raises if there is none."""
    found = read_layer(spark, path, layer, [id_column], True).join(ids.select(id_column).distinct(), id_column, "left_semi")
    if found.isEmpty():
        raise ValueError("none of the ids has a polygon")
    return found
