"""Shared helpers: the shared scratch folder, Arrow column access, ASCII lower-casing."""

from __future__ import annotations

import atexit
import ctypes
import importlib.util
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}

#: File of the vocabulary, a parameter of the operators that read one. The installed package of public vocabularies tells where it is.
PIECES = "piece_bpe_32k.model"


def vocabulary(name: str = PIECES) -> str:
    """Path of a vocabulary file: in the folder that PANELFORGE_VOCABULARIES names, or in the installed package."""
    folder = os.environ.get("PANELFORGE_VOCABULARIES")
    if folder:
        return str(Path(folder) / name)
    found = importlib.util.find_spec("public_tokenizers")
    if found is None or found.origin is None:
        raise FileNotFoundError(f"{name}: no package of vocabularies is installed, and PANELFORGE_VOCABULARIES names no folder")
    return str(Path(found.origin).parent / name)


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package wherever the driver was started from, as long as they see the same files."""
    root = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, paths) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a folder of our own, on a local master only: executors elsewhere would not see it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master, app = spark.sparkContext.master, spark.sparkContext.applicationId
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="panelforge-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"file://{_own[app]}")
    return f"file://{_own[app]}"


def store(df: DataFrame, name: str, codec: str = "zstd", by: str | None = None) -> DataFrame:
    """`df` written once to the shared folder and read back: lineage is cut, and every later
    reader sees the same rows, whichever executor made them and however often a task is retried."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/panelforge/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", codec)
    (writer.partitionBy(by) if by else writer).parquet(path)
    fields = df.schema
    return spark.read.schema(fields).parquet(path)


def utf8(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null gives empty bytes."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def batches(arrow: Iterator[pa.RecordBatch], text: str = "text", most: int = 12 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the incoming batches that hold about `most` bytes of text at most, one row at least."""
    for batch in arrow:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist() if batch.nbytes > most else []
        start = used = 0
        release()
        for i, n in enumerate(lengths):
            if used + n > most and i > start:
                yield batch.slice(start, i - start)
                release()
                start, used = i, 0
            used += n
        yield batch.slice(start)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Gives freed memory back to the system, where the C library can: workers live on between tasks, beside the executor's own heap."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def salted_partitions(spark: SparkSession, least: int = 12) -> int:
    """Tasks to deal out to, from the session's own settings."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
