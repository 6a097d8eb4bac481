"""Sinks: CSV, JSON, Markdown, markers, seals by digest, run metadata."""

from __future__ import annotations

import json
import platform
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.sources.files import binary


def write_csv(df: DataFrame, path: str, fields: Sequence[str] | None = None, single: bool = True) -> None:
    """One CSV with a header; with `fields`, exactly those columns in that order, missing ones and NULLs as empty text. An output that exists is refused."""
    if fields is not None:
        df = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in fields])
    (df.coalesce(1) if single else df).write.mode("errorifexists").option("header", True).option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).coalesce(1).write.mode("errorifexists").text(path)


def markdown(df: DataFrame, order: Sequence[str], formats: dict[str, str] | None = None) -> DataFrame:
    """(line, text): a table in Markdown, rows in the order given. For reports, which are short."""
    from pyspark.sql import Window

    cells = [F.format_string((formats or {}).get(c, "%s"), F.col(c)) for c in df.columns]
    body = df.select((F.row_number().over(Window.orderBy(*order)) + 1).cast("int").alias("line"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("text"))
    head = df.sparkSession.createDataFrame([(0, f"| {' | '.join(df.columns)} |"), (1, f"|{'---|' * len(df.columns)}")], "line int, text string")
    return head.unionByName(body).orderBy("line")


def digests(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(name, sha256) of files. Content is a binary column, so files must stay under 2 GB."""
    return binary(spark, paths).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"))


def seal(spark: SparkSession, paths: Sequence[str], marker: str) -> None:
    digests(spark, paths).coalesce(1).write.mode("errorifexists").json(marker)


def assert_sealed(spark: SparkSession, paths: Sequence[str], marker: str) -> None:
    """Raises unless a seal exists and every file named in it is there, unchanged."""
    from pyspark.errors import AnalysisException

    try:
        sealed = spark.read.schema("name string, sha256 string").json(marker)
    except AnalysisException as e:
        raise RuntimeError("the outputs aren't sealed") from e
    bad = [r["name"] for r in sealed.join(digests(spark, paths), ["name", "sha256"], "left_anti").limit(20).collect()]
    if bad:
        raise RuntimeError(f"missing or changed since sealing: {sorted(bad)}")


def _text(spark: SparkSession, path: str, text: str | None) -> bool:
    """Writes or (with None) removes a small file through Hadoop's file systems; whether it was there."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = fs.exists(p)
    if text is None:
        fs.delete(p, False)
    else:
        out = fs.create(p, True)
        out.write(bytearray(text.encode()))
        out.close()
    return there


def start_run(spark: SparkSession, folder: str) -> None:
    """Clears the markers of an earlier run."""
    for name in ("DONE", "FAILED"):
        _text(spark, f"{folder}/{name}", None)


def end_run(spark: SparkSession, folder: str, error: str | None = None) -> None:
    _text(spark, f"{folder}/{'FAILED' if error else 'DONE'}", error or time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()))


def run_metadata(spark: SparkSession, seed: int, started: float) -> str:
    return json.dumps({"seed": seed, "spark": spark.version, "python": platform.python_version(), "start": started, "end": time.time()}, sort_keys=True)
