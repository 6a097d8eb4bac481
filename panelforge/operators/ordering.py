"""Global order without a global task: prefix sums, row numbers and exact quantiles over range partitions.

A window without partitions would bring all rows to one task. Here rows are range-partitioned and sorted where they are, totals per
partition (one row each) are summed up, and every row adds its partition's offset to its local sum.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def settled(df: DataFrame) -> DataFrame:
    """`df` computed once, in the folder of reliable checkpoints, so that every reader sees the same rows, also after an executor is lost: range bounds come from samples, and two
    runs of one plan may cut differently. The folder is the one set, or that in spark.checkpoint.dir; without either, one of our own on a local master only."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="panelforge-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
    return df.checkpoint()


def prefix_sums(df: DataFrame, order: Sequence[str], weight: Column, out: str) -> DataFrame:
    """Adds `out`: the sum of `weight` over the rows before, in the order of the columns (which should tell all rows apart)."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = settled(df.withColumn("_sum_w", weight).repartitionByRange(n, *order).withColumn("_sum_p", F.spark_partition_id()))
    before = Window.partitionBy("_sum_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy("_sum_p").agg(F.sum("_sum_w").alias("_sum_t"))
    offsets = totals.select("_sum_p", F.coalesce(F.sum("_sum_t").over(Window.orderBy("_sum_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_sum_o"))
    summed = parts.withColumn("_sum_b", F.coalesce(F.sum("_sum_w").over(before), F.lit(0)))
    # One row per partition is broadcast.
    return summed.join(F.broadcast(offsets), "_sum_p").withColumn(out, F.col("_sum_b") + F.col("_sum_o")).drop("_sum_w", "_sum_p", "_sum_b", "_sum_o")


def few(table: DataFrame, most: int = 10_000) -> DataFrame:
    """`table` with a hint to broadcast it, if it has no more rows than `most`."""
    table = settled(table)
    return F.broadcast(table) if table.count() <= most else table


def group_prefix_sums(df: DataFrame, by: Sequence[str], order: Sequence[str], weight: Column, out: str) -> DataFrame:
    """`prefix_sums` that start anew in each group, however large the groups are. `weight` isn't negative; NULL groups count as one."""
    placed = prefix_sums(df, [*by, *order], weight, out)
    if not by:
        return placed
    first = few(placed.groupBy(*[F.col(c).alias(f"_g_{c}") for c in by]).agg(F.min(out).alias("_first")))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in by])
    return placed.join(first, same).withColumn(out, F.col(out) - F.col("_first")).drop("_first", *[f"_g_{c}" for c in by])


def row_numbers(df: DataFrame, order: Sequence[str], out: str, by: Sequence[str] = ()) -> DataFrame:
    """Adds `out`, from 0 in the order of the columns, in each group."""
    return group_prefix_sums(df, by, order, F.lit(1).cast("long"), out)


def exact_quantiles(df: DataFrame, column: str, qs: Sequence[float], out: str = "quantiles", by: Sequence[str] = ()) -> DataFrame:
    """One row, or one per group: the array of exact quantiles, interpolated linearly; NULLs without values. NULL and NaN values don't count. Memory follows neither the
    rows nor the distinct values, as it would in a single aggregate."""
    x = F.col(column).cast("double")
    rows = df.select(*by, x.alias("_x"))
    counts = rows.where(F.col("_x").isNotNull() & ~F.isnan("_x")).groupBy(*by, "_x").agg(F.count(F.lit(1)).alias("_n"))
    placed = group_prefix_sums(counts, by, ["_x"], F.col("_n"), "_before")
    total = counts.groupBy(*[F.col(c).alias(f"_t_{c}") for c in by]).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_total"))
    at = lambda i: F.max(F.when((F.col("_before") <= i) & (i < F.col("_before") + F.col("_n")), F.col("_x")))
    spots = [(F.col("_total") - 1) * F.lit(float(q)) for q in qs]
    picks = [F.max("_total").alias("_total"), *[a for k, p in enumerate(spots) for a in (at(F.floor(p)).alias(f"_l{k}"), at(F.ceil(p)).alias(f"_h{k}"))]]
    lerp = [F.when(F.floor(p) == F.ceil(p), F.col(f"_l{k}")).otherwise((F.ceil(p) - p) * F.col(f"_l{k}") + (p - F.floor(p)) * F.col(f"_h{k}")) for k, p in enumerate(spots)]
    if not by:
        return placed.join(F.broadcast(total)).groupBy().agg(*picks).select(F.array(*lerp).alias(out))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_t_{c}")) for c in by])
    own = placed.join(few(total), same).groupBy(*by).agg(*picks).select(*[F.col(c).alias(f"_t_{c}") for c in by], F.array(*lerp).alias(out))
    # Groups without values have a row too.
    return rows.select(*by).distinct().join(own, same, "left").select(*by, F.coalesce(out, F.array(*[F.lit(None).cast("double")] * len(qs))).alias(out))


def join_counted(rows: DataFrame, table: DataFrame, on: Sequence[str], count: str, share: float = 1 / 512) -> DataFrame:
    """`rows` joined to `table`, which has one row per key with the number of the key's rows in `count`. The keys that hold more than `share` of all rows, of which there can't be more
    than 1 / `share`, are broadcast, so their rows stay where they are; the rest is joined as Spark likes."""
    table = settled(table)
    most = max(1000, int((table.agg(F.sum(count)).first()[0] or 0) * share))
    hot, cold = table.where(F.col(count) > most).drop(count), table.where(F.col(count) <= most).drop(count)
    if hot.isEmpty():
        return rows.join(cold, on)
    return rows.join(F.broadcast(hot), on).unionByName(rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on))
