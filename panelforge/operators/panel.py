"""Panels of units over epochs: stocks, histories, descriptors, state and context blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.scalars import clipped_log, ratio


def cumulative(flow: DataFrame, values: Sequence[str], unit: str = "unit_id", epoch: str = "epoch") -> DataFrame:
    """Flows to stocks: running sums per unit."""
    w = Window.partitionBy(unit).orderBy(epoch).rowsBetween(Window.unboundedPreceding, 0)
    return flow.select(unit, epoch, *[F.sum(v).over(w).alias(v) for v in values])


def widen(panel: DataFrame, epochs: Sequence[int], values: Sequence[str], unit: str = "unit_id", epoch: str = "epoch") -> DataFrame:
    """One row per unit, one column per value and epoch, in one aggregation."""
    return panel.groupBy(unit).agg(*[F.max(F.when(F.col(epoch) == e, F.col(v))).alias(f"{v}_{e}") for v in values for e in epochs])


def steps(panel: DataFrame, value: str, unit: str = "unit_id", epoch: str = "epoch") -> DataFrame:
    """Change and ratio to the epoch before."""
    before = F.lag(value).over(Window.partitionBy(unit).orderBy(epoch))
    return panel.withColumn("step", F.col(value) - before).withColumn("step_ratio", ratio(F.col(value), before))


def jump_summary(panel: DataFrame, value: str, last_epoch: int | None = None, unit: str = "unit_id", epoch: str = "epoch") -> DataFrame:
    """Per unit: number of falls, largest and smallest step ratio; over epochs up to `last_epoch` if given."""
    own = panel if last_epoch is None else panel.where(F.col(epoch) <= last_epoch)
    return steps(own, value, unit, epoch).groupBy(unit).agg(F.count_if(F.col("step") < 0).alias("n_decreasing"), F.max("step_ratio").alias("max_ratio"), F.min("step_ratio").alias("min_ratio"))


def history(panel: DataFrame, value: str, base_epoch: int, unit: str = "unit_id", epoch: str = "epoch") -> DataFrame:
    """Trajectory relative to the base epoch: (unit, epoch, h), for epochs before it. NULL without a base or over a zero base."""
    base = F.max(F.when(F.col(epoch) == base_epoch, F.col(value))).over(Window.partitionBy(unit))
    return panel.select(unit, epoch, ratio(F.col(value), base).alias("h")).where(F.col(epoch) < base_epoch)


def history_array(h: DataFrame, unit: str = "unit_id", epoch: str = "epoch") -> DataFrame:
    """(unit, H): the trajectory as an array in order of epochs."""
    return h.groupBy(unit).agg(F.transform(F.array_sort(F.collect_list(F.struct(epoch, "h"))), lambda x: x["h"]).alias("H"))


def trajectories(flow: DataFrame, values: Sequence[str], base_epoch: int, history_of: str, unit: str = "unit_id", epoch: str = "epoch") -> DataFrame:
    """One row per unit from flows in one aggregation: the stocks at the base epoch, under the values' names, and the array `H` of stocks of `history_of` before it,
    relative to it. Units without a flow in the base epoch have NULLs. The same as `cumulative`, `history` and `history_array`, without their windows and joins."""
    rows = flow.groupBy(unit).agg(F.array_sort(F.collect_list(F.struct(epoch, *values))).alias("_p"))
    sum_to = lambda v, n: F.aggregate(F.slice(F.col(f"_p.{v}"), F.lit(1), n), F.lit(0.0), lambda s, x: s + x)
    at = F.array_position(F.col(f"_p.{epoch}"), F.lit(base_epoch)).cast("int")
    ends = rows.select(unit, "_p", *[F.when(at > 0, sum_to(v, at)).alias(v) for v in values], at.alias("_at"))
    before = F.when(F.col("_at") > 1, F.sequence(F.lit(1), F.col("_at") - 1)).otherwise(F.array().cast("array<int>"))
    return ends.select(unit, *values, F.when(F.col("_at") > 0, F.transform(before, lambda i: ratio(sum_to(history_of, i), F.col(history_of)))).alias("H"))


def descriptors(panel: DataFrame, value: str, base_epoch: int, early: int, middle: int, unit: str = "unit_id", epoch: str = "epoch") -> DataFrame:
    """Levels at two epochs, late growth, and the growth-weighted mean time: midpoints of steps weighted by positive growth
    (NULL without growth)."""
    w = Window.partitionBy(unit).orderBy(epoch)
    grown = panel.where(F.col(epoch) <= base_epoch).withColumn("_gain", F.greatest(F.col(value) - F.lag(value).over(w), F.lit(0.0))).withColumn("_mid", (F.col(epoch) + F.lag(epoch).over(w)) / 2)
    at = lambda e: F.max(F.when(F.col(epoch) == e, F.col(value)))
    out = grown.groupBy(unit).agg(at(early).alias("_a"), at(middle).alias("_b"), at(base_epoch).alias("_t"), F.sum(F.col("_gain") * F.col("_mid")).alias("_gm"), F.sum("_gain").alias("_g"))
    return out.select(unit, ratio(F.col("_a"), F.col("_t")).alias("h_early"), ratio(F.col("_b"), F.col("_t")).alias("h_middle"), (1 - ratio(F.col("_b"), F.col("_t"))).alias("late_growth"), ratio(F.col("_gm"), F.col("_g")).alias("weighted_timing"))


def state_block(pop: Column, built: Column, volume: Column, level: str = "S3", log: bool = False) -> Column:
    """Present state: S1 population and built area, S2 with density, S3 with volume; raw or as logarithms."""
    columns = [pop, built, ratio(pop, built), volume][: {"S1": 2, "S2": 3, "S3": 4}[level]]
    return F.array(*[clipped_log(c) if log else c for c in columns])


def context_block(lat: Column, lon: Column, elevation: Column, temperature: Column | None = None, rain: Column | None = None, seasonality: Sequence[Column] = (), group: Column | None = None, level: str = "C0") -> Column:
    """Context: C0 place, C1 with climate, C2 with seasonality and five fixed indicator columns."""
    columns = [lat, lon, elevation]
    if level in ("C1", "C2"):
        columns += [temperature, rain]
    if level == "C2":
        columns += [*seasonality, *[F.coalesce((group == g).cast("double"), F.lit(0.0)) for g in "ABCDE"]]
    return F.array(*columns)


def implied_height(panel: DataFrame, volume: str, built: str, base_epoch: int, unit: str = "unit_id", epoch: str = "epoch") -> DataFrame:
    """Per unit: range of volume over built area relative to the base epoch, and whether it stays within one percent."""
    height = ratio(F.col(volume), F.col(built))
    base = F.max(F.when(F.col(epoch) == base_epoch, height)).over(Window.partitionBy(unit))
    relative = panel.select(unit, ratio(height, base).alias("r"))
    return relative.groupBy(unit).agg((F.max("r") - F.min("r")).alias("height_range"), F.sqrt(F.avg((F.col("r") - 1) * (F.col("r") - 1))).alias("rms_from_base")).withColumn("constant", F.col("height_range") < 0.01)
