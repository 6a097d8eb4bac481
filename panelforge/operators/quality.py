"""Quality flags and ordered exclusions with an audit trail."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.scalars import any_infinite, any_missing, any_negative
from panelforge.operators.ordering import exact_quantiles
from panelforge.operators.panel import jump_summary


def flags(panel: DataFrame, attributes: DataFrame, epochs: Sequence[int], values: Sequence[str] = ("bus", "pop", "buv"), key_columns: Sequence[str] = ("name", "country"), birth: str = "born", death: str = "died", jump: float = 3.0, dip: float = 0.5, unit: str = "unit_id") -> DataFrame:
    """Quality flags of every unit; nothing is removed. `panel` is long, `attributes` one row per unit."""
    first, last = epochs[0], epochs[-1]
    per_unit = panel.groupBy(unit).agg(
        F.countDistinct("epoch").alias("n_epochs"),
        *[F.max(any_missing([F.col(v)])).alias(f"{v}_missing") for v in values],
        *[F.max(any_negative([F.col(v)])).alias(f"{v}_negative") for v in values],
        F.max(any_infinite([F.col(v) for v in values])).alias("not_finite"),
        F.max(F.when(F.col("epoch") == last, F.col(values[0]))).alias("_end"),
    )
    same = F.count(F.lit(1)).over(Window.partitionBy(*key_columns))
    joined = attributes.withColumn("duplicate_name", same > 1).join(per_unit, unit, "left").join(jump_summary(panel, values[0], unit=unit), unit, "left")
    return joined.select(
        unit, F.coalesce("n_epochs", F.lit(0)).alias("n_epochs"),
        *[F.coalesce(f"{v}_missing", F.lit(True)).alias(f"{v}_missing") for v in values],
        *[F.coalesce(f"{v}_negative", F.lit(False)).alias(f"{v}_negative") for v in values],
        F.coalesce("not_finite", F.lit(False)).alias("not_finite"),
        (F.coalesce("n_epochs", F.lit(0)) < len(epochs)).alias("incomplete"),
        F.coalesce(F.col("_end") <= 0, F.lit(True)).alias("zero_endpoint"),
        F.coalesce(F.col("n_decreasing") > 0, F.lit(False)).alias("any_decrease"),
        F.coalesce((F.col("max_ratio") > jump) | (F.col("min_ratio") < dip), F.lit(False)).alias("extreme_jump"),
        "duplicate_name",
        F.coalesce(F.col(birth) > first, F.lit(False)).alias("born_late"),
        F.coalesce(F.col(death) <= last, F.lit(False)).alias("died_early"),
        F.coalesce("n_decreasing", F.lit(0)).alias("n_decreasing"), "max_ratio", "min_ratio", F.col(birth).alias("born"), F.col(death).alias("died"),
    )


def first_reason(reasons: Mapping[str, Column]) -> Column:
    """The first reason that holds, in the order given; NULL if none does."""
    return F.coalesce(*[F.when(c, F.lit(name)) for name, c in reasons.items()])


def exclusion_audit(rows: DataFrame, reasons: Mapping[str, Column]) -> DataFrame:
    """(step, reason, removed, remaining): how many rows each reason removes that none before it did, reasons that remove none included."""
    spark = rows.sparkSession
    counts = rows.groupBy(first_reason(reasons).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    steps = spark.createDataFrame([(i + 1, r) for i, r in enumerate(reasons)], "step int, reason string")
    removed = F.broadcast(steps).join(counts, "reason", "left").select("step", "reason", F.coalesce("n", F.lit(0)).alias("removed"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    return removed.join(F.broadcast(total)).withColumn("remaining", F.col("total") - F.sum("removed").over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0))).drop("total")


def kept(rows: DataFrame, reasons: Mapping[str, Column]) -> DataFrame:
    return rows.where(first_reason(reasons).isNull())


def enough(rows: DataFrame, least: int) -> bool:
    """Whether there are at least that many rows; reads no more than needed."""
    return rows.limit(least).count() >= least


def assert_same_rows(a: DataFrame, b: DataFrame) -> None:
    """Raises unless both hold the same rows, repeats included."""
    if not (a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()):
        raise AssertionError("the rows differ")


def assert_unique(df: DataFrame, *keys: str) -> DataFrame:
    """`df`, after raising if a key repeats."""
    if not df.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"{', '.join(keys)} repeats")
    return df


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without NULL or NaN in the columns."""
    return df.where(~any_missing([F.col(c).cast("double") for c in columns]))


def below_quantile(df: DataFrame, column: str, q: float, keep_upper: bool = True) -> DataFrame:
    """Rows at or above the exact quantile of a column (or at or below it)."""
    cut = F.broadcast(exact_quantiles(df, column, [q], "_cut"))
    return df.join(cut).where(F.col(column) >= F.col("_cut")[0] if keep_upper else F.col(column) <= F.col("_cut")[0]).drop("_cut")
