"""Aggregates: counts, shares, quantile summaries, profiles, balance measures, correlations."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.scalars import ratio
from panelforge.operators.ordering import exact_quantiles, group_prefix_sums, join_counted, row_numbers


def weighted_mean(x: Column, w: Column) -> Column:
    """Weighted mean over rows that have a value; NULL without weight."""
    return ratio(F.sum(x * w), F.sum(F.when(x.isNotNull(), w)))


def kish_size(w: Column) -> Column:
    """Effective sample size of weights."""
    return ratio(F.sum(w) * F.sum(w), F.sum(w * w))


def largest_of_group(df: DataFrame, by: str, value: str, key: str) -> DataFrame:
    """The row with the largest value of each group; the smaller key on ties."""
    w = Window.partitionBy(by).orderBy(F.desc(value), key)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def top_counts(df: DataFrame, by: str, n: int = 5) -> DataFrame:
    """The most frequent values, ties in order of value."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), by).limit(n)


def quantile_summary(x: Column, quantiles: Sequence[float] = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) -> list[Column]:
    """Aggregates: valid and missing counts, extremes, exact quantiles (of groups whose distinct values fit a buffer; `quantile_table` has no such limit), mean, counts by sign."""
    v = F.when(~F.isnan(x), x)
    return [
        F.count(v).alias("n_valid"), F.count_if(v.isNull()).alias("n_missing"), F.min(v).alias("min"),
        *[F.percentile(v, F.lit(q)).alias(f"p{round(q * 100):02d}") for q in quantiles], F.max(v).alias("max"), F.avg(v).alias("mean"),
        F.count_if(v > 0).alias("n_positive"), F.count_if(v < 0).alias("n_negative"), F.count_if(v == 0).alias("n_zero"),
    ]


def quantile_table(df: DataFrame, column: str, by: Sequence[str] = (), quantiles: Sequence[float] = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) -> DataFrame:
    """`quantile_summary` for groups of any size, one row each: quantiles by ranks of distinct values in place of a buffer per group."""
    sums = df.groupBy(*by).agg(*quantile_summary(F.col(column).cast("double"), ()), F.stddev_samp(F.when(~F.isnan(F.col(column).cast("double")), F.col(column))).alias("sd"))
    own = exact_quantiles(df, column, quantiles, "_q", by).select(*[F.col(c).alias(f"_by_{c}") for c in by], *[F.col("_q")[i].alias(f"p{round(q * 100):02d}") for i, q in enumerate(quantiles)])
    if not by:
        return sums.join(F.broadcast(own))
    return sums.join(own, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by])).drop(*[f"_by_{c}" for c in by])


def profile(df: DataFrame, sentinels: Sequence[int] = (-999, -1)) -> DataFrame:
    """One row per column: type, rows, missing and distinct values, sentinels, whether it could be a key. One scan, unpivoted after aggregation."""
    kinds = dict(df.dtypes)
    numeric = {c for c, t in kinds.items() if t in ("int", "bigint", "smallint", "tinyint", "double", "float") or t.startswith("decimal")}
    aggregates = [F.count(F.lit(1)).alias("_n")]
    for c in df.columns:
        gone = F.col(c).isNull() | (F.isnan(c) if kinds[c] in ("double", "float") else F.lit(False))
        aggregates += [F.count_if(gone).alias(f"{c}__missing"), F.countDistinct(F.when(~gone, F.col(c))).alias(f"{c}__distinct")]
        aggregates += [F.count_if(F.col(c) == s if c in numeric else F.lit(False)).alias(f"{c}__s{i}") for i, s in enumerate(sentinels)]
    row = df.agg(*aggregates)
    parts = [F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("type"), F.col("_n").alias("n"), F.col(f"{c}__missing").alias("n_missing"), F.col(f"{c}__distinct").alias("n_distinct"), *[F.col(f"{c}__s{i}").alias(f"n_sentinel_{i}") for i in range(len(sentinels))]) for c in df.columns]
    out = row.select(F.explode(F.array(*parts)).alias("p")).select("p.*")
    return out.withColumn("pct_missing", ratio(100.0 * F.col("n_missing"), F.col("n"))).withColumn("id_candidate", (F.col("n_missing") == 0) & (F.col("n_distinct") == F.col("n")) & (F.col("n") > 0))


def mean_difference(x: Column, group: Column) -> Column:
    """Standardised mean difference of the rows where `group` holds against the rest: pooled sample deviation; NULL if either
    side has fewer than two values or nothing varies."""
    finite = F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
    a, b = F.when(group, finite), F.when(~group, finite)
    pooled = F.sqrt((F.var_samp(a) + F.var_samp(b)) / 2)
    return F.when((F.count(a) >= 2) & (F.count(b) >= 2), ratio(F.avg(a) - F.avg(b), pooled))


def bias_table(df: DataFrame, variables: Sequence[str], group: str) -> DataFrame:
    """One row per variable: means, medians and standardised differences of both groups, also on log10 of positive values."""
    long = df.select(F.col(group).alias("_g"), F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("x")) for v in variables])).alias("p")).select("_g", "p.*")
    g = F.col("_g")
    middle = exact_quantiles(long, "x", [0.5], "_q", ["variable", "_g"]).groupBy("variable").agg(*[F.max(F.when(side, F.col("_q")[0])).alias(name) for side, name in ((g, "median_in"), (~g, "median_out"))])
    means = long.groupBy("variable").agg(
        F.avg(F.when(g, F.col("x"))).alias("mean_in"), F.avg(F.when(~g, F.col("x"))).alias("mean_out"), mean_difference(F.col("x"), g).alias("smd"), mean_difference(F.when(F.col("x") > 0, F.log10("x")), g).alias("smd_log10"),
    )
    # One row per variable on either side.
    return means.join(F.broadcast(middle), "variable")


def match_rates(df: DataFrame, by: str, matched: str) -> DataFrame:
    """Per group: rows, matched rows, the rate, and the group's share of all and of matched rows."""
    own = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(matched)).alias("n_matched"))
    every = Window.partitionBy()
    return own.select(by, "n", "n_matched", (F.col("n_matched") / F.col("n")).alias("rate"), (F.col("n") / F.sum("n").over(every)).alias("share"), ratio(F.col("n_matched").cast("double"), F.sum("n_matched").over(every).cast("double")).alias("share_matched"))


def average_rank(df: DataFrame, column: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """Ranks from 1, ties sharing their mean, in each group. Distinct values are counted first, so the running sum is over values, not rows; frequent values don't gather
    their rows in one task. Rows without a value, or with a NULL group, are left out."""
    whole = reduce(and_, [F.col(c).isNotNull() for c in [*by, column]])
    counts = df.where(whole).groupBy(*by, column).agg(F.count(F.lit(1)).alias("_c"))
    ranks = group_prefix_sums(counts, by, [column], F.col("_c"), "_b").withColumn(out, (F.col("_b") + (F.col("_c") + 1) / 2).cast("double"))
    return join_counted(df, ranks.drop("_b"), [*by, column], "_c")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: rho and n."""
    ranked = average_rank(average_rank(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b), a, "_ra"), b, "_rb")
    return ranked.agg(F.corr("_ra", "_rb").alias("rho"), F.count(F.lit(1)).alias("n"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def beta_regularised(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def correlation_p(r: float, n: int) -> float:
    """Two-sided p-value of a correlation by the t distribution."""
    if n < 3 or not math.isfinite(r):
        return math.nan
    if abs(r) >= 1:
        return 0.0
    t2, v = r * r * (n - 2) / (1 - r * r), n - 2
    return beta_regularised(v / 2, 0.5, v / (v + t2))


def covariance_long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, covariance, correlation) of all pairs of columns, in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = df.agg(*[x for a, b in pairs for x in (F.covar_samp(a, b).alias(f"v_{a}_{b}"), F.corr(a, b).alias(f"r_{a}_{b}"))])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"v_{a}_{b}").alias("covariance"), F.col(f"r_{a}_{b}").alias("correlation")) for a, b in pairs])).alias("p")).select("p.*")


def stacked_means(df: DataFrame, value: str, groupings: dict[str, Column]) -> DataFrame:
    """(dimension, level, n, mean): several groupings of the same rows, in one aggregation over an unpivoted key."""
    keyed = df.select(F.col(value).alias("_v"), F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), c.cast("string").alias("level")) for d, c in groupings.items()])).alias("k"))
    return keyed.groupBy("k.dimension", "k.level").agg(F.count("_v").alias("n"), F.avg("_v").alias("mean"))


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n): 0 is below, bins + 1 at or above the upper end."""
    return df.where(F.col(column).isNotNull()).groupBy(F.width_bucket(F.col(column).cast("double"), F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def calendar_audit(files: DataFrame, start: str, end: str, date: str = "date", name: str = "name", expected_name: Column | None = None) -> DataFrame:
    """One row on the completeness of dated files between two days: days expected, found, missing, unexpected and repeated, files without a date or
    with another name, and whether all is complete."""
    days = files.sparkSession.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)), F.expr("interval 1 day"))).alias("day"))
    found = files.where(F.col(date).isNotNull()).groupBy(F.col(date).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    both = days.withColumn("expected", F.lit(True)).join(found, "day", "full_outer")
    wrong = F.lit(0) if expected_name is None else F.count_if(F.col(date).isNotNull() & (F.col(name) != expected_name))
    other = files.agg(F.count_if(F.col(date).isNull()).alias("n_undated"), wrong.cast("long").alias("n_wrong_name"))
    sums = both.agg(
        F.count("expected").alias("n_expected"), F.count_if(F.col("expected") & F.col("n").isNotNull()).alias("n_found"), F.count_if(F.col("expected") & F.col("n").isNull()).alias("n_missing"), F.count_if(F.col("expected").isNull()).alias("n_unexpected"),
        F.count_if(F.col("n") > 1).alias("n_repeated"), F.min(F.when(F.col("n").isNull(), F.col("day"))).alias("first_missing"),
    )
    good = (F.col("n_missing") == 0) & (F.col("n_unexpected") == 0) & (F.col("n_repeated") == 0) & (F.col("n_undated") == 0) & (F.col("n_wrong_name") == 0)
    return sums.join(F.broadcast(other)).withColumn("complete", good)


def missing_days(files: DataFrame, start: str, end: str, date: str = "date") -> DataFrame:
    days = files.sparkSession.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)), F.expr("interval 1 day"))).alias("day"))
    return days.join(files.select(F.col(date).alias("day")), "day", "left_anti")


def archive_summary(members: DataFrame) -> DataFrame:
    """Per extension of archive members (name, size, date): counts, bytes, date range, distinct and repeated days."""
    ext = F.lower(F.regexp_extract("name", r"(\.[^./\\]+)$", 1))
    return members.groupBy(ext.alias("extension")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.min("date").alias("first"), F.max("date").alias("last"), F.countDistinct("date").alias("n_days"), (F.count("date") - F.countDistinct("date")).alias("n_repeated"))


def completeness(members: DataFrame, required: Sequence[str] = (".shp", ".shx", ".dbf"), optional: Sequence[str] = (".prj", ".cpg")) -> DataFrame:
    """Per stem of file names, in any case: whether the required side files are there, and which optional ones."""
    low = F.lower("name")
    own = members.groupBy(F.regexp_replace(low, r"\.[^./\\]+$", "").alias("stem")).agg(F.collect_set(F.regexp_extract(low, r"(\.[^./\\]+)$", 1)).alias("ext"))
    want, may = F.array(*map(F.lit, required)), F.array(*map(F.lit, optional))
    return own.where(F.array_contains("ext", ".shp")).select("stem", (F.size(F.array_except(want, F.col("ext"))) == 0).alias("complete"), F.array_sort(F.array_except(want, F.col("ext"))).alias("missing"), F.array_sort(F.array_intersect(may, F.col("ext"))).alias("optional"))


def spaced_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """`n` rows evenly spaced over the order of `key`, both ends included; all rows if there are no more."""
    ranked = row_numbers(df, [key], "_r")
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    spots = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * (F.col("_n") - 1) / F.lit(max(1, n - 1))))
    return ranked.join(F.broadcast(total)).where((F.col("_n") <= n) | F.array_contains(spots, F.col("_r").cast("long"))).drop("_r", "_n")


def first_middle_last(df: DataFrame, key: str) -> DataFrame:
    ranked = row_numbers(df, [key], "_r")
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    return ranked.join(F.broadcast(total)).where((F.col("_r") == 0) | (F.col("_r") == F.floor(F.col("_n") / 2)) | (F.col("_r") == F.col("_n") - 1)).drop("_r", "_n")


def hashed_sample(df: DataFrame, key: str, n: int, seed: str = "") -> DataFrame:
    """`n` rows chosen by the hash of their key: the same whatever the partitions."""
    return df.orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key).limit(n)


def bins_right_closed(df: DataFrame, column: str, names: Sequence[str], out: str = "bin") -> DataFrame:
    """Equal-frequency bins whose edges are exact quantiles and belong to the bin below."""
    return _binned(df, column, names, out, lambda x, cut: x <= cut)


def bins_left_closed(df: DataFrame, column: str, names: Sequence[str], out: str = "bin") -> DataFrame:
    """The same with edges belonging to the bin above."""
    return _binned(df, column, names, out, lambda x, cut: x < cut)


def _binned(df, column, names, out, under):
    k = len(names)
    cuts = exact_quantiles(df, column, [i / k for i in range(1, k)], "_cuts")
    x = F.col(column)
    case = F.when(x.isNull(), None)
    for i, name in enumerate(names[:-1]):
        case = case.when(under(x, F.col("_cuts")[i]), name)
    return df.join(F.broadcast(cuts)).withColumn(out, case.otherwise(names[-1])).drop("_cuts")


def unordered_pairs(pairs: DataFrame, i: str = "i", j: str = "j") -> DataFrame:
    """One row per unordered pair, smaller id first."""
    return pairs.where(F.col(i) != F.col(j)).withColumn("_a", F.least(i, j)).withColumn("_b", F.greatest(i, j)).drop(i, j).withColumnsRenamed({"_a": i, "_b": j}).dropDuplicates([i, j])
