"""Scaling, principal components, ridge, forests, folds, out-of-fold prediction, metrics, support.

Sums over rows are Spark aggregates; what reaches the driver is one small matrix per fold (its side is the number of features, not of
rows), and what goes back are coefficients as literals.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from panelforge.functions.scalars import dot
from panelforge.operators.ordering import exact_quantiles, few, row_numbers, settled

ALPHAS = tuple(float(a) for a in np.logspace(-3, 3, 13))


# ------------------------------------------------------------------ scaling


def column_stats(df: DataFrame, x: str, width: int, center: Callable[[Column], Column] = F.avg, spread: Callable[[Column], Column] = F.stddev_pop) -> list[tuple[float, float]]:
    """(centre, spread) of each column of an array column; a spread of zero counts as one."""
    row = df.agg(*[a for i in range(width) for a in (center(F.col(x)[i]).alias(f"m{i}"), spread(F.col(x)[i]).alias(f"s{i}"))]).first()
    return [(float(row[f"m{i}"] or 0.0), float(row[f"s{i}"] or 0.0) or 1.0) for i in range(width)]


def scaled(x: str, stats: Sequence[tuple[float, float]], by: float = 1.0) -> Column:
    return F.array(*[(F.col(x)[i] - m) / (s * by) for i, (m, s) in enumerate(stats)])


def zscore(df: DataFrame, x: str, width: int, out: str | None = None, fit_on: DataFrame | None = None) -> DataFrame:
    """Population z-scores, fitted on `fit_on` if given."""
    return df.withColumn(out or x, scaled(x, column_stats(df if fit_on is None else fit_on, x, width)))


def robust_stats(df: DataFrame, x: str, width: int) -> list[tuple[float, float]]:
    """(median, interquartile range) of each column of an array column, exact; a range of zero counts as one."""
    cells = df.select(F.posexplode(F.slice(x, 1, width)).alias("_at", "_v"))
    # One row per column reaches the driver.
    cuts = {r["_at"]: r["_q"] for r in exact_quantiles(cells, "_v", [0.25, 0.5, 0.75], "_q", ["_at"]).collect()}
    return [(q[1] or 0.0, ((q[2] or 0.0) - (q[0] or 0.0)) or 1.0) for q in (cuts.get(i, [None] * 3) for i in range(width))]


def robust_scale(df: DataFrame, x: str, width: int, out: str | None = None) -> DataFrame:
    """(value - median) / interquartile range, exact."""
    return df.withColumn(out or x, scaled(x, robust_stats(df, x, width)))


def block_scale(df: DataFrame, blocks: dict[str, int], out: str = "x", fit_on: DataFrame | None = None) -> DataFrame:
    """Each block of columns z-scored and divided by the root of its width, so that blocks weigh alike; then joined into one array."""
    fit = df if fit_on is None else fit_on
    return df.withColumn(out, F.concat(*[scaled(b, column_stats(fit, b, n), float(np.sqrt(n))) for b, n in blocks.items()]))


# ------------------------------------------------------------------ folds


def random_folds(df: DataFrame, key: str, k: int = 5, seed: str = "") -> DataFrame:
    """Balanced folds in order of the key's hash."""
    hashed = df.withColumn("_hash", F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))))
    return row_numbers(hashed, ["_hash", key], "_r").withColumn("fold", (F.col("_r") % k).cast("int")).drop("_hash", "_r")


def group_out_folds(df: DataFrame, group: str, least_test: int = 5, least_train: int = 50, most: int = 10_000) -> list[str]:
    """Groups that can be held out: enough rows inside and outside. One row per group that can be reaches the driver; more than `most` are refused, as each is a model."""
    sizes = settled(df.groupBy(group).count())
    total = F.lit(sizes.agg(F.sum("count")).first()[0] or 0)
    held = sizes.where(F.col(group).isNotNull() & (F.col("count") >= least_test) & (total - F.col("count") >= least_train)).limit(most + 1).collect()
    if len(held) > most:
        raise ValueError(f"more than {most} groups of {group} can be held out")
    return sorted(r[0] for r in held)


def balanced_assignment(counts: Sequence[tuple], k: int) -> list[int]:
    """The fold of each (group, n), in the order given: the largest group first, ties by name, each to the fold with the fewest rows."""
    loads, fold = [0] * k, [0] * len(counts)
    for i in sorted(range(len(counts)), key=lambda i: (-counts[i][1], counts[i][0])):
        least = min(range(k), key=lambda f: loads[f])
        fold[i] = least
        loads[least] += counts[i][1]
    return fold


def balanced_group_folds(df: DataFrame, group: str, k: int = 5, most: int = 1_000_000) -> DataFrame:
    """Whole groups to folds, the largest first, each to the fold with the fewest rows. Greedy assignment is sequential, over one row per group (tiles of a grid: at most 648
    at ten degrees), so more than `most` groups are refused."""
    sizes = settled(df.groupBy(group).count())
    if sizes.count() > most:
        raise ValueError(f"more than {most} groups of {group}: greedy folds are for tiles or regions")
    counts = [(r[0], r[1]) for r in sizes.collect()]
    rows = [(g, f) for (g, _), f in zip(counts, balanced_assignment(counts, k), strict=True)]
    return df.join(few(df.sparkSession.createDataFrame(rows, f"{group} {dict(df.dtypes)[group]}, fold int")), group)


# ------------------------------------------------------------------ linear algebra on small matrices


def _grid(pdf: pd.DataFrame, x: str, width: int, more: Sequence[str] = ()) -> np.ndarray:
    """Rows by columns; what is missing counts as zero."""
    grid = np.zeros((len(pdf), width + len(more)))
    for i, row in enumerate(pdf[x]):
        if row is not None:
            grid[i, :width] = row[:width]
    for j, c in enumerate(more):
        grid[:, width + j] = pdf[c].to_numpy(float, na_value=np.nan)
    return np.nan_to_num(grid, copy=False, nan=0.0, posinf=np.inf, neginf=-np.inf)


def gram(df: DataFrame, x: str, width: int, ys: Sequence[str] = (), by: str | None = None) -> dict:
    """Per value of `by`: n, sums, cross products of [x, ys], in one pass. Partitions give their own sums, which are added up by place before they are fetched, so what reaches the driver
    depends on the width and the number of groups only."""
    m = width + len(ys)
    upper = np.triu_indices(m)
    key = df.schema[by] if by else StructField("_by", IntegerType())
    rows = df.select(F.col(x).cast("array<double>").alias("_x"), *[F.col(y).cast("double").alias(f"_y{i}") for i, y in enumerate(ys)], F.col(by).alias("_by") if by else F.lit(0).alias("_by"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for pdf in batches:
            for k, own in pdf.groupby("_by", dropna=False, sort=False):
                grid = _grid(own, "_x", width, [f"_y{i}" for i in range(len(ys))])
                found = np.concatenate([[len(grid)], grid.sum(axis=0), (grid.T @ grid)[upper]])
                k = None if pd.isna(k) else k
                held[k] = held.get(k, 0.0) + found
        for k, found in held.items():
            yield pd.DataFrame({"_by": pd.Series([k] * len(found), dtype=object if k is None or isinstance(k, str) else None), "at": np.arange(len(found)), "v": found})

    sums = rows.mapInPandas(run, StructType([StructField("_by", key.dataType), StructField("at", LongType()), StructField("v", DoubleType())])).groupBy("_by", "at").agg(F.sum("v").alias("v"))
    found: dict = {}
    for r in sums.collect():
        found.setdefault(r["_by"], np.zeros(1 + m + len(upper[0])))[r["at"]] = r["v"]
    out = {}
    for k, v in found.items():
        full = np.zeros((m, m))
        full[upper] = v[1 + m :]
        out[k if by else None] = (int(v[0]), v[1 : 1 + m], np.triu(full) + np.triu(full, 1).T)
    return out if by else out or {None: (0, np.zeros(m), np.zeros((m, m)))}


def _others(parts: dict, fold) -> tuple:
    own = [v for f, v in parts.items() if f != fold]
    return sum(v[0] for v in own), sum(v[1] for v in own), sum(v[2] for v in own)


def ridge_from_gram(n: int, sums: np.ndarray, products: np.ndarray, width: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients width x outputs, intercepts) of ridge on standardised columns, in original units."""
    mean = sums / n
    cov = products / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov)[:width], 0))
    sd[sd == 0] = 1
    a = cov[:width, :width] / np.outer(sd, sd) * n + alpha * np.eye(width)
    beta = np.linalg.solve(a, cov[:width, width:] / sd[:, None] * n) / sd[:, None]
    return beta, mean[width:] - mean[:width] @ beta


def ridge_oof(df: DataFrame, x: str, width: int, ys: Sequence[str], fold: str = "fold", alpha: float = 1.0) -> DataFrame:
    """Adds `pred_<y>`: ridge predictions of each fold by a model of the others. One aggregation serves all folds and outputs."""
    parts = gram(df, x, width, ys, fold)
    picks = {y: F.lit(None).cast("double") for y in ys}
    for f in sorted(parts):
        if len(parts) < 2:
            break
        beta, intercept = ridge_from_gram(*_others(parts, f), width, alpha)
        for j, y in enumerate(ys):
            value = F.lit(float(intercept[j])) + dot(F.col(x), F.array(*[F.lit(float(b)) for b in beta[:, j]]))
            picks[y] = F.when(F.col(fold) == f, value).otherwise(picks[y])
    return df.withColumns({f"pred_{y}": c for y, c in picks.items()})


def _loo_errors(df: DataFrame, x: str, width: int, y: str, parts: dict, alphas: Sequence[float], fold: str | None = None) -> dict:
    """Mean squared leave-one-out errors of each penalty, for models on the rows of all folds but one, by e / (1 - h) with the hat diagonal from one eigendecomposition.
    `parts`: by fold, (n, sums, products) of the model's rows. One pass for all models and penalties."""
    models, grid = {}, np.array(alphas, float)
    for f, (n, s, p) in parts.items():
        mean = s / n
        cov = p / n - np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(cov)[:width], 0))
        sd[sd == 0] = 1
        values, vectors = np.linalg.eigh(cov[:width, :width] / np.outer(sd, sd) * n)
        models[f] = (n, mean, sd, values, vectors, vectors.T @ (cov[:width, width] / sd * n))
    names = list(models)
    rows = df.select(F.col(x).cast("array<double>").alias("_x"), F.col(y).cast("double").alias("_y"), F.col(fold).alias("_f") if fold else F.lit(None).cast("int").alias("_f"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((len(names), len(grid)))
        for pdf in batches:
            data = _grid(pdf, "_x", width, ["_y"])
            for i, f in enumerate(names):
                n, mean, sd, values, vectors, g = models[f]
                own = data if f is None else data[(pdf["_f"] != f).to_numpy()]
                u = (own[:, :width] - mean[:width]) / sd @ vectors
                shrunk = 1 / (values[:, None] + grid[None, :])
                e = (own[:, width:] - mean[width] - u @ (g[:, None] * shrunk)) / (1 - 1 / n - (u * u) @ shrunk)
                sums[i] += (e * e).sum(axis=0)
        at = np.indices(sums.shape).reshape(2, -1)
        yield pd.DataFrame({"m": at[0], "a": at[1], "v": sums.ravel()})

    errors = np.zeros((len(names), len(grid)))
    for r in rows.mapInPandas(run, "m long, a long, v double").groupBy("m", "a").agg(F.sum("v").alias("v")).collect():
        errors[r["m"], r["a"]] = r["v"]
    return {f: errors[i] / models[f][0] for i, f in enumerate(names)}


def ridge_loo_alpha(train: DataFrame, x: str, width: int, y: str, alphas: Sequence[float] = ALPHAS) -> tuple[float, np.ndarray, float]:
    """(alpha, coefficients, intercept): the penalty with the least leave-one-out error. Two passes over the rows, whatever the number of penalties."""
    parts = gram(train, x, width, [y])
    best = alphas[int(np.argmin(_loo_errors(train, x, width, y, parts, alphas)[None]))]
    beta, intercept = ridge_from_gram(*parts[None], width, best)
    return best, beta[:, 0], float(intercept[0])


def ridgecv_oof(df: DataFrame, x: str, width: int, y: str, fold: str = "fold", alphas: Sequence[float] = ALPHAS) -> DataFrame:
    """Adds `pred_<y>`: per fold, the penalty is chosen by leave-one-out error on the other folds. Two passes over the rows, whatever the number of folds and penalties."""
    parts = gram(df, x, width, [y], fold)
    rest = {f: _others(parts, f) for f in sorted(parts)} if len(parts) > 1 else {}
    errors = _loo_errors(df, x, width, y, rest, alphas, fold) if rest else {}
    pred = F.lit(None).cast("double")
    for f, own in rest.items():
        beta, intercept = ridge_from_gram(*own, width, alphas[int(np.argmin(errors[f]))])
        pred = F.when(F.col(fold) == f, F.lit(float(intercept[0])) + dot(F.col(x), F.array(*[F.lit(float(b)) for b in beta[:, 0]]))).otherwise(pred)
    return df.withColumn(f"pred_{y}", pred)


def principal_components(df: DataFrame, x: str, width: int, k: int, standardise: bool = True) -> dict:
    """mean, sd, loadings (k x width, each with its largest entry positive), variance ratios."""
    n, s, p = gram(df, x, width)[None]
    mean = s / n
    cov = p / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    sd[sd == 0] = 1
    sd = sd if standardise else np.ones(width)
    values, vectors = np.linalg.eigh(cov / np.outer(sd, sd))
    order = np.argsort(-values)[:k]
    loadings = vectors[:, order].T
    loadings *= np.sign(loadings[np.arange(len(order)), np.abs(loadings).argmax(axis=1)])[:, None]
    return {"mean": mean, "sd": sd, "loadings": loadings, "ratio": values[order] / values.sum() if values.sum() else np.zeros(len(order))}


def project(x: Column, pca: dict) -> Column:
    z = F.array(*[(x[i] - float(m)) / float(s) for i, (m, s) in enumerate(zip(pca["mean"], pca["sd"], strict=True))])
    return F.array(*[dot(z, F.array(*[F.lit(float(v)) for v in row])) for row in pca["loadings"]])


def foldwise_components(df: DataFrame, x: str, width: int, k: int, fold: str = "fold", out: str = "pc") -> DataFrame:
    """Components of each fold's rows, fitted on the other folds only. One aggregation for all folds."""
    parts = gram(df, x, width, by=fold)
    pick = F.lit(None).cast("array<double>")
    for f in sorted(parts):
        n, s, p = _others(parts, f)
        mean = s / n
        cov = p / n - np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(cov), 0))
        sd[sd == 0] = 1
        values, vectors = np.linalg.eigh(cov / np.outer(sd, sd))
        loadings = vectors[:, np.argsort(-values)[:k]].T
        loadings *= np.sign(loadings[np.arange(len(loadings)), np.abs(loadings).argmax(axis=1)])[:, None]
        pick = F.when(F.col(fold) == f, project(F.col(x), {"mean": mean, "sd": sd, "loadings": loadings})).otherwise(pick)
    return df.withColumn(out, pick)


# ------------------------------------------------------------------ learners


def forest_oof(
    df: DataFrame, x: str, y: str, fold: str = "fold", trees: int = 50, depth: int = 10, least_leaf: int = 5, share: str = "0.5", seed: int = 7, key: str = "unit_id", task_bytes: int = 1 << 26
) -> DataFrame:
    """Adds `pred_<y>` by random forests of the other folds, cut at up to 32 quantiles. `share` is a fraction of the features, or another strategy of Spark ML.

    While all rows, a byte per feature, take up to `task_bytes`, tasks are given trees (`forest.binned_oof`), whose draws are hashes of `key` (of the row's place without such a column); missing
    features count as zero there, and rows without a label are only predicted. Beyond that forests are Spark ML's, which shuffles statistics of every node from every partition.
    """
    if _fraction(share) is not None:
        folds = sorted(r[0] for r in df.where(F.col(fold).isNotNull()).select(fold).distinct().collect())
        width, n = df.agg(F.max(F.size(x)), F.count(F.lit(1))).first()
        if folds and width and width > 0 and n * (width + 32) <= task_bytes:
            from panelforge.operators.forest import binned_oof

            own = settled(df.withColumn("_row", F.monotonically_increasing_id()))
            names = df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(folds)], f"_f {dict(df.dtypes)[fold]}, _own int")
            values = F.array(*[F.coalesce(F.nanvl(F.try_element_at(x, F.lit(i + 1)).cast("double"), F.lit(0.0)), F.lit(0.0)) for i in range(width)])
            drawn = F.xxhash64(key if key in df.columns else "_row")
            rows = own.join(F.broadcast(names), F.col(fold) == F.col("_f")).select("_row", drawn.alias("_h"), "_own", values.alias("_x"), F.col(y).cast("double").alias("_y"))
            found = binned_oof(settled(rows), width, len(folds), trees, least_leaf, max(1, math.ceil(_fraction(share) * width)), depth, seed)
            return own.join(found, "_row", "left").withColumnRenamed("_p", f"pred_{y}").drop("_row")
    data = df.withColumn("_features", array_to_vector(x)).withColumn("_label", F.col(y).cast("double"))
    learner = RandomForestRegressor(featuresCol="_features", labelCol="_label", predictionCol=f"pred_{y}", numTrees=trees, maxDepth=depth, minInstancesPerNode=least_leaf, featureSubsetStrategy=share, seed=seed)
    out = None
    for f in [r[0] for r in df.select(fold).distinct().orderBy(fold).collect()]:
        part = learner.fit(data.where(F.col(fold) != f)).transform(data.where(F.col(fold) == f))
        out = part if out is None else out.unionByName(part)
    return out.drop("_features", "_label")


def _fraction(share: str) -> float | None:
    """The fraction that a strategy names, if it names one."""
    return float(share) if re.fullmatch(r"0?\.\d*[1-9]\d*|1\.0+", share) else None


def mean_oof(df: DataFrame, y: str, fold: str = "fold") -> DataFrame:
    """Adds `pred_<y>`: the mean of the other folds."""
    w = df.groupBy(fold).agg(F.sum(y).alias("_s"), F.count(y).alias("_n"))
    every = Window.partitionBy()
    means = w.select(fold, ((F.sum("_s").over(every) - F.col("_s")) / F.nullif(F.sum("_n").over(every) - F.col("_n"), F.lit(0))).alias(f"pred_{y}"))
    return df.join(F.broadcast(means), fold)


def mean_oof_all(df: DataFrame, ys: Sequence[str], fold: str = "fold") -> DataFrame:
    """`mean_oof` for several outputs: one aggregation, one row per fold to the driver."""
    rows = df.groupBy(fold).agg(*[a for y in ys for a in (F.sum(y).alias(f"s_{y}"), F.count(y).alias(f"n_{y}"))]).collect()
    picks = {}
    for y in ys:
        s, n = sum(r[f"s_{y}"] or 0.0 for r in rows), sum(r[f"n_{y}"] for r in rows)
        pick = F.lit(None).cast("double")
        for r in rows:
            rest = n - r[f"n_{y}"]
            pick = F.when(F.col(fold).eqNullSafe(F.lit(r[fold])), F.lit((s - (r[f"s_{y}"] or 0.0)) / rest if rest else None).cast("double")).otherwise(pick)
        picks[f"pred_{y}"] = pick
    return df.withColumns(picks)


#: Learners by name: (frame, x, width, y, fold) to the frame with `pred_<y>`.
LEARNERS: dict[str, Callable] = {
    "mean": lambda df, x, width, y, fold="fold": mean_oof(df, y, fold),
    "ridge": lambda df, x, width, y, fold="fold": ridge_oof(df, x, width, [y], fold),
    "ridge_cv": lambda df, x, width, y, fold="fold": ridgecv_oof(df, x, width, y, fold),
    "forest": lambda df, x, width, y, fold="fold": forest_oof(df, x, y, fold),
    "deep_forest": lambda df, x, width, y, fold="fold": _deep_forest(df, x, width, y, fold),
}


def _deep_forest(df: DataFrame, x: str, width: int, y: str, fold: str) -> DataFrame:
    from panelforge.operators.forest import forest_oof as deep

    return deep(df, x, width, [y], fold)


# ------------------------------------------------------------------ metrics and support


def metrics(df: DataFrame, y: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """n, R2 (around the pooled mean), RMSE, MAE of the rows with both values."""
    e = F.col(y) - F.col(pred)
    own = df.where(F.col(y).isNotNull() & F.col(pred).isNotNull())
    return own.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), (1 - F.sum(e * e) / F.nullif(F.var_pop(y) * F.count(F.lit(1)), F.lit(0.0))).alias("r2"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))


def fold_mean_r2(df: DataFrame, y: str, pred: str, fold: str = "fold") -> DataFrame:
    """The other R2: per fold around the mean of the training rows, then the mean over folds."""
    w = Window.partitionBy()
    own = df.groupBy(fold).agg(F.sum(y).alias("s"), F.count(F.lit(1)).alias("n"), F.sum(F.col(y) * F.col(y)).alias("q"), F.sum((F.col(y) - F.col(pred)) * (F.col(y) - F.col(pred))).alias("sse"))
    m = (F.sum("s").over(w) - F.col("s")) / F.nullif(F.sum("n").over(w) - F.col("n"), F.lit(0))
    return own.withColumn("m", m).agg(F.avg(1 - F.col("sse") / F.nullif(F.col("q") - 2 * F.col("m") * F.col("s") + F.col("n") * F.col("m") * F.col("m"), F.lit(0.0))).alias("r2_mean"))


def delta_metrics(df: DataFrame, y: str, p0: str, p1: str, by: Sequence[str] = ()) -> DataFrame:
    """Differences of the second model's metrics from the first's, on the same rows."""
    e0, e1 = F.col(y) - F.col(p0), F.col(y) - F.col(p1)
    sst = F.nullif(F.var_pop(y) * F.count(F.lit(1)), F.lit(0.0))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), (1 - F.sum(e0 * e0) / sst).alias("r2_m0"), (1 - F.sum(e1 * e1) / sst).alias("r2_m1"), ((F.sum(e0 * e0) - F.sum(e1 * e1)) / sst).alias("delta_r2"),
        (F.sqrt(F.avg(e1 * e1)) - F.sqrt(F.avg(e0 * e0))).alias("delta_rmse"), (F.avg(F.abs(e1)) - F.avg(F.abs(e0))).alias("delta_mae"),
    )


def mean_row_l2(actual: Column, predicted: Column) -> Column:
    """Aggregate: mean over rows of the Euclidean norm of the error vector."""
    return F.avg(F.sqrt(F.aggregate(F.zip_with(actual, predicted, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)))


def row_error(actual: Column, predicted: Column, width: int) -> Column:
    """Euclidean norm of the difference of two arrays over their first `width` elements; missing ones count as zero."""
    at = lambda x, i: F.coalesce(F.try_element_at(x, F.lit(i + 1)), F.lit(0.0))
    return F.sqrt(sum(((at(actual, i) - at(predicted, i)) ** 2 for i in range(width)), F.lit(0.0)))


def mahalanobis(df: DataFrame, x: str, width: int, q: float = 0.95, ridge: float = 1e-6, out: str = "m_distance") -> DataFrame:
    """Adds the distance from the centre of standardised columns and `supported`: within its exact q-quantile."""
    n, s, p = gram(df, x, width)[None]
    mean = s / n
    cov = p / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    sd[sd == 0] = 1
    inverse = np.linalg.inv(cov / np.outer(sd, sd) * n / max(1, n - 1) + ridge * np.eye(width))
    z = df.withColumn("_z", F.array(*[(F.col(x)[i] - float(mean[i])) / float(sd[i]) for i in range(width)]))
    quad = sum((F.col("_z")[i] * dot(F.col("_z"), F.array(*[F.lit(float(v)) for v in inverse[i]])) for i in range(width)), F.lit(0.0))
    z = z.withColumn(out, F.sqrt(F.greatest(quad, F.lit(0.0)))).drop("_z")
    return z.join(F.broadcast(exact_quantiles(z, out, [q], "_cut"))).withColumn("supported", F.col(out) <= F.col("_cut")[0]).drop("_cut")
