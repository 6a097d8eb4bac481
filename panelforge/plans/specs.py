"""Specifications and batteries: the same rows and folds, with and without a block of features."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.scalars import cross_products, distance, quadratic, tile_id
from panelforge.operators import batched as B
from panelforge.operators import forest as T
from panelforge.operators import learning as M
from panelforge.operators import neighbours as N
from panelforge.operators import quality as Q
from panelforge.operators import resampling as RS
from panelforge.operators import summaries as A
from panelforge.operators.ordering import exact_quantiles, settled


@dataclass(frozen=True)
class Spec:
    """What a comparison uses: column names, block widths, learner and folds. `blocks` are the base model's arrays with their widths; `history` is
    the block under test."""

    label: str
    y: str
    blocks: tuple[tuple[str, int], ...]
    history: tuple[str, int]
    learner: str = "ridge"
    k: int = 5
    degrees: float = 10.0
    components: int | None = None


def with_folds(df: DataFrame, spec: Spec) -> DataFrame:
    """Tiles, and folds of whole tiles balanced by size."""
    return M.balanced_group_folds(df.withColumn("tile", tile_id(F.col("lat"), F.col("lon"), spec.degrees)), "tile", spec.k)


def predictions(df: DataFrame, spec: Spec, with_history: bool, out: str, history: str | None = None) -> DataFrame:
    """Out-of-fold predictions of one model as column `out`. Principal components of the history, if asked for, are fitted on training folds."""
    parts, width = [F.col(b) for b, _ in spec.blocks], sum(n for _, n in spec.blocks)
    if with_history:
        name, n = history or spec.history[0], spec.history[1]
        if spec.components:
            df, name, n = M.foldwise_components(df, name, n, spec.components, out="_pc"), "_pc", spec.components
        parts, width = [*parts, F.col(name)], width + n
    fitted = M.LEARNERS[spec.learner](df.withColumn("_x", F.concat(*parts)), "_x", width, spec.y)
    return fitted.withColumnRenamed(f"pred_{spec.y}", out).drop("_x", "_pc")


def evaluate(df: DataFrame, spec: Spec, history: str | None = None, base: str | None = None, boot: int = 0) -> DataFrame:
    """One row: the label, both models' fit and their differences on identical rows and folds, with bootstrap intervals over tiles if `boot` draws are asked for.
    `base` names predictions of the base model that exist already."""
    if base is None:
        df, base = predictions(df, spec, False, "p0"), "p0"
    df = predictions(df, spec, True, "p1", history)
    out = M.delta_metrics(df, spec.y, base, "p1").withColumn("spec", F.lit(spec.label))
    return out.join(F.broadcast(RS.tile_bootstrap_delta(df, spec.y, base, "p1", boot).drop("n_draws"))) if boot else out


def compare(df: DataFrame, specs: Sequence[Spec]) -> DataFrame:
    """Rows of `evaluate` for each specification."""
    out = None
    for s in specs:
        row = evaluate(with_folds(df, s), s)
        out = row if out is None else out.unionByName(row)
    return out


def variants(spec: Spec, **changes: Sequence) -> list[Spec]:
    """Specifications that each change one field to one of the values."""
    return [replace(spec, label=f"{spec.label}|{f}={v}", **{f: v}) for f, values in changes.items() for v in values]


def region_holdout(df: DataFrame, spec: Spec, region: str = "region") -> DataFrame:
    """Each region predicted by models of the others; differences per region."""
    groups = M.group_out_folds(df, region, 1, 1)
    own = df.where(F.col(region).isin(groups)).withColumn("fold", F.col(region))
    own = predictions(predictions(own, spec, False, "p0"), spec, True, "p1")
    return M.delta_metrics(own, spec.y, "p0", "p1", [region])


def subgroup_deltas(df: DataFrame, y: str, p0: str, p1: str, dimensions: dict[str, Column]) -> DataFrame:
    """Differences within levels of several dimensions, from predictions that exist."""
    levels = df.withColumn("_k", F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), c.cast("string").alias("level")) for d, c in dimensions.items()])))
    return M.delta_metrics(levels.select("*", "_k.dimension", "_k.level"), y, p0, p1, ["dimension", "level"])


def size_strata(df: DataFrame, region: str = "region", size: str = "bus", out: str = "stratum") -> DataFrame:
    """Strata of region and size tercile, within which histories are shuffled."""
    binned = A.bins_left_closed(df, size, ("0", "1", "2"), "_tercile")
    return binned.withColumn(out, F.concat_ws("||", F.col(region), "_tercile")).drop("_tercile")


def histories(df: DataFrame, spec: Spec, n_shuffled: int, n_random: int, strata: Sequence[str], key: str = "unit_id", redundant: str | None = None) -> DataFrame:
    """(null, draw, key, h): the observed history (draw 0), histories shuffled within strata, random ones of the same moments, the one predicted from the base blocks, and
    products of the state block `redundant`. Draws are rows, so batteries pass over them once."""
    name, width = spec.history
    own = lambda null, draw, h: (F.lit(null).alias("null"), F.lit(draw).cast("int").alias("draw"), F.col(key), h.alias("h"))
    out = df.select(*own("observed", 0, F.col(name)))
    out = out.unionByName(pseudo_history(df, spec).select(*own("pseudo", 1, F.col("pseudo"))))
    if redundant:
        out = out.unionByName(M.zscore(df, redundant, 4, "_z").select(*own("redundant", 1, cross_products(F.col("_z")))))
    if n_shuffled:
        perm = RS.shuffled(df, name, n_shuffled, strata, key=key, out="h")
        out = out.unionByName(perm.select(F.lit("shuffled").alias("null"), F.col("draw").cast("int").alias("draw"), key, "h"))
    if n_random:
        drawn = B.random_histories(df, name, width, n_random, "h", key)
        out = out.unionByName(drawn.select(F.lit("random").alias("null"), F.col("draw").cast("int").alias("draw"), key, "h"))
    return out


def null_battery(df: DataFrame, spec: Spec, n_shuffled: int, n_random: int, strata: Sequence[str], key: str = "unit_id", redundant: str | None = None) -> DataFrame:
    """(null, draw, n, r2_m0, r2_m1, delta_r2, delta_rmse) for the histories of `histories`, ridge out of fold: one pass, whatever the number of draws."""
    own = settled(with_folds(df, spec).withColumn("_base", F.concat(*[F.col(b) for b, _ in spec.blocks])))
    width = max(spec.history[1], 9 if redundant else 0)
    nulls = histories(own, spec, n_shuffled, n_random, strata, key, redundant)
    return B.null_deltas(own, "_base", sum(n for _, n in spec.blocks), spec.y, nulls, width, key=key)


def long_rows(df: DataFrame, experiment: Column, statistics: Sequence[str]) -> DataFrame:
    """(experiment, statistic, value): a row per figure of each row."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("statistic"), F.col(c).cast("double").alias("value")) for c in statistics]))
    return df.select(experiment.alias("experiment"), cells.alias("_c")).select("experiment", "_c.statistic", "_c.value")


def compact_battery(df: DataFrame, spec: Spec, blocks: dict[str, tuple[str, int]], samples: dict[str, Column], n_draws: int, n_transfer: int, region: str = "region", key: str = "unit_id") -> DataFrame:
    """(experiment, statistic, value) of one response: the comparison and its variants, shuffled and predicted histories, regions held out, twins, transfer, and residual autocorrelation."""
    own = settled(size_strata(df, region))
    one = lambda label, base, h, sample="all": B.Comparison(label, sample, base, (h,), spec.y)
    specs = [one("ridge", ("S3", "C1"), "H"), one("strict_early_history", ("S3", "C1"), "H_early"), one("wide_context", ("S3", "C2"), "H")]
    fits = B.compare_all(own, blocks, [spec.y], samples, specs, boot=500)
    out = long_rows(fits, F.concat(F.lit("E1_"), "label"), ("n", "r2_m0", "r2_m1", "delta_r2", "delta_rmse", "delta_r2_lo", "delta_r2_hi"))
    nulls = B.null_summary(null_battery(own, spec, n_draws, 0, ["stratum"]), "delta_r2")
    out = out.unionByName(long_rows(nulls, F.concat(F.lit("E1_null_"), F.col("null")), ("n_draws", "observed", "null_mean", "null_q95", "percentile_of_observed", "p_value")))
    out = out.unionByName(long_rows(region_holdout(own, spec, region), F.concat(F.lit("E1_region_"), region), ("n", "r2_m0", "r2_m1", "delta_r2", "delta_rmse")))
    twins = twin_block(own, spec, k=5, n_draws=100, boot=100)
    out = out.unionByName(long_rows(twins, F.lit("E2_twins"), ("n_pairs", "partial_rho", "p_value", "d_r_lo", "d_r_hi", "high_minus_low")))
    moved = B.null_summary(transfer_nulls(own, spec, n_transfer, ["stratum"], key=key), "delta_rmse", lower=True).where(F.col("null") == "shuffled")
    out = out.unionByName(long_rows(moved, F.lit("E3_transfer"), ("observed", "null_mean", "null_q05", "p_value")))
    moran = residual_autocorrelation(own, spec, (8,), 99)
    return out.unionByName(long_rows(moran, F.concat_ws("_", F.lit("moran"), "model", F.concat(F.lit("k"), F.col("k").cast("string"))), ("morans_i", "p_value")))


def pseudo_history(df: DataFrame, spec: Spec, learner: str = "ridge", key: str = "unit_id", trees: int = 500) -> DataFrame:
    """Column `pseudo`: the history as ridge, or one forest of all its elements, predicts it, out of fold, from the base blocks."""
    name, width = spec.history
    outs, n = [f"_h{i}" for i in range(width)], sum(n for _, n in spec.blocks)
    parts = df.withColumn("_x", F.concat(*[F.col(b) for b, _ in spec.blocks])).withColumns({o: F.coalesce(F.try_element_at(name, F.lit(i + 1)), F.lit(0.0)) for i, o in enumerate(outs)})
    fitted = M.ridge_oof(parts, "_x", n, outs) if learner == "ridge" else T.forest_oof(parts, "_x", n, outs, key=key, trees=trees)
    return fitted.withColumn("pseudo", F.array(*[F.col(f"pred_{o}") for o in outs])).drop("_x", *outs, *[f"pred_{o}" for o in outs])


def transfer(df: DataFrame, spec: Spec, k: int = 10, with_history: bool = True, key: str = "unit_id", donors: str = "fold") -> DataFrame:
    """Adds `transferred`: inverse-distance mean of the k nearest donors of other folds (or other values of `donors`), on block-scaled features."""
    blocks = dict(spec.blocks) | (dict([spec.history]) if with_history else {})
    x = M.block_scale(df, blocks, "_tx")
    near = N.knn(x, x, k, "_tx", key, other_group=donors)
    return df.join(N.idw_predict(near, df, spec.y, key).select(F.col("i").alias(key), F.col("prediction").alias("transferred")), key, "left")


def transfer_battery(df: DataFrame, spec: Spec, k: int = 10, region: str = "region") -> DataFrame:
    """RMSE of transfer without and with history, pooled and with whole regions as recipients."""
    own = with_folds(df, spec)
    rows = []
    for scheme, donors in (("pooled", "fold"), ("leave_region_out", region)):
        for name, h in (("A0", False), ("A1", True)):
            rows.append(M.metrics(transfer(own, spec, k, h, donors=donors), spec.y, "transferred").select(F.lit(scheme).alias("scheme"), F.lit(name).alias("model"), "n", "rmse"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def twin_block(df: DataFrame, spec: Spec, k: int = 10, least_km: float = 200.0, n_draws: int = 99, boot: int = 99) -> DataFrame:
    """One row: mutual twins on block-scaled base features, partial rank correlation of response and history differences given feature and geographic distance,
    its permutation p-value and bootstrap interval of the mean response difference, high-minus-low median difference by history tercile."""
    from panelforge.functions.scalars import haversine_km

    own = with_folds(df, spec)
    x = settled(M.block_scale(own, dict(spec.blocks), "_tx"))
    pairs = settled(N.mutual_pairs(N.knn(x, x, k, "_tx", least_km=least_km)))
    full = N.pair_distances(pairs.withColumnRenamed("d", "d_sc"), x, {"d_h": spec.history[0]})
    full = settled(N.with_ends(full, x, ["lat", "lon", spec.y]).withColumn("d_geo", haversine_km(F.col("lat_i"), F.col("lon_i"), F.col("lat_j"), F.col("lon_j"))).withColumn("d_r", F.abs(F.col(f"{spec.y}_i") - F.col(f"{spec.y}_j"))))
    rho = RS.partial_spearman(full, "d_r", "d_h", ["d_sc", "d_geo"])
    null = RS.permutation_pair_null(pairs, x, spec.history[0], n_draws)
    observed = full.agg(F.avg("d_h").alias("m")).first()["m"]
    p = RS.permutation_summary(null, observed, plus_one=True).select("null_mean", "p_value")
    # Percentiles of draws, which are few; medians of pairs come from range partitions.
    interval = RS.pair_bootstrap_mean(full, x, "d_r", boot).agg(F.percentile("stat", F.lit(0.025)).alias("d_r_lo"), F.percentile("stat", F.lit(0.975)).alias("d_r_hi"))
    medians = exact_quantiles(A.bins_left_closed(full, "d_h", ("low", "mid", "high")), "d_r", [0.5], "_q", ["bin"])
    of = lambda name: F.max(F.when(F.col("bin") == name, F.col("_q")[0]))
    thirds = medians.agg((of("high") - of("low")).alias("high_minus_low"))
    n = full.agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("d_h").alias("mean_d_h"))
    return n.join(F.broadcast(p)).join(F.broadcast(interval)).join(F.broadcast(thirds)).withColumn("partial_rho", F.lit(rho))


def residual_autocorrelation(df: DataFrame, spec: Spec, ks: Sequence[int] = (4, 8), n_draws: int = 99) -> DataFrame:
    """Moran's I of both models' residuals for several neighbourhood sizes."""
    own = settled(predictions(predictions(with_folds(df, spec), spec, False, "p0"), spec, True, "p1"))
    out = None
    for k in ks:
        for m in ("p0", "p1"):
            row = RS.morans_i(own.withColumn("_e", F.col(spec.y) - F.col(m)), "_e", k, n_draws).withColumn("k", F.lit(k)).withColumn("model", F.lit(m))
            out = row if out is None else out.unionByName(row)
    return out


def reconstruction_grid(df: DataFrame, blocks: dict[str, tuple[str, int]], context: tuple[str, int], history: tuple[str, int], schemes: Sequence[str] = ("random", "region"), learners: Sequence[str] = ("mean", "ridge"), trees: int = 200) -> DataFrame:
    """How well each state, with and without context, rebuilds the history: mean R2 over its elements and mean row error, per learner and scheme. The learner `forest`
    is one forest of all elements."""
    name, width = history
    outs = [f"_h{i}" for i in range(width)]
    rows = []
    for scheme in schemes:
        folded = M.random_folds(df, "unit_id") if scheme == "random" else df.withColumn("fold", F.col("region"))
        folded = settled(folded.withColumns({o: F.try_element_at(name, F.lit(i + 1)) for i, o in enumerate(outs)}))
        for label, (block, n) in blocks.items():
            for with_context in (False, True):
                x = folded.withColumn("_x", F.concat(F.col(block), F.col(context[0])) if with_context else F.col(block))
                w = n + context[1] * with_context
                for learner in learners:
                    fit = x
                    if learner == "ridge":
                        fit = M.ridge_oof(x, "_x", w, outs)
                    elif learner == "mean":
                        fit = M.mean_oof_all(x, outs)
                    else:
                        fit = T.forest_oof(x, "_x", w, outs, trees=trees)
                    r2 = [1 - F.sum((F.col(o) - F.col(f"pred_{o}")) ** 2) / F.nullif(F.var_pop(o) * F.count(F.lit(1)), F.lit(0.0)) for o in outs]
                    error = M.mean_row_l2(F.array(*outs), F.array(*[F.col(f"pred_{o}") for o in outs]))
                    rows.append(fit.agg(F.aggregate(F.array(*r2), F.lit(0.0), lambda s, v: s + v / width).alias("mean_r2"), error.alias("mean_row_error")).select(F.lit(scheme).alias("scheme"), F.lit(label).alias("state"), F.lit(with_context).alias("context"), F.lit(learner).alias("learner"), "mean_r2", "mean_row_error"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def key_reconstruction_error(df: DataFrame, block: tuple[str, int], history: tuple[str, int], group: str = "region", least_test: int = 5, least_train: int = 50) -> float:
    """Mean over held-out groups of the mean row error of ridge; NaN without groups that can be held out."""
    name, width = history
    groups = M.group_out_folds(df, group, least_test, least_train)
    if not groups:
        return float("nan")
    outs = [f"_h{i}" for i in range(width)]
    own = df.withColumn("_fold", F.col(group)).withColumns({o: F.col(name)[i] for i, o in enumerate(outs)})
    fit = M.ridge_oof(own, block[0], block[1], outs, "_fold").where(F.col(group).isin(groups))
    per = fit.groupBy("_fold").agg(M.mean_row_l2(F.array(*outs), F.array(*[F.col(f"pred_{o}") for o in outs])).alias("e"))
    return per.agg(F.avg("e")).first()[0]


def boundary_distance(a: DataFrame, b: DataFrame, vector: str, key: str = "unit_id") -> DataFrame:
    """(key, d_boundary): distance of two definitions of each unit's history."""
    return a.select(key, F.col(vector).alias("_a")).join(b.select(key, F.col(vector).alias("_b")), key).select(key, distance(F.col("_a"), F.col("_b")).alias("d_boundary"))


def transfer_nulls(df: DataFrame, spec: Spec, n_draws: int, strata: Sequence[str], k: int = 10, key: str = "unit_id") -> DataFrame:
    """(null, draw, n, rmse, mae, delta_rmse) of transfer under shuffled, random and predicted histories, and under the observed one; `delta_rmse` is the difference to
    transfer without any history (null `none`). Distances on the base blocks are found once for all draws."""
    own = settled(M.block_scale(with_folds(df, spec), dict(spec.blocks), "_base"))
    nulls = histories(own, spec, n_draws, n_draws, strata, key)
    none = own.select(F.lit("none").alias("null"), F.lit(0).alias("draw"), key, F.array_repeat(F.lit(0.0), spec.history[1]).alias("h"))
    found = settled(B.transfer_errors(own, "_base", spec.y, nulls.unionByName(none), spec.history[1], k, key=key))
    base = found.where(F.col("null") == "none").select(F.col("rmse").alias("_r"))
    return found.where(F.col("null") != "none").join(F.broadcast(base)).withColumn("delta_rmse", F.col("rmse") - F.col("_r")).drop("_r")


def agreement(a: DataFrame, b: DataFrame, epochs: Sequence[str], key: str = "unit_id") -> DataFrame:
    """(epoch, pearson, spearman, n) of two definitions of the same columns, matched by key; p-values by the t distribution."""
    both = a.select(key, *[F.col(e).alias(f"a_{e}") for e in epochs]).join(b.select(key, *[F.col(e).alias(f"b_{e}") for e in epochs]), key)
    cells = F.explode(F.array(*[F.struct(F.lit(e).alias("epoch"), F.col(f"a_{e}").alias("a"), F.col(f"b_{e}").alias("b")) for e in epochs]))
    long = settled(both.select(cells.alias("_e")).select("_e.*").where("a IS NOT NULL AND b IS NOT NULL"))
    ranked = A.average_rank(A.average_rank(long, "a", "_ra", ["epoch"]), "b", "_rb", ["epoch"])
    # One row per epoch reaches the driver.
    sums = ranked.groupBy("epoch").agg(F.corr("a", "b").alias("r"), F.corr("_ra", "_rb").alias("s"), F.count(F.lit(1)).alias("n"))
    found = {r["epoch"]: r for r in sums.collect()}
    p = lambda r, n: A.correlation_p(r, n) if r is not None else None
    rows = [(e, r["r"], p(r["r"], r["n"]), r["s"], p(r["s"], r["n"]), r["n"]) if (r := found.get(e)) else (e, None, None, None, None, 0) for e in epochs]
    return a.sparkSession.createDataFrame(rows, "epoch string, pearson double, pearson_p double, spearman double, spearman_p double, n long")


@dataclass(frozen=True)
class Variant:
    """A variant of the separability study: the condition of its sample, the blocks of its feature space with their widths, its history, and k."""

    label: str
    sample: Column
    blocks: tuple[tuple[str, int], ...]
    history: str
    k: int = 5
    robust: bool = False


def separability_variants(df: DataFrame, variants_: Sequence[Variant], n_draws: int, strata: str = "stratum", key: str = "unit_id", least: int = 50) -> DataFrame:
    """(variant, n, mean_d_h, divergent_rate, null_mean, p_lower, relative_effect): how far apart the histories of near neighbours are, against histories shuffled within strata of the sample. All variants
    of one feature space share a search, and all share a pass over pairs; samples of fewer than `least` units have NULLs beside their n."""
    names = [v.label for v in variants_]
    row = df.agg(*[F.count_if(v.sample).alias(f"n{i}") for i, v in enumerate(variants_)]).first()
    held = [v for i, v in enumerate(variants_) if row[f"n{i}"] >= least]
    # Variants of one sample and the same blocks share a space, whose nearest are found for the largest k.
    spaces, space_of = {}, {}
    for v in held:
        of = space_of.setdefault((id(v.sample), v.blocks, v.robust), v.label)
        if of != v.label:
            spaces[of] = (spaces[of][0], max(spaces[of][1], v.k))
            continue
        own = df.where(v.sample)
        scale = lambda b, n, own=own, v=v: M.scaled(b, M.robust_stats(own, b, n) if v.robust else M.column_stats(own, b, n), n**0.5)
        spaces[v.label] = (F.when(v.sample, F.concat(*[scale(b, n) for b, n in v.blocks])), v.k)
    counts = df.sparkSession.createDataFrame([(v.label, row[f"n{i}"]) for i, v in enumerate(variants_)], "variant string, n long")
    if not held:
        return counts.withColumns({c: F.lit(None).cast("double") for c in ("mean_d_h", "divergent_rate", "null_mean", "p_lower", "relative_effect")})
    near = B.nearest_many(df, spaces, key).withColumn("_rank", F.row_number().over(Window.partitionBy("space", "i").orderBy("d", "j")))
    uses = F.broadcast(df.sparkSession.createDataFrame([(space_of[id(v.sample), v.blocks, v.robust], v.label, v.k) for v in held], "space string, variant string, _k int"))
    pairs = settled(near.join(uses, "space").where(F.col("_rank") <= F.col("_k")).select("variant", "i", "j", "d"))
    rows = None
    for v in held:
        here = df.where(v.sample).select(F.lit(v.label).alias("variant"), key, F.col(v.history).alias("h"))
        rows = here if rows is None else rows.unionByName(here)
    ends = lambda c: rows.select("variant", F.col(key).alias(c), F.col("h").alias(f"_{c}"))
    full = settled(pairs.join(ends("i"), ["variant", "i"]).join(ends("j"), ["variant", "j"]).withColumn("d_h", distance(F.col("_i"), F.col("_j"))).select("variant", "i", "j", "d", "d_h"))
    stats = None
    for v in held:
        null = RS.permutation_pair_null(full.where(F.col("variant") == v.label), df.where(v.sample), v.history, n_draws, [strata], 1, key).withColumn("variant", F.lit(v.label))
        stats = null if stats is None else stats.unionByName(null)
    seen = full.groupBy("variant").agg(F.avg("d_h").alias("mean_d_h"))
    judged = stats.join(F.broadcast(seen), "variant").groupBy("variant", "mean_d_h").agg(F.avg("stat").alias("null_mean"), F.avg((F.col("stat") <= F.col("mean_d_h")).cast("double")).alias("p_lower"))
    # One row per variant each.
    near, far = (exact_quantiles(full, c, [q], f"_{c}_cut", ["variant"]) for c, q in (("d", 0.25), ("d_h", 0.75)))
    cut = full.join(F.broadcast(near), "variant").join(F.broadcast(far), "variant").where(F.col("d") <= F.col("_d_cut")[0])
    rate = cut.groupBy("variant").agg(F.avg((F.col("d_h") > F.col("_d_h_cut")[0]).cast("double")).alias("divergent_rate"))
    out = counts.join(judged, "variant", "left").join(rate, "variant", "left").withColumn("relative_effect", (F.col("null_mean") - F.col("mean_d_h")) / F.col("null_mean"))
    assert len(set(names)) == len(names)
    return out.select("variant", "n", "mean_d_h", "divergent_rate", "null_mean", "p_lower", "relative_effect")


def divergent_rates(samples: dict[str, DataFrame], rates: dict[str, tuple[str, dict[str, int], int]], history: str, key: str = "unit_id", least: int = 50) -> DataFrame:
    """(near_cut, far_cut, n_near, divergent_rate, variant): `divergent_rate` of the nearest units in variants, each a sample by name, the blocks of its space with their widths, and k. Samples of fewer than
    `least` units are left out. Variants of one sample and the same blocks share a search, for the largest k; each search is settled once, and all variants share the passes over pairs."""
    enough = {s for s in {s for s, _, _ in rates.values()} if Q.enough(samples[s], least)}
    held = {label: (s, tuple(blocks.items()), k) for label, (s, blocks, k) in rates.items() if s in enough}
    spaces: dict[tuple, int] = {}
    for s, blocks, k in held.values():
        spaces[s, blocks] = max(k, spaces.get((s, blocks), 0))
    pairs = None
    for (s, blocks), most in spaces.items():
        x = settled(M.block_scale(samples[s], dict(blocks)).select(key, "x", history))
        near = settled(N.knn(x, x, most, key=key).select("i", "j", F.col("d").alias("d_sc"), "rank"))
        uses = [(label, k) for label, (own, same, k) in held.items() if (own, same) == (s, blocks)]
        apart = N.pair_distances(near, x, {"d_h": history}, key).select("d_sc", "d_h", "rank", F.explode(F.array(*[F.struct(F.lit(label).alias("variant"), F.lit(k).alias("k")) for label, k in uses])).alias("use"))
        own = apart.where(F.col("rank") <= F.col("use.k")).select(F.col("use.variant").alias("variant"), "d_sc", "d_h")
        pairs = own if pairs is None else pairs.unionByName(own)
    if pairs is None:
        return None
    pairs = settled(pairs)
    cuts = [exact_quantiles(pairs, c, [q], f"_{c}", ["variant"]).select("variant", F.col(f"_{c}")[0].alias(name)) for c, q, name in (("d_sc", 0.25, "near_cut"), ("d_h", 0.75, "far_cut"))]
    # One row per variant each.
    judged = pairs.join(F.broadcast(cuts[0]), "variant").join(F.broadcast(cuts[1]), "variant").where(F.col("d_sc") <= F.col("near_cut"))
    rate = judged.groupBy("variant", "near_cut", "far_cut").agg(F.count(F.lit(1)).alias("n_near"), F.avg((F.col("d_h") > F.col("far_cut")).cast("double")).alias("divergent_rate"))
    return rate.select("near_cut", "far_cut", "n_near", "divergent_rate", "variant")


def quadratic_study(df: DataFrame, spec: Spec) -> DataFrame:
    """Linear and quadratic base models against each other with history added."""
    width = sum(n for _, n in spec.blocks)
    joined = df.withColumn("_b", F.concat(*[F.col(b) for b, _ in spec.blocks]))
    z = M.zscore(joined, "_b", width).withColumn("_q", quadratic(F.col("_b"), width))
    linear = replace(spec, label="linear", blocks=(("_b", width),))
    full = replace(spec, label="quadratic", blocks=(("_q", width + width * (width + 1) // 2),))
    return compare(z, [linear, full])


def sensitivity(df: DataFrame, name: str, variants_: dict[str, Callable[[DataFrame], DataFrame]], statistic: Callable[[DataFrame], DataFrame], least: int = 50) -> DataFrame:
    """A statistic under variants of the sample; variants with too few rows are left out."""
    out = None
    for label, change in variants_.items():
        own = change(df)
        if not Q.enough(own, least):
            continue
        row = statistic(own).withColumn(name, F.lit(label))
        out = row if out is None else out.unionByName(row)
    return out
