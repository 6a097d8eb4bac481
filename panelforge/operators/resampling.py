"""Permutations, bootstraps and spatial statistics, with draws that are hashes of keys.

A draw number and a key give the same value on every partition and in every SQL engine, so results don't depend on the layout and retries
repeat them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.scalars import distance, hash_draw, unit_xyz
from panelforge.operators.neighbours import knn, neighbour_mean
from panelforge.operators.ordering import few, row_numbers, settled


def draws(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n))))


def shuffled(df: DataFrame, value: str, n_draws: int, strata: Sequence[str] = (), least: int = 1, key: str = "unit_id", out: str = "value_perm", window_rows: int = 1 << 20) -> DataFrame:
    """(draw, key, out): the column's values dealt anew within strata, for each draw. In strata with fewer than `least` rows values stay.

    Receivers are ranked by key, givers by the hash of draw and key, and ranks are matched. Strata of up to `window_rows` rows are ranked by windows, each draw and stratum in one task;
    if any is larger, all are ranked over range partitions, with the same result.
    """
    groups = ["draw", *strata]
    # One number reaches the driver.
    largest = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    own = draws(df.select(key, value, *strata), n_draws).withColumn("_hash", F.md5(F.concat_ws(":", F.col("draw").cast("string"), F.col(key).cast("string"))))
    if largest <= window_rows:
        number = lambda rows, order, name: rows.withColumn(name, F.row_number().over(Window.partitionBy(*groups).orderBy(*order)) - 1)
    else:
        number = lambda rows, order, name: row_numbers(rows, order, name, groups)
    takers = number(own.drop("_hash"), [key], "_to")
    givers = number(own.select(*groups, key, "_hash", value), ["_hash", key], "_from").select(*[F.col(g).alias(f"_g_{g}") for g in groups], "_from", F.col(value).alias("_given"))
    # Null-safe on strata, which may be missing.
    cond = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in groups] + [F.col("_to") == F.col("_from")]
    dealt = takers.join(givers, cond).select("draw", key, *strata, value, "_given")
    if least <= 1:
        return dealt.select("draw", key, F.col("_given").alias(out))
    sizes = few(df.groupBy(*[F.col(g).alias(f"_s_{g}") for g in strata]).agg(F.count(F.lit(1)).alias("_n")))
    sized = dealt.join(sizes, [F.col(g).eqNullSafe(F.col(f"_s_{g}")) for g in strata]) if strata else dealt.crossJoin(sizes)
    return sized.select("draw", key, F.when(F.col("_n") >= least, F.col("_given")).otherwise(F.col(value)).alias(out))


def drawn_by_tasks(
    units: DataFrame, pairs: DataFrame, value: str, n_draws: int, statistic: Callable[[np.ndarray, np.ndarray, np.ndarray], float | None], strata: Sequence[str] = (), least: int = 1, key: str = "unit_id", task_bytes: int = 1 << 27
) -> DataFrame | None:
    """(draw, stat): `statistic` of (values, i, j) for each shuffle of `shuffled`: the units' dealt vectors, in the order of strata and keys, and the places of both ends of every pair between units.

    Draws meet the same units and pairs, so tasks are given draws, and get units and pairs once, in packed columns. None where that isn't so: more than `task_bytes` of them, keys that aren't whole numbers
    or repeat, or vectors of several lengths or with missing entries. Rows of draws serve these.
    """
    kinds = dict(units.dtypes)
    vector = F.array(F.col(value).cast("double")) if not kinds[value].startswith("array") else F.col(value).cast("array<double>")
    if kinds[key] not in ("tinyint", "smallint", "int", "bigint"):
        return None
    own = units.select(F.col(key).cast("long").alias("_k"), vector.alias("_v"), (F.to_json(F.struct(*strata)) if strata else F.lit("")).alias("_s"))
    held = own.agg(F.count("_k"), F.countDistinct("_k"), F.min(F.size("_v")), F.max(F.size("_v")), F.count_if(F.col("_v").isNull() | F.exists("_v", lambda e: e.isNull())), F.count(F.lit(1))).first()
    n, width, many = held[0], held[3], pairs.count()
    if not n or not held[0] == held[1] == held[5] or held[2] != width or held[4] or not width or n * 8 * (width + 3) + 16 * many > task_bytes:
        return None
    packs = lambda df, of: df.groupBy(F.pmod(F.xxhash64(df.columns[0]), F.lit(max(1, of // 8192))).alias("_pack"))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    a = packs(own, n).agg(F.collect_list(F.struct("_k", "_v", "_s")).alias("_r")).select(F.col("_r._k").alias("_k"), F.flatten("_r._v").alias("_v"), F.col("_r._s").alias("_s"), none("bigint").alias("_i"), none("bigint").alias("_j"))
    b = packs(pairs.select(F.col("i").cast("long"), F.col("j").cast("long")), many).agg(F.collect_list(F.struct("i", "j")).alias("_r")).select(none("bigint").alias("_k"), none("double").alias("_v"), none("string").alias("_s"), F.col("_r.i").alias("_i"), F.col("_r.j").alias("_j"))
    spark = units.sparkSession
    tasks = max(1, min(n_draws, 4 * spark.sparkContext.defaultParallelism))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, parts = None, []
        for batch in batches:
            if batch.num_rows:
                task = int(batch.column("_task")[0].as_py())
                parts.append([batch.column(c).flatten() for c in ("_k", "_v", "_s", "_i", "_j")])
        if task is None:
            return
        k, v, s, i, j = (pa.chunked_array(c) for c in zip(*parts, strict=True))
        code = s.combine_chunks().dictionary_encode().indices.to_numpy()
        k, v = k.to_numpy(), v.to_numpy().reshape(-1, width)
        order = np.lexsort((k, code))
        k, v, code = k[order], v[order], code[order]
        fixed = np.bincount(code)[code] < least
        i, j = _places(k, i.to_numpy(), j.to_numpy())
        words = [b":%d" % key for key in k.tolist()]
        found = []
        for draw in range(task + 1, n_draws + 1, tasks):
            begun = md5(str(draw).encode())
            digests = []
            for word in words:
                own = begun.copy()
                own.update(word)
                digests.append(own.digest())
            bits = np.frombuffer(b"".join(digests), ">u8").reshape(-1, 2).astype(np.uint64)
            givers = np.lexsort((k, bits[:, 1], bits[:, 0], code))
            givers[fixed] = np.flatnonzero(fixed)
            stat = statistic(v[givers], i, j)
            if stat is not None:
                found.append((draw, stat))
        yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int32()), pa.array([x for _, x in found], pa.float64())], names=["draw", "stat"])

    # One row per partition: every task has its own draws.
    asked = spark.range(0, tasks, 1, tasks).select(F.col("id").alias("_task"))
    return settled(asked.join(F.broadcast(a.unionByName(b))).mapInArrow(run, "draw int, stat double"))


def _places(keys: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of both ends among the keys, of pairs that have both there."""
    order = np.argsort(keys, kind="stable")
    there = [np.minimum(np.searchsorted(keys, e, sorter=order), len(keys) - 1) for e in (i, j)]
    both = (keys[order[there[0]]] == i) & (keys[order[there[1]]] == j)
    return order[there[0][both]], order[there[1][both]]


def _mean_distance(v: np.ndarray, i: np.ndarray, j: np.ndarray, rows: int = 1 << 16) -> float | None:
    total = sum(float(np.sqrt(((v[i[x : x + rows]] - v[j[x : x + rows]]) ** 2).sum(axis=1)).sum()) for x in range(0, len(i), rows))
    return total / len(i) if len(i) else None


def _weighed_product(v: np.ndarray, i: np.ndarray, j: np.ndarray) -> float | None:
    """Sum of values times the mean of their neighbours', over the sum of squares, of values that have neighbours."""
    z, n = v[:, 0], np.bincount(i, minlength=len(v))
    near = np.bincount(i, z[j], len(v))
    has = n > 0
    square = float((z[has] ** 2).sum())
    return float((z[has] * near[has] / n[has]).sum()) / square if square else None


def permutation_pair_null(pairs: DataFrame, units: DataFrame, vector: str, n_draws: int, strata: Sequence[str] = (), least: int = 5, key: str = "unit_id", task_bytes: int = 1 << 27) -> DataFrame:
    """(draw, stat): mean distance over the pairs after each shuffle of the vectors among units. Up to `task_bytes` of units and pairs, tasks are given draws; beyond that, draws are rows."""
    pairs = settled(pairs.select("i", "j"))
    drawn = drawn_by_tasks(units, pairs, vector, n_draws, _mean_distance, strata, least, key, task_bytes)
    if drawn is not None:
        return drawn
    perm = shuffled(units, vector, n_draws, strata, least, key)
    a = perm.select("draw", F.col(key).alias("i"), F.col("value_perm").alias("_a"))
    b = perm.select("draw", F.col(key).alias("j"), F.col("value_perm").alias("_b"))
    return pairs.select("i", "j").join(a, "i").join(b, ["draw", "j"]).groupBy("draw").agg(F.avg(distance(F.col("_a"), F.col("_b"))).alias("stat"))


def permutation_summary(null: DataFrame, observed: float, plus_one: bool = False, lower: bool = True) -> DataFrame:
    """Mean, deviation and quantiles of a null distribution, the p-value of the observed statistic and its relative effect."""
    hit = F.count_if(F.col("stat") <= observed if lower else F.col("stat") >= observed)
    n = F.count(F.lit(1))
    return null.agg(n.alias("n_draws"), F.avg("stat").alias("null_mean"), F.stddev_pop("stat").alias("null_sd"), F.percentile("stat", F.lit(0.05)).alias("q05"), F.percentile("stat", F.lit(0.95)).alias("q95"), ((hit + 1) / (n + 1) if plus_one else hit / n).alias("p_value"), ((F.avg("stat") - observed) / F.avg("stat")).alias("relative_effect")).withColumn("observed", F.lit(observed))


def tile_counts(tiles: DataFrame, n_draws: int, tile: str = "tile") -> DataFrame:
    """(draw, tile, times): how often each tile is drawn when as many tiles are drawn with replacement. Tiles are few (a grid's), rows aren't touched."""
    ranked = tiles.select(tile).distinct().withColumn("_no", F.row_number().over(Window.orderBy(tile)) - 1)
    total = ranked.agg(F.count(F.lit(1)).alias("_t"))
    picks = draws(total, n_draws).withColumn("_p", F.explode(F.sequence(F.lit(1), F.col("_t").cast("int"))))
    seed = F.md5(F.concat_ws(":", F.col("draw").cast("string"), F.col("_p").cast("string")))
    no = (F.conv(F.substring(seed, 1, 8), 16, 10).cast("long") % F.col("_t")).cast("long")
    return picks.withColumn("_no", no).groupBy("draw", "_no").agg(F.count(F.lit(1)).alias("times")).join(F.broadcast(ranked), "_no").select("draw", tile, "times")


def tile_bootstrap_delta(df: DataFrame, y: str, p0: str, p1: str, n_draws: int, tile: str = "tile", level: float = 0.95) -> DataFrame:
    """One row: mean, sample deviation and percentile interval of the metric differences over resampled tiles. Rows are reduced to sums per tile once."""
    e0, e1 = F.col(y) - F.col(p0), F.col(y) - F.col(p1)
    sums = df.groupBy(tile).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("s"), F.sum(F.col(y) * F.col(y)).alias("q"), F.sum(e0 * e0).alias("a"), F.sum(e1 * e1).alias("b"), F.sum(F.abs(e0)).alias("c"), F.sum(F.abs(e1)).alias("d"))
    times = tile_counts(sums, n_draws, tile)
    w = lambda c: F.sum(F.col(c) * F.col("times"))
    per = times.join(sums, tile).groupBy("draw").agg(
        ((w("a") - w("b")) / F.nullif(w("q") - w("s") * w("s") / w("n"), F.lit(0.0))).alias("delta_r2"), (F.sqrt(w("b") / w("n")) - F.sqrt(w("a") / w("n"))).alias("delta_rmse"), ((w("d") - w("c")) / w("n")).alias("delta_mae")
    )
    lo, hi = (1 - level) / 2, (1 + level) / 2
    out = []
    for c in ("delta_r2", "delta_rmse", "delta_mae"):
        out += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_sd"), F.percentile(c, F.lit(lo)).alias(f"{c}_lo"), F.percentile(c, F.lit(hi)).alias(f"{c}_hi")]
    return per.agg(F.count(F.lit(1)).alias("n_draws"), *out)


def pair_bootstrap(pairs: DataFrame, tiles: DataFrame, statistic: Callable[[Column], Column], n_draws: int, least: int = 10, tile: str = "tile", key: str = "unit_id") -> DataFrame:
    """(draw, stat): a weighted statistic over pairs, each weighing the product of the times its ends' tiles were drawn; draws
    with `least` or fewer pairs are left out. `statistic` takes the weight column and returns an aggregate."""
    times = tile_counts(tiles, n_draws, tile)
    ends = pairs.join(tiles.select(F.col(key).alias("i"), F.col(tile).alias("_ti")), "i").join(tiles.select(F.col(key).alias("j"), F.col(tile).alias("_tj")), "j")
    a, b = times.select("draw", F.col(tile).alias("_ti"), F.col("times").alias("_wi")), times.select("draw", F.col(tile).alias("_tj"), F.col("times").alias("_wj"))
    weighed = ends.join(a, "_ti").join(b, ["draw", "_tj"]).withColumn("_w", F.col("_wi") * F.col("_wj"))
    return weighed.groupBy("draw").agg(F.sum("_w").alias("_n"), statistic(F.col("_w")).alias("stat")).where(F.col("_n") > least).select("draw", "stat")


def pair_bootstrap_mean(pairs: DataFrame, tiles: DataFrame, value: str, n_draws: int, least: int = 10, tile: str = "tile", key: str = "unit_id", chunk: int = 50) -> DataFrame:
    """(draw, stat): `pair_bootstrap` of the weighted mean of a column. Pairs are summed by their ends' tiles once, so a draw costs as much as there are pairs of tiles of a grid, not
    as there are pairs."""
    from panelforge.operators.batched import tile_times

    names = [r[0] for r in few_tiles(tiles, tile)]
    ends = pairs.join(tiles.select(F.col(key).alias("i"), F.col(tile).alias("_ti")), "i").join(tiles.select(F.col(key).alias("j"), F.col(tile).alias("_tj")), "j")
    sums = ends.groupBy("_ti", "_tj").agg(F.sum(value).alias("s"), F.count(value).alias("v"), F.count(F.lit(1)).alias("n"))
    packed = sums.agg(F.collect_list(F.struct("_ti", "_tj", "s", "v", "n")).alias("_sums"))
    spark = pairs.sparkSession
    chunks = spark.range(0, n_draws, chunk, min(-(-n_draws // chunk), 4 * spark.sparkContext.defaultParallelism)).join(F.broadcast(packed))

    def run(pdfs):
        for pdf in pdfs:
            for first, rows in zip(pdf["id"], pdf["_sums"], strict=True):
                if rows is None or not len(rows):
                    continue
                at = {name: i for i, name in enumerate(names)}
                a, b = (np.array([at[r[c]] for r in rows]) for c in ("_ti", "_tj"))
                s, v, n = (np.array([r[c] or 0 for r in rows], float) for c in ("s", "v", "n"))
                times = tile_times(len(names), min(chunk, n_draws - first), first)
                weight = times[:, a] * times[:, b]
                held = (weight @ n > least) & (weight @ v > 0)
                yield pd.DataFrame({"draw": (first + 1 + np.flatnonzero(held)).astype(np.int32), "stat": (weight @ s)[held] / (weight @ v)[held]})

    return chunks.mapInPandas(run, "draw int, stat double")


def few_tiles(tiles: DataFrame, tile: str, most: int = 100_000) -> list:
    """The distinct tiles of a grid, in order; more than `most` are refused."""
    found = tiles.select(tile).distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} tiles")
    return sorted(found)


def partial_correlation(r: dict[tuple[str, str], float], a: str, b: str, given: Sequence[str]) -> float:
    """Correlation of a and b given other variables, from a correlation table."""
    names = [a, b, *given]
    m = np.array([[1.0 if x == y else r[(x, y)] if (x, y) in r else r[(y, x)] for y in names] for x in names])
    inverse = np.linalg.pinv(m)
    return float(-inverse[0, 1] / np.sqrt(inverse[0, 0] * inverse[1, 1]))


def partial_spearman(df: DataFrame, a: str, b: str, given: Sequence[str]) -> float:
    """Partial correlation of average ranks. One row of correlations reaches the driver."""
    from panelforge.operators.summaries import average_rank

    names = [a, b, *given]
    ranked = df.select(*names)
    for c in names:
        ranked = average_rank(ranked, c, f"_r_{c}")
    pairs = [(x, y) for i, x in enumerate(names) for y in names[i + 1 :]]
    row = ranked.agg(*[F.corr(f"_r_{x}", f"_r_{y}").alias(f"{x}|{y}") for x, y in pairs]).first()
    return partial_correlation({(x, y): row[f"{x}|{y}"] for x, y in pairs}, a, b, given)


def morans_i(df: DataFrame, value: str, k: int = 8, n_draws: int = 99, key: str = "unit_id", task_bytes: int = 1 << 27) -> DataFrame:
    """Moran's I with row-standardised k-nearest weights on the sphere, and its permutation p-value (plus one). Neighbours are found once; draws
    only move values. Up to `task_bytes` of units and neighbours, tasks are given draws; beyond that, draws are rows."""
    base = df.select(key, F.col(value).cast("double").alias("v"), unit_xyz(F.col("lat"), F.col("lon")).alias("x"))
    near = settled(knn(base, base, k, "x", key))
    centred = base.join(F.broadcast(base.agg(F.avg("v").alias("_m")))).select(key, (F.col("v") - F.col("_m")).alias("z"))
    mean = neighbour_mean(near, centred, "z", key)
    observed = centred.join(mean, centred[key] == mean["i"]).agg((F.sum(F.col("z") * F.col("neighbour_mean")) / F.nullif(F.sum(F.col("z") * F.col("z")), F.lit(0.0))).alias("i")).first()["i"]
    drawn = drawn_by_tasks(centred, near, "z", n_draws, _weighed_product, key=key, task_bytes=task_bytes)
    if drawn is not None:
        return permutation_summary(drawn, observed, plus_one=True, lower=False).select(F.col("observed").alias("morans_i"), "null_mean", "null_sd", "p_value")
    perm = shuffled(centred, "z", n_draws, key=key, out="z")
    there = near.select("i", "j").join(perm.select("draw", F.col(key).alias("j"), F.col("z").alias("zj")), "j").groupBy("draw", "i").agg(F.avg("zj").alias("zbar"))
    null = there.join(perm.select("draw", F.col(key).alias("i"), "z"), ["draw", "i"]).groupBy("draw").agg((F.sum(F.col("z") * F.col("zbar")) / F.nullif(F.sum(F.col("z") * F.col("z")), F.lit(0.0))).alias("stat"))
    return permutation_summary(null, observed, plus_one=True, lower=False).select(F.col("observed").alias("morans_i"), "null_mean", "null_sd", "p_value")


def matched_random(df: DataFrame, x: str, width: int, seed: int = 7, out: str = "x_random", key: str = "unit_id") -> DataFrame:
    """Normal vectors with the mean and covariance of the array column: its lower Cholesky factor times independent normals, each made of two hash draws of seed, place and key by the
    Box-Muller transform. Covariances of less than full rank get 1e-12 of their trace on the diagonal."""
    from panelforge.functions.scalars import dot
    from panelforge.operators.learning import gram

    n, s, p = gram(df, x, width)[None]
    mean = s / max(1, n)
    cov = (p - n * np.outer(mean, mean)) / max(1, n - 1)
    root = np.linalg.cholesky(cov + (1e-12 * np.trace(cov) + 1e-300) * np.eye(width))
    uniform = lambda i, half: (hash_draw(F.concat(F.lit(f"{seed}:{2 * i + half}:"), F.col(key).cast("string")), 2**32) + 0.5) / 2.0**32
    normal = F.array(*[F.sqrt(-2 * F.ln(uniform(i, 0))) * F.cos(F.lit(2 * np.pi) * uniform(i, 1)) for i in range(width)])
    drawn = df.withColumn("_e", normal)
    return drawn.withColumn(out, F.array(*[F.lit(float(mean[i])) + dot(F.col("_e"), F.array(*[F.lit(float(v)) for v in root[i]])) for i in range(width)])).drop("_e")


__all__ = ["draws", "hash_draw", "matched_random", "morans_i", "pair_bootstrap", "partial_correlation", "partial_spearman", "permutation_pair_null", "permutation_summary", "shuffled", "tile_bootstrap_delta", "tile_counts"]
