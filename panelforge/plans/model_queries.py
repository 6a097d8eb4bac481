"""Queries of scaling, learning, resampling, decisions and batteries, with SQL where it can express them."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from panelforge.functions import scalars as S
from panelforge.operators import batched as B
from panelforge.operators import decisions as D
from panelforge.operators import forest as T
from panelforge.operators import learning as M
from panelforge.operators import neighbours as N
from panelforge.operators import panel as P
from panelforge.operators import quality as Q
from panelforge.operators import resampling as RS
from panelforge.operators import summaries as A
from panelforge.operators.ordering import settled
from panelforge.plans import specs as X
from panelforge.plans.base import EPOCHS, LAST, STOCK, U, WIDE, stock, t, units, wide
from panelforge.plans.relational_queries import _KM, _PAIRS, _emb, _pairs

R = F.round
Q_ = {}
H = 6


def query(name: str, sql: str | None = None):
    def add(f):
        Q_[name] = (f, sql)
        return f

    return add


_E = "e AS (SELECT vec_id AS unit_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x, label, CAST(vec_id * 37 % 160 - 80 AS DOUBLE) AS lat, CAST(vec_id * 53 % 360 - 180 AS DOUBLE) AS lon FROM embeddings)"


@query("ml1_zscores", f"WITH {WIDE} SELECT unit_id, round((S[1] - avg(S[1]) OVER ()) / stddev_pop(S[1]) OVER (), 5) AS z1, round((S[4] - avg(S[4]) OVER ()) / stddev_pop(S[4]) OVER (), 5) AS z4 FROM wide")
def _(spark, sf):
    z = M.zscore(wide(spark, sf), "S", 4)
    return z.select("unit_id", R(F.col("S")[0], 5).alias("z1"), R(F.col("S")[3], 5).alias("z4"))


@query("ml2_block_scaling", f"WITH {WIDE} SELECT unit_id, round((S[1] - avg(S[1]) OVER ()) / stddev_pop(S[1]) OVER () / sqrt(4), 5) AS x1, round((lat - avg(lat) OVER ()) / stddev_pop(lat) OVER () / sqrt(3), 5) AS x5 FROM wide")
def _(spark, sf):
    z = M.block_scale(wide(spark, sf), {"S": 4, "C": 3})
    return z.select("unit_id", R(F.col("x")[0], 5).alias("x1"), R(F.col("x")[4], 5).alias("x5"))


@query("ml3_robust_scaling", f"WITH {WIDE}, q AS (SELECT quantile_cont(elev, 0.5) AS m, quantile_cont(elev, 0.75) - quantile_cont(elev, 0.25) AS r FROM wide) SELECT unit_id, round((elev - m) / r, 6) AS z3 FROM wide, q")
def _(spark, sf):
    return M.robust_scale(wide(spark, sf), "C", 3).select("unit_id", R(F.col("C")[2], 6).alias("z3"))


@query("ml4_principal_components")
def _(spark, sf):
    w = wide(spark, sf)
    pca = M.principal_components(w, "H", H, 5)
    return spark.createDataFrame([(i + 1, float(r), [float(v) for v in row]) for i, (r, row) in enumerate(zip(pca["ratio"], pca["loadings"], strict=True))], "component int, variance_ratio double, loadings array<double>")


@query("ml5_foldwise_components")
def _(spark, sf):
    w = wide(spark, sf).withColumn("fold", (F.col("unit_id") % 5).cast("int"))
    return M.foldwise_components(w, "H", H, 3).select("unit_id", "fold", "pc")


@query("ml6_mean_predictor", "WITH e AS (SELECT vec_id, embedding[1]::DOUBLE AS y, CAST(vec_id % 5 AS INTEGER) AS fold FROM embeddings), s AS (SELECT fold, sum(y) AS s, count(*) AS n FROM e GROUP BY 1) SELECT vec_id AS unit_id, round((SELECT sum(s) / sum(n) FROM s WHERE s.fold <> e.fold), 8) AS pred FROM e")
def _(spark, sf):
    e = _emb(spark, sf).select("unit_id", F.col("x")[0].alias("y"), (F.col("unit_id") % 5).cast("int").alias("fold"))
    return M.mean_oof(e, "y").select("unit_id", R("pred_y", 8).alias("pred"))


@query(
    "ml7_ridge_one_feature",
    """WITH e AS (SELECT vec_id, embedding[1]::DOUBLE AS y, embedding[2]::DOUBLE AS x, vec_id % 5 AS fold FROM embeddings), f AS (SELECT DISTINCT fold AS k FROM e),
    m AS (SELECT k, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) / stddev_pop(x) * count(*) / (count(*) + 1.0) / stddev_pop(x) AS b FROM e, f WHERE fold <> k GROUP BY k) SELECT vec_id AS unit_id, round(my + b * (x - mx), 7) AS pred FROM e JOIN m ON fold = k""",
)
def _(spark, sf):
    e = _emb(spark, sf).select("unit_id", F.col("x")[0].alias("y"), F.array(F.col("x")[1]).alias("f"), (F.col("unit_id") % 5).cast("int").alias("fold"))
    return M.ridge_oof(e, "f", 1, ["y"]).select("unit_id", R("pred_y", 7).alias("pred"))


@query("ml7_ridge")
def _(spark, sf):
    e = _emb(spark, sf).withColumn("y", F.col("x")[0]).withColumn("f", F.slice("x", 2, 63)).withColumn("fold", (F.col("unit_id") % 5).cast("int"))
    return M.metrics(M.ridge_oof(e, "f", 63, ["y"]), "y", "pred_y")


@query("ml8_ridge_cv")
def _(spark, sf):
    e = _emb(spark, sf).withColumn("y", F.col("x")[0]).withColumn("f", F.slice("x", 2, 63)).withColumn("fold", (F.col("unit_id") % 5).cast("int"))
    return M.metrics(M.ridgecv_oof(e, "f", 63, "y"), "y", "pred_y")


@query("ml9_forest")
def _(spark, sf):
    e = _emb(spark, sf).withColumn("y", F.col("x")[0]).withColumn("f", F.slice("x", 2, 63)).withColumn("fold", (F.col("unit_id") % 5).cast("int"))
    return M.metrics(M.forest_oof(settled(e), "f", "y", trees=200, depth=10), "y", "pred_y")


@query("ml9_deep_forest")
def _(spark, sf):
    """500 trees without a limit of depth, half the features at each node, leaves of five rows or more, for two outputs together."""
    e = _emb(spark, sf).select("unit_id", F.col("x")[0].alias("y"), F.col("x")[1].alias("z"), F.slice("x", 3, 62).alias("f"), (F.col("unit_id") % 5).cast("int").alias("fold"))
    own = settled(T.forest_oof(e, "f", 62, ["y", "z"]).drop("f"))
    return M.metrics(own, "y", "pred_y").withColumn("output", F.lit("y")).unionByName(M.metrics(own, "z", "pred_z").withColumn("output", F.lit("z")))


@query("ml17_pseudo_history")
def _(spark, sf):
    """One forest of all elements predicts the history out of fold."""
    own = X.pseudo_history(settled(X.with_folds(_spec_frame(spark, sf), _SPEC)), _SPEC, "forest")
    return own.select("unit_id", "fold", F.size("pseudo").alias("width"), M.row_error(F.col("H"), F.col("pseudo"), H).alias("error"))


@query("ml10_random_folds", "SELECT s_suppkey AS unit_id, CAST((row_number() OVER (ORDER BY md5(CAST(s_suppkey AS VARCHAR)), s_suppkey) - 1) % 5 AS INTEGER) AS fold FROM supplier")
def _(spark, sf):
    return M.random_folds(t(spark, sf, "supplier").select(F.col("s_suppkey").alias("unit_id")), "unit_id")


@query("ml11_group_out", f"WITH {U} SELECT region, count(*) AS n FROM units GROUP BY 1 HAVING count(*) >= 5 AND (SELECT count(*) FROM units) - count(*) >= 50")
def _(spark, sf):
    u = units(spark, sf)
    return u.where(F.col("region").isin(M.group_out_folds(u, "region"))).groupBy("region").agg(F.count(F.lit(1)).alias("n"))


@query(
    "ml12_balanced_folds",
    f"""WITH RECURSIVE {U}, u AS (SELECT *, CAST(floor((lat + 90) / 10) * 1000 + floor((lon + 180) / 10) AS BIGINT) AS tile FROM units),
    g AS (SELECT tile, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, tile) AS r FROM u GROUP BY 1),
    w(r, loads, tile, fold) AS (SELECT 0::BIGINT, [0, 0, 0, 0, 0]::BIGINT[], NULL::BIGINT, NULL::INTEGER UNION ALL
        SELECT g.r, list_transform(range(1, 6), lambda i: loads[i] + CASE WHEN i = list_position(loads, list_min(loads)) THEN g.n ELSE 0 END), g.tile, CAST(list_position(loads, list_min(loads)) - 1 AS INTEGER) FROM w JOIN g ON g.r = w.r + 1)
    SELECT unit_id, u.tile, fold FROM u JOIN w ON w.tile = u.tile""",
)
def _(spark, sf):
    u = units(spark, sf).withColumn("tile", S.tile_id(F.col("lat"), F.col("lon")))
    return M.balanced_group_folds(u, "tile").select("unit_id", "tile", "fold")


@query("ml13_out_of_fold")
def _(spark, sf):
    own = X.with_folds(_spec_frame(spark, sf), _SPEC)
    return X.predictions(X.predictions(own, _SPEC, False, "p0"), _SPEC, True, "p1").select("unit_id", "fold", R("p0", 6).alias("p0"), R("p1", 6).alias("p1"))


@query("rs16_second_response")
def _(spark, sf):
    """The compact replication: the same specification with another response."""
    own = _spec_frame(spark, sf).withColumn("y2", F.log(F.col("pop")) + F.col("H")[1])
    second = replace(_SPEC, label="second", y="y2")
    return X.evaluate(X.with_folds(own, second), second, boot=200)


@query("ml14_metrics", "SELECT l_returnflag, count(*) AS n, round(1 - sum(pow(l_tax - l_discount, 2)) / (var_pop(l_tax) * count(*)), 6) AS r2, round(sqrt(avg(pow(l_tax - l_discount, 2))), 8) AS rmse, round(avg(abs(l_tax - l_discount)), 8) AS mae FROM lineitem GROUP BY 1")
def _(spark, sf):
    return M.metrics(t(spark, sf, "lineitem"), "l_tax", "l_discount", ["l_returnflag"]).select("l_returnflag", "n", R("r2", 6).alias("r2"), R("rmse", 8).alias("rmse"), R("mae", 8).alias("mae"))


@query(
    "ml14_deltas",
    "SELECT count(*) AS n, round((sum(pow(l_tax - l_discount, 2)) - sum(pow(l_tax - 0.04, 2))) / (var_pop(l_tax) * count(*)), 6) AS delta_r2, round(sqrt(avg(pow(l_tax - 0.04, 2))) - sqrt(avg(pow(l_tax - l_discount, 2))), 8) AS delta_rmse, round(avg(abs(l_tax - 0.04)) - avg(abs(l_tax - l_discount)), 8) AS delta_mae FROM lineitem",
)
def _(spark, sf):
    d = M.delta_metrics(t(spark, sf, "lineitem").withColumn("p1", F.lit(0.04)), "l_tax", "l_discount", "p1")
    return d.select("n", R("delta_r2", 6).alias("delta_r2"), R("delta_rmse", 8).alias("delta_rmse"), R("delta_mae", 8).alias("delta_mae"))


@query("ml15_reconstruction_grid")
def _(spark, sf):
    w = settled(wide(spark, sf).withColumn("S1", F.slice("S", 1, 2)).withColumn("S2", F.slice("S", 1, 3)))
    return X.reconstruction_grid(w, {"S1": ("S1", 2), "S2": ("S2", 3), "S3": ("S", 4)}, ("C", 3), ("H", H), learners=("mean", "ridge", "forest"))


@query("ml19_transfer")
def _(spark, sf):
    return X.transfer_battery(_spec_frame(spark, sf), _SPEC)


@query("ml20_support")
def _(spark, sf):
    return M.mahalanobis(wide(spark, sf), "S", 4).select("unit_id", R("m_distance", 6).alias("m_distance"), "supported")


_SPEC = X.Spec("primary", "y", (("S", 4), ("C", 3)), ("H", H))


def _spec_frame(spark, sf):
    return settled(wide(spark, sf).withColumn("y", F.col("elev") / 1000 + F.col("H")[2]))


@query("ml21_specification")
def _(spark, sf):
    return X.evaluate(X.with_folds(_spec_frame(spark, sf), _SPEC), _SPEC, boot=2000)


@query("ml21_variants")
def _(spark, sf):
    return X.compare(_spec_frame(spark, sf), [_SPEC, *X.variants(_SPEC, components=[3], degrees=[20.0])])


@query("ml18_region_holdout")
def _(spark, sf):
    return X.region_holdout(_spec_frame(spark, sf), _SPEC)


@query(
    "rs2_shuffle_within_strata",
    f"""WITH {U}, d AS (SELECT unit_id, region, elev, d.draw FROM units, range(1, 6) d(draw)),
    r AS (SELECT *, row_number() OVER (PARTITION BY draw, region ORDER BY unit_id) AS a, row_number() OVER (PARTITION BY draw, region ORDER BY md5(CAST(draw AS VARCHAR) || ':' || CAST(unit_id AS VARCHAR)), unit_id) AS b FROM d)
    SELECT CAST(x.draw AS INTEGER) AS draw, x.unit_id, y.elev FROM r x JOIN r y ON x.draw = y.draw AND x.region = y.region AND x.a = y.b""",
)
def _(spark, sf):
    return RS.shuffled(units(spark, sf), "elev", 5, ["region"], out="elev")


@query(
    "rs1_permutation_null",
    f"""WITH {_PAIRS}, d AS (SELECT unit_id, region, H, draw FROM wide, range(1, 301) d(draw)),
    r AS (SELECT *, row_number() OVER (PARTITION BY draw, region ORDER BY unit_id) AS a, row_number() OVER (PARTITION BY draw, region ORDER BY md5(CAST(draw AS VARCHAR) || ':' || CAST(unit_id AS VARCHAR)), unit_id) AS b, count(*) OVER (PARTITION BY draw, region) AS n FROM d),
    p AS (SELECT x.draw, x.unit_id, CASE WHEN x.n >= 5 THEN y.H ELSE x.H END AS H FROM r x JOIN r y ON x.draw = y.draw AND x.region = y.region AND x.a = y.b)
    SELECT CAST(draw AS INTEGER) AS draw, round(avg(sqrt(list_sum(list_transform(list_zip(u.H, v.H), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))), 6) AS stat FROM pairs JOIN p u ON u.unit_id = i JOIN p v USING (draw) WHERE v.unit_id = j GROUP BY 1""",
)
def _(spark, sf):
    return RS.permutation_pair_null(_pairs(spark, sf), settled(wide(spark, sf)), "H", 300, ["region"]).withColumn("stat", R("stat", 6))


@query("rs3_matched_random")
def _(spark, sf):
    return RS.matched_random(wide(spark, sf), "H", H).select("unit_id", "x_random")


_TILES = """tl AS (SELECT tile, row_number() OVER (ORDER BY tile) - 1 AS no, count(*) OVER () AS t FROM (SELECT DISTINCT tile FROM b)),
    pk AS (SELECT draw, ('0x' || substr(md5(CAST(draw AS VARCHAR) || ':' || CAST(p AS VARCHAR)), 1, 8))::UBIGINT % t AS no FROM range(1, {n} + 1) d(draw), (SELECT unnest(range(1, max(t) + 1)) AS p, max(t) AS t FROM tl)),
    tm AS (SELECT draw, tile, count(*) AS w FROM pk JOIN tl USING (no) GROUP BY 1, 2)"""


@query(
    "rs4_tile_bootstrap",
    f"""WITH b AS (SELECT CAST(o_custkey % 40 AS BIGINT) AS tile, o_totalprice / 1000 AS y, 150.0 AS p0, CASE o_orderpriority WHEN '1-URGENT' THEN 160.0 ELSE 148.0 END AS p1 FROM orders), {_TILES.format(n=2000)},
    s AS (SELECT tile, count(*) AS n, sum(y) AS s, sum(y * y) AS q, sum(pow(y - p0, 2)) AS a, sum(pow(y - p1, 2)) AS b FROM b GROUP BY 1),
    d AS (SELECT draw, (sum(a * w) - sum(b * w)) / (sum(q * w) - pow(sum(s * w), 2) / sum(n * w)) AS dr, sqrt(sum(b * w) / sum(n * w)) - sqrt(sum(a * w) / sum(n * w)) AS de FROM tm JOIN s USING (tile) GROUP BY 1)
    SELECT count(*) AS n_draws, round(avg(dr), 7) AS delta_r2_mean, round(stddev_samp(dr), 7) AS delta_r2_sd, round(quantile_cont(dr, 0.025), 7) AS delta_r2_lo, round(quantile_cont(dr, 0.975), 7) AS delta_r2_hi, round(avg(de), 7) AS delta_rmse_mean FROM d""",
)
def _(spark, sf):
    o = t(spark, sf, "orders").select((F.col("o_custkey") % 40).alias("tile"), (F.col("o_totalprice") / 1000).alias("y"), F.lit(150.0).alias("p0"), F.when(F.col("o_orderpriority") == "1-URGENT", 160.0).otherwise(148.0).alias("p1"))
    b = RS.tile_bootstrap_delta(o, "y", "p0", "p1", 2000)
    return b.select("n_draws", *[R(c, 7).alias(c) for c in ("delta_r2_mean", "delta_r2_sd", "delta_r2_lo", "delta_r2_hi", "delta_rmse_mean")])


@query(
    "rs5_pair_bootstrap",
    f"""WITH {_PAIRS}, b AS (SELECT unit_id, CAST(floor((lat + 90) / 30) * 1000 + floor((lon + 180) / 30) AS BIGINT) AS tile FROM wide), {_TILES.format(n=30)}
    SELECT CAST(x.draw AS INTEGER) AS draw, round(sum(d_h * x.w * y.w) / sum(x.w * y.w), 6) AS stat FROM pairs JOIN b u ON u.unit_id = i JOIN b v ON v.unit_id = j JOIN tm x ON x.tile = u.tile JOIN tm y ON y.tile = v.tile AND y.draw = x.draw GROUP BY 1 HAVING sum(x.w * y.w) > 10""",
)
def _(spark, sf):
    tiles = units(spark, sf).select("unit_id", S.tile_id(F.col("lat"), F.col("lon"), 30.0).alias("tile"))
    return RS.pair_bootstrap(_pairs(spark, sf), tiles, lambda w: F.sum(F.col("d_h") * w) / F.sum(w), 30).withColumn("stat", R("stat", 6))


@query(
    "rs5_pair_bootstrap_means",
    f"""WITH {_PAIRS}, b AS (SELECT unit_id, CAST(floor((lat + 90) / 30) * 1000 + floor((lon + 180) / 30) AS BIGINT) AS tile FROM wide), {_TILES.format(n=2000)}
    SELECT CAST(x.draw AS INTEGER) AS draw, round(sum(d_h * x.w * y.w) / sum(x.w * y.w), 6) AS stat FROM pairs JOIN b u ON u.unit_id = i JOIN b v ON v.unit_id = j JOIN tm x ON x.tile = u.tile JOIN tm y ON y.tile = v.tile AND y.draw = x.draw GROUP BY 1 HAVING sum(x.w * y.w) > 10""",
)
def _(spark, sf):
    """2,000 draws over pairs that are summed by tiles once."""
    tiles = units(spark, sf).select("unit_id", S.tile_id(F.col("lat"), F.col("lon"), 30.0).alias("tile"))
    return RS.pair_bootstrap_mean(_pairs(spark, sf), tiles, "d_h", 2000).withColumn("stat", R("stat", 6))


@query(
    "rs6_partial_spearman",
    """WITH r AS (SELECT rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS a, rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2 AS b, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS c FROM lineitem),
    k AS (SELECT corr(a, b) AS ab, corr(a, c) AS ac, corr(b, c) AS bc FROM r) SELECT round((ab - ac * bc) / sqrt((1 - ac * ac) * (1 - bc * bc)), 7) AS rho FROM k""",
)
def _(spark, sf):
    rho = RS.partial_spearman(t(spark, sf, "lineitem"), "l_extendedprice", "l_discount", ["l_quantity"])
    return spark.createDataFrame([(float(rho),)], "rho double").select(R("rho", 7).alias("rho"))


@query("rs7_twin_block")
def _(spark, sf):
    """1,000 permutations and 2,000 bootstraps."""
    return X.twin_block(_spec_frame(spark, sf), _SPEC, k=5, n_draws=1000, boot=2000)


@query("rs8_divergent_twins", f"WITH {_PAIRS}, q AS (SELECT quantile_cont(d_sc, 0.25) AS a, quantile_cont(d_h, 0.75) AS b FROM pairs) SELECT round(a, 6) AS near_cut, round(b, 6) AS far_cut, count(*) AS n_near, round(avg(CAST(d_h > b AS INTEGER)), 8) AS divergent_rate FROM pairs, q WHERE d_sc <= a GROUP BY a, b")
def _(spark, sf):
    return N.divergent_rate(_pairs(spark, sf)).select(R("near_cut", 6).alias("near_cut"), R("far_cut", 6).alias("far_cut"), "n_near", R("divergent_rate", 8).alias("divergent_rate"))


@query(
    "rs9_morans_i",
    f"""WITH {WIDE}, p AS (SELECT unit_id, elev - avg(elev) OVER () AS z, [cos(radians(lat)) * cos(radians(lon)), cos(radians(lat)) * sin(radians(lon)), sin(radians(lat))] AS x FROM wide),
    m AS MATERIALIZED (SELECT a.unit_id AS i, b.unit_id AS j, sqrt(list_sum(list_transform(list_zip(a.x, b.x), lambda q: (q[1] - q[2]) * (q[1] - q[2])))) AS d FROM p a JOIN p b ON a.unit_id <> b.unit_id),
    k AS MATERIALIZED (SELECT i, j FROM m QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) <= 8),
    o AS (SELECT sum(a.z * n.zbar) / sum(a.z * a.z) AS i FROM p a JOIN (SELECT k.i, avg(z) AS zbar FROM k JOIN p ON p.unit_id = j GROUP BY 1) n ON n.i = a.unit_id),
    s AS (SELECT unit_id, z, draw, row_number() OVER (PARTITION BY draw ORDER BY unit_id) AS a, row_number() OVER (PARTITION BY draw ORDER BY md5(CAST(draw AS VARCHAR) || ':' || CAST(unit_id AS VARCHAR)), unit_id) AS b FROM p, range(1, 500) d(draw)),
    h AS MATERIALIZED (SELECT x.draw, x.unit_id, y.z FROM s x JOIN s y ON x.draw = y.draw AND x.a = y.b),
    t AS (SELECT g.draw, sum(g.z * n.zbar) / sum(g.z * g.z) AS stat FROM h g JOIN (SELECT draw, k.i, avg(z) AS zbar FROM k JOIN h ON h.unit_id = j GROUP BY 1, 2) n ON n.draw = g.draw AND n.i = g.unit_id GROUP BY 1)
    SELECT round(o.i, 6) AS morans_i, round(avg(stat), 6) AS null_mean, round(stddev_pop(stat), 6) AS null_sd, (count(*) FILTER (stat >= o.i) + 1) / (count(*) + 1) AS p_value FROM t, o GROUP BY o.i""",
)
def _(spark, sf):
    return RS.morans_i(settled(wide(spark, sf)), "elev", 8, 499).select(R("morans_i", 6).alias("morans_i"), R("null_mean", 6).alias("null_mean"), R("null_sd", 6).alias("null_sd"), "p_value")


@query("rs10_null_battery")
def _(spark, sf):
    """300 shuffled and 50 random histories, the predicted and the redundant one, against the observed one."""
    own = X.size_strata(_spec_frame(spark, sf))
    return B.null_summary(X.null_battery(own, _SPEC, 300, 50, ["stratum"], redundant="S"), "delta_r2")


@query(
    "rs10_one_column_nulls",
    """WITH e AS (SELECT vec_id, embedding[1]::DOUBLE AS y, embedding[2]::DOUBLE AS x, embedding[3]::DOUBLE AS h, vec_id % 5 AS fold, label FROM embeddings), d AS (SELECT *, draw FROM e, range(1, 21) d(draw)),
    r AS (SELECT *, row_number() OVER (PARTITION BY draw, label ORDER BY vec_id) AS a, row_number() OVER (PARTITION BY draw, label ORDER BY md5(CAST(draw AS VARCHAR) || ':' || CAST(vec_id AS VARCHAR)), vec_id) AS b FROM d),
    p AS (SELECT u.draw, u.vec_id, u.fold, u.y, u.x, v.h FROM r u JOIN r v ON u.draw = v.draw AND u.label IS NOT DISTINCT FROM v.label AND u.a = v.b UNION ALL SELECT 0, vec_id, fold, y, x, h FROM e),
    m AS (SELECT draw, k, count(*) AS n, avg(x) AS mx, avg(h) AS mh, avg(y) AS my, stddev_pop(x) AS sx, stddev_pop(h) AS sh, covar_pop(x, y) AS xy, covar_pop(h, y) AS hy, covar_pop(x, h) AS xh FROM p, (SELECT DISTINCT fold AS k FROM e) WHERE fold <> k GROUP BY 1, 2),
    c AS (SELECT *, n + 1.0 AS a, n * xh / sx / sh AS b, n * xy / sx AS p1, n * hy / sh AS p2 FROM m), w AS (SELECT *, (p1 * a - p2 * b) / (a * a - b * b) AS w1, (p2 * a - p1 * b) / (a * a - b * b) AS w2, p1 / a AS w0 FROM c),
    s AS (SELECT p.draw, count(*) AS n, sum(pow(y - my - w0 * (x - mx) / sx, 2)) AS e0, sum(pow(y - my - w1 * (x - mx) / sx - w2 * (h - mh) / sh, 2)) AS e1, var_pop(y) * count(*) AS t FROM p JOIN w ON w.draw = p.draw AND fold = k GROUP BY 1)
    SELECT CASE WHEN draw = 0 THEN 'observed' ELSE 'shuffled' END AS "null", CAST(draw AS INTEGER) AS draw, n, round(1 - e0 / t, 7) AS r2_m0, round((e0 - e1) / t, 7) AS delta_r2 FROM s""",
)
def _(spark, sf):
    e = settled(_emb(spark, sf).select("unit_id", F.col("x")[0].alias("y"), F.array(F.col("x")[1]).alias("b"), F.array(F.col("x")[2]).alias("h"), (F.col("unit_id") % 5).cast("int").alias("fold"), "label"))
    perm = RS.shuffled(e, "h", 20, ["label"], out="h").select(F.lit("shuffled").alias("null"), F.col("draw").cast("int").alias("draw"), "unit_id", "h")
    nulls = perm.unionByName(e.select(F.lit("observed").alias("null"), F.lit(0).alias("draw"), "unit_id", "h"))
    return B.null_deltas(e, "b", 1, "y", nulls, 1).select("null", "draw", "n", R("r2_m0", 7).alias("r2_m0"), R("delta_r2", 7).alias("delta_r2"))


@query("rs13_subgroups", "SELECT 'flag' AS dimension, l_returnflag AS level, count(*) AS n, round((sum(pow(l_tax - l_discount, 2)) - sum(pow(l_tax - 0.04, 2))) / (var_pop(l_tax) * count(*)), 6) AS delta_r2 FROM lineitem GROUP BY 2 UNION ALL SELECT 'status', l_linestatus, count(*), round((sum(pow(l_tax - l_discount, 2)) - sum(pow(l_tax - 0.04, 2))) / (var_pop(l_tax) * count(*)), 6) FROM lineitem GROUP BY 2")
def _(spark, sf):
    d = X.subgroup_deltas(t(spark, sf, "lineitem").withColumn("p1", F.lit(0.04)), "l_tax", "l_discount", "p1", {"flag": F.col("l_returnflag"), "status": F.col("l_linestatus")})
    return d.select("dimension", "level", "n", R("delta_r2", 6).alias("delta_r2"))


_EARLY = 1999


def _geometry():
    """Rules that decide which sales make a unit: the primary one, a looser and a stricter one, and one without its second condition."""
    return {"primary": F.lit(True), "looser": F.col("l_quantity") <= 45, "stricter": F.col("l_quantity") <= 25, "no_floor": F.col("l_discount") <= 0.08}


def _union_frame(spark, sf):
    """One row per unit with the blocks of all variants: states and histories at two base epochs, of other definitions, of a unit's largest part and under other rules, contexts of three levels, and two
    responses. The rows of sales are read once."""
    lines = t(spark, sf, "lineitem").withColumn("epoch", F.year("l_shipdate")).withColumn("part", F.col("l_linenumber") == 1)
    values = lambda name, keep: [F.sum(F.when(keep, v)).alias(f"{c}_{name}") for c, v in (("bus", F.col("l_extendedprice")), ("pop", F.col("l_quantity")), ("buv", F.lit(1.0)))]
    rules = _geometry() | {"dominant": F.col("part")}
    flows = settled(lines.groupBy(F.col("l_suppkey").alias("unit_id"), "epoch").agg(*[a for n, k in rules.items() for a in values(n, k)]))
    own = lambda rule: flows.select("unit_id", "epoch", *[F.coalesce(f"{v}_{rule}", F.lit(0.0)).alias(v) for v in ("bus", "pop", "buv")])
    state = P.state_block(F.col("pop"), F.col("bus"), F.col("buv"), "S3", log=True)

    def made(rule, base, value, name, with_state=True):
        x = P.trajectories(own(rule), ("bus", "pop", "buv"), base, value)
        return x.select("unit_id", F.col("H").alias(f"H_{name}"), *([state.alias(f"S_{name}"), F.col("bus").alias(f"bus_{name}")] if with_state else []))

    out = units(spark, sf).join(made("primary", LAST, "bus", "primary"), "unit_id").where("H_primary IS NOT NULL")
    parts = [made("primary", _EARLY, "bus", "early"), made("primary", LAST, "pop", "people", False), made("dominant", LAST, "bus", "dominant", False)]
    for x in [*parts, *(made(r, LAST, "bus", r) for r in ("looser", "stricter", "no_floor"))]:
        out = out.join(x, "unit_id", "left")
    context = lambda level: P.context_block(F.col("lat"), F.col("lon"), F.col("elev"), F.col("temp"), F.col("rain"), (F.col("temp") / 2, F.col("rain") / 2), S.climate_group(F.col("climate")), level)
    out = out.withColumns({"S": F.col("S_primary"), "H": F.col("H_primary"), "bus": F.col("bus_primary"), "H_late": F.slice("H_primary", 4, 3), "C0": context("C0"), "C1": context("C1"), "C2": context("C2")})
    response = F.col("elev") / 1000 + F.coalesce(F.try_element_at("H", F.lit(3)), F.lit(0.0))
    return settled(out.withColumn("y", response).withColumn("y2", F.log(F.element_at("S", 1) + 1) + F.coalesce(F.try_element_at("H", F.lit(2)), F.lit(0.0))))


#: Blocks of the union frame: column and width.
_BLOCKS = {
    "S1": ("S", 2), "S2": ("S", 3), "S3": ("S", 4), "S_early": ("S_early", 4), "S_looser": ("S_looser", 4), "S_stricter": ("S_stricter", 4), "S_no_floor": ("S_no_floor", 4), "C0": ("C0", 3), "C1": ("C1", 5), "C2": ("C2", 12),
    "H": ("H", 6), "H_early": ("H_early", 4), "H_late": ("H_late", 3), "H_people": ("H_people", 6), "H_dominant": ("H_dominant", 6), "H_looser": ("H_looser", 6), "H_stricter": ("H_stricter", 6), "H_no_floor": ("H_no_floor", 6),
}


def _families(y):
    """The five families of sensitivity comparisons: time, boundary, geometry, context and state, and common support."""
    c = lambda label, base, h, sample="all": B.Comparison(label, sample, tuple(base.split("+")), (h,), y)
    return [
        c("temporal|primary", "S3+C1", "H"), c("temporal|strict_early_history", "S3+C1", "H_early"), c("temporal|strict_early_history_and_state", "S_early+C1", "H_early", "early"), c("temporal|overlapping_only", "S3+C1", "H_late"),
        c("temporal|early_base", "S_early+C1", "H_early"), c("boundary|aggregate", "S3+C1", "H"), c("boundary|dominant_part", "S3+C1", "H_dominant"), c("boundary|aggregate_of_several", "S3+C1", "H", "several"), c("boundary|dominant_of_several", "S3+C1", "H_dominant", "several"),
        c("boundary|other_definition", "S3+C1", "H_people"), *[c(f"geometry|{r}", f"S_{r}+C1", f"H_{r}", r) for r in ("looser", "stricter", "no_floor")],
        *[c(f"context|{s}+{k}", f"{s}+{k}", "H") for s, k in (("S1", "C1"), ("S2", "C1"), ("S3", "C0"), ("S3", "C1"), ("S3", "C2"))], c("support|full", "S3+C1", "H"), c("support|supported", "S3+C1", "H", "supported"), c("support|without_smallest", "S3+C1", "H", "large"),
    ]


def _samples(frame):
    """The union frame with its cuts, and the samples as conditions."""
    x = M.mahalanobis(frame.withColumn("_sc", F.concat("S", "C1")), "_sc", 9)
    cut = A.exact_quantiles(x, "bus", [0.1], "_q")
    x = settled(x.join(F.broadcast(cut)))
    there = lambda c: F.col(c).isNotNull()
    samples = {"all": F.lit(True), "early": there("H_early"), "several": F.col("unit_id") % 3 != 0, "supported": F.col("supported"), "large": F.col("bus") >= F.col("_q")[0]}
    return x, samples | {r: there(f"H_{r}") for r in ("looser", "stricter", "no_floor")}


@query("rs12_sensitivity")
def _(spark, sf):
    """All five families from one pass over the union of their blocks; samples of fewer than 50 units have NULLs."""
    frame, samples = _samples(_union_frame(spark, sf))
    out = B.compare_all(frame, _BLOCKS, ["y"], samples, _families("y"), boot=200)
    return out.select(F.split("label", r"\|")[0].alias("family"), "label", "n", *[R(c, 7).alias(c) for c in ("r2_m0", "r2_m1", "delta_r2", "delta_rmse", "delta_r2_lo", "delta_r2_hi")])


@query("rs16_compact_battery")
def _(spark, sf):
    """The second response through the whole battery: fit, shuffled and predicted histories, early history, context, regions, twins, transfer and autocorrelation, as (experiment, statistic, value)."""
    frame, samples = _samples(_union_frame(spark, sf))
    spec = replace(_SPEC, label="second", y="y2", blocks=(("S", 4), ("C1", 5)))
    return X.compact_battery(frame, spec, _BLOCKS, samples, 300, 50)


@query("rs15_quadratic_study")
def _(spark, sf):
    return X.quadratic_study(_spec_frame(spark, sf), _SPEC)


@query("rs17_agreement", f"WITH {STOCK} SELECT 'e' || CAST(epoch AS VARCHAR) AS epoch, round(corr(bus, pop), 7) AS pearson, count(*) AS n FROM stock GROUP BY epoch")
def _(spark, sf):
    w = P.widen(stock(spark, sf), EPOCHS, ("bus", "pop"))
    side = lambda v: w.select("unit_id", *[F.col(f"{v}_{e}").alias(f"e{e}") for e in EPOCHS])
    return X.agreement(side("bus"), side("pop"), [f"e{e}" for e in EPOCHS]).select("epoch", R("pearson", 7).alias("pearson"), "n")


@query("rs17_residual_autocorrelation")
def _(spark, sf):
    return X.residual_autocorrelation(_spec_frame(spark, sf), _SPEC, (4,), 19)


_HPOP = f"""{WIDE}, hp AS (SELECT unit_id, list(h ORDER BY epoch) AS G FROM (SELECT unit_id, epoch, pop / nullif(max(CASE WHEN epoch = {LAST} THEN pop END) OVER (PARTITION BY unit_id), 0) AS h FROM stock QUALIFY epoch < {LAST}) GROUP BY 1)"""


def _pop_history(spark, sf):
    return P.history_array(P.history(stock(spark, sf), "pop", LAST))


@query("rs17_boundary_distance", f"WITH {_HPOP} SELECT unit_id, round(sqrt(list_sum(list_transform(list_zip(H, G), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 7) AS d_boundary FROM wide JOIN hp USING (unit_id)")
def _(spark, sf):
    return X.boundary_distance(wide(spark, sf), _pop_history(spark, sf), "H").withColumn("d_boundary", R("d_boundary", 7))


@query("ag22_distance_by_stratum", f"WITH {_HPOP}, d AS (SELECT region, born > 1990 AS late, sqrt(list_sum(list_transform(list_zip(H, G), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d FROM wide JOIN hp USING (unit_id)) SELECT 'region' AS dimension, region AS level, count(*) AS n, round(avg(d), 7) AS mean FROM d GROUP BY 2 UNION ALL SELECT 'born_late', CAST(late AS VARCHAR), count(*), round(avg(d), 7) FROM d GROUP BY 2")
def _(spark, sf):
    w = wide(spark, sf)
    d = X.boundary_distance(w, _pop_history(spark, sf), "H").join(w.select("unit_id", "region", "born"), "unit_id")
    return A.stacked_means(d, "d_boundary", {"region": F.col("region"), "born_late": F.col("born") > 1990}).withColumn("mean", R("mean", 7))


@query("ml16_two_definitions")
def _(spark, sf):
    w = settled(wide(spark, sf))
    fixed = X.reconstruction_grid(w, {"S3": ("S", 4)}, ("C", 3), ("H", H), learners=("ridge", "forest")).withColumn("definition", F.lit("built"))
    other = w.drop("H").join(_pop_history(spark, sf), "unit_id")
    return fixed.unionByName(X.reconstruction_grid(other, {"S3": ("S", 4)}, ("C", 3), ("H", H), learners=("ridge", "forest")).withColumn("definition", F.lit("population")))


@query("ml22_key_reconstruction")
def _(spark, sf):
    return spark.createDataFrame([(float(X.key_reconstruction_error(wide(spark, sf), ("S", 4), ("H", H), least_train=20)),)], "mean_row_error double")


@query("rs11_transfer_nulls")
def _(spark, sf):
    """100 shuffled and 100 random histories, and the predicted one; small errors speak for the history."""
    return B.null_summary(X.transfer_nulls(X.size_strata(_spec_frame(spark, sf)), _SPEC, 100, ["stratum"]), "delta_rmse", lower=True)


@query(
    "rs11_one_column_transfer",
    f"""WITH e AS (SELECT vec_id AS i, embedding[1]::DOUBLE AS y, embedding[2]::DOUBLE AS x, embedding[3]::DOUBLE AS h, vec_id % 5 AS fold FROM embeddings), d AS (SELECT *, draw FROM e, range(1, 4) d(draw)),
    r AS (SELECT *, row_number() OVER (PARTITION BY draw ORDER BY i) AS a, row_number() OVER (PARTITION BY draw ORDER BY md5(CAST(draw AS VARCHAR) || ':' || CAST(i AS VARCHAR)), i) AS b FROM d),
    p AS (SELECT u.draw, u.i, u.y, u.fold, u.x, (v.h - avg(v.h) OVER (PARTITION BY u.draw)) / stddev_pop(v.h) OVER (PARTITION BY u.draw) AS h FROM r u JOIN r v ON u.draw = v.draw AND u.a = v.b),
    k AS (SELECT a.draw, a.i, a.y, b.y AS z, sqrt(pow(a.x - b.x, 2) + pow(a.h - b.h, 2)) AS d FROM p a JOIN p b ON a.draw = b.draw AND a.fold <> b.fold QUALIFY row_number() OVER (PARTITION BY a.draw, a.i ORDER BY d, b.i) <= 10),
    t AS (SELECT draw, i, y - sum(z / (d + 1e-9)) / sum(1 / (d + 1e-9)) AS e FROM k GROUP BY draw, i, y)
    SELECT CAST(draw AS INTEGER) AS draw, count(*) AS n, round(sqrt(avg(e * e)), 7) AS rmse, round(avg(abs(e)), 7) AS mae FROM t GROUP BY 1""",
)
def _(spark, sf):
    e = settled(_emb(spark, sf).select("unit_id", F.col("x")[0].alias("y"), F.array(F.col("x")[1]).alias("b"), F.array(F.col("x")[2]).alias("h"), (F.col("unit_id") % 5).alias("fold")))
    nulls = RS.shuffled(e, "h", 3, out="h").select(F.lit("shuffled").alias("null"), F.col("draw").cast("int").alias("draw"), "unit_id", "h")
    return B.transfer_errors(e, "b", "y", nulls, 1).select("draw", "n", R("rmse", 7).alias("rmse"), R("mae", 7).alias("mae"))


@query("rs14_separability_variants")
def _(spark, sf):
    w = settled(wide(spark, sf).withColumn("S1", F.slice("S", 1, 2)).withColumn("raw", F.array("pop", "bus", "buv")))
    samples = {"baseline": w, "without_smallest": Q.below_quantile(w, "pop", 0.1), "robust": M.robust_scale(w, "S", 4), "late": w.where("born >= 1990")}
    s4 = {"S": 4}
    rates = {label: (label, s4, 5) for label in samples} | {"k3": ("baseline", s4, 3), "k10": ("baseline", s4, 10), "with_context": ("baseline", {"S": 4, "C": 3}, 5), "two_states": ("baseline", {"S1": 2}, 5), "raw_states": ("baseline", {"raw": 3}, 5)}
    return X.divergent_rates(samples, rates, "H")


def _padded(c, n):
    return F.array(*[F.coalesce(F.try_element_at(F.col(c), F.lit(i + 1)).cast("double"), F.lit(0.0)) for i in range(n)])


@query("rs14_gate1_variants")
def _(spark, sf):
    """The eight variants of the first gate: the baseline, two smaller states, no context, robust scaling, without the smallest, without flagged trajectories, and another endpoint."""
    x = X.size_strata(_union_frame(spark, sf)).withColumns({"H": _padded("H", 6), "H_early": _padded("H_early", 4), "S": _padded("S", 4), "S_early": _padded("S_early", 4)}).withColumns({"S1": F.slice("S", 1, 2), "S2": F.slice("S", 1, 3)})
    jump = F.exists(F.arrays_zip(F.slice("H", 1, 5).alias("a"), F.slice("H", 2, 5).alias("b")), lambda z: (z["a"] > 0) & (z["b"] > 2.5 * z["a"]))
    x = settled(x.join(F.broadcast(A.exact_quantiles(x, "bus", [0.1], "_q"))).withColumn("jump", jump))
    every, c = F.lit(True), ("C0", 3)
    v = X.Variant
    return X.separability_variants(x, [
        v("baseline", every, (("S", 4), c), "H"), v("two_states", every, (("S1", 2), c), "H"), v("three_states", every, (("S2", 3), c), "H"), v("without_context", every, (("S", 4),), "H"), v("robust_scaling", every, (("S", 4), c), "H", robust=True),
        v("without_smallest", F.col("bus") >= F.col("_q")[0], (("S", 4), c), "H"), v("without_jumps", ~F.col("jump"), (("S", 4), c), "H"), v("other_endpoint", every, (("S_early", 4), c), "H_early"),
    ], 100)


@query("rs14_gate1b_variants")
def _(spark, sf):
    """Variants A to G of the boundary gate, each with both definitions of the history: all, ambiguous ones excluded, without the smallest, without jumps, regions, another endpoint, other k."""
    x = X.size_strata(_union_frame(spark, sf)).withColumns({"H": _padded("H", 6), "H_people": _padded("H_people", 6), "H_early": _padded("H_early", 4), "S": _padded("S", 4)})
    jump = F.exists(F.arrays_zip(F.slice("H", 1, 5).alias("a"), F.slice("H", 2, 5).alias("b")), lambda z: (z["a"] > 0) & (z["b"] > 2.5 * z["a"]))
    x = settled(x.join(F.broadcast(A.exact_quantiles(x, "bus", [0.1], "_q"))).withColumn("jump", jump))
    every = F.lit(True)
    samples = {"A_all": every, "B_unambiguous": F.col("H_people").isNotNull(), "C_without_smallest": F.col("bus") >= F.col("_q")[0], "D_without_jumps": ~F.col("jump")}
    samples |= {f"E_{r.lower()}": F.col("region") == r for r in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")}
    blocks, out = (("S", 4), ("C0", 3)), []
    for name, history in (("fixed", "H"), ("dynamic", "H_people")):
        out += [X.Variant(f"{label}|{name}", c, blocks, history) for label, c in samples.items()]
        out += [X.Variant(f"G_k{k}|{name}", every, blocks, history, k) for k in (3, 10)]
    out.append(X.Variant("F_other_endpoint|fixed", every, blocks, "H_early"))
    return X.separability_variants(x, out, 50)


@query("dr3_increment", "SELECT 'FAIL' AS gate, 'STOP' AS program, 'DISAPPEARS' AS strict_precedence, 'NULL' AS second_response, count(*) AS n FROM supplier")
def _(spark, sf):
    zero = ("d1", "d1_lo", "null_q95", "pseudo_mean", "redundant_mean", "regions_positive", "partial_rho", "twin_p", "transfer", "transfer_q05", "c2", "strict", "strict_lo", "second", "second_lo")
    m = t(spark, sf, "supplier").agg(F.count(F.lit(1)).alias("n"), *[F.lit(0.0).alias(c) for c in zero], F.lit(0.01).alias("d1_hi"))
    return D.increment_gate(m).select("gate", "program", "strict_precedence", "second_response", "n")


@query("dr3_increment_of_results")
def _(spark, sf):
    """The gate fed by the results themselves: comparisons of both responses, nulls, held-out regions, twins and transfer."""
    frame, samples = _samples(_union_frame(spark, sf))
    frame = settled(X.size_strata(frame))
    spec = replace(_SPEC, blocks=(("S", 4), ("C1", 5)))
    c = lambda label, base, h, y="y": B.Comparison(label, "all", base, (h,), y)
    fits = B.compare_all(frame, _BLOCKS, ["y", "y2"], samples, [c("d1", ("S3", "C1"), "H"), c("c2", ("S3", "C2"), "H"), c("strict", ("S3", "C1"), "H_early"), c("second", ("S3", "C1"), "H", "y2")], boot=500)
    pick = lambda label, column: F.max(F.when(F.col("label") == label, F.col(column)))
    m = fits.agg(*[pick(x, "delta_r2").alias(x) for x in ("d1", "c2", "strict", "second")], *[pick(x, "delta_r2_lo").alias(f"{x}_lo") for x in ("d1", "strict", "second")], pick("d1", "delta_r2_hi").alias("d1_hi"))
    nulls = B.null_summary(X.null_battery(frame, spec, 300, 0, ["stratum"], redundant="S"), "delta_r2")
    of = lambda null, column: F.max(F.when(F.col("null") == null, F.col(column)))
    m = m.join(F.broadcast(nulls.agg(of("shuffled", "null_q95").alias("null_q95"), of("pseudo", "null_mean").alias("pseudo_mean"), of("redundant", "null_mean").alias("redundant_mean"))))
    m = m.join(F.broadcast(X.region_holdout(frame, spec).agg(F.count_if(F.col("delta_r2") > 0).cast("double").alias("regions_positive"))))
    m = m.join(F.broadcast(X.twin_block(frame, spec, k=5, n_draws=200, boot=200).select("partial_rho", F.col("p_value").alias("twin_p"))))
    moved = B.null_summary(X.transfer_nulls(frame, spec, 50, ["stratum"]), "delta_rmse", lower=True).where(F.col("null") == "shuffled")
    return D.increment_gate(m.join(F.broadcast(moved.select(F.col("observed").alias("transfer"), F.col("null_q05").alias("transfer_q05")))))


@query("dr1_separability", "SELECT 'MIXED' AS classification, 3 AS n_for, 1 AS n_against, round((avg(c_acctbal) - 0.5 * avg(c_acctbal)) / avg(c_acctbal), 6) AS relative_effect FROM customer")
def _(spark, sf):
    m = t(spark, sf, "customer").agg(F.lit(0.2265).alias("r2_full"), F.lit(0.25).alias("r2_simple"), F.avg("c_acctbal").alias("null_mean"), (F.avg("c_acctbal") * 0.5).alias("observed"), F.lit(0.8).alias("share_consistent"))
    return D.separability_gate(m).select("classification", "n_for", "n_against", R("relative_effect", 6).alias("relative_effect"))


@query("dr2_boundary", "SELECT 'PASS' AS classification, 4 AS n_for")
def _(spark, sf):
    m = spark.createDataFrame([(0.2, 0.25, 0.2, 0.22, 0.31, 0.24, 0.8)], "r2_fixed double, r2_dynamic double, rate_fixed double, rate_dynamic double, effect_fixed double, effect_dynamic double, mean_correlation double")
    return D.boundary_gate(m).select("classification", "n_for")


@query("dr4_archive", "SELECT 'READY_FOR_AGGREGATION' AS state, true AS same_grid, CAST(count(*) AS BIGINT) AS n_rasters FROM orders")
def _(spark, sf):
    m = t(spark, sf, "orders").agg(F.count(F.lit(1)).alias("n_rasters")).select("n_rasters", F.lit(True).alias("zip_ok"), F.lit(3).alias("n_inspected"), F.lit(True).alias("crs_ok"), F.lit(True).alias("unit_known"), F.lit(False).alias("unit_numeric_only"), F.lit(True).alias("overlap_tested"), F.lit(True).alias("bbox_overlap"), F.lit(5).alias("n_valid"), F.lit(True).alias("same_grid"), F.lit(0.1).alias("seconds_per_place"))
    return D.archive_gate(m, 10915).select("state", "same_grid", "n_rasters")


@query("dr5_same_grid", "SELECT count(DISTINCT (n_regionkey, 10)) = 1 AS same_grid, count(*) AS n FROM nation")
def _(spark, sf):
    return D.same_grid(t(spark, sf, "nation").withColumn("w", F.lit(10)), ("n_regionkey", "w"))


@query(
    "flagship_twins",
    f"""WITH {WIDE}, z AS (SELECT unit_id, lat, lon, H, [(S[1] - avg(S[1]) OVER ()) / stddev_pop(S[1]) OVER () / 2, (S[2] - avg(S[2]) OVER ()) / stddev_pop(S[2]) OVER () / 2, (S[3] - avg(S[3]) OVER ()) / stddev_pop(S[3]) OVER () / 2, (S[4] - avg(S[4]) OVER ()) / stddev_pop(S[4]) OVER () / 2] AS x FROM wide),
    k AS (SELECT a.unit_id AS i, b.unit_id AS j, sqrt(list_sum(list_transform(list_zip(a.x, b.x), lambda q: (q[1] - q[2]) * (q[1] - q[2])))) AS d FROM z a JOIN z b ON a.unit_id <> b.unit_id AND {_KM} >= 200 QUALIFY row_number() OVER (PARTITION BY a.unit_id ORDER BY sqrt(list_sum(list_transform(list_zip(a.x, b.x), lambda q: (q[1] - q[2]) * (q[1] - q[2])))), b.unit_id) <= 5)
    SELECT m.i, m.j, round(m.d, 5) AS d_s, round(sqrt(list_sum(list_transform(list_zip(a.H, b.H), lambda q: (q[1] - q[2]) * (q[1] - q[2])))), 5) AS d_h FROM k m JOIN k n ON m.i = n.j AND m.j = n.i JOIN z a ON a.unit_id = m.i JOIN z b ON b.unit_id = m.j WHERE m.i < m.j""",
)
def flagship(spark, sf):
    """Suppliers as cities: panel, histories, scaled states, mutual neighbours 200 km apart, distances of histories."""
    # One row per unit, read several times: for the scaling, both sides of the search, and both ends of the pairs.
    w = M.block_scale(settled(wide(spark, sf)), {"S": 4})
    twins = N.mutual_pairs(N.knn(w, w, 5, least_km=200.0))
    return N.pair_distances(twins, w, {"d_h": "H"}).select("i", "j", R("d", 5).alias("d_s"), R("d_h", 5).alias("d_h"))


_ = A, LAST
