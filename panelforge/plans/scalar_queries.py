"""Queries of scalar functions, scans and filters, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelforge.functions import scalars as S
from panelforge.operators import panel as P
from panelforge.operators import quality as Q
from panelforge.plans.base import EPOCHS, HIST, LAST, OVER, STOCK, U, VALUES, WIDE, flow, overlaps, stock, t, units, wide

R = F.round
Q_ = {}


def query(name: str, sql: str | None):
    def add(f):
        Q_[name] = (f, sql)
        return f

    return add


@query("sc_pruned_scan", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45")
def _(spark, sf):
    return t(spark, sf, "lineitem").where("l_returnflag = 'R' AND l_quantity >= 45").select("l_orderkey", "l_linenumber", "l_quantity")


@query("pf01_repair_text", "SELECT doc_id, md5(text) AS repaired_md5, md5(text) AS kept_md5 FROM documents")
def _(spark, sf):
    garbled = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return t(spark, sf, "documents").select("doc_id", F.md5(S.repair_mojibake(garbled)).alias("repaired_md5"), F.md5(S.repair_mojibake(F.col("text"))).alias("kept_md5"))


@query("pf02_parse_numbers", "SELECT o_orderkey, round(o_totalprice, 2) AS amount, CAST(NULL AS DOUBLE) AS bad FROM orders")
def _(spark, sf):
    return t(spark, sf, "orders").select("o_orderkey", S.parse_number(F.format_number("o_totalprice", 2)).alias("amount"), S.parse_number(F.when(F.col("o_orderkey") % 2 == 0, "nan").otherwise("n/a")).alias("bad"))


@query("pf03_region_lookup", "SELECT n_nationkey, coalesce(r_name, 'Other') AS region FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey <> 2) ON n_regionkey = r_regionkey")
def _(spark, sf):
    known = t(spark, sf, "region").where("r_regionkey <> 2")
    return t(spark, sf, "nation").join(F.broadcast(known), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_nationkey", F.coalesce("r_name", F.lit("Other")).alias("region"))


@query("pf04_match_key", "SELECT c_custkey, lower(trim(c_name)) || '||' || lower(trim(n_name)) AS match_key FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(spark, sf):
    return t(spark, sf, "customer").join(F.broadcast(t(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", S.match_key(F.col("c_name"), F.col("n_name")).alias("match_key"))


@query("pf05_climate_group", "SELECT p_partkey, CASE WHEN p_size <= 3 THEN 'A' WHEN p_size <= 7 THEN 'B' WHEN p_size <= 16 THEN 'C' WHEN p_size <= 28 THEN 'D' ELSE 'E' END AS climate FROM part")
def _(spark, sf):
    return t(spark, sf, "part").select("p_partkey", S.climate_group(F.col("p_size")).alias("climate"))


@query("pf06_logs", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN round(ln(c_acctbal), 6) END AS plain, round(ln(greatest(c_acctbal, 1)), 6) AS clipped, round(log10(greatest(c_acctbal, 1)), 6) AS base10 FROM customer")
def _(spark, sf):
    x = F.col("c_acctbal")
    return t(spark, sf, "customer").select("c_custkey", R(S.clipped_log(x), 6).alias("plain"), R(S.clipped_log(x, 1.0), 6).alias("clipped"), R(S.clipped_log(x, 1.0, True), 6).alias("base10"))


@query("pf07_row_mean", "SELECT l_orderkey, l_linenumber, round((l_discount + l_tax) / 2, 6) AS mean_rate FROM lineitem")
def _(spark, sf):
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", R(S.row_mean([F.col("l_discount"), F.col("l_tax")]), 6).alias("mean_rate"))


@query("pf08_row_flags", "SELECT c_custkey, c_acctbal < 0 OR c_acctbal > 9000 AS missing, c_acctbal < 0 AS negative, c_acctbal > 5000 AS infinite FROM customer")
def _(spark, sf):
    x = F.col("c_acctbal")
    a = F.when(x > 9000, float("nan")).when(x >= 0, x)
    return t(spark, sf, "customer").select("c_custkey", S.any_missing([x, a]).alias("missing"), S.any_negative([x, a]).alias("negative"), S.any_infinite([x, F.when(x > 5000, float("inf")).otherwise(x)]).alias("infinite"))


@query("pf09_steps", f"WITH {STOCK}, f AS (SELECT unit_id, epoch, bus, lag(bus) OVER (PARTITION BY unit_id ORDER BY epoch) AS b FROM flow) SELECT unit_id, epoch, round(bus - b, 2) AS step, round(bus / nullif(b, 0), 6) AS step_ratio FROM f")
def _(spark, sf):
    return P.steps(flow(spark, sf), "bus").select("unit_id", "epoch", R("step", 2).alias("step"), R("step_ratio", 6).alias("step_ratio"))


@query("pf10_jumps_to_epoch", f"WITH {STOCK}, f AS (SELECT unit_id, bus, lag(bus) OVER (PARTITION BY unit_id ORDER BY epoch) AS b FROM flow WHERE epoch <= 1999) SELECT unit_id, count(*) FILTER (bus < b) AS n_decreasing, round(max(bus / nullif(b, 0)), 6) AS max_ratio, round(min(bus / nullif(b, 0)), 6) AS min_ratio FROM f GROUP BY 1")
def _(spark, sf):
    return P.jump_summary(flow(spark, sf), "bus", 1999).select("unit_id", "n_decreasing", R("max_ratio", 6).alias("max_ratio"), R("min_ratio", 6).alias("min_ratio"))


@query("pf11_history", f"WITH {HIST} SELECT unit_id, epoch, round(h, 8) AS h FROM hist")
def _(spark, sf):
    return P.history(stock(spark, sf), "bus", LAST).select("unit_id", "epoch", R("h", 8).alias("h"))


@query("pf11_history_rebased", f"WITH {STOCK} SELECT unit_id, epoch, round(pop / nullif(max(CASE WHEN epoch = 1999 THEN pop END) OVER (PARTITION BY unit_id), 0), 8) AS h FROM stock QUALIFY epoch < 1999")
def _(spark, sf):
    return P.history(stock(spark, sf), "pop", 1999).select("unit_id", "epoch", R("h", 8).alias("h"))


@query(
    "pf12_descriptors",
    f"""WITH {STOCK}, g AS (SELECT unit_id, epoch, bus, greatest(bus - lag(bus) OVER w, 0) AS gain, (epoch + lag(epoch) OVER w) / 2.0 AS mid FROM stock WINDOW w AS (PARTITION BY unit_id ORDER BY epoch)),
    d AS (SELECT unit_id, max(bus) FILTER (epoch = 1996) AS a, max(bus) FILTER (epoch = 1998) AS b, max(bus) FILTER (epoch = {LAST}) AS t, sum(gain * mid) FILTER (mid IS NOT NULL) AS gm, sum(gain) FILTER (mid IS NOT NULL) AS g FROM g GROUP BY 1)
    SELECT unit_id, round(a / t, 8) AS h_early, round(b / t, 8) AS h_middle, round(1 - b / t, 8) AS late_growth, round(gm / nullif(g, 0), 6) AS weighted_timing FROM d""",
)
def _(spark, sf):
    # The first epoch has no step: its gain is NULL in both.
    s = stock(spark, sf)
    d = P.descriptors(s, "bus", LAST, 1996, 1998)
    return d.select("unit_id", *[R(c, 8).alias(c) for c in ("h_early", "h_middle", "late_growth")], R("weighted_timing", 6).alias("weighted_timing"))


@query("pf13_state_raw", f"WITH {STOCK} SELECT unit_id, round(pop, 2) AS s1, round(bus, 2) AS s2, round(pop / nullif(bus, 0), 10) AS s3, round(buv, 2) AS s4 FROM stock WHERE epoch = {LAST}")
def _(spark, sf):
    x = stock(spark, sf).where(F.col("epoch") == LAST).withColumn("s", P.state_block(F.col("pop"), F.col("bus"), F.col("buv")))
    return x.select("unit_id", R(F.col("s")[0], 2).alias("s1"), R(F.col("s")[1], 2).alias("s2"), R(F.col("s")[2], 10).alias("s3"), R(F.col("s")[3], 2).alias("s4"))


@query("pf14_state_log", f"WITH {WIDE} SELECT unit_id, round(S[1], 6) AS s1, round(S[2], 6) AS s2, round(S[3], 6) AS s3, round(S[4], 6) AS s4 FROM wide")
def _(spark, sf):
    return wide(spark, sf).select("unit_id", *[R(F.col("S")[i], 6).alias(f"s{i + 1}") for i in range(4)])


@query(
    "pf15_context",
    f"""WITH {U}, g AS (SELECT *, CASE WHEN climate <= 3 THEN 'A' WHEN climate <= 7 THEN 'B' WHEN climate <= 16 THEN 'C' WHEN climate <= 28 THEN 'D' ELSE 'E' END AS k FROM units)
    SELECT unit_id, 12 AS width, lat, lon, round(temp, 6) AS temp, rain, CAST(k = 'A' AS DOUBLE) AS a, CAST(k = 'C' AS DOUBLE) AS c, CAST(k = 'E' AS DOUBLE) AS e FROM g""",
)
def _(spark, sf):
    u = units(spark, sf)
    c = P.context_block(F.col("lat"), F.col("lon"), F.col("elev"), F.col("temp"), F.col("rain"), (F.col("temp") / 2, F.col("rain") / 2), S.climate_group(F.col("climate")), "C2")
    x = u.select("unit_id", c.alias("c"))
    return x.select("unit_id", F.size("c").alias("width"), F.col("c")[0].alias("lat"), F.col("c")[1].alias("lon"), R(F.col("c")[3], 6).alias("temp"), F.col("c")[4].alias("rain"), F.col("c")[7].alias("a"), F.col("c")[9].alias("c_"), F.col("c")[11].alias("e")).withColumnRenamed("c_", "c")


@query("pf16_from_mollweide", f"WITH {U}, p AS (SELECT unit_id, lon * 40000.0 AS x, lat * 100000.0 AS y FROM units), q AS (SELECT unit_id, x, asin(y / (sqrt(2) * 6378137)) AS th FROM p) SELECT unit_id, round(degrees(asin((2 * th + sin(2 * th)) / pi())), 6) AS lat, round(degrees(pi() * x / (2 * sqrt(2) * 6378137 * cos(th))), 6) AS lon FROM q")
def _(spark, sf):
    m = S.from_mollweide(F.col("lon") * 40000.0, F.col("lat") * 100000.0)
    return units(spark, sf).select("unit_id", m.alias("m")).select("unit_id", R("m.lat", 6).alias("lat"), R("m.lon", 6).alias("lon"))


@query("pf17_mollweide_round_trip", f"WITH {U} SELECT unit_id, round(lat, 6) AS lat, round(lon, 6) AS lon FROM units")
def _(spark, sf):
    there = units(spark, sf).select("unit_id", S.to_mollweide(F.col("lat"), F.col("lon")).alias("p"))
    return there.select("unit_id", S.from_mollweide(F.col("p.x"), F.col("p.y")).alias("m")).select("unit_id", R("m.lat", 6).alias("lat"), R("m.lon", 6).alias("lon"))


@query("pf18_haversine", f"WITH {U} SELECT unit_id, round(2 * 6371.0088 * asin(sqrt(least(1, pow(sin(radians(10 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(10)) * pow(sin(radians(20 - lon) / 2), 2)))), 6) AS km FROM units")
def _(spark, sf):
    return units(spark, sf).select("unit_id", R(S.haversine_km(F.col("lat"), F.col("lon"), F.lit(10.0), F.lit(20.0)), 6).alias("km"))


@query("pf19_unit_sphere", f"WITH {U} SELECT unit_id, round(cos(radians(lat)) * cos(radians(lon)), 9) + 0.0 AS x, round(cos(radians(lat)) * sin(radians(lon)), 9) + 0.0 AS y, round(sin(radians(lat)), 9) + 0.0 AS z FROM units")
def _(spark, sf):
    p = units(spark, sf).select("unit_id", S.unit_xyz(F.col("lat"), F.col("lon")).alias("p"))
    return p.select("unit_id", *[(R(F.col("p")[i], 9) + F.lit(0.0)).alias(n) for i, n in enumerate("xyz")])


@query("pf20_tiles", f"WITH {U} SELECT unit_id, CAST(floor((lat + 90) / 10) * 1000 + floor((lon + 180) / 10) AS BIGINT) AS tile FROM units")
def _(spark, sf):
    return units(spark, sf).select("unit_id", S.tile_id(F.col("lat"), F.col("lon")).alias("tile"))


@query("pf21_overlap_measures", f"WITH {OVER} SELECT unit_id, cluster_id, round(inter / a_unit, 8) AS frac_a, round(inter / a_cluster, 8) AS frac_b, round(inter / least(a_unit, a_cluster), 8) AS overlap_over_min, round(inter / (a_unit + a_cluster - inter), 8) AS iou, round(a_unit / a_cluster, 8) AS area_ratio FROM ovl")
def _(spark, sf):
    m = S.overlap_measures(F.col("inter"), F.col("a_unit"), F.col("a_cluster"))
    return overlaps(spark, sf).select("unit_id", "cluster_id", *[R(c, 8).alias(n) for n, c in m.items()])


@query("pf22_link_predicates", f"WITH {OVER} SELECT unit_id, cluster_id, inter / least(a_unit, a_cluster) >= 0.5 AS is_link, inter / (a_unit + a_cluster - inter) >= 0.25 AND a_unit / a_cluster BETWEEN 0.25 AND 4 AND distance_km <= 25 AS strict FROM ovl")
def _(spark, sf):
    m = S.overlap_measures(F.col("inter"), F.col("a_unit"), F.col("a_cluster"))
    return overlaps(spark, sf).select("unit_id", "cluster_id", S.is_link(m["overlap_over_min"]).alias("is_link"), S.strict_pair(m["iou"], m["area_ratio"], F.col("distance_km")).alias("strict"))


@query("pf23_response_fields", "SELECT * FROM (VALUES ('Annual_nig', 'Annual', 'nig'), ('Summer_day', 'Summer', 'day'), ('winter_night', 'Winter', 'nig'), ('Spring_day', NULL, NULL), ('hasPlace', NULL, NULL)) v(name, period, diurnal)")
def _(spark, sf):
    names = spark.createDataFrame([(n,) for n in ("Annual_nig", "Summer_day", "winter_night", "Spring_day", "hasPlace")], "name string")
    return names.withColumn("f", S.response_field(F.col("name"))).select("name", "f.period", "f.diurnal")


@query("pf24_dates_in_names", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders")
def _(spark, sf):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    name = F.when(k == 0, F.concat(F.lit("LST_"), F.date_format(d, "yyyyMMdd"), F.lit(".tif"))).when(k == 1, F.concat(F.lit("x_"), F.date_format(d, "yyyy-MM-dd"), F.lit(".tif"))).when(k == 2, F.concat(F.lit("a"), F.date_format(d, "yyyyDDD"), F.lit("b"))).otherwise(F.concat(F.lit("no_99999999_"), F.lit("20201399.tif")))
    return t(spark, sf, "orders").select("o_orderkey", S.date_in_name(name).alias("day"))


@query("pf25_canonical_names", "SELECT o_orderkey, o_orderkey % 5 <> 0 AS canonical FROM orders")
def _(spark, sf):
    name = F.concat(F.date_format("o_orderdate", "yyyy_MM_dd"), F.when(F.col("o_orderkey") % 5 == 0, "_dmlst.tif").otherwise("_DMLST.tif"))
    return t(spark, sf, "orders").select("o_orderkey", (name == S.canonical_name(F.col("o_orderdate"))).alias("canonical"))


@query("pf26_units_of_values", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'K' WHEN 1 THEN 'degC' WHEN 2 THEN 'K' ELSE NULL END AS unit, CASE p_size % 4 WHEN 0 THEN 'metadata' WHEN 1 THEN 'metadata' WHEN 2 THEN 'numeric_diagnostic_only' ELSE 'unresolved' END AS evidence FROM part")
def _(spark, sf):
    k = F.col("p_size") % 4
    meta = F.when(k == 0, "Land surface, Kelvin").when(k == 1, '{"unit": "\\u00b0C"}').otherwise("none")
    u = S.unit_of(meta, F.when(k == 2, 250.0).otherwise(-5000.0), F.when(k == 2, 310.0).otherwise(9000.0))
    return t(spark, sf, "part").select("p_partkey", u.alias("u")).select("p_partkey", "u.unit", "u.evidence")


@query("pf27_mentions", "SELECT p_partkey, regexp_matches(lower(p_type), 'brass|steel') AS mentions FROM part")
def _(spark, sf):
    return t(spark, sf, "part").select("p_partkey", S.mentions(F.col("p_type"), ("brass", "steel")).alias("mentions"))


@query("pf28_id_lists", "SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ';' ORDER BY l_partkey) AS ids, sum(l_partkey)::BIGINT AS id_sum FROM lineitem GROUP BY 1")
def _(spark, sf):
    x = t(spark, sf, "lineitem").groupBy("l_orderkey").agg(S.join_ids(F.collect_list("l_partkey")).alias("ids"))
    return x.withColumn("id_sum", F.aggregate(S.split_ids(F.col("ids")), F.lit(0).cast("long"), lambda s, v: s + v))


@query("pf29_summary_text", f"WITH {STOCK} SELECT unit_id, format('pop={{:d}}; n={{:d}}', CAST(pop AS BIGINT), CAST(buv AS BIGINT)) AS summary FROM stock WHERE epoch = {LAST}")
def _(spark, sf):
    return stock(spark, sf).where(F.col("epoch") == LAST).select("unit_id", F.format_string("pop=%.0f; n=%.0f", F.col("pop"), F.col("buv")).alias("summary"))


@query("pf30_quadratic", f"WITH {WIDE} SELECT unit_id, 14 AS width, round(S[1] * S[1], 5) AS q11, round(S[1] * S[2], 5) AS q12, round(S[4] * S[4], 5) AS q44 FROM wide")
def _(spark, sf):
    x = wide(spark, sf).select("unit_id", S.quadratic(F.col("S"), 4).alias("q"))
    return x.select("unit_id", F.size("q").alias("width"), R(F.col("q")[4], 5).alias("q11"), R(F.col("q")[5], 5).alias("q12"), R(F.col("q")[13], 5).alias("q44"))


@query("pf31_pseudo_history", f"WITH {WIDE} SELECT unit_id, 9 AS width, round(S[1] * S[1], 5) AS p1, round(S[4] * S[4], 5) AS p4, round(S[1] * S[2], 5) AS p5, round(S[2] * S[4], 5) AS p9 FROM wide")
def _(spark, sf):
    x = wide(spark, sf).select("unit_id", S.cross_products(F.col("S")).alias("p"))
    return x.select("unit_id", F.size("p").alias("width"), *[R(F.col("p")[i], 5).alias(f"p{i + 1}") for i in (0, 3, 4, 8)])


@query("pf32_implied_height", f"WITH {STOCK}, r AS (SELECT unit_id, (buv / bus) / max(CASE WHEN epoch = {LAST} THEN buv / bus END) OVER (PARTITION BY unit_id) AS r FROM stock) SELECT unit_id, round(max(r) - min(r), 8) AS height_range, round(sqrt(avg((r - 1) * (r - 1))), 8) AS rms_from_base, max(r) - min(r) < 0.01 AS constant FROM r GROUP BY 1")
def _(spark, sf):
    return P.implied_height(stock(spark, sf), "buv", "bus", LAST).select("unit_id", R("height_range", 8).alias("height_range"), R("rms_from_base", 8).alias("rms_from_base"), "constant")


@query("pf33_content_digest", "SELECT doc_id, sha256(text) AS digest FROM documents")
def _(spark, sf):
    return t(spark, sf, "documents").select("doc_id", S.content_sha256(F.col("text").cast("binary")).alias("digest"))


@query("pf33_hash_draws", "SELECT o_orderkey, CAST(('0x' || substr(md5('7:' || CAST(o_orderkey AS VARCHAR)), 1, 8))::UBIGINT % 25 AS BIGINT) AS draw FROM orders")
def _(spark, sf):
    return t(spark, sf, "orders").select("o_orderkey", S.hash_draw(F.concat(F.lit("7:"), F.col("o_orderkey").cast("string")), 25).alias("draw"))


@query(
    "fl1_quality_flags",
    f"""WITH {U}, {STOCK}, j AS (SELECT unit_id, bus, lag(bus) OVER (PARTITION BY unit_id ORDER BY epoch) AS b FROM flow),
    js AS (SELECT unit_id, count(*) FILTER (bus < b) AS nd, max(bus / nullif(b, 0)) AS mx, min(bus / nullif(b, 0)) AS mn FROM j GROUP BY 1),
    e AS (SELECT unit_id, count(DISTINCT epoch) AS n_epochs, max(CASE WHEN epoch = {LAST} THEN bus END) AS ending FROM flow GROUP BY 1)
    SELECT u.unit_id, coalesce(n_epochs, 0) AS n_epochs, coalesce(n_epochs, 0) < {len(EPOCHS)} AS incomplete, coalesce(ending <= 0, true) AS zero_endpoint, coalesce(nd > 0, false) AS any_decrease,
        coalesce(mx > 3 OR mn < 0.5, false) AS extreme_jump, count(*) OVER (PARTITION BY name, country) > 1 AS duplicate_name, born > {EPOCHS[0]} AS born_late, died <= {LAST} AS died_early, coalesce(nd, 0) AS n_decreasing, round(mx, 6) AS max_ratio
    FROM units u LEFT JOIN e USING (unit_id) LEFT JOIN js USING (unit_id)""",
)
def _(spark, sf):
    f = Q.flags(flow(spark, sf), units(spark, sf), EPOCHS, VALUES)
    return f.select("unit_id", "n_epochs", "incomplete", "zero_endpoint", "any_decrease", "extreme_jump", "duplicate_name", "born_late", "died_early", "n_decreasing", R("max_ratio", 6).alias("max_ratio"))


def _reasons():
    return {"negative_balance": F.col("c_acctbal") < 0, "no_segment": F.col("c_mktsegment").isNull(), "machinery": F.col("c_mktsegment") == "MACHINERY", "rich": F.col("c_acctbal") > 9000}


@query(
    "fl2_exclusion_cascade",
    """WITH r AS (SELECT CASE WHEN c_acctbal < 0 THEN 1 WHEN c_mktsegment IS NULL THEN 2 WHEN c_mktsegment = 'MACHINERY' THEN 3 WHEN c_acctbal > 9000 THEN 4 END AS k FROM customer),
    s(step, reason) AS (VALUES (1, 'negative_balance'), (2, 'no_segment'), (3, 'machinery'), (4, 'rich')),
    c AS (SELECT step, reason, count(k) AS removed FROM s LEFT JOIN r ON k = step GROUP BY 1, 2)
    SELECT step, reason, removed, CAST((SELECT count(*) FROM customer) - sum(removed) OVER (ORDER BY step) AS BIGINT) AS remaining FROM c""",
)
def _(spark, sf):
    return Q.exclusion_audit(t(spark, sf, "customer"), _reasons())


@query("fl2_kept", "SELECT c_custkey FROM customer WHERE NOT (c_acctbal < 0 OR c_mktsegment IS NULL OR c_mktsegment = 'MACHINERY' OR c_acctbal > 9000)")
def _(spark, sf):
    return Q.kept(t(spark, sf, "customer"), _reasons()).select("c_custkey")


@query("fl4_quantile_filter", "SELECT s_suppkey FROM supplier WHERE s_acctbal >= (SELECT quantile_cont(s_acctbal, 0.1) FROM supplier)")
def _(spark, sf):
    return Q.below_quantile(t(spark, sf, "supplier"), "s_acctbal", 0.1).select("s_suppkey")


@query("fl5_membership", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AS urgent FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def _(spark, sf):
    o = t(spark, sf, "orders")
    keep = t(spark, sf, "customer").join(o.where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    urgent = o.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("urgent")).distinct()
    return keep.join(urgent, "c_custkey", "left").select("c_custkey", F.coalesce("urgent", F.lit(False)).alias("urgent"))


@query("fl6_minimum_sample", "SELECT r_name AS region, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE (SELECT count(*) FROM supplier) >= 5 GROUP BY 1")
def _(spark, sf):
    u = units(spark, sf)
    return u.where(F.lit(Q.enough(u, 5))).groupBy("region").agg(F.count(F.lit(1)).alias("n"))


@query("fl7_complete_rows", "SELECT c_custkey FROM customer WHERE c_acctbal BETWEEN 0 AND 9000")
def _(spark, sf):
    x = F.col("c_acctbal")
    d = t(spark, sf, "customer").select("c_custkey", F.when(x > 9000, float("nan")).when(x >= 0, x).alias("x"))
    return Q.complete_rows(d, ["x"]).select("c_custkey")


@query("fl8_same_rows", "SELECT count(*) AS n FROM nation")
def _(spark, sf):
    n = t(spark, sf, "nation")
    Q.assert_same_rows(n, n.orderBy(F.desc("n_name")))
    return n.agg(F.count(F.lit(1)).alias("n"))


@query("wn1_top_of_group", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def _(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t(spark, sf, "orders").withColumn("r", F.row_number().over(w)).where("r = 1").select("o_custkey", "o_orderkey")


@query("wn6_duplicate_flags", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand, p_size) > 1 AS duplicated FROM part")
def _(spark, sf):
    return t(spark, sf, "part").select("p_partkey", (F.count(F.lit(1)).over(Window.partitionBy("p_brand", "p_size")) > 1).alias("duplicated"))
