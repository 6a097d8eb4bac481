"""Frames that the registered queries share, each with the SQL that gives the same rows.

Suppliers stand for cities: their yearly sales, accumulated, are the panel; their nation and region are country and region; place and
climate are arithmetic on the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.operators import panel as P

EPOCHS = (1995, 1996, 1997, 1998, 1999, 2000, 2001)
LAST = EPOCHS[-1]
VALUES = ("bus", "pop", "buv")


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def units(spark: SparkSession, sf: str) -> DataFrame:
    s = t(spark, sf, "supplier").join(F.broadcast(t(spark, sf, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(t(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("s_suppkey")
    return s.select(
        k.alias("unit_id"), F.col("s_name").alias("name"), F.col("n_name").alias("country"), F.col("r_name").alias("region"), (k * 37 % 160 - 80).cast("double").alias("lat"), (k * 53 % 360 - 180).cast("double").alias("lon"),
        F.col("s_acctbal").alias("elev"), (k % 30 + 1).cast("int").alias("climate"), (F.col("s_acctbal") / 500).alias("temp"), (k % 17 + 1).cast("double").alias("rain"), (k * 7 % 40 + 1970).cast("int").alias("born"), (k * 11 % 60 + 1998).cast("int").alias("died"),
    )


def flow(spark: SparkSession, sf: str) -> DataFrame:
    x = t(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("unit_id"), F.year("l_shipdate").alias("epoch"))
    return x.agg(F.sum("l_extendedprice").alias("bus"), F.sum("l_quantity").alias("pop"), F.count(F.lit(1)).cast("double").alias("buv"))


def stock(spark: SparkSession, sf: str) -> DataFrame:
    return P.cumulative(flow(spark, sf), VALUES)


def wide(spark: SparkSession, sf: str) -> DataFrame:
    """One row per unit: attributes, the last epoch's values, the history array, and state and context arrays."""
    u = units(spark, sf).join(P.trajectories(flow(spark, sf), VALUES, LAST, "bus").where("H IS NOT NULL"), "unit_id")
    state = P.state_block(F.col("pop"), F.col("bus"), F.col("buv"), "S3", log=True)
    context = P.context_block(F.col("lat"), F.col("lon"), F.col("elev"))
    return u.withColumn("S", state).withColumn("C", context)


def overlaps(spark: SparkSession, sf: str) -> DataFrame:
    """Overlaps of a bipartite graph: every pair of an order and a part that has a lineitem. Areas and overlaps are arithmetic on the keys: about 6 in 100 pairs overlap enough
    for a link, and two thirds of the pairs of every fiftieth part, which thereby becomes a hub."""
    u, c = F.col("unit_id"), F.col("cluster_id")
    pairs = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("unit_id"), F.col("l_partkey").alias("cluster_id")).distinct()
    sized = pairs.withColumn("a_unit", (u % 7 * 100 + 500).cast("double")).withColumn("a_cluster", (c % 5 * 150 + 600).cast("double"))
    part = ((u * 31 + c * 17) % 101 + F.when(c % 50 == 7, 60).otherwise(0)).cast("double")
    return sized.withColumn("inter", F.least("a_unit", "a_cluster") * part / 189).withColumn("distance_km", ((u + c) % 40).cast("double"))


def link_countries(spark: SparkSession, sf: str) -> DataFrame:
    # The units and clusters of overlaps are the orders and parts of lineitems; their pairs aren't needed for that.
    return t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("unit_id")).distinct().withColumn("country", F.concat(F.lit("c"), (F.col("unit_id") % 3).cast("string")))


def cluster_valid(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "lineitem").select(F.col("l_partkey").alias("cluster_id")).distinct().withColumn("valid", F.col("cluster_id") % 11 != 0)


U = """units AS (
    SELECT s_suppkey AS unit_id, s_name AS name, n_name AS country, r_name AS region, CAST(s_suppkey * 37 % 160 - 80 AS DOUBLE) AS lat, CAST(s_suppkey * 53 % 360 - 180 AS DOUBLE) AS lon,
           s_acctbal AS elev, CAST(s_suppkey % 30 + 1 AS INTEGER) AS climate, s_acctbal / 500 AS temp, CAST(s_suppkey % 17 + 1 AS DOUBLE) AS rain, CAST(s_suppkey * 7 % 40 + 1970 AS INTEGER) AS born, CAST(s_suppkey * 11 % 60 + 1998 AS INTEGER) AS died
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
FLOW = """flow AS (
    SELECT l_suppkey AS unit_id, CAST(year(l_shipdate) AS INTEGER) AS epoch, sum(l_extendedprice) AS bus, sum(l_quantity) AS pop, CAST(count(*) AS DOUBLE) AS buv FROM lineitem GROUP BY 1, 2)"""
STOCK = FLOW + """, stock AS (
    SELECT unit_id, epoch, sum(bus) OVER w AS bus, sum(pop) OVER w AS pop, sum(buv) OVER w AS buv FROM flow WINDOW w AS (PARTITION BY unit_id ORDER BY epoch ROWS UNBOUNDED PRECEDING))"""
HIST = STOCK + f""", hist AS (
    SELECT unit_id, epoch, bus / nullif(max(CASE WHEN epoch = {LAST} THEN bus END) OVER (PARTITION BY unit_id), 0) AS h FROM stock QUALIFY epoch < {LAST})"""
WIDE = U + ", " + HIST + f""", wide AS (
    SELECT u.*, e.bus, e.pop, e.buv, x.H, [ln(e.pop), ln(e.bus), ln(e.pop / e.bus), ln(e.buv)] AS S, [u.lat, u.lon, u.elev] AS C
    FROM units u JOIN (SELECT * FROM stock WHERE epoch = {LAST}) e USING (unit_id) JOIN (SELECT unit_id, list(h ORDER BY epoch) AS H FROM hist GROUP BY 1) x USING (unit_id))"""
OVER = """ovl AS (
    SELECT *, least(a_unit, a_cluster) * CAST((unit_id * 31 + cluster_id * 17) % 101 + CASE WHEN cluster_id % 50 = 7 THEN 60 ELSE 0 END AS DOUBLE) / 189 AS inter, CAST((unit_id + cluster_id) % 40 AS DOUBLE) AS distance_km
    FROM (SELECT DISTINCT l_orderkey AS unit_id, l_partkey AS cluster_id, CAST(l_orderkey % 7 * 100 + 500 AS DOUBLE) AS a_unit, CAST(l_partkey % 5 * 150 + 600 AS DOUBLE) AS a_cluster FROM lineitem))"""
#: Links with their classes; components by a recursive walk.
LINKS = OVER + """, sub AS (SELECT *, 'c' || CAST(unit_id % 3 AS VARCHAR) AS country, cluster_id % 11 <> 0 AS valid FROM ovl WHERE inter / least(a_unit, a_cluster) >= 0.5),
    walk(start, node) AS (SELECT DISTINCT unit_id, unit_id FROM sub UNION SELECT w.start, b.unit_id FROM walk w JOIN sub a ON a.unit_id = w.node JOIN sub b ON b.cluster_id = a.cluster_id),
    comp AS (SELECT start AS unit_id, min(node) AS component FROM walk GROUP BY 1),
    sized AS (SELECT component, count(DISTINCT unit_id) AS comp_units, count(DISTINCT cluster_id) AS comp_clusters FROM sub JOIN comp USING (unit_id) GROUP BY 1),
    deg AS (SELECT sub.*, component, comp_units, comp_clusters, count(*) OVER c AS n_units, count(*) OVER u AS n_clusters, inter / sum(inter) OVER c AS share, sum(inter) OVER c / a_cluster AS coverage,
        len(list_distinct(list(country) OVER c)) AS n_countries, inter / (a_unit + a_cluster - inter) AS iou, inter / a_cluster AS frac_cluster, a_unit / a_cluster AS area_ratio
        FROM sub JOIN comp USING (unit_id) JOIN sized USING (component) WINDOW c AS (PARTITION BY cluster_id), u AS (PARTITION BY unit_id)),
    links AS (SELECT *, CASE
        WHEN comp_units = 1 AND comp_clusters = 1 THEN CASE WHEN iou >= 0.25 AND area_ratio BETWEEN 0.25 AND 4 AND distance_km <= 25 THEN 'A_strict_1to1' ELSE 'H_footprint_mismatch_1to1' END
        WHEN comp_clusters = 1 AND n_countries > 1 THEN 'E_cross_country_cluster'
        WHEN comp_clusters = 1 THEN CASE WHEN share >= 0.8 AND frac_cluster >= 0.5 THEN 'B_dominant_1to1' WHEN share >= 0.8 OR max(share) OVER (PARTITION BY cluster_id) < 0.8 THEN 'D_many_to_one_ambiguous' ELSE 'D_minor_of_dominant' END
        WHEN comp_units = 1 THEN 'C_ambiguous_one_to_many' ELSE 'J_complex_many_to_many' END AS pair_class FROM deg)"""
