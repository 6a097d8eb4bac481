"""Linking two registries: key correspondence, overlap graphs, cluster classes and analysis units."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.scalars import is_link, join_ids, ratio, split_ids, strict_pair
from panelforge.operators.graph import connected
from panelforge.operators.ordering import exact_quantiles, few, join_counted, row_numbers, settled


@dataclass(frozen=True)
class LinkRules:
    """Thresholds of links and classes."""

    link_overlap: float = 0.5
    strict_iou: float = 0.25
    strict_ratios: tuple[float, float] = (0.25, 4.0)
    strict_km: float = 25.0
    dominant_share: float = 0.8
    dominant_coverage: float = 0.5
    unit_coverage: float = 0.5


def _counted_keys(df: DataFrame, key: str) -> DataFrame:
    """Adds n, the rows of the key; 1 for NULL keys. Counts are partial before they are shuffled, and hot keys' rows stay where they are."""
    named = df.where(F.col(key).isNotNull())
    counts = named.groupBy(key).agg(F.count(F.lit(1)).alias("n")).withColumn("_rows", F.col("n"))
    columns = [*df.columns, "n"]
    return join_counted(named, counts, [key], "_rows").select(columns).unionByName(df.where(F.col(key).isNull()).withColumn("n", F.lit(1).cast("long")).select(columns))


def key_classes(left: DataFrame, right: DataFrame, key: str = "key", id: str = "id", check: str | None = None, corroborated: tuple[float, float] = (0.2, 5.0)) -> DataFrame:
    """One row per key: (key, match, n_left, n_right, l_id, r_id), the ids where the key is single on their side; with `check`, the ratio of that column for one-to-one keys and whether it is
    corroborated. A key that repeats on both sides is one row, not all of its pairs. Rows with a NULL key are one row per side."""
    more = [check] if check else []
    one = lambda c, name: F.when(F.count(F.lit(1)) == 1, F.min(c)).alias(name)
    side = lambda df, p, n: df.groupBy(F.col(key).alias(f"_{p}")).agg(F.count(F.lit(1)).alias(n), one(id, f"{p}_id"), *[one(c, f"_{p}_{c}") for c in more])
    both = side(left, "l", "n_left").join(side(right, "r", "n_right"), F.col("_l") == F.col("_r"), "full_outer")
    match = F.when(F.col("n_right").isNull(), "left_only").when(F.col("n_left").isNull(), "right_only").when((F.col("n_left") > 1) | (F.col("n_right") > 1), "ambiguous_many_sided").otherwise("one_to_one")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = both.select(F.coalesce("_l", "_r").alias(key), match.alias("match"), zero("n_left"), zero("n_right"), "l_id", "r_id", *[f"_{p}_{c}" for p in "lr" for c in more])
    if not check:
        return out
    r = F.when(F.col("match") == "one_to_one", ratio(F.col(f"_l_{check}"), F.col(f"_r_{check}")))
    return out.withColumn("check_ratio", r).withColumn("corroborated", F.coalesce(r.between(*corroborated), F.lit(False))).drop(f"_l_{check}", f"_r_{check}")


def member_lists(members: DataFrame, by: str = "cluster_id", id: str = "unit_id", chunk: int = 4096) -> DataFrame:
    """(by, unit_ids): each group's ids in order, `;`-joined. Groups of up to `chunk` rows are joined where their rows meet; the ids of larger ones are numbered over range partitions and joined
    from pieces of `chunk` ids, so only the text itself is one value. `members` is read twice."""
    large = few(members.groupBy(by).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > chunk).select(by))
    if large.isEmpty():
        return members.groupBy(by).agg(join_ids(F.collect_set(id)).alias("unit_ids"))
    small = members.join(large, by, "left_anti").groupBy(by).agg(join_ids(F.collect_set(id)).alias("unit_ids"))
    placed = row_numbers(members.join(large, by, "left_semi").select(by, id).distinct(), [id], "_at", by=[by]).withColumn("_piece", F.floor(F.col("_at") / chunk))
    pieces = placed.groupBy(by, "_piece").agg(join_ids(F.collect_list(id)).alias("_text"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_piece", "_text"))), lambda x: x["_text"])
    return small.unionByName(pieces.groupBy(by).agg(F.array_join(ordered, ";").alias("unit_ids")))


def correspond(left: DataFrame, right: DataFrame, key: str = "key", check: str | None = None, corroborated: tuple[float, float] = (0.2, 5.0), core: Column | None = None) -> DataFrame:
    """Full outer match of two registries on a key.

    match: `one_to_one`, `ambiguous_many_sided`, `left_only` or `right_only`. With `check`, the ratio of that
    column (left over right) must lie in `corroborated`; `core` is a further condition, over l_ and r_ columns, for the core sample. NULL keys
    match nothing. A key that repeats on both sides has a row for each of its pairs; where that is too many, `key_classes` has one row per key.
    """
    tag = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns])
    a, b = tag(_counted_keys(left, key), "l"), tag(_counted_keys(right, key), "r")
    both = a.join(b, a[f"l_{key}"] == b[f"r_{key}"], "full_outer")
    match = F.when(F.col("r_n").isNull(), "left_only").when(F.col("l_n").isNull(), "right_only").when((F.col("l_n") > 1) | (F.col("r_n") > 1), "ambiguous_many_sided").otherwise("one_to_one")
    out = both.withColumn("match", match)
    if check:
        r = ratio(F.col(f"l_{check}"), F.col(f"r_{check}"))
        out = out.withColumn("check_ratio", r).withColumn("corroborated", (F.col("match") == "one_to_one") & F.coalesce(r.between(*corroborated), F.lit(False)))
        out = out.withColumn("core", F.col("corroborated") & (F.lit(True) if core is None else F.coalesce(core, F.lit(False))))
    return out


def matched_pull(matched: DataFrame, left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """Rows of two tables through their correspondence (columns l_<key>, r_<key>), in the order of the left key: `at` is the row's place from 0, the same for both sides, whose columns come
    as l_<column> and r_<column>. A matched key without a row raises."""
    side = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns])
    a, b = side(left, "l"), side(right, "r")
    pairs = row_numbers(matched.select(f"l_{key}", f"r_{key}"), [f"l_{key}", f"r_{key}"], "at")
    out = pairs.join(a, f"l_{key}", "left").join(b, f"r_{key}", "left")
    for df, p in ((a, "l"), (b, "r")):
        gone = pairs.join(df, f"{p}_{key}", "left_anti")
        if not gone.isEmpty():
            raise KeyError(f"matched keys without a row: {[r[0] for r in gone.select(f'{p}_{key}').limit(5).collect()]}")
    return out


def positional_concat(left: DataFrame, right: DataFrame, left_order: Sequence[str], right_order: Sequence[str]) -> DataFrame:
    """The columns of both tables side by side, rows matched by place in the given orders; `at` is the place from 0. Tables of unlike length keep all rows."""
    return row_numbers(left, left_order, "at").join(row_numbers(right, right_order, "at"), "at", "full_outer")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(side, id, component) of a bipartite graph; component is the smallest `a` node of each.

    Every `b` node stands for the smallest of its `a` nodes, so hubs never meet in one task. Only `a` nodes of several `b` nodes connect these, so star contraction sees no others.
    Edges with a null end don't count.
    """
    pairs = settled(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL").distinct())
    least = pairs.groupBy("b").agg(F.min("a").alias("_m"))
    met = settled(pairs.join(least, "b"))
    low = met.groupBy("a").agg(F.min("_m").alias("_mm"))
    roots = _roots(met.join(low, "a"))
    named = lambda df, side, node: df.join(roots, F.col(node) == F.col("node"), "left").select(F.lit(side).alias("side"), F.col(side).alias("id"), F.coalesce("root", node).alias("component"))
    return named(low, "a", "_mm").unionByName(named(least, "b", "_m"))


def _roots(met: DataFrame) -> DataFrame:
    """(node, root) of the nodes _m that an `a` node connects to others; _mm is the smallest _m of the row's `a` node."""
    return connected(met.where("_m <> _mm").select(F.col("_m").alias("u"), F.col("_mm").alias("v")))


def classify(overlaps: DataFrame, countries: DataFrame, rules: LinkRules = LinkRules()) -> DataFrame:
    """Classes of substantive links.

    `overlaps`: unit_id, cluster_id, inter, a_unit, a_cluster, distance_km. `countries`: unit_id, country. Adds the degrees of both ends, the share of
    the cluster's total overlap, its coverage, the component with its sizes, and pair_class.
    """
    links = settled(overlaps.where(is_link(ratio(F.col("inter"), F.least("a_unit", "a_cluster")), rules.link_overlap)).join(countries, "unit_id", "left"))
    # An edge is one row per pair, so counts of rows are counts of partners. Aggregates per node are partial before they are shuffled, and their joins can split a hub. _m is the smallest unit
    # of a cluster, _mm the smallest _m of a unit, as in `components`.
    n = F.count(F.lit(1))
    of_cluster = links.groupBy("cluster_id").agg(
        n.alias("n_units"), F.sum("inter").alias("_all"), F.max("inter").alias("_most"), F.size(F.collect_set("country")).alias("n_countries"), F.min("unit_id").alias("_m")
    )
    links = links.join(of_cluster, "cluster_id", "left")
    of_unit = links.groupBy("unit_id").agg(n.alias("n_clusters"), F.min("_m").alias("_mm"))
    links = settled(links.join(of_unit, "unit_id").where(F.col("cluster_id").isNotNull()))
    links = links.withColumn("share", ratio(F.col("inter"), F.col("_all"))).withColumn("coverage", ratio(F.col("_all"), F.col("a_cluster")))
    side = lambda node, id: links.select(F.col(node).alias("node"), F.lit(id).alias("side"), F.col(id).alias("id"))
    ends = side("_mm", "unit_id").unionByName(side("_m", "cluster_id")).distinct()
    nodes = ends.groupBy("node").agg(F.count_if(F.col("side") == "unit_id").alias("_u"), F.count_if(F.col("side") == "cluster_id").alias("_c"))
    nodes = settled(nodes.join(_roots(links), "node", "left").select(F.col("node").alias("_mm"), F.coalesce("root", "node").alias("component"), "_u", "_c"))
    sizes = nodes.groupBy("component").agg(F.sum("_u").alias("comp_units"), F.sum("_c").alias("comp_clusters"))
    # Nodes, fewer than links, meet the sizes, so that the links of one component needn't meet.
    links = links.join(nodes.drop("_u", "_c").join(sizes, "component"), "_mm")
    iou, frac_cluster = ratio(F.col("inter"), F.col("a_unit") + F.col("a_cluster") - F.col("inter")), ratio(F.col("inter"), F.col("a_cluster"))
    strict = strict_pair(iou, ratio(F.col("a_unit"), F.col("a_cluster")), F.col("distance_km"), rules.strict_iou, rules.strict_ratios, rules.strict_km)
    top = F.col("share") >= rules.dominant_share
    some_top = ratio(F.col("_most"), F.col("_all")) >= rules.dominant_share
    one_unit, one_cluster = F.col("comp_units") == 1, F.col("comp_clusters") == 1
    pair_class = (
        F.when(one_unit & one_cluster, F.when(strict, "A_strict_1to1").otherwise("H_footprint_mismatch_1to1"))
        .when(one_cluster & (F.col("n_countries") > 1), "E_cross_country_cluster")
        .when(one_cluster, F.when(top & (frac_cluster >= rules.dominant_coverage), "B_dominant_1to1").when(top | ~some_top, "D_many_to_one_ambiguous").otherwise("D_minor_of_dominant"))
        .when(one_unit, "C_ambiguous_one_to_many")
        .otherwise("J_complex_many_to_many")
    )
    return links.withColumn("iou", iou).withColumn("pair_class", pair_class).drop("_all", "_most", "_m", "_mm")


def unit_classes(links: DataFrame) -> DataFrame:
    """One class per unit: the first in order of names."""
    return links.groupBy("unit_id").agg(F.min("pair_class").alias("structural_class"))


def cluster_classes(links: DataFrame, valid: DataFrame) -> DataFrame:
    """One class per cluster: dominant wins, minors alone are ambiguous, else the first; wrapped where the response is missing."""
    any_dominant, only_minor = F.bool_or(F.col("pair_class") == "B_dominant_1to1"), F.bool_and(F.col("pair_class") == "D_minor_of_dominant")
    own = links.groupBy("cluster_id").agg(F.when(any_dominant, "B_dominant_1to1").when(only_minor, "D_many_to_one_ambiguous").otherwise(F.min("pair_class")).alias("c"))
    known = own.join(valid, "cluster_id", "left")
    return known.select("cluster_id", F.when(F.coalesce("valid", F.lit(False)), F.col("c")).otherwise(F.concat(F.lit("G_response_missing("), F.col("c"), F.lit(")"))).alias("structural_class"))


def usable_units(links: DataFrame, valid: DataFrame, sample: DataFrame, rules: LinkRules = LinkRules()) -> DataFrame:
    """Clusters that can serve as units: stars of one country with a valid response, all members in the sample, covered enough."""
    marked = links.join(sample.select("unit_id", F.lit(True).alias("_in")).distinct(), "unit_id", "left").join(valid, "cluster_id", "left")
    fits = (F.col("comp_clusters") == 1) & (F.col("n_clusters") == 1) & (F.col("pair_class") != "E_cross_country_cluster") & F.coalesce("_in", F.lit(False)) & F.coalesce("valid", F.lit(False))
    marked = settled(marked.select("cluster_id", "unit_id", "inter", "a_cluster", fits.alias("_fits")))
    own = marked.groupBy("cluster_id").agg(F.bool_and("_fits").alias("ok"), F.count(F.lit(1)).alias("n_units"), ratio(F.sum("inter"), F.first("a_cluster")).alias("coverage"))
    usable = settled(own.where(F.col("ok") & (F.col("coverage") >= rules.unit_coverage)))
    lists = member_lists(marked.join(usable.select("cluster_id"), "cluster_id", "left_semi"))
    return usable.join(lists, "cluster_id").select("cluster_id", "n_units", "unit_ids", "coverage", unit_type(F.col("n_units")))


def unit_type(n: Column) -> Column:
    return F.when(n == 1, "single_city").otherwise("multi_city_aggregate").alias("unit_type")


def cluster_status(links: DataFrame, coverage: Column | float, iou: Column | float | None = None, require_valid: bool = True, lists: bool = True) -> DataFrame:
    """One row per cluster: coverage, unit IoU, and the first status that holds of
    invalid_R, cross_country, ambiguous_nonstar, low_coverage, low_iou, unit. `coverage` and `iou` may be literal or a column. `lists` adds unit_ids, made last; without
    it a hub's members never meet. A link is one row per pair of unit and cluster."""
    lift = lambda x: x if isinstance(x, Column) else F.lit(x)
    if lists:
        links = settled(links.select("cluster_id", "unit_id", "inter", "a_unit", "a_cluster", "valid", "country", "comp_clusters", "n_clusters"))
    own = links.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("n_units"), F.first("a_cluster").alias("a_cluster"),
        F.sum("inter").alias("_i"), F.sum("a_unit").alias("_u"), F.first("valid").alias("valid"), (F.min("country") < F.max("country")).alias("_c"),
        F.bool_and((F.col("comp_clusters") == 1) & (F.col("n_clusters") == 1)).alias("_star"),
    )
    own = own.withColumn("coverage", ratio(F.col("_i"), F.col("a_cluster"))).withColumn("unit_iou", ratio(F.col("_i"), F.col("_u") + F.col("a_cluster") - F.col("_i")))
    status = F.when(F.lit(require_valid) & ~F.coalesce("valid", F.lit(False)), "invalid_R").when(F.col("_c"), "cross_country").when(~F.col("_star"), "ambiguous_nonstar").when(F.col("coverage") < lift(coverage) - 1e-12, "low_coverage")
    if iou is not None:
        status = status.when(F.col("unit_iou") < lift(iou) - 1e-12, "low_iou")
    out = own.withColumn("status", status.otherwise("unit")).drop("_i", "_u", "_c", "_star")
    return out.join(member_lists(links), "cluster_id") if lists else out


def sweep(links: DataFrame, rules: DataFrame) -> DataFrame:
    """Statistics of many rules in one pass: `rules` has rule, min_coverage and min_iou (NULL: none); a few rows, which are broadcast. Clusters are
    aggregated once; only their statuses multiply with the rules."""
    own = settled(cluster_status(links, 0.0, lists=False))
    crossed = own.join(F.broadcast(rules))
    status = F.when(F.col("status") != "unit", F.col("status")).when(F.col("coverage") < F.col("min_coverage") - 1e-12, "low_coverage").when(F.col("unit_iou") < F.col("min_iou") - 1e-12, "low_iou").otherwise("unit")
    good = F.col("s") == "unit"
    judged = crossed.withColumn("s", status)
    sums = judged.groupBy("rule").agg(
        F.count_if(good).alias("n_units"), F.count_if(good & (F.col("n_units") == 1)).alias("n_single"), F.count_if(good & (F.col("n_units") > 1)).alias("n_multi"),
        F.coalesce(F.sum(F.when(good, F.col("n_units"))), F.lit(0)).alias("n_members"), F.avg(F.when(good, F.col("coverage"))).alias("mean_coverage"),
    )
    # One row per rule.
    medians = exact_quantiles(judged.where(good), "unit_iou", [0.5], "_q", ["rule"]).select(F.col("rule").alias("_rule"), F.col("_q")[0].alias("median_iou"))
    return sums.join(F.broadcast(medians), F.col("rule") == F.col("_rule"), "left").drop("_rule")


def aggregate_units(units: DataFrame, members: DataFrame, sums: dict[str, str], weight: str, means: list[str], carried: list[str]) -> DataFrame:
    """Members to units: sums, means weighted by `weight`, and the columns of the dominant member (largest weight, smaller id on ties).

    `units`: cluster_id, unit_ids (`;`-joined). `members`: unit_id and the columns. A listed member that is missing raises.
    """
    listed = units.select("cluster_id", F.explode(split_ids(F.col("unit_ids"))).alias("unit_id"))
    missing = listed.join(members, "unit_id", "left_anti")
    if not missing.isEmpty():
        raise KeyError(f"members without a row: {[r['unit_id'] for r in missing.limit(5).collect()]}")
    own = listed.join(members, "unit_id")
    w = F.col(weight)
    return own.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("n_members"), join_ids(F.collect_list("unit_id")).alias("unit_ids"),
        *[F.sum(c).alias(name) for name, c in sums.items()],
        *[ratio(F.sum(F.col(c) * w), F.sum(F.when(F.col(c).isNotNull(), w))).alias(c) for c in means],
        F.min_by(F.struct("unit_id", *carried), F.struct(-w, "unit_id")).alias("_d"), ratio(F.max(w), F.sum(w)).alias("dominant_share"),
    ).select("*", F.col("_d.unit_id").alias("dominant_id"), *[F.col(f"_d.{c}").alias(c) for c in carried]).drop("_d")
