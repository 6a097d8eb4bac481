"""Polygons and pixels: overlay areas, containment, zonal means.

A polygon is an array of rings, a ring an array of struct(x, y); outer rings and holes run in opposite directions. Candidate pairs come from
a grid: both sides are put into the cells their boxes cover and joined on cells, and a pair counts in one cell only, the one that holds the lower left corner of
the boxes' common part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType, StructField, StructType

from panelforge.operators.ordering import settled

RINGS = "array<array<struct<x:double,y:double>>>"


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1)))


def box(rings: Column) -> dict[str, Column]:
    points = F.flatten(rings)
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return {"x0": F.array_min(xs), "y0": F.array_min(ys), "x1": F.array_max(xs), "y1": F.array_max(ys)}


def edges(rings: Column) -> Column:
    """array of struct(x1, y1, x2, y2), rings closed."""
    of = lambda r: F.transform(r, lambda p, i: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), r[(i + 1) % F.size(r)]["x"].alias("x2"), r[(i + 1) % F.size(r)]["y"].alias("y2")))
    return F.flatten(F.transform(rings, of))


def area(rings: Column) -> Column:
    """Area by the signed sum over all rings."""
    return F.abs(F.aggregate(edges(rings), F.lit(0.0), lambda s, e: s + e["x1"] * e["y2"] - e["x2"] * e["y1"])) / 2


def contains(edge_array: Column, x: Column, y: Column) -> Column:
    """Even-odd test of a point against edges, holes included."""
    crossing = lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"])
    return F.aggregate(edge_array, F.lit(0), lambda n, e: n + F.when(crossing(e), 1).otherwise(0)) % 2 == 1


def _cells(df: DataFrame, cell: float) -> DataFrame:
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))
    return df.withColumn("_cx", F.explode(span("x0", "x1"))).withColumn("_cy", F.explode(span("y0", "y1")))


def _edge_table(rings) -> np.ndarray:
    """Edges (x1, y1, x2, y2) of closed rings."""
    parts = [np.array([(q["x"], q["y"]) for q in ring], float).reshape(-1, 2) for ring in rings]
    return np.concatenate([np.hstack([p, np.roll(p, -1, axis=0)]) for p in parts]) if parts else np.empty((0, 4))


def intersection_area(a, b) -> float:
    """Area of the common part of two polygons given as rings."""
    return common_area(_edge_table(a), _edge_table(b))


def _upwards(e: np.ndarray) -> np.ndarray:
    """Edges with their lower end first; level ones bound no area between heights and are left out."""
    e = e[e[:, 1] != e[:, 3]]
    return np.where((e[:, 1] > e[:, 3])[:, None], e[:, [2, 3, 0, 1]], e)


def common_area(ea: np.ndarray, eb: np.ndarray, rounds: int = 64, most: int = 1 << 20) -> float:
    """Area of the common part of two polygons with holes, concave or not.

    Heights of all corners cut the plane into slabs. In a slab whose edges keep their order, the length of the common part changes linearly with the height, so its area is
    that length at half height times the slab's height. Slabs where neighbouring edges change places are cut at those crossings and looked at again. Slabs are handled
    together in arrays, as long as they have no more than `most` edges: the work is that of sorting pairs of slabs and edges in them, n log n where a level line meets few edges.
    """
    ea, eb = _upwards(ea), _upwards(eb)
    if not len(ea) or not len(eb):
        return 0.0
    low, high = max(ea[:, 1].min(), eb[:, 1].min()), min(ea[:, 3].max(), eb[:, 3].max())
    if not low < high:
        return 0.0
    e = np.concatenate([ea, eb])
    first = np.arange(len(e)) < len(ea)
    slope = (e[:, 2] - e[:, 0]) / (e[:, 3] - e[:, 1])
    heights = np.unique(np.clip(np.concatenate([e[:, 1], e[:, 3]]), low, high))
    todo, total = [(heights[:-1], heights[1:], rounds)], 0.0
    least = 1e-12 * max(1.0, float(np.abs(e).max()))
    while todo:
        bottom, top, left = todo.pop()
        if len(bottom) > 1 and _pairs_of_slabs(bottom, top, e) > most:
            half = len(bottom) // 2
            todo += [(bottom[:half], top[:half], left), (bottom[half:], top[half:], left)]
            continue
        slab, edge = _edges_of_slabs(bottom, top, e)
        x0 = e[edge, 0] + slope[edge] * (bottom[slab] - e[edge, 1])
        x1 = e[edge, 0] + slope[edge] * (top[slab] - e[edge, 1])
        order = np.lexsort((x1, x0, slab))
        slab, edge, x0, x1 = slab[order], edge[order], x0[order], x1[order]
        gap0, gap1 = x0[1:] - x0[:-1], x1[:-1] - x1[1:]
        crossed = np.flatnonzero((slab[1:] == slab[:-1]) & (gap1 > least) & (gap0 > least)) if left else np.empty(0, np.int64)
        at = bottom[slab[crossed]] + (top - bottom)[slab[crossed]] * gap0[crossed] / (gap0[crossed] + gap1[crossed])
        inside = (at > bottom[slab[crossed]]) & (at < top[slab[crossed]])
        crossed, at = crossed[inside], at[inside]
        uncertain = np.zeros(len(bottom), bool)
        uncertain[slab[crossed]] = True
        total += float(_common(slab, first[edge], (x0 + x1) / 2, (top - bottom) * ~uncertain, len(bottom)).sum())
        if len(crossed):
            # The cuts of each such slab, between its own bottom and top.
            own = np.flatnonzero(uncertain)
            owner, cut = np.concatenate([own, own, slab[crossed]]), np.concatenate([bottom[own], top[own], at])
            order = np.lexsort((cut, owner))
            owner, cut = owner[order], cut[order]
            keep = (owner[1:] == owner[:-1]) & (cut[1:] > cut[:-1])
            todo.append((cut[:-1][keep], cut[1:][keep], left - 1))
    return total


def _pairs_of_slabs(bottom: np.ndarray, top: np.ndarray, e: np.ndarray) -> int:
    return int(np.maximum(np.searchsorted(top, e[:, 3], side="right") - np.searchsorted(bottom, e[:, 1], side="left"), 0).sum())


def _edges_of_slabs(bottom: np.ndarray, top: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slab, edge) of every edge that spans a slab; slabs are in order and don't overlap."""
    lo, hi = np.searchsorted(bottom, e[:, 1], side="left"), np.searchsorted(top, e[:, 3], side="right")
    n = np.maximum(hi - lo, 0)
    edge = np.repeat(np.arange(len(e)), n)
    return np.arange(len(edge)) - np.repeat(np.cumsum(n) - n, n) + lo[edge], edge


def _common(slab: np.ndarray, first: np.ndarray, x: np.ndarray, weight: np.ndarray, slabs: int) -> np.ndarray:
    """For each slab its weight times the length that is inside both polygons, by even-odd counts of edges to the left."""
    if ((x[1:] < x[:-1]) & (slab[1:] == slab[:-1])).any():
        order = np.lexsort((x, slab))
        slab, first, x = slab[order], first[order], x[order]
    inside = np.logical_and(np.cumsum(first) % 2, np.cumsum(~first) % 2)
    same = slab[1:] == slab[:-1]
    held = inside[:-1] & same
    return np.bincount(slab[1:][held], (x[1:] - x[:-1])[held], slabs) * weight


def common_areas(ea: np.ndarray, pa: np.ndarray, eb: np.ndarray, pb: np.ndarray, n: int, rounds: int = 64) -> np.ndarray:
    """`common_area` of n pairs of polygons together: `pa` and `pb` tell the pair of each edge. The work of arrays is shared by all pairs, which matters where polygons have few edges; memory grows with
    the slabs of all pairs and the edges in them."""
    total = np.zeros(n)
    level = lambda e, p: (_upwards(e), p[e[:, 1] != e[:, 3]])
    (ea, pa), (eb, pb) = level(ea, pa), level(eb, pb)
    low, high = np.full((2, n), np.inf), np.full((2, n), -np.inf)
    for side, (e, p) in enumerate(((ea, pa), (eb, pb))):
        np.minimum.at(low[side], p, e[:, 1])
        np.maximum.at(high[side], p, e[:, 3])
    low, high = low.max(axis=0), high.min(axis=0)
    e, pair, first = np.concatenate([ea, eb]), np.concatenate([pa, pb]), np.arange(len(ea) + len(eb)) < len(ea)
    # Edges beyond the common heights bound nothing there.
    held = (low[pair] < high[pair]) & (e[:, 1] < high[pair]) & (e[:, 3] > low[pair])
    e, pair, first = e[held], pair[held], first[held]
    if not len(e):
        return total
    least = np.full(n, 1.0)
    np.maximum.at(least, pair, np.abs(e).max(axis=1))
    least *= 1e-12
    slope = (e[:, 2] - e[:, 0]) / (e[:, 3] - e[:, 1])
    ends, owner = np.concatenate([np.maximum(e[:, 1], low[pair]), np.minimum(e[:, 3], high[pair])]), np.concatenate([pair, pair])
    order = np.lexsort((ends, owner))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (ends[order][1:] != ends[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(fresh) - 1
    heights, of = ends[order][fresh], owner[order][fresh]
    bottom, top, of = heights[:-1], heights[1:], of[:-1]
    # An edge spans the slabs between the numbers of its ends.
    lo, count = number[: len(e)], number[len(e) :] - number[: len(e)]
    edge = np.repeat(np.arange(len(e)), count)
    slab = np.arange(len(edge)) - np.repeat(np.cumsum(count) - count, count) + lo[edge]
    for left in range(rounds, -1, -1):
        x0 = e[edge, 0] + slope[edge] * (bottom[slab] - e[edge, 1])
        x1 = e[edge, 0] + slope[edge] * (top[slab] - e[edge, 1])
        order = np.lexsort((x1, x0, slab))
        slab, edge, x0, x1 = slab[order], edge[order], x0[order], x1[order]
        gap0, gap1, bar = x0[1:] - x0[:-1], x1[:-1] - x1[1:], least[of[slab[1:]]]
        crossed = np.flatnonzero((slab[1:] == slab[:-1]) & (gap1 > bar) & (gap0 > bar)) if left else np.empty(0, np.int64)
        at = bottom[slab[crossed]] + (top - bottom)[slab[crossed]] * gap0[crossed] / (gap0[crossed] + gap1[crossed])
        inside = (at > bottom[slab[crossed]]) & (at < top[slab[crossed]])
        crossed, at = crossed[inside], at[inside]
        uncertain = np.zeros(len(bottom), bool)
        uncertain[slab[crossed]] = True
        found = _common(slab, first[edge], (x0 + x1) / 2, (top - bottom) * ~uncertain, len(bottom))
        total += np.bincount(of, found, n)
        if not len(crossed):
            break
        # Parts of a slab hold the edges of the slab.
        own = np.flatnonzero(uncertain)
        parent, cut = np.concatenate([own, own, slab[crossed]]), np.concatenate([bottom[own], top[own], at])
        order = np.lexsort((cut, parent))
        parent, cut = parent[order], cut[order]
        keep = (parent[1:] == parent[:-1]) & (cut[1:] > cut[:-1])
        parts = np.bincount(parent[:-1][keep], minlength=len(bottom))
        begin = np.cumsum(parts) - parts
        held = uncertain[slab]
        slab, edge = slab[held], edge[held]
        times = parts[slab]
        slab, edge = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(begin[slab], times), np.repeat(edge, times)
        bottom, top, of = cut[:-1][keep], cut[1:][keep], of[parent[:-1][keep]]
    return total


def _areas_of_batches(batches: Iterator[pa.RecordBatch], names: Sequence[str], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Adds `inter` to batches with flat edges `_ra` and `_rb`, as many rows at a time as have `most` edges in their slabs."""
    for batch in batches:
        ends = [(c.flatten().to_numpy(zero_copy_only=False).reshape(-1, 4), c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) // 4) for c in (batch.column("_ra"), batch.column("_rb"))]
        (ea, na), (eb, nb) = ends
        stop_a, stop_b, cost = np.cumsum(na), np.cumsum(nb), np.cumsum((na + nb) ** 2)
        out, at = np.zeros(batch.num_rows), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + most, side="right")))
            own = lambda e, n, stop, a=at, b=to: (e[stop[a] - n[a] : stop[b - 1]], np.repeat(np.arange(b - a), n[a:b]))
            out[at:to] = common_areas(*own(ea, na, stop_a), *own(eb, nb, stop_b), to - at)
            at = to
        yield pa.RecordBatch.from_arrays([pa.array(out) if c == "inter" else batch.column(c) for c in names], names=list(names))


def shapes(df: DataFrame, key: str, rings: str = "rings", together: int = 4096) -> tuple[DataFrame, DataFrame, bool] | None:
    """(key, rings) of one row for each outline, (key, _part, _ids) of the rows that have it, up to about `together` in a list, and whether any outline has several lists. None where fewer than half of the
    rows share an outline with another. Outlines are told apart by two hashes of 64 bits and the sum of their corners."""
    corners = F.aggregate(F.flatten(rings), F.lit(0.0), lambda s, p: s + p["x"] + 3 * p["y"])
    marks = df.where(F.col(rings).isNotNull()).select(key, rings, F.xxhash64(rings).alias("_a"), F.xxhash64(F.lit("outline"), F.col(rings)).alias("_b"), corners.alias("_c"))
    same = ["_a", "_b", "_c"]
    own = settled(marks.groupBy(*same).agg(F.min(key).alias("_first"), F.min_by(rings, key).alias(rings), F.count(F.lit(1)).alias("_n")))
    # Three numbers reach the driver.
    many, rows, most = own.agg(F.count(F.lit(1)), F.sum("_n"), F.max("_n")).first()
    if not rows or 2 * many > rows:
        return None
    found = marks.select(key, *same).join(own.select("_first", *same, F.ceil(F.col("_n") / together).alias("_parts")), same)
    lists = found.groupBy(F.col("_first").alias(key), F.pmod(F.xxhash64(key), F.col("_parts")).cast("int").alias("_part")).agg(F.collect_list(key).alias("_ids"))
    return own.select(F.col("_first").alias(key), rings), lists, most > together


def overlay(left: DataFrame, right: DataFrame, cell: float, left_id: str = "left_id", right_id: str = "right_id", rings: str = "rings", short: int = 64) -> DataFrame:
    """(left_id, right_id, inter, a_left, a_right) of pairs whose common area is positive. Ids tell rows apart.

    Equal outlines of a side are intersected once, where most of its rows share them. Boxes meet on grid cells. Two polygons that fill their boxes are rectangles, whose common area is an expression. Of
    others, those with up to `short` edges take these along, and the areas of many pairs are summed over slabs together; pairs with longer ones fetch their rings.
    """
    sides = {key: shapes(df, key, rings) for df, key in ((left, left_id), (right, right_id))}
    own = [df if sides[key] is None else sides[key][0] for df, key in ((left, left_id), (right, right_id))]
    found = _overlay(*own, cell, left_id, right_id, rings, short)
    for key, side in sides.items():
        if side is not None:
            _, lists, several = side
            if several:
                parts = lists.groupBy(key).agg((F.max("_part") + 1).alias("_parts"))
                found = found.join(parts, key).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
            # As many tasks as asked for: few bytes of pairs become many rows.
            on, tasks = [key, "_part"] if several else [key], int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            met = found.repartition(tasks, *on).join((lists if several else lists.drop("_part")).repartition(tasks, *on), on)
            found = met.withColumn(key, F.explode("_ids")).select(left_id, right_id, "inter", "a_left", "a_right")
    return found


def _overlay(left: DataFrame, right: DataFrame, cell: float, left_id: str, right_id: str, rings: str, short: int) -> DataFrame:
    # Flat arrays of ends: rings of unlike lengths don't make an array of arrays.
    flat = F.flatten(F.transform(edges(F.col(rings)), lambda e: F.array(e["x1"], e["y1"], e["x2"], e["y2"])))

    def side(df: DataFrame, key: str, p: str, q: str) -> DataFrame:
        boxed = df.select(key, rings, area(F.col(rings)).alias(f"a_{p}"), *[c.alias(n) for n, c in box(F.col(rings)).items()])
        kind = F.when(F.col(f"a_{p}") == (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), 0).when(F.size(F.flatten(rings)) <= short, 1).otherwise(2)
        return boxed.withColumn(f"{q}kind", kind).withColumn(f"_r{q}", F.when(F.col(f"{q}kind") == 1, flat)).drop(rings)

    cells = lambda df, q: _cells(df, cell).withColumnsRenamed({c: f"{q}{c}" for c in ("x0", "y0", "x1", "y1")})
    a, b = cells(side(left, left_id, "left", "a"), "a"), cells(side(right, right_id, "right", "b"), "b")

    # As many tasks as asked for: few bytes of polygons may make many pairs.
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def near(mine: str, theirs: str) -> DataFrame:
        met = a.where(mine).repartition(parts, "_cx", "_cy").join(b.where(theirs).repartition(parts, "_cx", "_cy"), ["_cx", "_cy"]).where("ax0 < bx1 AND bx0 < ax1 AND ay0 < by1 AND by0 < ay1")
        return met.where((F.floor(F.greatest("ax0", "bx0") / cell) == F.col("_cx")) & (F.floor(F.greatest("ay0", "by0") / cell) == F.col("_cy")))

    across = (F.least("ax1", "bx1") - F.greatest("ax0", "bx0")) * (F.least("ay1", "by1") - F.greatest("ay0", "by0"))
    names = [left_id, right_id, "inter", "a_left", "a_right"]

    @F.pandas_udf("double")
    def common(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([common_area(np.reshape(p, (-1, 4)), np.reshape(q, (-1, 4))) for p, q in zip(x, y, strict=True)], dtype=float)

    filled = near("akind = 0", "bkind = 0").withColumn("inter", across).select(names)
    # A rectangle's edges are those of its box.
    whole = lambda q: F.coalesce(f"_r{q}", F.array(*[F.col(f"{q}{c}") for c in ("x0", "y0", "x1", "y0", "x1", "y0", "x1", "y1", "x1", "y1", "x0", "y1", "x0", "y1", "x0", "y0")]))
    brief = near("akind = 1", "bkind < 2").unionByName(near("akind = 0", "bkind = 1")).select(left_id, right_id, "a_left", "a_right", whole("a").alias("_ra"), whole("b").alias("_rb"))
    kinds = left.select(left_id).schema.fields + right.select(right_id).schema.fields + [StructField(c, DoubleType()) for c in names[2:]]
    brief = brief.mapInArrow(lambda batches: _areas_of_batches(batches, names), StructType(kinds))
    long = near("akind = 2", "bkind <= 2").unionByName(near("akind < 2", "bkind = 2")).drop("_ra", "_rb").join(left.select(left_id, flat.alias("_ra")), left_id).join(right.select(right_id, flat.alias("_rb")), right_id)
    return filled.unionByName(brief).unionByName(long.withColumn("inter", common("_ra", "_rb")).select(names)).where("inter > 0")


def zonal_mean(
    pixels: DataFrame, zones: DataFrame, cell: float, zone_id: str = "zone_id", rings: str = "rings", scale: float = 1.0, offset: float = 0.0, nodata: float | None = None, short: int = 64,
    edges_together: int = 1 << 21, places_together: int = 1 << 17, to: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """(zone_id, zonal_mean, n_valid, n_inside) of pixels (x, y, value at centres) inside each zone. Zones without a geometry or without pixels have a NULL mean and
    zero counts.

    Pixels at one place are summed before they meet zones. Zones of up to `short` edges take these to the cells they cover; longer outlines are cut by cells, and a cell's pixels meet
    what crosses it, in groups of up to `edges_together` edges and about `places_together` places. `short` of zero cuts all outlines by cells, so no pair of a place and a zone becomes a row.

    `to` takes x and y and gives struct(x, y), the place in the zones' projection, in which `cell` is given too. A place has one image, so this is exact where outlines brought to the pixels'
    projection are curves that `reprojected` follows within a tolerance.
    """
    good = F.col("value").isNotNull() & ~F.isnan("value") & (F.lit(True) if nodata is None else F.col("value") != nodata)
    places = pixels.groupBy("x", "y").agg(F.sum(F.when(good, F.col("value"))).alias("_s"), F.count_if(good).alias("_v"), F.count(F.lit(1)).alias("_n"))
    if to is not None:
        places = places.withColumn("_to", to(F.col("x"), F.col("y"))).withColumns({"x": F.col("_to")["x"], "y": F.col("_to")["y"]}).drop("_to").where("x IS NOT NULL AND y IS NOT NULL")
    p = places.withColumn("_cx", F.floor(F.col("x") / cell)).withColumn("_cy", F.floor(F.col("y") / cell))
    z = zones.where(F.col(rings).isNotNull()).select(zone_id, edges(F.col(rings)).alias("_e"), *[c.alias(n) for n, c in box(F.col(rings)).items()]).withColumn("_m", F.size("_e"))
    inside = _inside_long(p, z.where(F.col("_m") > short), cell, zone_id, edges_together, places_together)
    if short:
        near = p.join(_cells(z.where(F.col("_m") <= short), cell), ["_cx", "_cy"])
        near = near.where((F.col("x") >= F.col("x0")) & (F.col("x") <= F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") <= F.col("y1")) & contains(F.col("_e"), F.col("x"), F.col("y")))
        inside = near.select(zone_id, "_s", "_v", "_n").unionByName(inside)
    found = inside.groupBy(zone_id).agg(F.sum("_s").alias("_s"), F.sum("_v").alias("_v"), F.sum("_n").alias("_n"))
    mean = F.col("_s") / F.nullif(F.col("_v"), F.lit(0)) * scale + offset
    return zones.select(zone_id).join(found, zone_id, "left").select(zone_id, mean.alias("zonal_mean"), F.coalesce("_v", F.lit(0)).alias("n_valid"), F.coalesce("_n", F.lit(0)).alias("n_inside"))


def _inside_long(places: DataFrame, zones: DataFrame, cell: float, zone_id: str, edges_together: int, places_together: int) -> DataFrame:
    """(zone_id, _s, _v, _n): sums over the places of a cell that are inside, cell by cell, for outlines of many edges."""
    kind = zones.schema[zone_id]
    at = ["_cx", "_cy"]
    # One row per cell: into how many parts its zones and its places are dealt.
    parts = _cells(zones.select("x0", "y0", "x1", "y1", "_m"), cell).groupBy(*at).agg(F.ceil(F.sum("_m") / edges_together).cast("int").alias("_parts"))
    blocks = places.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / places_together).cast("int").alias("_blocks"))
    dealt = settled(parts.join(blocks, at))
    flat = F.flatten(F.transform("_e", lambda e: F.array(e["x1"], e["y1"], e["x2"], e["y2"])))
    schema = StructType([kind, *(StructField(c, LongType()) for c in at), StructField("_near", BinaryType()), StructField("_turns", BinaryType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("_flat")
            for i in range(batch.num_rows):
                made = _pieces(own[i].values.to_numpy(zero_copy_only=False).reshape(-1, 4), cell)
                if made:
                    cx, cy, near, turns = zip(*made, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(zone_id)[i].as_py()] * len(cx), batch.column(zone_id).type), pa.array(cx, pa.int64()), pa.array(cy, pa.int64()), pa.array(near, pa.binary()), pa.array(turns, pa.binary())], names=schema.names)

    pieces = zones.select(zone_id, flat.alias("_flat")).mapInArrow(cut, schema).join(dealt, at).withColumn("_part", F.pmod(F.xxhash64(zone_id), F.col("_parts")).cast("int"))
    pieces = pieces.withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_parts", "_blocks")
    there = places.join(dealt, at).withColumn("_block", F.pmod(F.xxhash64("x", "y"), F.col("_blocks")).cast("int")).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts", "_blocks")

    def met(own: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        there = there.sort_values("y", kind="stable")
        x, y = there["x"].to_numpy(float), there["y"].to_numpy(float)
        sums = np.column_stack([there["_s"].fillna(0.0), there["_v"], there["_n"]]).astype(float)
        rows = []
        for key, near, turns in zip(own[zone_id], own["_near"], own["_turns"], strict=True) if len(x) else ():
            e = np.frombuffer(near).reshape(-1, 4)
            lo, hi = (np.searchsorted(y, f(e[:, 1], e[:, 3])) for f in (np.minimum, np.maximum))
            n = hi - lo
            edge = np.repeat(np.arange(len(e)), n)
            place = np.arange(len(edge)) - np.repeat(np.cumsum(n) - n, n) + lo[edge]
            x1, y1, x2, y2 = e[edge].T
            beyond = x[place] < (x2 - x1) * (y[place] - y1) / (y2 - y1) + x1
            odd = (np.bincount(place[beyond], minlength=len(x)) + np.searchsorted(np.frombuffer(turns), y, side="right")) % 2 == 1
            if odd.any():
                rows.append((key, *sums[odd].sum(axis=0)))
        found = pd.DataFrame(rows, columns=[zone_id, "_s", "_v", "_n"])
        return found.astype({"_v": np.int64, "_n": np.int64})

    keys = [*at, "_part", "_block"]
    return pieces.groupBy(*keys).cogroup(there.groupBy(*keys)).applyInPandas(met, StructType([kind, StructField("_s", DoubleType()), StructField("_v", LongType()), StructField("_n", LongType())]))


def _pieces(e: np.ndarray, cell: float) -> list[tuple[int, int, bytes, bytes]]:
    """(cell x, cell y, edges near the cell, heights) of an outline. Edges to the left of a cell are crossed by no line to the right; of those beyond it only the heights where they begin and end count,
    and heights that come twice cancel, so a chain of edges leaves two."""
    e = e[(e[:, 1] != e[:, 3]) & np.isfinite(e).all(axis=1)]
    if not len(e):
        return []
    x0, x1, y0, y1 = (f(e[:, i], e[:, i + 2]) for i in (0, 1) for f in (np.minimum, np.maximum))
    slack = 1e-9 * (1 + np.abs(e).max())
    out = []
    for cy in range(int(np.floor(y0.min() / cell)), int(np.floor(y1.max() / cell)) + 1):
        row = np.flatnonzero((y1 >= cy * cell - slack) & (y0 <= (cy + 1) * cell + slack))
        for cx in range(int(np.floor(x0.min() / cell)), int(np.floor(x1.max() / cell)) + 1):
            past = x0[row] > (cx + 1) * cell + slack
            near = row[~past & (x1[row] >= cx * cell - slack)]
            ends, times = np.unique(np.concatenate([y0[row[past]], y1[row[past]]]), return_counts=True)
            turns = ends[times % 2 == 1]
            if len(near) or len(turns):
                out.append((cx, cy, e[near].tobytes(), turns.tobytes()))
    return out


def reprojected(rings: Column, to: Callable[[Column, Column], Column], tolerance: float, most: int = 4096) -> Column:
    """Rings in another projection; `to` takes x and y and gives struct(x, y). A straight edge becomes a curve: each is cut into as many equal pieces as bring it within `tolerance` of
    its chords, by how far its middle leaves the chord (the distance falls with the square of the number of pieces), `most` at most."""

    def pieces(r: Column) -> Column:
        def edge(p: Column, i: Column) -> Column:
            q = F.element_at(r, F.when(i + 2 > F.size(r), 1).otherwise(i + 2))
            a, b, mid = to(p["x"], p["y"]), to(q["x"], q["y"]), to((p["x"] + q["x"]) / 2, (p["y"] + q["y"]) / 2)
            off = F.hypot(mid["x"] - (a["x"] + b["x"]) / 2, mid["y"] - (a["y"] + b["y"]) / 2)
            count = F.least(F.lit(most), F.greatest(F.lit(1), F.ceil(F.sqrt(off / tolerance)).cast("int")))
            return F.struct(p["x"].alias("x"), p["y"].alias("y"), (q["x"] - p["x"]).alias("dx"), (q["y"] - p["y"]).alias("dy"), F.coalesce(count, F.lit(1)).alias("m"))

        return F.transform(r, edge)

    def cut(e: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), e["m"] - 1), lambda k: to(e["x"] + e["dx"] * k / e["m"], e["y"] + e["dy"] * k / e["m"]))

    return F.transform(rings, lambda r: F.flatten(F.transform(pieces(r), cut)))


def compatibility(pixels: DataFrame, zones: DataFrame, zonal: DataFrame, rings: str = "rings", enough: int = 9) -> DataFrame:
    """One row: whether the boxes of pixels and zones overlap, zones with any valid pixel, and the share with enough."""
    b = box(F.col(rings))
    zb = zones.agg(F.min(b["x0"]).alias("x0"), F.min(b["y0"]).alias("y0"), F.max(b["x1"]).alias("x1"), F.max(b["y1"]).alias("y1"))
    pb = pixels.agg(F.min("x").alias("px0"), F.min("y").alias("py0"), F.max("x").alias("px1"), F.max("y").alias("py1"))
    n = zonal.agg(F.count(F.lit(1)).alias("n_zones"), F.count_if(F.col("n_valid") > 0).alias("n_with_any"), F.avg((F.col("n_valid") >= enough).cast("double")).alias("share_enough"))
    return zb.join(F.broadcast(pb)).join(F.broadcast(n)).select(F.expr("x0 <= px1 AND px0 <= x1 AND y0 <= py1 AND py0 <= y1").alias("bbox_overlap"), "n_zones", "n_with_any", "share_enough")


def rings_of_wkb(blob: bytes) -> list[list[tuple[float, float]]]:
    """Rings of a WKB polygon or multipolygon."""
    import struct

    at = 0

    def take(fmt: str):
        nonlocal at
        order = "<" if blob[start] else ">"
        values = struct.unpack_from(order + fmt, blob, at)
        at += struct.calcsize(order + fmt)
        return values

    def polygon() -> list:
        out = []
        for _ in range(take("I")[0]):
            n = take("I")[0]
            flat = np.array(take(f"{2 * n}d")).reshape(n, 2)
            pts = [tuple(map(float, p)) for p in flat]
            out.append(pts[:-1] if len(pts) > 1 and pts[0] == pts[-1] else pts)
        return out

    start, rings = 0, []
    at = 1
    kind = take("I")[0] % 1000
    if kind == 3:
        return polygon()
    if kind != 6:
        raise ValueError(f"geometry type {kind} is not a polygon")
    for _ in range(take("I")[0]):
        start = at
        at += 1
        take("I")
        rings += polygon()
    return rings


def wkb_rings(wkb: str = "wkb") -> Column:
    """Rings of a WKB column."""

    @F.pandas_udf(RINGS)
    def decoded(blobs: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else [[{"x": x, "y": y} for x, y in ring] for ring in rings_of_wkb(bytes(b))] for b in blobs])

    return decoded(wkb)
