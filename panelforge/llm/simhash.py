"""SimHash near-duplicates by tiled exact comparison.

Fingerprints (64 bits over word shingles) are compared exactly: sorted into tiles by the bit counts of their four 16-bit quarters, tile
pairs whose counts differ by more than the radius are skipped (the sum over quarters of the least difference bounds
the Hamming distance from below, and so does that of the whole count), and the rest are compared by numpy exclusive-or and bit counts.

Scale: only distinct fingerprints are compared, so exact copies collapse first. They are dealt into groups by the same bit counts, each pair
of groups that can hold a link is one task, and a task returns a spanning forest of the links it found (fewer rows than it has
fingerprints), never all pairs. Components of the forests are found by star contraction.

Defined cases: null and empty texts, and texts without words, have fingerprint zero, linked like any other; fewer words than a shingle
make one shingle of the whole sequence; repeated rows share their class; a table without rows gives none; only the key
and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm._base import batches, release, salted_partitions, store, utf8
from panelforge.llm.components import connected_components
from panelforge.operators.ordering import join_counted

#: Bytes of `[\x20\x09-\x0D]`, which separate words.
SPACES = b" \t\n\v\f\r"
_TO_SPACE = bytes.maketrans(SPACES, b" " * len(SPACES))
TILE = 1024


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    words = text.lower().translate(_TO_SPACE).split()
    if not words:
        return 0
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    else:
        joined = b" ".join(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=False)]
    n = len(hashes)
    octets = np.array(hashes, dtype=np.uint64).astype("<u8").view(np.uint8).reshape(n, 8)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        counts += np.unpackbits(octets[at : at + (1 << 14)], axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """(key, fp): fp is the fingerprint as a signed long."""

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(arrow, text):
            marks = np.array([fingerprint(x, width) for x in utf8(batch.column(text))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(marks.view(np.int64))], names=[key, "fp"])

    return docs.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, f"{key} long, fp long")


def _features(marks: np.ndarray) -> np.ndarray:
    return np.bitwise_count(np.ascontiguousarray(marks).view("<u2").reshape(len(marks), 4)).astype(np.int16)


def _tiles(marks: np.ndarray) -> list[np.ndarray]:
    """Indices of tiles that are compact in the bit counts of the quarters, by halving along the widest one."""
    counts, done, todo = _features(marks), [], [np.arange(len(marks))]
    while todo:
        at = todo.pop()
        if len(at) <= TILE:
            if len(at):
                done.append(at)
            continue
        own = counts[at]
        axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
        order = np.argsort(own[:, axis], kind="stable")
        half = len(at) // 2
        todo += [at[order[:half]], at[order[half:]]]
    return done


class _Forest:
    """Union by smallest label over indices 0..n-1, in whole arrays."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while True:
            s = self.up[r]
            if np.array_equal(r, s):
                return r
            r = s

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.up, np.maximum(ra, rb), np.minimum(ra, rb))


def forest_of_links(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fingerprint, root fingerprint) of a spanning forest of all pairs within `radius`; within `left` alone
    where `right` is None, else of pairs across."""
    marks = left if right is None else np.concatenate([left, right])
    a = _tiles(left)
    b = a if right is None else [x + len(left) for x in _tiles(right)]
    if not a or not b:
        return marks[:0], marks[:0]
    counts = _features(marks)
    bounds = lambda tiles: (np.array([counts[t].min(axis=0) for t in tiles]), np.array([counts[t].max(axis=0) for t in tiles]))
    whole = lambda tiles: (np.array([counts[t].sum(axis=1).min() for t in tiles]), np.array([counts[t].sum(axis=1).max() for t in tiles]))
    (alo, ahi), (blo, bhi), (wa, wA), (wb, wB) = bounds(a), bounds(b), whole(a), whole(b)
    forest = _Forest(len(marks))
    for i, t in enumerate(a):
        gap = np.maximum(0, np.maximum(alo[i] - bhi, blo - ahi[i])).sum(axis=1)
        near = (gap <= radius) & (wa[i] - wB <= radius) & (wb - wA[i] <= radius)
        if right is None:
            near[:i] = False
        mine = marks[t]
        for j in np.flatnonzero(near):
            u = b[j]
            hit = np.bitwise_count(mine[:, None] ^ marks[u][None, :]) <= radius
            if hit.any():
                x, y = np.nonzero(hit)
                forest.link(t[x], u[y])
    roots = forest.roots(np.arange(len(marks)))
    moved = roots != np.arange(len(marks))
    return marks[moved], marks[roots[moved]]


def _quarters(fp: Column) -> Column:
    """The bit counts of the four 16-bit quarters as one number below 17**4."""
    counts = [F.bit_count(F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF))) for i in range(4)]
    return reduce(lambda a, b: a * 17 + b, counts).cast("int")


def deal(cells: np.ndarray, counts: np.ndarray, group_rows: int, radius: int) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """Cells (numbers of `_quarters`, with their fingerprints counted) to groups of about `group_rows` at most: per cell its first group and how many it is dealt over, and
    per group the later groups, itself included, that are within the radius by the bit counts."""
    at = np.stack([cells // 17**k % 17 for k in (3, 2, 1, 0)], axis=1).astype(np.int64)
    first, parts = np.zeros(len(cells), np.int64), np.ones(len(cells), np.int64)
    lows, highs, todo = [], [], [np.arange(len(cells))] if len(cells) else []
    while todo:
        own = todo.pop()
        total = counts[own].sum()
        if total > group_rows and len(own) > 1:
            axis = int(np.argmax(at[own].max(axis=0) - at[own].min(axis=0)))
            order = own[np.argsort(at[own, axis], kind="stable")]
            cut = int(np.clip(np.searchsorted(np.cumsum(counts[order]), total / 2), 1, len(order) - 1))
            todo += [order[:cut], order[cut:]]
            continue
        first[own], parts[own] = len(lows), -(-total // group_rows)
        for _ in range(int(parts[own[0]])):
            lows.append(at[own].min(axis=0))
            highs.append(at[own].max(axis=0))
    low, high = np.array(lows).reshape(-1, 4), np.array(highs).reshape(-1, 4)
    near = [(i + np.flatnonzero(np.maximum(0, np.maximum(low[i] - high[i:], low[i:] - high[i])).sum(axis=1) <= radius)).tolist() for i in range(len(low))]
    return first, parts, near


def near_links(marks: DataFrame, radius: int = 4, group_rows: int | None = None) -> DataFrame:
    """(u, v): a spanning forest's edges per task over the distinct fingerprints of `marks` (column fp).

    Fingerprints are dealt to groups that are compact in the bit counts of their quarters. A histogram of these counts, which has 17**4 rows at most, tells the groups, and which pairs of them can
    hold a link; each such pair is one task. Groups grow with the table between 2**14 and 2**18 rows, so a task's work is bounded.
    """
    spark = marks.sparkSession
    seen = marks.select("fp", _quarters(F.col("fp")).alias("cell"))
    histogram = np.array([tuple(r) for r in seen.groupBy("cell").count().orderBy("cell").collect()], np.int64).reshape(-1, 2)
    rows = int(histogram[:, 1].sum())
    # At least as many groups as occupy the tasks, for small tables.
    groups = max(4, int(np.ceil(np.sqrt(2 * salted_partitions(spark)))))
    most = group_rows or min(1 << 18, max(1 << 14, rows // 64))
    first, parts, near = deal(histogram[:, 0], histogram[:, 1], max(1, min(most, -(-rows // groups))), radius)
    partners = [[] for _ in near]
    for i, others in enumerate(near):
        for j in others:
            partners[i].append((i, j))
            if i != j:
                partners[j].append((i, j))
    table = spark.createDataFrame([(int(c), int(f), int(n)) for c, f, n in zip(histogram[:, 0], first, parts, strict=True)], "cell int, first int, parts int")
    # Both tables are bounded by the histogram and the number of groups.
    pairs = spark.createDataFrame([(g, own) for g, own in enumerate(partners)], "g int, cells array<struct<i:int,j:int>>")
    spread = seen.join(F.broadcast(table), "cell").select("fp", (F.col("first") + F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts"))).cast("int").alias("g"))
    cells = spread.join(F.broadcast(pairs), "g").select("fp", "g", F.explode("cells").alias("c")).select("fp", "g", "c.i", "c.j")

    def run(_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        own = pdf["fp"].to_numpy(np.int64).view(np.uint64)
        in_i = pdf["g"].to_numpy() == i
        u, v = forest_of_links(np.sort(own[in_i]), None if i == j else np.sort(own[~in_i]), radius)
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    return cells.groupBy("i", "j").applyInPandas(run, "u long, v long")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """One row per document: key, fingerprint (16 hex digits) and component_id, the smallest key of its class."""
    marked = store(fingerprints(docs, key, text, width), "fingerprints")
    distinct = store(marked.groupBy("fp").agg(F.min(key).alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
    links = store(near_links(distinct, radius), "near")
    joined = connected_components(links)
    classed = distinct.join(joined.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # Classes of one fingerprint keep their own least key; only the rest meet by root, pre-aggregated.
    least = joined.join(distinct.withColumnRenamed("fp", "node"), "node").groupBy("root").agg(F.min("least").alias("component_id"))
    named = classed.join(least, "root", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), "n")
    return join_counted(marked, named, ["fp"], "n").select(key, hex_of(F.col("fp")).alias("fingerprint"), "component_id")


# ------------------------------------------------------------------ similarity of word shingles, by wide fingerprints and an exact check


def _shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of every shingle; none for a text without words."""
    words = text.lower().translate(_TO_SPACE).split()
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)] if words else [], np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip((ends - lengths).tolist(), ends[width - 1 :].tolist(), strict=False)], np.uint64)


def wide_fingerprint(hashes: np.ndarray, words: int) -> bytes:
    """SimHash of `words` times 64 bits over distinct shingles; further words are mixed from the shingle's hash."""
    n = len(hashes)
    if not n:
        return bytes(8 * words)
    counts = np.zeros(64 * words, np.int64)
    more = [np.uint64((0x9E3779B97F4A7C15 * (k + 1)) % 2**64) for k in range(words)]
    for at in range(0, n, 1 << 12):
        own = hashes[at : at + (1 << 12)]
        grid = np.empty((len(own), words), np.uint64)
        for k in range(words):
            x = own if k == 0 else (own ^ more[k]) * np.uint64(0xBF58476D1CE4E5B9)
            grid[:, k] = x if k == 0 else (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        counts += np.unpackbits(grid.astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * counts > n, bitorder="little").tobytes()


def reach_of(similarity: float, bits: int, sigmas: float) -> int:
    """Hamming distance that pairs of that Jaccard similarity stay within, up to `sigmas` deviations: bits differ with the angle between
    shingle sets of equal size."""
    p = float(np.arccos(min(1.0, 2 * similarity / (1 + similarity))) / np.pi)
    return int(np.ceil(bits * p + sigmas * np.sqrt(bits * p * (1 - p))))


class PairForest(_Forest):
    """Keeps, of the pairs it is given, those that joined two trees."""

    def __init__(self, n: int):
        super().__init__(n)
        self.kept: list[tuple[np.ndarray, np.ndarray]] = []

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            apart = np.flatnonzero(ra != rb)
            if not len(apart):
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            hook, first = np.unique(np.maximum(ra, rb), return_index=True)
            self.up[hook] = np.minimum(ra, rb)[first]
            self.kept.append((a[first], b[first]))


def _pairs(left: np.ndarray, right: np.ndarray | None, near: int, reach: int, rows: int = 128) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Indices (into left, then right) and distances of all pairs within `reach`, block by block; within `left` alone where `right` is None (some in both
    orders), else across. Fingerprints are rows of 64-bit words; the first word alone sorts out pairs beyond `near`."""
    marks = left if right is None else np.concatenate([left, right])
    if not len(left) or (right is not None and not len(right)):
        return
    head = np.ascontiguousarray(marks[:, 0])
    a = _tiles(np.ascontiguousarray(left[:, 0]))
    b = a if right is None else [x + len(left) for x in _tiles(np.ascontiguousarray(right[:, 0]))]
    counts = np.bitwise_count(head).astype(np.int64)
    for i, t in enumerate(a):
        for u in b[i:] if right is None else b:
            if counts[t].min() - counts[u].max() > near or counts[u].min() - counts[t].max() > near:
                continue
            hit = np.bitwise_count(head[t][:, None] ^ head[u][None, :]) <= near
            for at in range(0, len(t), rows):
                x, y = np.nonzero(hit[at : at + rows])
                x, y = t[x + at], u[y]
                keep = x != y
                x, y = x[keep], y[keep]
                if not len(x):
                    continue
                distance = np.bitwise_count(marks[x] ^ marks[y]).sum(axis=1, dtype=np.int64)
                keep = distance <= reach
                if keep.any():
                    yield x[keep], y[keep], distance[keep]


class _Later:
    """Pairs of several levels (closer first), of which only `forests` nested spanning forests are kept: each holds no pair of those before it, and prefers closer levels. Whenever there are
    many, they are cut down to these; a pair whose ends the last forest connects already, at its level or below, can't be in any, and isn't taken."""

    def __init__(self, n: int, levels: int, forests: int):
        self.n, self.levels, self.forests = n, levels, forests
        self.most = max(1 << 18, 4 * forests * n)
        self.pairs: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(levels)]
        self.held, self.kept = 0, []
        self.last: list[_Forest] | None = None

    def add(self, level: int, x: np.ndarray, y: np.ndarray, close: np.ndarray) -> None:
        if self.last is not None and len(x):
            new = self.last[level].roots(x) != self.last[level].roots(y)
            x, y = x[new], y[new]
        if len(x):
            self.pairs[level].append((x.astype(np.int32), y.astype(np.int32)))
            self.held += len(x)
        if self.held > self.most:
            self.settle(close)

    def settle(self, close: np.ndarray) -> None:
        """`close`: the forest of pairs that are closer than any level; no pair inside one of its trees is kept."""
        left = [[(x.astype(np.int64), y.astype(np.int64)) for x, y in own] for own in self.pairs]
        self.kept, self.last = [[] for _ in range(self.levels)], None
        for _ in range(self.forests):
            forest, tops, taken = PairForest(self.n), [], []
            forest.up = close.copy()
            for level, own in enumerate(left):
                forest.kept = []
                for x, y in own:
                    forest.link(x, y)
                self.kept[level] += forest.kept
                taken += [x * self.n + y for x, y in forest.kept]
                top = _Forest(self.n)
                top.up = forest.up.copy()
                tops.append(top)
            self.last = tops
            if not taken:
                break
            gone = np.concatenate(taken)
            left = [[(x[free], y[free]) for x, y in own for free in (~np.isin(x * self.n + y, gone),)] for own in left]
        self.pairs = [[(x.astype(np.int32), y.astype(np.int32)) for x, y in own] for own in self.kept]
        self.held = sum(len(x) for own in self.pairs for x, _ in own)


def forest_of_pairs(left: np.ndarray, right: np.ndarray | None, near: int, reaches: tuple[int, ...], spare: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Indices (into left, then right) of pairs that make a spanning forest of all pairs within the last reach, closer ones
    first, and `spare` further forests of other pairs beyond the first reach, in case some of the first fail a later check. Every fingerprint that has a pair is in one of those returned. What is held
    follows the number of fingerprints, not of pairs."""
    n = len(left) + (0 if right is None else len(right))
    forest, later = PairForest(n), _Later(n, len(reaches) - 1, spare + 1)
    for x, y, distance in _pairs(left, right, near, reaches[-1]):
        forest.link(x[distance <= reaches[0]], y[distance <= reaches[0]])
        for level, (lo, hi) in enumerate(zip(reaches, reaches[1:], strict=False)):
            own = (distance > lo) & (distance <= hi)
            later.add(level, x[own], y[own], forest.up)
    later.settle(forest.up)
    kept = [*forest.kept, *(pair for own in later.kept for pair in own)]
    if not kept:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([x for x, _ in kept]), np.concatenate([y for _, y in kept])


def open_documents(left: np.ndarray, right: np.ndarray | None, near: int, reach: int, roots: np.ndarray) -> np.ndarray:
    """Indices of the fingerprints that have a pair within `reach` whose `roots` differ."""
    found = np.zeros(len(roots), bool)
    for x, y, _ in _pairs(left, right, near, reach):
        apart = roots[x] != roots[y]
        found[x[apart]] = True
        found[y[apart]] = True
    return np.flatnonzero(found)


def joining_pairs(left: np.ndarray, right: np.ndarray | None, near: int, reach: int, roots: np.ndarray, sets: list[np.ndarray], similarity: float, at_once: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within `reach` whose distinct `sets` have that similarity, as far as they join trees that `roots` and earlier pairs leave apart. All other
    pairs within reach are checked as well."""
    n = len(sets)
    size = np.fromiter(map(len, sets), np.int64, n)
    ends = np.cumsum(size)
    values, ids = np.unique(np.concatenate([*sets, np.empty(0, np.uint32)]), return_inverse=True)
    ids = [ids[e - k : e].astype(np.int32) for e, k in zip(ends.tolist(), size.tolist(), strict=True)]
    forest, mine = PairForest(n), np.zeros(len(values), bool)
    _, first, which = np.unique(roots, return_index=True, return_inverse=True)
    forest.up = first[which]
    for x, y, _ in _pairs(left, right, near, reach):
        few, many = np.minimum(size[x], size[y]), np.maximum(size[x], size[y])
        keep = (few > 0) & (few >= similarity * many) & (forest.roots(x) != forest.roots(y))
        x, y = x[keep], y[keep]
        order = np.argsort(x, kind="stable")
        x, y = x[order], y[order]
        own, start = np.unique(x, return_index=True)
        for v, ys in zip(own.tolist(), np.split(y, start[1:]), strict=True) if len(own) else ():
            ys = ys[forest.roots(ys) != forest.roots(np.array([v]))]
            mine[ids[v]] = True
            for some in np.split(ys, np.flatnonzero(np.diff(np.cumsum(size[ys]) // at_once)) + 1) if len(ys) else ():
                starts = np.cumsum(size[some]) - size[some]
                common = np.add.reduceat(mine[np.concatenate([ids[w] for w in some])], starts, dtype=np.int64)
                good = some[common >= similarity * (size[v] + size[some] - common)]
                forest.link(np.full(len(good), v), good)
            mine[ids[v]] = False
    if not forest.kept:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([x for x, _ in forest.kept]), np.concatenate([y for _, y in forest.kept])


def _cells(rows: DataFrame, groups: int) -> DataFrame:
    """`rows` (with fp) once for each pair i <= j of groups that holds their group g."""
    g = F.pmod(F.xxhash64("fp"), F.lit(groups)).cast("int")
    return rows.withColumn("g", g).withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("i", F.least("g", "h")).withColumn("j", F.greatest("g", "h")).drop("h")


def similar_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8, words: int = 8, group_rows: int = 1 << 17, set_bytes: int = 1 << 24) -> DataFrame:
    """One row per document with a key: key and component_id, the smallest key of its group. Documents are linked if their sets of word shingles have a Jaccard similarity
    of `similarity` or more.

    Candidates come from the tiled comparison of wide fingerprints, with a reach that keeps nearly all similar pairs; each task returns a few spanning forests of its
    candidates, closest first, and each of their edges is checked exactly on the shingle sets (as 32-bit hashes), so no documents are grouped without a similar
    pair. Documents that still have a candidate in another group are then dealt out with their shingle sets, and all such candidates are checked. Texts of equal fingerprints are one group. Texts without words make one group. Rows with a null key are left out.
    """
    spark = docs.sparkSession
    bits = 64 * words

    def mark(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(arrow, text):
            marks = [wide_fingerprint(np.unique(_shingle_hashes(x, width)), words) for x in utf8(batch.column(text))]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(marks, pa.binary())], names=[key, "fp"])

    keyed = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias(key), text)
    marked = store(keyed.mapInArrow(mark, f"{key} long, fp binary"), "wide-fingerprints")
    distinct = store(marked.groupBy("fp").agg(F.min(key).alias("node"), F.count(F.lit(1)).alias("n")), "wide-distinct")
    rows = distinct.count()
    groups = max(4, int(np.ceil(np.sqrt(2 * salted_partitions(spark)))), -(-rows // group_rows))
    near, reaches = reach_of(similarity, 64, 3.6), tuple(reach_of(s, bits, z) for s, z in ((0.9, 0.0), (similarity, 0.0), (similarity, 3.3)))

    def sides(pdf: pd.DataFrame) -> tuple:
        """The order of rows, by group and node so that a retry gives the same, and the fingerprints of both groups."""
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        release()
        marks = np.frombuffer(b"".join(pdf["fp"]), "<u8").reshape(len(pdf), words)
        node, own = pdf["node"].to_numpy(np.int64), pdf["g"].to_numpy() == i
        a, b = (x[np.argsort(node[x], kind="stable")] for x in (np.flatnonzero(own), np.flatnonzero(~own)))
        return np.concatenate([a, b]), marks[a], None if i == j else marks[b]

    def compare(_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        order, left, right = sides(pdf)
        u, v = forest_of_pairs(left, right, near, reaches)
        names = pdf["node"].to_numpy(np.int64)[order]
        return pd.DataFrame({"u": names[u], "v": names[v]})

    pairs = store(_cells(distinct.select("fp", "node"), groups).groupBy("i", "j").applyInPandas(compare, "u long, v long"), "candidates")
    # A table of known size: Spark broadcasts it while it is small, and else shuffles the texts.
    ends = store(pairs.select(F.explode(F.array("u", "v")).alias(key)).distinct(), "ends")

    def shingle(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(arrow, text):
            sets = [np.unique((_shingle_hashes(x, width) >> np.uint64(32)).astype(np.uint32)).tobytes() for x in utf8(batch.column(text))]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(sets, pa.binary())], names=[key, "s"])

    # A key may repeat with another text: the one whose fingerprint made the node isn't known here, so any of its texts may vouch.
    sets = store(keyed.join(ends, key, "left_semi").mapInArrow(shingle, f"{key} long, s binary"), "shingles")

    def verify(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            good = []
            for a, b in zip(batch.column("su").to_pylist(), batch.column("sv").to_pylist(), strict=True):
                x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(common >= similarity * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(sets.select(F.col(key).alias("u"), F.col("s").alias("su")), "u").join(sets.select(F.col(key).alias("v"), F.col("s").alias("sv")), "v")
    links = store(both.select("u", "v", "su", "sv").mapInArrow(verify, "u long, v long"), "similar")
    joined = connected_components(links)

    # The forests leave out pairs, so those between groups are looked at again. All documents that have a candidate are among the ends.
    def look(_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        order, left, right = sides(pdf)
        found = open_documents(left, right, near, reaches[-1], pdf["root"].to_numpy(np.int64)[order])
        return pd.DataFrame({"node": pdf["node"].to_numpy(np.int64)[order][found]})

    def settle(_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        order, left, right = sides(pdf)
        s = pdf["s"].to_numpy()
        u, v = joining_pairs(left, right, near, reaches[-1], pdf["root"].to_numpy(np.int64)[order], [np.frombuffer(s[k], np.uint32) for k in order], similarity)
        names = pdf["root"].to_numpy(np.int64)[order]
        return pd.DataFrame({"u": names[u], "v": names[v]})

    rooted = distinct.join(ends.withColumnRenamed(key, "node"), "node", "left_semi").join(joined.select("node", "root"), "node", "left").select("fp", "node", F.coalesce("root", "node").alias("root"))
    rooted = store(rooted, "rooted")
    unsettled = store(_cells(rooted, groups).groupBy("i", "j").applyInPandas(look, "node long").distinct(), "unsettled")
    held = store(rooted.join(unsettled, "node", "left_semi").join(sets.select(F.col(key).alias("node"), "s").distinct(), "node"), "held")
    octets = held.agg(F.sum(F.length("s"))).first()[0] or 0
    parts = max(4, int(np.ceil(np.sqrt(2 * salted_partitions(spark)))), -(-octets // set_bytes))
    further = store(_cells(held, parts).groupBy("i", "j").applyInPandas(settle, "u long, v long"), "further")
    joined = connected_components(links.unionByName(further))
    named = distinct.join(joined.select("node", "root"), "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"), "n")
    return join_counted(marked, named, ["fp"], "n").select(key, "component_id")


def representatives(docs: DataFrame, classed: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of `docs` that stand for their class: the one with the smallest key, one row of those that repeat it. Rows with a null key have no
    class and stay.

    Only the keys that go, and those that repeat, are joined to the texts. They are tables of known size, so Spark sends them to the texts while they are under its
    broadcast threshold, and shuffles both sides beyond it.
    """
    head = (F.col(key) == F.col("component_id")).cast("int")
    odd = store(classed.groupBy(key).agg(F.max(head).alias("_head"), F.count(F.lit(1)).alias("_n")).where("_head = 0 OR _n > 1"), "odd")
    left = docs.join(odd.where("_head = 0").select(key), key, "left_anti")
    twice = odd.where("_head = 1").select(key)
    if twice.isEmpty():
        return left.select(docs.columns)
    once = left.join(twice, key, "left_anti").select(docs.columns)
    return once.unionByName(left.join(twice, key, "left_semi").dropDuplicates([key]).select(docs.columns))
