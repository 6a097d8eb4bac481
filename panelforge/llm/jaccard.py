"""Similarity join of texts on sets of word shingles, exact, by prefixes under several global token orders.

Two sets of a Jaccard similarity of t or more share a token in their prefixes under every order of all tokens, where a set's prefix is its first
n - ceil(t * n) + 1 tokens. Three orders are used: by frequency, by hash, and by coarse frequency with another hash. All begin with the tokens
that one set alone holds, so these need not be kept: a set in which they fill the prefix has no partner. Candidates share a prefix token
under the first order; where both sets are at hand, those that share none under the second and third go before the overlap is counted.

Scale: tokens meet in buckets by hash, packed, six bytes and the place in their block each, and only those that several sets hold come back to their block. Tokens that
many sets of one block hold are counted per block and dealt by token and block, so no bucket gets a frequent token's sets. Equal sets collapse by their digest. Copies
are joined by stars to a few centres per token first. What tokens still connect then is a family: its sets travel to tasks of bounded size, in pairs of stripes if they are
many, where all pairs that are still apart are looked at; no table of pairs is made, and no document or token is a hot key. The work on one
family grows with the square of its documents that stay apart, over as many tasks.

Defined cases: null texts and texts without words have the empty set, are linked with nothing and keep their own key; fewer words than a shingle make
one shingle of the whole sequence; rows that repeat are linked; a null key links others but names no component (null where all keys are); a
table without rows gives none; only the key and the text are read. Tokens are 64-bit hashes of shingles, sets 128-bit digests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm._base import batches, importable, release, salted_partitions, store, utf8
from panelforge.llm.components import connected_components
from panelforge.llm.simhash import PairForest, _shingle_hashes
from panelforge.operators.ordering import join_counted

#: Bytes of text whose tokens make one bucket, and bytes of one block of texts.
BUCKET_BYTES, BLOCK_BYTES = 32 << 20, 12 << 20
#: Rows of one token that a bucket may get from all blocks.
TOKEN_ROWS = 1 << 22
#: Edges that one task of a round of components writes.
EDGES = 100_000
#: Rows of `_cut` and `_counted`: tokens with their sets, totals of frequent tokens, frequent tokens with their sets, and documents.
TOKENS, TOTALS, SPREAD, DOCUMENTS = range(4)
_DIGEST = np.dtype("V16")
_CUT = "kind byte, target int, block long, a binary, b binary, c binary, d binary"
_COUNTED = "kind byte, block long, token long, level int, a binary, b binary, c binary, d binary"
_HELD = "block long, a binary, b binary, c binary, d binary"


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """Tokens that a set of n must share with any similar set."""
    return -(-percent * n // 100)


def canonical(token: np.ndarray, buckets: int) -> np.ndarray:
    """Tokens as a multiple of the number of buckets below 2**48, plus the bucket: within a bucket six bytes tell them apart. From 2**16 buckets on all 64 bits stay."""
    b = np.uint64(buckets)
    return (token // b & np.uint64((1 << 48) - 1)) * b + token % b


def six_bytes(x: np.ndarray) -> bytes:
    return (x & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (x >> np.uint64(32)).astype("<u2").tobytes()


def from_six_bytes(raw: bytes) -> np.ndarray:
    n = len(raw) // 6
    return np.frombuffer(raw, "<u4", n).astype(np.uint64) | np.frombuffer(raw, "<u2", n, 4 * n).astype(np.uint64) << np.uint64(32)


def _runs(x: np.ndarray) -> Iterator[slice]:
    """Slices of equal neighbours."""
    ends = np.flatnonzero(x[1:] != x[:-1]) + 1 if len(x) else []
    return (slice(a, b) for a, b in zip([0, *ends], [*ends, len(x)], strict=True) if b > a)


def _cut(width: int, buckets: int, text: str, frequent: int):
    """Blocks of texts to rows of _CUT: their tokens dealt to buckets, with the place of their set in the block; those that `frequent` sets of the block hold are dealt by token and block, and
    only counted in their bucket. A block is named by its contents, so a retry names it alike."""

    def rows(keys: pa.Array, texts: list[bytes]) -> Iterator[tuple]:
        sets = [canonical(_shingle_hashes(x, width), buckets) for x in texts]
        sets = [np.unique(x) for x in sets]
        digests = b"".join(xxhash.xxh3_128_digest(x.tobytes()) if len(x) else bytes(16) for x in sets)
        size = np.fromiter(map(len, sets), np.int64, len(sets))
        known = np.array(keys.is_valid(), bool)
        names = keys.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
        block = int(np.int64(xxhash.xxh64_intdigest(digests + names.tobytes()) - (1 << 63)))
        yield DOCUMENTS, block % buckets, block, digests, size.astype("<u4").tobytes(), names.tobytes(), known.tobytes()
        # Equal sets of a block are one.
        _, first = np.unique(np.frombuffer(digests, "<u8").reshape(-1, 2), axis=0, return_index=True)
        first = np.sort(first[size[first] > 0])
        if not len(first):
            return
        token, place = np.concatenate([sets[k] for k in first]), np.repeat(first, size[first]).astype("<u2")
        del sets
        order = np.argsort(token % np.uint64(buckets), kind="stable")
        token, place = token[order], place[order]
        home = (token % np.uint64(buckets)).astype(np.int64)
        often = np.zeros(len(token), bool)
        if len(first) >= frequent:
            values, number, count = np.unique(token, return_inverse=True, return_counts=True)
            often = count[number] >= frequent
        for s in _runs(home):
            own = ~often[s]
            yield TOKENS, int(home[s.start]), block, None, None, place[s][own].tobytes(), six_bytes(token[s][own] // np.uint64(buckets))
        if often.any():
            common = count >= frequent
            values, count = values[common], count[common]
            for s in _runs((values[np.argsort(values % np.uint64(buckets), kind="stable")] % np.uint64(buckets)).astype(np.int64)):
                own = np.argsort(values % np.uint64(buckets), kind="stable")[s]
                yield TOTALS, int(values[own[0]] % np.uint64(buckets)), block, None, None, count[own].astype("<i8").tobytes(), values[own].astype("<u8").tobytes()
            order = np.argsort(token[often], kind="stable")
            token, place = token[often][order], place[often][order]
            for s in _runs(token):
                yield SPREAD, int((int(token[s.start]) ^ block) % buckets), block, None, None, place[s].tobytes(), token[s.start : s.start + 1].astype("<u8").tobytes()

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(arrow, text, BLOCK_BYTES):
            for part in (batch.slice(at, 1 << 15) for at in range(0, batch.num_rows, 1 << 15)):
                made = list(rows(part.column("_key"), utf8(part.column(text))))
                kinds = (pa.int8(), pa.int32(), pa.int64(), *[pa.binary()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*made, strict=True), kinds, strict=True)], names=["kind", "target", "block", "a", "b", "c", "d"])
                del made
                release()

    return run


def levels_of(sets: np.ndarray) -> np.ndarray:
    """Eight levels for each doubling of the number of sets; 0 for one set."""
    return np.minimum(255, np.rint(8 * np.log2(np.maximum(sets, 1)))).astype(np.uint8)


def _counted(buckets: int):
    """A bucket's rows to rows of _COUNTED: tokens of several sets with their level, by block; the levels of frequent tokens; the rest as it is."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        release()
        out = [(DOCUMENTS, r.block, None, None, r.a, r.b, r.c, r.d) for r in pdf[pdf["kind"] == DOCUMENTS].itertuples()]
        out += [(SPREAD, r.block, int(np.frombuffer(r.d, "<i8")[0]), None, None, None, r.c, None) for r in pdf[pdf["kind"] == SPREAD].itertuples()]
        totals, held = pdf[pdf["kind"] == TOTALS], pdf[pdf["kind"] == TOKENS]
        often, number = np.unique(np.frombuffer(b"".join(totals["d"]), "<u8"), return_inverse=True)
        more = np.bincount(number, np.frombuffer(b"".join(totals["c"]), "<i8"), len(often)).astype(np.int64)
        if len(held):
            home = np.uint64(held["target"].iloc[0])
            each = np.fromiter((len(x) // 2 for x in held["c"]), np.int64, len(held))
            token = np.concatenate([from_six_bytes(x) for x in held["d"]]) * np.uint64(buckets) + home
            values, number, count = np.unique(token, return_inverse=True, return_counts=True)
            del token
            at = np.searchsorted(values, often)
            here = at < len(values)
            here[here] = values[at[here]] == often[here]
            count[at[here]] += more[here]
            more = more.copy()
            more[here] = count[at[here]]
            shared = count[number] > 1
            level = levels_of(count)
            starts = np.cumsum(each) - each
            for block, a, n, places in zip(held["block"], starts.tolist(), each.tolist(), held["c"], strict=True):
                keep = np.flatnonzero(shared[a : a + n])
                if len(keep):
                    own = number[a + keep]
                    out.append((TOKENS, block, None, None, np.frombuffer(places, "<u2")[keep].tobytes(), values[own].astype("<u8").tobytes(), level[own].tobytes(), None))
        out += [(TOTALS, 0, t, v, *[None] * 4) for t, v in zip(often.view(np.int64).tolist(), levels_of(more).tolist(), strict=True)]
        columns = dict(zip(("kind", "block", "token", "level", "a", "b", "c", "d"), zip(*out, strict=True), strict=True)) if out else {}
        kinds = {"kind": "int8", "block": "int64", "token": "Int64", "level": "Int32"}
        return pd.DataFrame({c: pd.array(columns.get(c, []), kinds.get(c, "object")) for c in ("kind", "block", "token", "level", "a", "b", "c", "d")})

    return run


def _surviving(percent: int):
    """A block's rows to its sets that may have a partner: digest, n, and the tokens they share with others, in the first order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        release()
        documents, tokens = pdf[pdf["a"].notna() & pdf["d"].notna()], pdf[pdf["d"].isna()]
        # A block that a retry or a repeated file made twice is there twice, with equal rows.
        digests, size = np.frombuffer(documents["a"].iloc[0], _DIGEST), np.frombuffer(documents["b"].iloc[0], "<u4").astype(np.int64)
        place = np.frombuffer(b"".join(tokens["a"]), "<u2").astype(np.int64)
        token, level = np.frombuffer(b"".join(tokens["b"]), "<u8"), np.frombuffer(b"".join(tokens["c"]), np.uint8)
        order = np.lexsort((token, level, place))
        place, token, level = place[order], token[order], level[order]
        new = np.ones(len(place), bool)
        new[1:] = (place[1:] != place[:-1]) | (token[1:] != token[:-1])
        place, token, level = place[new], token[new], level[new]
        shared = np.bincount(place, minlength=len(size))
        ends = np.cumsum(shared)
        alive = np.flatnonzero((shared > 0) & (shared >= needed(size, percent)))
        spans = [slice(e - k, e) for e, k in zip(ends[alive], shared[alive], strict=True)]
        return pd.DataFrame({
            "digest": [digests[k].tobytes() for k in alive], "n": size[alive].astype(np.int32),
            "tokens": [token[s].tobytes() for s in spans], "levels": [level[s].tobytes() for s in spans],
        })

    return run


def _mixed(token: np.ndarray, odd: int) -> np.ndarray:
    x = token * np.uint64(odd)
    return (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)


def prefixes(token: np.ndarray, level: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first `count` shared tokens under the three orders: by level, by a hash, by eight doublings and another hash. `token` is in the first order."""
    second = np.argsort(_mixed(token, 0x9E3779B97F4A7C15), kind="stable")[:count]
    third = np.lexsort((_mixed(token, 0xC2B2AE3D27D4EB4F), level >> 6))[:count]
    return token[:count], token[second], token[third]


def _repacked(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A frequent token's rows, with their level, like rows of other tokens."""
    for batch in arrow:
        if not batch.num_rows:
            continue
        places = batch.column("c").to_pylist()
        tokens = [np.full(len(p) // 2, t, "<i8").tobytes() for p, t in zip(places, batch.column("token").to_pylist(), strict=True)]
        levels = [np.full(len(p) // 2, v, np.uint8).tobytes() for p, v in zip(places, batch.column("level").to_pylist(), strict=True)]
        columns = [pa.array(x, pa.binary()) for x in (places, tokens, levels, [None] * len(places))]
        yield pa.RecordBatch.from_arrays([batch.column("block"), *columns], names=["block", "a", "b", "c", "d"])


def _postings(percent: int):
    """Prefix tokens of sets under the first order."""

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(arrow, "tokens", 1 << 22):
            tokens = [np.frombuffer(x, "<i8") for x in batch.column("tokens").to_pylist()]
            n = batch.column("n").to_numpy().astype(np.int64)
            count = np.fromiter(map(len, tokens), np.int64, len(tokens)) - needed(n, percent) + 1
            own = np.concatenate([x[:k] for x, k in zip(tokens, count, strict=True)])
            nodes, sizes = (np.repeat(x, count) for x in (batch.column("node").to_numpy(), n.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(nodes), pa.array(sizes)], names=["token", "node", "n"])

    return run


class _Cell:
    """The sets of one task: their tokens as numbers, and their prefixes under the three orders."""

    def __init__(self, tokens: list[np.ndarray], levels: list[np.ndarray], n: np.ndarray, percent: int):
        self.n, self.percent = n, percent
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        values, ids = np.unique(np.concatenate([*tokens, np.empty(0, np.uint64)]), return_inverse=True)
        ends = np.cumsum(self.size)
        self.whole = [ids[e - k : e] for e, k in zip(ends, self.size, strict=True)]
        self.heads: list[list[np.ndarray]] = [[], [], []]
        for t, z, k in zip(tokens, levels, self.size - needed(n, percent) + 1, strict=True):
            for own, head in zip(self.heads, prefixes(t, z, int(k)), strict=True):
                own.append(np.searchsorted(values, head))
        self.mark = np.zeros(len(values), bool)

    def _common(self, own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
        self.mark[own] = True
        starts = np.cumsum([0, *map(len, others)][:-1])
        found = np.add.reduceat(self.mark[np.concatenate(others)], starts, dtype=np.int64)
        self.mark[own] = False
        return found

    def partners(self, x: int, ys: np.ndarray, orders: tuple[int, ...]) -> np.ndarray:
        """Which of `ys` are linked to x: by their sizes, by prefixes under the given orders, then by the overlap."""
        n, percent = self.n, self.percent
        ys = ys[(100 * np.minimum(n[x], n[ys]) >= percent * np.maximum(n[x], n[ys])) & (ys != x)]
        for k in orders:
            ys = ys[self._common(self.heads[k][x], [self.heads[k][y] for y in ys]) > 0] if len(ys) else ys
        good = [np.empty(0, np.int64)]
        for some in np.split(ys, np.flatnonzero(np.diff(np.cumsum(self.size[ys]) // (1 << 22))) + 1) if len(ys) else ():
            both = self._common(self.whole[x], [self.whole[y] for y in some])
            good.append(some[100 * both >= percent * (n[x] + n[some] - both)])
        return np.concatenate(good)

    def forest(self, roots: np.ndarray, stripe: np.ndarray | None) -> PairForest:
        """Links that join trees which `roots` and earlier links leave apart. Candidates share a prefix token under the first order; all of them that are still apart are looked at, those
        of one stripe left out where `stripe` is given."""
        forest = PairForest(len(self.n))
        _, first, which = np.unique(roots, return_index=True, return_inverse=True)
        forest.up = first[which]
        counts = np.fromiter(map(len, self.heads[0]), np.int64, len(self.n))
        token, owner = np.concatenate([*self.heads[0], np.empty(0, np.int64)]).astype(np.int64), np.repeat(np.arange(len(self.n)), counts)
        order = np.lexsort((owner, token))
        token, owner = token[order], owner[order]
        starts, ends = (np.searchsorted(token, np.arange(len(self.mark)), side) for side in ("left", "right"))
        for x, head in enumerate(self.heads[0]):
            lists = [owner[starts[t] : ends[t]] for t in head if ends[t] - starts[t] > 1]
            if not lists:
                continue
            ys = np.unique(np.concatenate(lists))
            ys = ys[ys > x]
            ys = ys if stripe is None else ys[stripe[ys] != stripe[x]]
            ys = ys[forest.roots(ys) != forest.roots(np.array([x]))]
            good = self.partners(x, ys, (1, 2))
            forest.link(np.full(len(good), x), good)
        return forest


def linked(tokens: list[np.ndarray], levels: list[np.ndarray], n: np.ndarray, u: np.ndarray, v: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of indices are links."""
    cell, good, order = _Cell(tokens, levels, n, percent), np.zeros(len(u), bool), np.argsort(u, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(u[order])) + 1) if len(u) else ():
        good[at] = np.isin(v[at], cell.partners(int(u[at[0]]), np.unique(v[at]), (1, 2)))
    return good


def _arrays(held: pd.DataFrame) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    return [np.frombuffer(x, "<u8") for x in held["tokens"]], [np.frombuffer(x, np.uint8) for x in held["levels"]], held["n"].to_numpy(np.int64)


def _edges(forest: PairForest, node: np.ndarray) -> pd.DataFrame:
    a, b = (np.concatenate([pair[k] for pair in forest.kept] or [np.empty(0, np.int64)]) for k in (0, 1))
    return pd.DataFrame({"u": node[a], "v": node[b]})


def verified(pairs: DataFrame, sets: DataFrame, grid: int, percent: int) -> DataFrame:
    """The links among `pairs` (u, v). Pairs are dealt to grid x grid cells by their ends, and each set goes once to each cell where it has pairs."""
    cell = lambda c: F.pmod(F.xxhash64(c, F.lit(11)), F.lit(grid)).cast("int")
    dealt = pairs.select(cell("u").alias("i"), cell("v").alias("j"), "u", "v")
    ends = dealt.select(F.col("i").alias("ci"), F.col("j").alias("cj"), F.explode(F.array("u", "v")).alias("node")).distinct()
    there = ends.join(sets.select("node", "n", "tokens", "levels"), "node")

    def check(own: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        release()
        node = held["node"].to_numpy(np.int64)
        order = np.argsort(node)
        u, v = (order[np.searchsorted(node[order], own[c].to_numpy(np.int64))] for c in ("u", "v"))
        good = linked(*_arrays(held), u, v, percent)
        # Of the links a spanning forest tells all that components need.
        forest = PairForest(len(node))
        forest.link(u[good], v[good])
        return _edges(forest, node)

    return dealt.groupBy("i", "j").cogroup(there.groupBy("ci", "cj")).applyInPandas(check, "u long, v long")


def _with_centres(postings: DataFrame, seeds: int) -> DataFrame:
    """Postings of tokens that several sets have in their prefix, with centres of the token: the sets that are first by as many hashes, so a family of copies has few."""
    first = [F.min(F.struct(F.xxhash64("node", F.lit(s)), "node"))["node"] for s in range(seeds)]
    table = postings.groupBy("token").agg(F.count(F.lit(1)).alias("_m"), F.array(*first).alias("centres")).where("_m > 1")
    return join_counted(postings, table, ["token"], "_m")


def _apart(rooted: DataFrame, sets: DataFrame, percent: int, cell_bytes: int) -> DataFrame:
    """Links between documents of unlike roots that share a prefix token, as far as they join such roots.

    Only documents of tokens with several roots take part. Those that such tokens connect are a family; a family's sets meet in one task, small families together, large ones in pairs of
    stripes. Pairs are looked at where their sets are, and only links are rows.
    """
    spark = sets.sparkSession
    table = rooted.groupBy("token").agg(F.count(F.lit(1)).alias("_m"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("node").alias("m")).where("lo <> hi")
    opened = store(join_counted(rooted.select("token", "node", "root"), table.select("token", "_m", "m"), ["token"], "_m").groupBy("node", "root", "m").agg(F.count(F.lit(1)).alias("_t")), "open")
    joined = connected_components(opened.select(F.col("node").alias("u"), F.col("m").alias("v")), rows_per_task=EDGES)
    named = opened.select("node", "root").distinct().join(joined.select("node", F.col("root").alias("family")), "node")
    held = store(sets.select("node", "n", "tokens", "levels").join(named, "node"), "open-sets")
    sizes = held.groupBy("family").agg(F.count(F.lit(1)).alias("_m"), F.ceil(F.sum(F.length("tokens")) / cell_bytes).cast("int").alias("g"))
    small = sizes.where("g = 1").agg(F.sum("_m")).first()[0] or 0
    tasks = max(salted_partitions(spark), -(-small // 4096))
    dealt = join_counted(held, sizes, ["family"], "_m").withColumn("s", F.pmod(F.xxhash64("node", F.lit(5)), "g").cast("int"))
    cells = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1))).select(
        F.when(F.col("g") > 1, F.col("family")).otherwise(F.pmod(F.xxhash64("family"), F.lit(tasks))).alias("cell"), (F.col("g") > 1).alias("large"), F.least("s", "o").alias("i"), F.greatest("s", "o").alias("j"),
        "s", "node", "root", "n", "tokens", "levels",
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        release()
        pdf = pdf.sort_values("node", kind="stable")
        across = pdf["i"].iloc[0] != pdf["j"].iloc[0]
        forest = _Cell(*_arrays(pdf), percent).forest(pdf["root"].to_numpy(np.int64), pdf["s"].to_numpy() if across else None)
        return _edges(forest, pdf["node"].to_numpy(np.int64))

    return cells.groupBy("large", "cell", "i", "j").applyInPandas(run, "u long, v long")


def similar_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, frequent: int | None = None, cell_bytes: int = 1 << 24) -> DataFrame:
    """One row per row of `docs`: key, n_shingles and component_id, the smallest key that links lead to. Two texts are linked if the intersection of their
    sets of distinct shingles has `percent` hundredths of the union or more.

    `frequent`: sets of a block that must hold a token for it to be dealt by block; by default as many as keep its rows of all blocks below TOKEN_ROWS."""
    spark = docs.sparkSession
    importable(spark)
    own = docs.select(F.col(key).cast("long").alias("_key"), text)
    octets = own.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(salted_partitions(spark), -(-octets // BUCKET_BYTES))
    often = frequent or max(2, TOKEN_ROWS // max(1, octets // BLOCK_BYTES))
    cut = own.mapInArrow(_cut(width, buckets, text, often), _CUT)
    counted = store(cut.groupBy("target").applyInPandas(_counted(buckets), _COUNTED), "counted")

    held = counted.where(F.col("kind").isin(TOKENS, DOCUMENTS)).select("block", "a", "b", "c", "d")
    levels = counted.where(F.col("kind") == TOTALS).select("token", "level")
    if not levels.isEmpty():
        spread = counted.where(F.col("kind") == SPREAD).select("token", "block", "c")
        table = levels.join(spread.groupBy("token").agg(F.count(F.lit(1)).alias("_m")), "token")
        held = held.unionByName(join_counted(spread, table, ["token"], "_m").select("token", "level", "block", "c").mapInArrow(_repacked, _HELD))
    alive = held.groupBy("block").applyInPandas(_surviving(percent), "digest binary, n int, tokens binary, levels binary")
    sets = store(alive.dropDuplicates(["digest"]).withColumn("node", F.monotonically_increasing_id()), "sets")

    postings = sets.select("node", "n", "tokens").mapInArrow(_postings(percent), "token long, node long, n int")
    postings = store(_with_centres(postings, 3), "postings")
    octets = sets.agg(F.sum(F.length("tokens"))).first()[0] or 0
    grid = max(int(np.ceil(np.sqrt(2 * salted_partitions(spark)))), -(-octets // cell_bytes))
    stars = postings.select("node", F.explode("centres").alias("u")).where("u <> node").select("u", F.col("node").alias("v")).distinct()
    links = store(verified(stars, sets, grid, percent), "links")
    # A document's root is a centre it is linked to, or that one's: not all of its component, but nothing beside it.
    near = links.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("root"))
    above = near.select(F.col("node").alias("root"), F.col("root").alias("_top"))
    near = near.join(above, "root", "left").select("node", F.least("root", "_top").alias("root"))
    rooted = postings.select("token", "node").join(near, "node", "left").withColumn("root", F.coalesce("root", "node"))
    further = store(_apart(store(rooted, "rooted"), sets, percent, cell_bytes >> 2), "further")
    roots = store(connected_components(links.unionByName(further), rows_per_task=EDGES), "roots")

    texts = store(counted.where(F.col("kind") == DOCUMENTS).select("a", "b", "c", "d").mapInArrow(_texts, "_key long, n_shingles long, digest binary"), "texts")
    some = texts.where("n_shingles > 0")
    named = some.groupBy("digest").agg(F.min("_key").alias("component_id"), F.count(F.lit(1)).alias("_n"))
    named = store(named, "named")
    rooted = sets.select("node", "digest").join(roots, "node").join(named.select("digest", "component_id"), "digest")
    least = rooted.groupBy("root").agg(F.min("component_id").alias("least"), F.count(F.lit(1)).alias("_m"))
    least = join_counted(rooted.select("digest", "root"), least, ["root"], "_m").select("digest", "least")
    named = named.join(least, "digest", "left").select("digest", F.coalesce("least", "component_id").alias("component_id"), "_n")
    out = join_counted(some.select("_key", "n_shingles", "digest"), named, ["digest"], "_n").select("_key", "n_shingles", "component_id")
    none = texts.where("n_shingles = 0").select("_key", "n_shingles", F.col("_key").alias("component_id"))
    return out.unionByName(none).withColumnRenamed("_key", key)


def _texts(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed rows of documents, one by one."""
    for batch in arrow:
        for a, b, c, d in zip(*(batch.column(x).to_pylist() for x in "abcd"), strict=True):
            keys = pa.array(np.frombuffer(c, "<i8"), mask=~np.frombuffer(d, bool))
            digests = pa.array([a[k : k + 16] for k in range(0, len(a), 16)], pa.binary())
            yield pa.RecordBatch.from_arrays([keys, pa.array(np.frombuffer(b, "<u4").astype(np.int64)), digests], names=["_key", "n_shingles", "digest"])
