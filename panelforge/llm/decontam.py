"""Benchmark decontamination by a positional inverted index, split over the documents.

The index is a table of segments in the shared folder. A segment holds the tokens of some documents: its term dictionary, and for each
term the sorted list of positions (postings), as delta-coded bytes. Documents lie one after another on a segment's
position axis, with gaps, so a phrase never crosses documents. A search intersects, for each phrase, the lists of its terms shifted by
their offsets, rarest term first; all phrases of a block of test items advance together. Matches are exact: every term of the
phrase is intersected.

Scale: building and searching are map-only; nothing but the results of items that match is shuffled, and that only
where the items take more than one block. Test items are sent to the workers in blocks of bounded size.

Defined cases: null, empty and word-free texts have no words, are never hit, and as items have no window; an item shorter than the window
is one window; repeated items count by item id; repeated documents are judged each; long documents lie whole in one segment, long items are cut into overlapping parts; empty tables give empty or all-clean results;
only the keys and texts are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm._base import batches, store, utf8

#: ASCII other than digits and letters separates words; all other bytes are of words.
_TABLE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
WINDOW = 13
_SEGMENT = "segment string, doc_ids binary, starts binary, lengths binary, terms binary, counts binary, postings binary"
_GAP = 64


def tokens(text: bytes) -> list[bytes]:
    return text.lower().translate(_TABLE).split()


def _pack(values: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(values).tobytes(), 1)


def _unpack(blob: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), kind)


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", gap: int = _GAP, segment_bytes: int = 6 << 20) -> DataFrame:
    """The index as a DataFrame of segments; write it with `store` or any writer."""

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for no, batch in enumerate(batches(arrow, text, segment_bytes)):
            codes: dict[bytes, int] = {}
            ids, lengths = [], []
            for x in utf8(batch.column(text)):
                words = tokens(x)
                lengths.append(len(words))
                ids.append(np.fromiter([codes.setdefault(w, len(codes)) for w in words], np.int32, len(words)))
            sizes = np.array(lengths, np.int64)
            starts = np.concatenate([[0], np.cumsum(sizes + gap)[:-1]])
            flat = np.concatenate(ids)
            where = np.arange(len(flat)) + np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
            # Terms of a segment fit 16 bits or two rounds of them; a stable sort on them is a radix sort.
            order = np.argsort((flat & 0xFFFF).astype(np.uint16), kind="stable")
            if len(codes) > 1 << 16:
                order = order[np.argsort((flat[order] >> 16).astype(np.uint16), kind="stable")]
            counts = np.bincount(flat, minlength=len(codes)).astype(np.int32)
            lists = where[order]
            steps = np.diff(lists, prepend=0)
            heads = np.cumsum(counts)[:-1]
            if len(counts) > 1:
                steps[heads] = lists[heads]
            yield pa.RecordBatch.from_pydict(
                {
                    "segment": [f"{part}-{no}"],
                    "doc_ids": [zstandard.compress(np.array([np.iinfo(np.int64).min if x is None else x for x in batch.column(key).to_pylist()], np.int64).tobytes(), 1)],
                    "starts": [_pack(starts)],
                    "lengths": [_pack(sizes)],
                    "terms": [zstandard.compress(b" ".join(codes), 1)],
                    "counts": [_pack(counts)],
                    "postings": [_pack(steps.astype(np.uint32))],
                },
                schema=pa.schema([("segment", pa.string())] + [(n, pa.binary()) for n in ("doc_ids", "starts", "lengths", "terms", "counts", "postings")]),
            )

    return docs.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, _SEGMENT)


class Phrases:
    """Distinct phrases (windows) of a block of test items, as offset-aligned term codes."""

    def __init__(self, items: list[tuple[str, bytes]], window: int | None = WINDOW):
        codes: dict[bytes, int] = {}
        windows: dict[tuple, int] = {}
        owners: list[set[int]] = []
        self.names: list[str] = []
        for name, text in items:
            words = [codes.setdefault(w, len(codes)) for w in tokens(text)]
            if not words:
                continue
            self.names.append(name)
            width = len(words) if window is None else min(window, len(words))
            for i in range(len(words) - width + 1):
                at = windows.setdefault(tuple(words[i : i + width]), len(windows))
                if at == len(owners):
                    owners.append(set())
                owners[at].add(len(self.names) - 1)
        self.terms = list(codes)
        self.lengths = np.array([len(w) for w in windows], np.int64)
        longest = int(self.lengths.max(initial=0))
        self.codes = np.full((len(windows), longest), -1, np.int64)
        for w, i in windows.items():
            self.codes[i, : len(w)] = w
        self.owner_counts = np.array([len(x) for x in owners], np.int64)
        self.owners = np.array([y for x in owners for y in sorted(x)], np.int64)
        self.owner_starts = np.cumsum(self.owner_counts) - self.owner_counts


class Segment:
    """A decoded segment: one sorted array of (term, position) for all lists of the terms asked for."""

    def __init__(self, row: dict, wanted: list[bytes]):
        self.doc_ids = _unpack(row["doc_ids"], "<i8")
        self.starts, self.lengths = _unpack(row["starts"], "<i8"), _unpack(row["lengths"], "<i8")
        codes = {w: i for i, w in enumerate(zstandard.decompress(row["terms"]).split(b" "))}
        counts = _unpack(row["counts"], "<i4").astype(np.int64)
        heads = np.cumsum(counts) - counts
        steps = _unpack(row["postings"], "<u4")
        self.df = np.zeros(len(wanted), np.int64)
        lists = []
        for q, w in enumerate(wanted):
            own = codes.get(w)
            if own is not None and len(counts):
                self.df[q] = counts[own]
                lists.append((q << 40) + np.cumsum(steps[heads[own] : heads[own] + counts[own]], dtype=np.int64))
        self.keys = np.concatenate(lists) if lists else np.empty(0, np.int64)
        self.heads = np.cumsum(self.df) - self.df

    def occurrences(self, p: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, position of its first word), by intersecting the lists of each phrase from its rarest term."""
        if not len(p.lengths) or not len(self.keys):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        held = p.codes >= 0
        df = np.where(held, self.df[p.codes], np.iinfo(np.int64).max)
        alive = np.flatnonzero((df > 0).all(axis=1))
        if not len(alive):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        order = np.argsort(df[alive], axis=1, kind="stable")  # rarest first, fillers last
        first = order[:, 0]
        term = p.codes[alive, first]
        n = self.df[term]
        phrase = np.repeat(np.arange(len(alive)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.heads[term], n)
        start = (self.keys[at] & ((1 << 40) - 1)) - np.repeat(first, n)
        keep = start >= 0
        phrase, start = phrase[keep], start[keep]
        for r in range(1, p.codes.shape[1]):
            if not len(phrase):
                break
            offset = order[phrase, r]
            code = p.codes[alive[phrase], offset]
            sought = (code << 40) + start + offset
            spot = np.minimum(np.searchsorted(self.keys, sought), len(self.keys) - 1)
            keep = (code < 0) | (self.keys[spot] == sought)
            phrase, start = phrase[keep], start[keep]
        return alive[phrase], start

    def docs_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, side="right") - 1


def _pieces(body: bytes, window: int, most: int) -> Iterator[bytes]:
    """An item's text in parts of about `most` bytes that overlap by a window less one word, so that each of its windows is in one of them."""
    if len(body) <= most:
        yield body
        return
    words = tokens(body)
    step = max(1, len(words) * most // len(body))
    for at in range(0, max(1, len(words) - window + 1), step):
        yield b" ".join(words[at : at + step + window - 1])


def _blocks(items: DataFrame, key: str, text: str, most: int, window: int) -> Iterator[list[tuple[str, bytes]]]:
    """Items in blocks of about `most` bytes at most, fetched a partition at a time; longer items are cut."""
    block, used = [], 0
    for row in items.where(F.col(text).isNotNull()).select(F.col(key).cast("string"), F.col(text).cast("binary")).toLocalIterator():
        for body in _pieces(bytes(row[1]), window, most):
            if block and used + len(body) > most:
                yield block
                block, used = [], 0
            block.append(("" if row[0] is None else row[0], body))
            used += len(body)
    yield block


_HITS = "segment string, seg_doc long, doc_id long, n_words long, hits array<int>, items array<string>"


def phrase_hits(index: DataFrame, phrases: Phrases) -> tuple[DataFrame, Broadcast]:
    """Per document: its number of words, the hit word positions and the ids of the items that occur; and the broadcast that the frame reads."""
    sent = index.sparkSession.sparkContext.broadcast(phrases)

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, none = sent.value, np.empty(0, np.int32)
        for batch in arrow:
            for row in batch.to_pylist():
                s = Segment(row, p.terms)
                phrase, start = s.occurrences(p)
                doc = s.docs_of(start)
                n = p.lengths[phrase]
                word = np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                word = np.unique(word)
                word_doc = s.docs_of(word)
                hits, found = {}, {}
                if len(word):
                    cut = np.flatnonzero(np.diff(word_doc)) + 1
                    for d, w in zip(word_doc[np.concatenate([[0], cut])].tolist(), np.split(word, cut), strict=True):
                        hits[d] = (w - s.starts[d]).astype(np.int32)
                    pair = np.unique((doc << 32) + phrase)
                    for x in pair.tolist():
                        i = x & 0xFFFFFFFF
                        found.setdefault(x >> 32, set()).update(p.owners[p.owner_starts[i] : p.owner_starts[i] + p.owner_counts[i]].tolist())
                m = len(s.doc_ids)
                names = [sorted({p.names[i] for i in found.get(d, ())}) for d in range(m)]
                missing = s.doc_ids == np.iinfo(np.int64).min
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["segment"]] * m, pa.string()), pa.array(np.arange(m)), pa.array(s.doc_ids, mask=missing), pa.array(s.lengths), pa.array([hits.get(d, none) for d in range(m)], pa.list_(pa.int32())), pa.array(names, pa.list_(pa.string()))],
                    names=["segment", "seg_doc", "doc_id", "n_words", "hits", "items"],
                )

    return index.mapInArrow(run, _HITS), sent


def proximity_hits(index: DataFrame, terms: list[bytes], within: int) -> DataFrame:
    """(doc_id, start, end): spans of at most `within` words that hold all the terms in any order, one for each occurrence of the rarest term in a
    segment that has any: the tightest one, of equally tight ones the last. From the same lists as phrases."""
    if within > _GAP:
        raise ValueError(f"spans of more than {_GAP} words need an index with wider gaps")
    wanted = [x for t in terms for x in tokens(t)]

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            for row in batch.to_pylist():
                s = Segment(row, wanted)
                if not wanted or not (s.df > 0).all():
                    continue
                lists = [s.keys[h : h + n] & ((1 << 40) - 1) for h, n in zip(s.heads, s.df, strict=True)]
                lists.sort(key=len)
                # A span starts at an occurrence of some term, and ends where the last of the terms comes first from there on.
                starts, far = np.unique(np.concatenate(lists)), np.iinfo(np.int64).max
                ends = np.max([np.append(x, far)[np.searchsorted(x, starts)] for x in lists], axis=0)
                rare = lists[0]
                low, high, last = rare - within, rare.copy(), np.searchsorted(starts, rare)
                for back in range(within):
                    at = np.maximum(last - back, 0)
                    end = np.maximum(ends[at], rare)
                    near = (last >= back) & (rare - starts[at] < within)
                    if not near.any():
                        break
                    better = near & (end < far) & (end - starts[at] < high - low)
                    low, high = np.where(better, starts[at], low), np.where(better, end, high)
                good = high - low < within
                doc = s.docs_of(low[good])
                yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids[doc]), pa.array(low[good] - s.starts[doc]), pa.array(high[good] - s.starts[doc])], names=["doc_id", "start", "end"])

    return index.mapInArrow(run, "doc_id long, start long, end long")


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item_key: str = "item_id", text: str = "text", window: int = WINDOW, share: int = 20, block_bytes: int = 2 << 20) -> DataFrame:
    """Per document: doc_id, n_words, hits (sorted word positions inside an occurrence of an item's window), items (their ids,
    sorted as strings), n_hit, contaminated (hit, and at least one word in `share` is)."""
    if window > _GAP:
        raise ValueError(f"windows of more than {_GAP} words need an index with wider gaps")
    index = store(build_index(docs, key, text), "index")
    blocks = _blocks(benchmark, item_key, text, block_bytes, window)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        merged, _ = phrase_hits(index, Phrases(first, window))
    else:
        # One block at a time is on the workers: its hits are stored, and the block is dropped.
        parts = []
        for block in chain((first, second), blocks):
            found, sent = phrase_hits(index, Phrases(block, window))
            parts.append(store(found.where(F.size("hits") > 0) if parts else found, "hits"))
            sent.destroy()
        merged = reduce(DataFrame.unionByName, parts)
        merged = merged.groupBy("segment", "seg_doc").agg(
            F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
        )
    return merged.select("doc_id", "n_words", "hits", "items", F.size("hits").cast("long").alias("n_hit")).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))

