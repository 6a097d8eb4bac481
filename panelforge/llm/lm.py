"""Language-model scores from a log-frequency Bloom filter.

Texts are cut into blocks; each block is tokenised once and kept as word numbers. Exact word counts and hashed n-gram counts are summed over
hash buckets. Each bucket makes its own slice of the filter: an n-gram of quantised count level q is inserted once per level up to q, so its
count is read back by probing level after level until the first miss. The bucket's task probes its slice for all n-grams that the blocks
sent to it, and the levels go back to the blocks as the word counts do; the score of a word is its smoothed probability given the one before.

Sizes: a slice is as large as its own exact histogram asks for a fill of `_FILL`, so n-grams of every count are kept whatever the input, and no slice leaves its task.
The number of buckets follows the bytes of text. What meets in one task is one hash bucket or one block. Hot words come once per block.

Defined cases: null and empty texts have one token, the end; without training texts every base probability is one; unknown words have
the smoothed count zero; repeated rows count each; null keys belong to the fold of the empty text; empty tables give empty results; only key and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm._base import batches, release, salted_partitions, store, utf8

SPACES = b" \t\n\v\f\r"
_TO_SPACE = bytes.maketrans(SPACES, b" " * len(SPACES))
#: The end token: no word has a blank in it. It also stands before the first word.
END = b" "
_NULL = np.iinfo(np.int64).min
_PROBES = 4
#: Bytes of text in a block, which bounds what a worker holds: some forty times as much.
_BLOCK = 7 << 20
_FILL = 0.35
#: Bytes of text to a bucket, which bounds the n-grams that meet in a task.
_BUCKET = 32 << 20
#: Least counts of the levels: about half as much again each.
LEVELS = np.unique(np.ceil(1.5 ** np.arange(100)).astype(np.float64))
_MEAN = np.concatenate([[0.0], np.sqrt(LEVELS[:-1] * np.maximum(LEVELS[:-1], LEVELS[1:] - 1))])
_ANSWER = ["kind", "block", "bucket", "counts", "levels", "tokens", "distinct"]
_ROWS = "kind string, block string, bucket int, n long, a binary, b binary, c binary, d binary, e binary"


def _pack(values: np.ndarray) -> bytes:
    """Byte planes, compressed."""
    values = np.ascontiguousarray(values)
    return zstandard.compress(values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes(), 1)


def _unpack(blob: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(kind).ravel()


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _pair_hashes(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return _mix(before * np.uint64(3) + (after << np.uint64(1) | np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))


def _cells(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket in the high half, 32-bit key in the low one."""
    return ((hashes >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF))


def _by_bucket(cells: np.ndarray) -> Iterator[tuple[int, slice]]:
    bucket = (cells >> np.uint64(32)).astype(np.int64)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]) if len(bucket) else np.array([0])
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(bucket[lo]), slice(lo, hi)


def _previous(ids: np.ndarray, starts: np.ndarray, end: int) -> np.ndarray:
    out = np.empty_like(ids)
    out[1:] = ids[:-1]
    out[starts] = end
    return out


def _pairs(ids: np.ndarray, starts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of a block (the word before in the high half), and for each word the number of its pair."""
    return np.unique((_previous(ids, starts, end).astype(np.int64) << 32) | ids, return_inverse=True)


def _turned(hashes: np.ndarray, pairs: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells of a block's pairs, and the order in which they go to the buckets and come back."""
    cells = _cells(_pair_hashes(hashes[pairs >> 32], hashes[pairs & 0xFFFFFFFF]), buckets)
    return cells, np.argsort(cells, kind="stable")


def _tokenised(docs: DataFrame, key: str, text: str, folds: int, buckets: int) -> DataFrame:
    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for no, batch in enumerate(batches(arrow, text, _BLOCK)):
            block, codes, ids = f"{part}-{no}", {END: 0}, []
            for x in utf8(batch.column(text)):
                words = x.lower().translate(_TO_SPACE).split()
                words.append(END)
                ids.append(np.fromiter([codes.setdefault(w, len(codes)) for w in words], np.int32, len(words)))
            keys = batch.column(key).to_pylist()
            held = np.array([zlib.crc32(b"" if k is None else str(k).encode()) % folds == 0 for k in keys])
            lengths = np.array([len(x) for x in ids], np.int64)
            flat = np.concatenate(ids)
            train = np.repeat(~held, lengths)
            words = list(codes)
            # Frequent words get small numbers, which pack well.
            rank = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")
            place = np.empty_like(rank)
            place[rank] = np.arange(len(rank))
            flat, words = place[flat].astype(np.int32), [words[i] for i in rank]
            counts, hashes = np.bincount(flat[train], minlength=len(words)), _word_hashes(words)
            rows = [("doc", block, 0, len(keys), _pack(np.array([_NULL if k is None else k for k in keys], np.int64)), _pack(held.astype(np.uint8)), _pack(lengths), _pack(flat), zstandard.compress(b"\n".join(words), 1))]
            order = np.argsort(hashes % np.uint64(buckets), kind="stable")
            of = (hashes % np.uint64(buckets))[order] << np.uint64(32)
            for bucket, at in _by_bucket(of):
                own = order[at]
                rows.append(("word", block, bucket, len(own), zstandard.compress(b"\n".join([words[i] for i in own]), 1), _pack(counts[own].astype(np.int32)), None, None, None))
            # Pairs of held-out texts come with the count zero: they are asked for only.
            pairs, back = _pairs(flat, np.cumsum(lengths) - lengths, int(place[0]))
            times = np.bincount(back[train], minlength=len(pairs))
            cells, turn = _turned(hashes, pairs, buckets)
            cells, times = cells[turn], times[turn]
            for bucket, at in _by_bucket(cells):
                low = (cells[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
                rows.append(("pair", block, bucket, len(low), _pack(np.diff(low, prepend=0).astype(np.uint32)), _pack(times[at].astype(np.int32)), None, None, None))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int32(), pa.int64(), *[pa.binary()] * 5), strict=True)], names=["kind", "block", "bucket", "n", "a", "b", "c", "d", "e"])

    return docs.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, _ROWS)


def _positions(keys: np.ndarray, level: int, bits: int) -> Iterator[np.ndarray]:
    a = _mix(keys.astype(np.uint64) + np.uint64(level * 0x5851F42D4C957F2D % 2**64))
    b = (a >> np.uint64(17)) | np.uint64(1)
    for _ in range(_PROBES):
        yield a % np.uint64(bits)
        a = a + b


def _slice(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The slice that holds all these n-grams, filled to `_FILL`."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    heads = np.flatnonzero(np.concatenate([[True], np.diff(keys) > 0]))
    keys, counts = keys[heads], np.add.reduceat(counts, heads)
    levels = np.searchsorted(LEVELS, counts, side="right")
    table = np.zeros(max(64, int(np.ceil(levels.sum() * _PROBES / _FILL / 8)) * 8), bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        for at in _positions(keys[levels >= level], level, len(table)):
            table[at] = True
    return np.packbits(table)


def _slice_of(pdf: pd.DataFrame) -> np.ndarray:
    """The slice of one bucket's n-grams."""
    release()
    keys = np.concatenate([np.cumsum(_unpack(x, "<u4"), dtype=np.int64) for x in pdf["a"]])
    counts = np.concatenate([_unpack(x, "<i4") for x in pdf["b"]]).astype(np.int64)
    return _slice(keys, counts)


def _probed(part: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Levels of the keys by a bucket's own slice: the highest that probing level after level reaches."""
    bits, out = 8 * len(part), np.zeros(len(keys), np.uint8)
    alive, level = np.arange(len(keys)), 1
    while len(alive) and level < len(_MEAN):
        held = np.ones(len(alive), bool)
        for at in _positions(keys[alive], level, bits):
            spot = at.astype(np.int64)
            held &= (part[spot >> 3] >> (7 - (spot & 7)).astype(np.uint8)) & 1 == 1
        alive = alive[held]
        out[alive] = level
        level += 1
    return out


def _answer_words(pdf: pd.DataFrame) -> pd.DataFrame:
    """Exact counts and levels of one bucket's words, given back to each block in its own order; one more row has the sums."""
    release()
    total: dict[bytes, int] = {}
    lists = [zstandard.decompress(x).split(b"\n") for x in pdf["a"]]
    for words, blob in zip(lists, pdf["b"], strict=True):
        for w, c in zip(words, _unpack(blob, "<i4").tolist(), strict=True):
            total[w] = total.get(w, 0) + c
    bucket, counts = int(pdf["bucket"].iloc[0]), np.fromiter(total.values(), np.int64, len(total))
    keys = (_mix(_word_hashes(list(total))) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    levels = _probed(_slice(keys, counts), keys)
    place = {w: i for i, w in enumerate(total)}
    out = []
    for b, words in zip(pdf["block"], lists, strict=True):
        at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
        out.append(("word", b, bucket, _pack(counts[at]), _pack(levels[at]), 0, 0))
    out.append(("word", None, bucket, None, None, int(counts.sum()), int((counts > 0).sum())))
    return pd.DataFrame(out, columns=_ANSWER)


def _answer_pairs(pdf: pd.DataFrame) -> pd.DataFrame:
    """Levels of one bucket's pairs, given back to each block in its own order."""
    part = _slice_of(pdf)
    bucket = int(pdf["bucket"].iloc[0])
    asked = (np.cumsum(_unpack(x, "<u4"), dtype=np.int64) for x in pdf["a"])
    out = [("pair", b, bucket, None, _pack(_probed(part, keys)), 0, 0) for b, keys in zip(pdf["block"], asked, strict=True)]
    return pd.DataFrame(out, columns=_ANSWER)


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 10, weight: float = 0.3, smooth: float = 0.1) -> DataFrame:
    """Per row: key, held_out, n_tokens, n_known, train_tokens, base_score, score. Learns from the rows outside the held-out fold."""
    spark = docs.sparkSession
    octets = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    buckets = max(64, salted_partitions(spark), -(-octets // _BUCKET))
    kept = store(_tokenised(docs, key, text, folds, buckets), "blocks", by="kind")
    answer = lambda pdf: (_answer_words if pdf["kind"].iloc[0] == "word" else _answer_pairs)(pdf)
    asked = kept.where("kind IN ('word', 'pair')").select("kind", "block", "bucket", "a", "b")
    answers = store(asked.groupBy("kind", "bucket").applyInPandas(answer, "kind string, block string, bucket int, counts binary, levels binary, tokens long, distinct long"), "counts")
    sums = answers.where("block IS NULL").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    tokens, distinct = int(sums[0]), int(sums[1])
    total = tokens + smooth * (distinct + 1)

    def run(doc: pd.DataFrame, answer: pd.DataFrame) -> pd.DataFrame:
        names = [key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        if not len(doc):
            return pd.DataFrame(columns=names)
        release()
        row = doc.iloc[0]
        keys, held, lengths, ids, words = _unpack(row["a"], "<i8"), _unpack(row["b"], "u1") == 1, _unpack(row["c"], "<i8"), _unpack(row["d"], "<i4"), zstandard.decompress(row["e"]).split(b"\n")
        hashes = _word_hashes(words)
        order = np.argsort(hashes % np.uint64(buckets), kind="stable")
        of = {kind: own.sort_values("bucket") for kind, own in answer.groupby("kind")}
        counts, plain = np.empty(len(words), np.int64), np.empty(len(words))
        counts[order] = np.concatenate([_unpack(x, "<i8") for x in of["word"]["counts"]])
        plain[order] = _MEAN[np.concatenate([_unpack(x, "u1") for x in of["word"]["levels"]])]
        starts = np.cumsum(lengths) - lengths
        summed = lambda v: np.add.reduceat(v, starts)
        base = np.log10((counts + smooth) / total)
        # The model: what the probes gave for each distinct word and pair of the block.
        single = (plain + smooth) / total
        pairs, back = _pairs(ids, starts, words.index(END))
        left, right = pairs >> 32, pairs & 0xFFFFFFFF
        together = np.empty(len(pairs))
        together[_turned(hashes, pairs, buckets)[1]] = _MEAN[np.concatenate([_unpack(x, "u1") for x in of["pair"]["levels"]])]
        context = np.maximum(plain[left], together)
        given = np.divide(together, context, out=np.zeros(len(pairs)), where=context > 0)
        model = np.log10(np.minimum(1.0, weight * given + (1 - weight) * single[right]))
        return pd.DataFrame(
            {
                key: pd.array([None if k == _NULL else k for k in keys.tolist()], dtype="Int64"), "held_out": held, "n_tokens": lengths, "n_known": summed((counts[ids] > 0).astype(np.int64)), "train_tokens": tokens, "base_score": summed(base[ids]), "score": summed(model[back]),
            }
        )

    blocks = kept.where("kind = 'doc'").select("block", "a", "b", "c", "d", "e")
    given_back = answers.where("block IS NOT NULL").select("kind", "block", "bucket", "counts", "levels")
    return blocks.groupBy("block").cogroup(given_back.groupBy("block")).applyInPandas(run, f"{key} long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
