"""Secret scans: patterns, and password guess-cost over credential-context values.

Base spans are pattern matches of three kinds (assign, access, hex). The method adds spans of kind `guess`: values that
stand in a credential context (`pwd: x`, `passphrase = x`, `credential is x` and the like) and would take an attacker at least
10**`least_log10` guesses. The cost of a value is that of its cheapest segmentation, found by dynamic programming over words, dates, repeats,
keyboard walks, character sequences and brute-force spans (`Guesser`).

Defined cases: null texts are empty; empty texts have no spans; texts are scanned whole, whatever their length; repeated rows are scanned each;
spans count code points, end exclusive; spans of several kinds at one place all count, ordered by start, kind and end; null keys stay null; empty tables give
empty results; only the key and the text are read, so other columns don't matter.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm import wfst
from panelforge.llm._base import batches, utf8, vocabulary

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
#: A run of 16 or more is matched from its start, as by the open pattern with shorter matches dropped.
HEX = re.compile(rb"[0-9a-f]{16,}")
_IS_HEX = bytes(120 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
#: A wider circle of credential contexts, for the method.
CONTEXT = re.compile(
    rb"""(?i:\b(?:password|passwd|passphrase|passcode|pwd|pass|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth))["']?(?:\x20*(?:[:=]|=>)|\x20+is\b)\x20*["']?([!-&(-~]{8,})"""
)
_CUES = (b"pass", b"pwd", b"secret", b"token", b"key", b"credential", b"auth")

#: Common words of passwords and placeholders, in order of rank.
WORDS = (
    "password secret admin welcome example changeme letmein login default test user master token key root guest access monkey dragon hello love sunshine princess football shadow superman "
    "qwerty abc iloveyou trustno charlie summer winter spring autumn secure private public placeholder sample demo dummy insert your none null true false here value string pass word "
    "the and for with that this from have not are was you all but they his her she which been their has would there what will if can more when who said do time up no so out than then them some into "
    "new server database service account system client network manager office company house people world life day man work"
).split()
_LEET = str.maketrans("@4301$57!+", "aaeoisstit")
#: The rows of a keyboard.
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
_AT = {ch: (r, c) for r, row in enumerate(ROWS) for c, ch in enumerate(row)}
_DATE = re.compile(r"(?:(?:19|20)\d\d([-/._]?)(?:1[0-2]|0?[1-9])\1(?:[12]\d|3[01]|0?[1-9])|(?:[12]\d|3[01]|0?[1-9])([-/._]?)(?:1[0-2]|0?[1-9])\2(?:19|20)?\d\d|(?:19|20)\d\d)")
_WORD_START = re.compile("\u2581[A-Za-z]{3,}")
_log = math.log10


def _neighbours(a: str, b: str) -> bool:
    p, q = _AT.get(a), _AT.get(b)
    return bool(p and q and p != q and abs(p[0] - q[0]) <= 1 and -1 <= q[1] - p[1] <= 1)


def _alphabet(ch: str) -> float:
    return 10 if ch.isdigit() else 26 if ch.isalpha() else 33


#: Relations of runs and what a whole run costs: one character repeated, a step up or down the alphabet or the digits, a walk over neighbouring keys.
_RUNS = (
    (lambda a, b: a == b, lambda run: _log(_alphabet(run[0]) * len(run))),
    (lambda a, b: ord(b) - ord(a) == 1 and a.isalnum() and b.isalnum(), lambda run: _log(_alphabet(run[0]) * len(run))),
    (lambda a, b: ord(a) - ord(b) == 1 and a.isalnum() and b.isalnum(), lambda run: _log(2 * _alphabet(run[0]) * len(run))),
    (_neighbours, lambda run: _log(len(_AT) * len(run)) + 0.3 * sum(_AT[b][1] - _AT[a][1] != 1 for a, b in zip(run, run[1:], strict=False))),
)


class Guesser:
    """Prices values by their cheapest segmentation, in log10 of guesses.

    Spans are: any stretch of characters by brute force; words of the dictionary, as they are or with common substitutions undone; dates; longest runs (three characters or more)
    of one character, of a sequence up or down, or of neighbouring keys; and blocks of 2 to `widest` characters repeated, from the start of the longest stretch of that
    period, in whole blocks, at the cost of one block and their number. Each span after the first multiplies the guesses by ten. Of equally cheap segmentations any
    gives the cost, which is all that is returned. One rule for values of every length.
    """

    def __init__(self, words: Iterable[str] = WORDS, widest: int = 48):
        self.rank: dict[str, int] = {}
        for w in words:
            self.rank.setdefault(w, len(self.rank) + 1)
        self.longest, self.widest = max(map(len, self.rank), default=0), widest
        self.known: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def _words(self, text: str, low: str) -> Iterator[tuple[int, int, float]]:
        plain, get, n = low.translate(_LEET), self.rank.get, len(text)
        for i in range(n):
            for j in range(i + 2, min(n, i + self.longest) + 1):
                rank, leet = get(low[i:j]), 1
                if rank is None:
                    rank, leet = get(plain[i:j]), 4
                if rank is not None:
                    own = text[i:j]
                    upper = sum(map(str.isupper, own))
                    shape = 1 if not upper else 2 if upper in (1, len(own)) else 2 ** min(upper, len(own) - upper) * 2
                    yield i, j, _log(1 + rank * shape * leet)

    @staticmethod
    def _dates(text: str) -> Iterator[tuple[int, int, float]]:
        for i, ch in enumerate(text):
            if ch.isdigit():
                for j in range(i + 4, min(len(text), i + 10) + 1):
                    if _DATE.fullmatch(text, i, j):
                        yield i, j, _log(120 if j - i == 4 else 365 * 120 * (1 if text[i:j].isdigit() else 4))

    @staticmethod
    def _runs(low: str) -> Iterator[tuple[int, int, float]]:
        for same, price in _RUNS:
            i, n = 0, len(low)
            while i < n - 2:
                j = i
                while j < n - 1 and same(low[j], low[j + 1]):
                    j += 1
                if j - i >= 2:
                    yield i, j + 1, price(low[i : j + 1])
                i = max(j, i + 1)

    def _blocks(self, text: str) -> Iterator[tuple[int, int, float]]:
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
        for width in range(2, min(self.widest, len(text) // 2) + 1):
            edge = np.diff(np.concatenate([[0], (codes[width:] == codes[:-width]).astype(np.int8), [0]]))
            for a, m in zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - np.flatnonzero(edge == 1)).tolist(), strict=True):
                if m >= width:
                    times = 1 + m // width
                    yield a, a + times * width, self.cost(text[a : a + width]) + _log(times)

    def cost(self, value: str) -> float:
        found = self.known.get(value)
        if found is not None:
            return found
        low, ends = value.lower(), [[] for _ in range(len(value) + 1)]
        for spans in (self._words(value, low), self._dates(value), self._runs(low), self._blocks(value)):
            for i, j, c in spans:
                ends[j].append((i, c))
        # The cheapest way to each position whose last span is brute force, and whose isn't: the next character continues the former for nothing.
        brute, other = [0.0] + [math.inf] * len(value), [0.0] + [math.inf] * len(value)
        for j, ch in enumerate(value, 1):
            brute[j] = min(brute[j - 1], other[j - 1] + (j > 1)) + _log(_alphabet(ch))
            other[j] = min((min(brute[i], other[i]) + c + (i > 0) for i, c in ends[j]), default=math.inf)
        out = min(brute[-1], other[-1])
        if len(value) <= 96:
            # Only what is remembered depends on the length.
            if len(self.known) >= 1 << 14:
                self.known.clear()
            self.known[value] = out
        return out


def vocabulary_words(path: str) -> list[str]:
    """Common passwords and placeholders, then the words that a tokenizer's vocabulary starts, in its own order, the most frequent first. `path`: a model file of SentencePiece."""
    return [*WORDS, *(p[1:].lower() for p in wfst.pieces_of(path) if _WORD_START.fullmatch(p))]


_COMMON = Guesser()


def log10_guesses(value: str) -> float:
    """By the short dictionary of this module alone."""
    return _COMMON.cost(value)


def find_spans(text: bytes, least_log10: float = 10.0, guesser: Guesser = _COMMON) -> list[tuple[int, int, int]]:
    """(start, end, kind number) in bytes, sorted."""
    low = text.lower()
    spans = []
    cued = any(c in low for c in _CUES)
    if cued:
        spans += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if b"AKIA" in text:
        spans += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if b"x" * 16 in text.translate(_IS_HEX):
        spans += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    if cued:
        # Disjoint stretches of base spans, for a search by bisection.
        stretches: list[list[int]] = []
        for a, b, _ in sorted(spans):
            if stretches and a <= stretches[-1][1]:
                stretches[-1][1] = max(stretches[-1][1], b)
            else:
                stretches.append([a, b])
        heads = [s[0] for s in stretches]
        for m in CONTEXT.finditer(text):
            value = m.group(1).rstrip(b"\"',;:.)]}>")
            a, b = m.start(1), m.start(1) + len(value)
            # Values that base spans cover in part only are costed too.
            if len(value) >= 8 and not ((k := bisect_right(heads, a)) and stretches[k - 1][1] >= b) and guesser.cost(value.decode("ascii")) >= least_log10:
                spans.append((a, b, 3))
    return sorted(spans, key=lambda s: (s[0], s[2], s[1]))


def _points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Byte offsets to code points."""
    if not spans or text.isascii():
        return spans
    out, at, points = {}, 0, 0
    for x in sorted({y for s in spans for y in s[:2]}):
        points += len(text[at:x].decode("utf-8", "replace"))
        out[x], at = points, x
    return [(out[a], out[b], k) for a, b, k in spans]


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", least_log10: float = 10.0, words: Iterable[str] | None = None) -> DataFrame:
    """Per row: key, n_assign, n_access, n_hex, n_guess, base_sha256 (of the base spans), spans (`kind:start:end`, comma-joined). `words`: the dictionary by rank,
    sent to the workers; without it, that of the installed vocabulary."""
    guesser = Guesser(vocabulary_words(vocabulary()) if words is None else words)

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(arrow, text):
            out = [_points(x, find_spans(x, least_log10, guesser)) for x in utf8(batch.column(text))]
            counts = [pa.array([sum(s[2] == k for s in spans) for spans in out], pa.int64()) for k in range(4)]
            sums = [hashlib.sha256(spans_text([s for s in spans if s[2] < 3]).encode()).hexdigest() for spans in out]
            yield pa.RecordBatch.from_arrays([batch.column(key), *counts, pa.array(sums), pa.array([spans_text(s) for s in out])], names=[key, "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans"])

    return docs.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, f"{key} long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string")


def redacted(text: bytes, least_log10: float = 10.0, guesser: Guesser = _COMMON) -> bytes:
    """The text with each secret replaced by `[kind]`; of overlapping spans the union is replaced."""
    out, at = [], 0
    for a, b, k in find_spans(text, least_log10, guesser):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k]}]".encode()]
        at = max(at, b)
    return b"".join([*out, text[at:]]) if out else text


def redact_secrets(docs: DataFrame, text: str = "text", length: str | None = "n_chars", least_log10: float = 10.0, words: Iterable[str] | None = None) -> DataFrame:
    """`docs` with its secrets replaced; the length column, if there is one, is set anew for rows that change. Null texts stay null;
    `words` as in `scan_secrets`."""
    names, guesser = docs.columns, Guesser(vocabulary_words(vocabulary()) if words is None else words)

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(arrow, text):
            at = batch.schema.get_field_index(text)
            old = batch.column(at)
            given = utf8(old)
            new = [redacted(x, least_log10, guesser) for x in given]
            columns = list(batch.columns)
            columns[at] = pa.array([None if not v else y.decode("utf-8", "replace") for v, y in zip(old.is_valid().to_pylist(), new, strict=True)], pa.string())
            if length in names:
                n = batch.schema.get_field_index(length)
                columns[n] = pa.array([w if x == y else len(y.decode("utf-8", "replace")) for x, y, w in zip(given, new, columns[n].to_pylist(), strict=True)], columns[n].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)
