"""Periodic runs of words, by recursive frequency splitting and a lag scan.

A run is a maximal stretch of words with smallest period q and at least max(6, 4q) words, so each of its words occurs in it
four times or more, and two neighbouring occurrences of a word lie q words apart at most.  Periods are looked for by octave
[Q, 2Q).  Within an octave a text is a segment at first; a word whose chain of occurrences inside its segment, with steps below
2Q, is shorter than four cannot be in a run and splits its segment.  The chains are counted again in the smaller segments until
nothing splits.  A segment of fewer than max(6, 4Q) words goes.  In those that are left the lag scan compares, at every 2Q-th word g
and each lag q of the octave, the q words from g with the q words after them; one of these g lies in each run
so that both are inside.  Hits are extended both ways by binary search over prefix hashes, which takes
n log n steps for a text of n words in an octave, whatever it holds.  A stretch that two lags find alike is the shorter one's.

Everything works on all texts of a slice at once, in numpy; no shuffle, each text by itself and whole.

Defined cases: a null or empty text has no words, no runs, and the digests of the empty string; a null id is never rewritten by
:func:`planted`; repeated rows are each treated alike; an empty table gives an empty result; other columns of the input are not returned.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import slices, span_hash

#: A run has at least so many words, and so many times its period.
LEAST_WORDS, LEAST_TIMES = 6, 4
#: Prefix hashes are kept modulo these primes.
_PRIMES = (np.int64(2147483647), np.int64(2147483629))
_BASES = (np.int64(1000003), np.int64(69061))

SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def _powers(base: np.int64, prime: np.int64, n: int) -> np.ndarray:
    out = np.ones(n, np.int64)
    have = 1
    while have < n:
        step = min(have, n - have)
        out[have : have + step] = out[:step] * (out[have - 1] * base % prime) % prime
        have += step
    return out


class _Spans:
    """Equality of spans of a sequence of words, by prefix hashes."""

    def __init__(self, words: np.ndarray):
        self.sums, self.powers = [], []
        for k, (prime, base) in enumerate(zip(_PRIMES, _BASES, strict=True)):
            value = ((words >> np.uint64(31 * k)) & np.uint64(0x7FFFFFFF)).astype(np.int64) % prime
            power = _powers(base, prime, len(words) + 1)
            total = np.zeros(len(words) + 1, np.int64)
            np.cumsum(value * power[:-1] % prime, out=total[1:])
            self.sums.append(total)
            self.powers.append(power)

    def equal(self, a: np.ndarray, lag: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the words from a are those from a + lag, ``size`` of them."""
        out = np.ones(len(a), bool)
        for prime, total, power in zip(_PRIMES, self.sums, self.powers, strict=True):
            one = (total[a + size] - total[a]) % prime
            two = (total[a + lag + size] - total[a + lag]) % prime
            out &= one * power[lag] % prime == two
        return out


def _segments(at: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """Numbers of the stretches of neighbouring places within one piece."""
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (piece[1:] != piece[:-1])
    return np.cumsum(new) - 1


def _split(words: np.ndarray, at: np.ndarray, piece: np.ndarray, reach: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The places, and their segments, that stay when words too rare for a run split the segments until nothing changes."""
    segment = _segments(at, piece)
    while len(at):
        order = np.lexsort((at, words[at], segment))
        w, s, p = words[at][order], segment[order], at[order]
        new = np.ones(len(p), bool)
        new[1:] = (w[1:] != w[:-1]) | (s[1:] != s[:-1]) | (p[1:] - p[:-1] >= reach)
        chain = np.cumsum(new) - 1
        stays = np.empty(len(p), bool)
        stays[order] = np.bincount(chain)[chain] >= LEAST_TIMES
        kept, own = at[stays], segment[stays]
        own = _segments(kept, own)
        long = np.bincount(own)[own] >= least if len(own) else np.zeros(0, bool)
        if stays.all() and long.all():
            break
        at, segment = kept[long], own[long]
    return at, segment


def _extended(spans: _Spans, g: np.ndarray, lag: np.ndarray, most: np.ndarray, left: bool) -> np.ndarray:
    """How many words more agree at the lag, to the right from g or to the left of it; ``most`` at the most."""
    low, high = np.zeros(len(g), np.int64), most.copy()
    while (open_ := low < high).any():
        mid = (low + high + 1) // 2
        same = spans.equal(g - mid if left else g, lag, mid)
        low = np.where(open_ & same, mid, low)
        high = np.where(open_ & ~same, mid - 1, high)
    return low


def find_runs(words: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of every run of ``words`` (hashes); stretches lie within one ``row``.  By start, then period."""
    found = []
    at, piece = _split(words, np.arange(len(words)), row, len(words) + 1, LEAST_WORDS)
    if not len(at):
        return (np.zeros(0, np.int64),) * 3
    spans, low = _Spans(words), 1
    while True:
        least = max(LEAST_WORDS, LEAST_TIMES * low)
        sizes = np.bincount(piece)
        if sizes.max() < least:
            break
        roomy = sizes[piece] >= least
        mine, segment = _split(words, at[roomy], piece[roomy], 2 * low, least)
        if len(mine):
            heads = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
            begin, end = mine[heads], mine[np.append(heads[1:], len(mine)) - 1] + 1
            many = -(-(end - begin) // (2 * low))
            of = np.repeat(np.arange(len(heads)), many)
            g = begin[of] + (np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)) * 2 * low
            for lo in range(0, len(g), max(1, (1 << 20) // low)):  # bounded pieces of the places times lags
                piece_g, piece_of = (np.repeat(x[lo : lo + max(1, (1 << 20) // low)], low) for x in (g, of))
                lag = np.tile(np.arange(low, 2 * low), len(piece_g) // low)
                fits = piece_g + 2 * lag <= end[piece_of]
                piece_g, piece_of, lag = piece_g[fits], piece_of[fits], lag[fits]
                same = words[piece_g] == words[piece_g + lag]
                piece_g, piece_of, lag = piece_g[same], piece_of[same], lag[same]
                hit = spans.equal(piece_g, lag, lag)
                piece_g, piece_of, lag = piece_g[hit], piece_of[hit], lag[hit]
                right = _extended(spans, piece_g, lag, end[piece_of] - piece_g - lag, False)
                left = _extended(spans, piece_g, lag, piece_g - begin[piece_of], True)
                start, stop = piece_g - left, piece_g + lag + right
                long = stop - start >= np.maximum(LEAST_WORDS, LEAST_TIMES * lag)
                found.append(np.unique(np.stack([start[long], stop[long], lag[long]], axis=1), axis=0))
        low *= 2
    runs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)  # rows are in order of start, end, period
    runs = runs[first]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    return runs[:, 0], runs[:, 1], runs[:, 2]


def _source(ids: list, row: np.ndarray, rows: int, plant: bool) -> np.ndarray:
    """Number of the word that stands at each place: itself, or in rewritten texts an earlier one."""
    out = np.arange(len(row))
    if not plant:
        return out
    bounds = np.searchsorted(row, np.arange(rows + 1))
    for i, doc in enumerate(ids):
        n = int(bounds[i + 1] - bounds[i])
        if doc is None or n == 0 or (h := zlib.crc32(str(doc).encode())) % 10:
            continue
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        out[bounds[i] + a : bounds[i + 1]] = bounds[i] + a + np.arange(n - a) % p
    return out


def _digests(column: pa.Array, ids: pa.Array, plant: bool) -> Iterator[list]:
    for s in slices(column):
        own = ids.slice(s.first, s.rows).to_pylist()
        starts, ends, row = s.words()
        source = _source(own, row, s.rows, plant)
        words = span_hash(s.prefix(), starts, ends)[source]
        start, end, period = find_runs(words, row)
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, start + period, 1)
        np.add.at(edge, end, -1)
        kept = np.cumsum(edge[:-1]) == 0
        moved = source != np.arange(len(source))
        bounds = np.searchsorted(row, np.arange(s.rows + 1))
        by_row = np.searchsorted(start, bounds)
        changed = s.per_row(row[~kept | moved]) > 0
        raw, edges = s.data.tobytes(), s.bounds
        for i, doc in enumerate(own):
            text = raw[edges[i] : edges[i + 1]].split()  # bytes split at the same six characters
            lo, hi = bounds[i], bounds[i + 1]
            if changed[i]:
                text = [text[k] for k in (source[lo:hi] - lo)[kept[lo:hi]]]
            runs = [(int(start[k] - lo), int(end[k] - start[k]), int(period[k])) for k in range(by_row[i], by_row[i + 1])]
            best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
            shown = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
            milli = None if best is None else 1000 * best[1] // best[2]
            yield [doc, len(runs), *(best or (None, None, None)), milli, hashlib.sha256(shown.encode()).hexdigest(), hashlib.sha256(b" ".join(text)).hexdigest()]


def run_digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", plant: bool = False) -> DataFrame:
    """Per row of ``docs``: the number of runs, the strongest one, and digests of all runs and of the text without their repeats
    (see SCHEMA); ``plant`` makes periodic every text whose id asks for it, see :func:`planted`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(_digests(batch.column(1), batch.column(0), plant))
            if rows:
                arrays = [pa.array(c, pa.string() if name.endswith("256") else pa.int64()) for name, c in zip(_NAMES, zip(*rows, strict=True), strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, _NAMES)

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(run, SCHEMA)


def runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, start, length, period) of every run, in word numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column(1)):
                starts, ends, row = s.words()
                start, end, period = find_runs(span_hash(s.prefix(), starts, ends), row)
                own = row[start]
                first = np.searchsorted(row, own)
                ids = batch.column(0).take(pa.array(own + s.first))
                yield pa.RecordBatch.from_arrays([ids, pa.array(start - first), pa.array(end - start), pa.array(period)], ["doc_id", "start", "length", "period"])

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(run, "doc_id long, start long, length long, period long")


def planted(docs: DataFrame) -> DataFrame:
    """:func:`run_digests` of the documents after a tenth of them, by the checksum of the id, has been made periodic from some word on."""
    return run_digests(docs, plant=True)


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    return planted(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op12_periodic_runs": op12_periodic_runs}
ORACLES: dict = {}
