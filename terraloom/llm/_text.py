"""Vectorised helpers over Arrow string columns, shared by the text operators.

Words are the maximal runs outside ``[\\x20\\x09-\\x0D]``.  Everything works on the raw UTF-8 buffer of a
slice of rows, so no Python object is made for a word.  Hashes are 64 bits wide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Rows are worked on in slices of about this many bytes of text; a longer text is a slice by itself.
SLICE_BYTES = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: For a second hash, where 64 bits are too few to name content.
_BASE_2 = np.uint64(0xD1342543DE82EF95)
_INVERSE_2 = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        step = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        step[0] = 1
        have = np.multiply.accumulate(step)
        if len(have) <= SLICE_BYTES + 1:  # those of a longer text are not held
            _powers[kind] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser for 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Slice:
    """Some rows of a string column: ``data`` (uint8) and ``bounds`` (row i is data[bounds[i]:bounds[i+1]])."""

    def __init__(self, column: pa.Array, first: int, lower: bool = False):
        if column.null_count:
            column = column.fill_null("")
        column = column.cast(pa.large_string())
        self.first, self.rows = first, len(column)
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64, self.rows + 1, column.offset * 8) if self.rows else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.data = raw[at[0] : at[-1]]
        self.bounds = at - at[0]
        if lower:
            self.data = LOWER[self.data]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end (byte offsets) and row of every word."""
        black = ~SPACE[self.data]
        n = len(black)
        edge = np.zeros(n + 1, bool)
        edge[self.bounds] = True
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], before[1:] = False, black[:-1]
            after[-1], after[:-1] = False, black[1:]
        starts = np.flatnonzero(black & (~before | edge[:n]))
        ends = np.flatnonzero(black & (~after | edge[1:])) + 1
        return starts, ends, np.searchsorted(self.bounds, starts, side="right") - 1

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and row of every ``\\n``-split line; an empty text is one empty line."""
        breaks = np.flatnonzero(self.data == 10)
        starts = np.sort(np.concatenate([self.bounds[:-1], breaks + 1]), kind="stable")
        # A break at the very end of a row and the next row's start share an offset: keep both, in order.
        row = np.repeat(np.arange(self.rows), np.searchsorted(breaks, self.bounds[1:]) - np.searchsorted(breaks, self.bounds[:-1]) + 1)
        last = np.append(row[1:] != row[:-1], True) if len(row) else np.zeros(0, bool)
        ends = np.empty(len(row), np.int64)
        ends[last] = self.bounds[1:]
        ends[~last] = breaks
        return starts, ends, row

    def prefix(self, second: bool = False) -> np.ndarray:
        """Cumulative polynomial sums, for :func:`span_hash`."""
        out = np.zeros(len(self.data) + 1, np.uint64)
        power = _power("up 2", _BASE_2, len(self.data)) if second else _power("up", _BASE, len(self.data))
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * power, out=out[1:])
        return out

    def points(self) -> np.ndarray:
        """points()[i]: code points that begin before byte i."""
        out = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=out[1:])
        return out

    def per_row(self, row: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        out = np.bincount(row, weights, minlength=self.rows)
        return out.astype(np.int64) if weights is None or weights.dtype.kind in "biu" else out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, second: bool = False) -> np.ndarray:
    """64-bit hash of each byte span, the same wherever the span lies; ``second`` as for ``prefix``."""
    down = _power("down 2", _INVERSE_2, len(prefix)) if second else _power("down", _INVERSE, len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def gram_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words (their hashes); len(words) - n + 1 values."""
    out = words[: len(words) - n + 1].copy() if len(words) >= n else np.zeros(0, np.uint64)
    for k in range(1, n):
        out = out * _BASE + words[k : len(words) - n + 1 + k]
    return mix(out + np.uint64(n))


def slices(column: pa.Array, lower: bool = False) -> Iterator[Slice]:
    """The whole column in slices of about SLICE_BYTES; unused memory goes back after the last."""
    n = len(column)
    if not n:
        return
    column = column.cast(pa.large_string())
    at = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + SLICE_BYTES, side="right")) - 1)
        yield Slice(column.slice(lo, min(hi, n) - lo), lo, lower)
        lo = hi
    pa.default_memory_pool().release_unused()


def parts(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of ``rows`` rows, so that few texts are Python strings at a time; unused memory goes back."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
        pa.default_memory_pool().release_unused()


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks: the key occurs more than once; the key occurred at an earlier position."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys), bool)
    if len(keys):
        ranked = keys[order]
        same[1:] = ranked[1:] == ranked[:-1]
    often, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order] = same
    both = same.copy()
    both[:-1] |= same[1:]
    often[order] = both
    return often, later
