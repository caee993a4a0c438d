"""Ranked lexical search: a block index in shards of documents, searched by Block-Max MaxScore.

A score sums, over the terms of an item, w * part, where w depends on how many documents hold the term and part on its
occurrences in the document and the document's length; both are integers, so results do not depend on the order of sums.

* :func:`build_index` reads every document once and writes a forward table (terms and occurrences of each row), from which it counts
  documents, lengths and document frequencies; then it deals the rows to shards by hash and inverts each shard: rows (shard, term, block,
  first, last, peak, n, packed), a block holding up to BLOCK postings with the parts of :func:`part`, ``peak`` the largest of them.
  Documents of a shard are numbered in order of id; their ids are blocks of a term of their own.
* :func:`search` reads the shards and, for each item, keeps the best ``k`` of the shard.  The lists of an item, in order of their global bound
  (weight times the largest part of the whole index), are split: the lists whose bounds together cannot pass the k-th best score so far are
  not essential.  Window by window of document numbers the postings of the essential lists are unpacked and summed; from the other lists,
  the largest bound first, blocks are unpacked only where a document still passes the k-th score with the peaks of the blocks it lies in.
  The heaps of the shards are merged by rank, of which Spark keeps k for each item and task before it shuffles them.

Terms are named by 64-bit hashes: a term of an item and an unlike one of the corpus agree by chance once in 2**64 pairs.  Items are searched in blocks
whose terms fit ITEM_TERMS; a shard holds about SHARD_POSTINGS postings.  If the terms to be searched are known, only their postings are indexed,
of all rows.

Defined cases: a null or empty text has no terms, is not counted and never found; a null id is the smallest of all; repeated rows are
documents, or items, by themselves; an item without terms, or whose terms no document holds, has no rows; with an empty table of documents or items
the result is empty; other columns of the input are not returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import written
from ._text import Slice, slices, span_hash

TOP = 20
BLOCK = 128
#: Document numbers that are scored together.
WINDOW = 4096
#: Postings of a shard, about; terms of the items that are searched together.
SHARD_POSTINGS, ITEM_TERMS = 2_000_000, 1_000_000
#: Stands for "no term": the blocks of document ids, of which each holds ID_BLOCK.
IDS, ID_BLOCK = 0, 4096

_TERM = np.zeros(256, bool)
_TERM[48:58] = _TERM[65:91] = _TERM[97:123] = _TERM[128:] = True
_INDEX = "shard int, term long, block int, first int, last int, peak long, n int, packed binary"
_FORWARD = "doc_id long, row long, n long, terms binary, times binary"


def _terms(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Hash (never IDS) and row of every term of a slice."""
    black = _TERM[s.data]
    edge = np.zeros(len(black) + 1, bool)
    edge[s.bounds] = True
    before, after = np.zeros(len(black), bool), np.zeros(len(black), bool)
    before[1:], after[:-1] = black[:-1], black[1:]
    starts = np.flatnonzero(black & (~before | edge[:-1]))
    ends = np.flatnonzero(black & (~after | edge[1:])) + 1
    h = span_hash(s.prefix(), starts, ends)
    return np.where(h == IDS, np.uint64(1), h).view(np.int64), np.searchsorted(s.bounds, starts, side="right") - 1


def _counted(term: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, terms and occurrences of the distinct (row, term), in order of both."""
    order = np.lexsort((term, row))
    term, row = term[order], row[order]
    heads = np.flatnonzero(np.append(np.ones(min(1, len(term)), bool), (term[1:] != term[:-1]) | (row[1:] != row[:-1])))
    return row[heads], term[heads], np.diff(np.append(heads, len(term)))


def _forward(docs: DataFrame, doc_id: str, text: str, only: np.ndarray | None) -> DataFrame:
    """Every row that has terms: its number of terms, and those (of ``only``) it holds with their occurrences."""
    session = docs.sparkSession
    known = session.sparkContext.broadcast(only) if only is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column(2), lower=True):
                term, row = _terms(s)
                length = s.per_row(row)
                if known is not None:
                    wanted = known.value
                    at = np.minimum(np.searchsorted(wanted, term), max(0, len(wanted) - 1))
                    mine = wanted[at] == term if len(wanted) else np.zeros(len(term), bool)
                    term, row = term[mine], row[mine]
                row, term, times = _counted(term, row)
                full = np.flatnonzero(length)
                lo, hi = np.searchsorted(row, full), np.searchsorted(row, full, side="right")
                here = pa.array(full + s.first)
                packed = [pa.array([x[a:b].tobytes() for a, b in zip(lo, hi, strict=True)], pa.binary()) for x in (term, times.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(here), batch.column(1).take(here), pa.array(length[full]), *packed], ["doc_id", "row", "n", "terms", "times"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text).cast("string").alias("text"))
    return written(rows.mapInArrow(run, _FORWARD), "forward")


def _frequencies(forward: DataFrame) -> DataFrame:
    """(term, df), counted by batch before it is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            term, df = np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(df)], ["term", "df"])

    return forward.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def part(times: np.ndarray, length: np.ndarray, docs: int, total: int) -> np.ndarray:
    """What a term's occurrences in a document count, before its weight; 64-bit integers, rounded down."""
    m = 100 - 25 + (25 * length * docs) // total
    return (1_000_000_000 * times) // (1000 * times + 12 * m)


def weight(df: int, docs: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def _packed(values: np.ndarray) -> bytes:
    """Non-negative integers at the least width of 1, 2, 4 or 8 bytes that holds them all."""
    wide = next(w for w in (1, 2, 4, 8) if w == 8 or int(values.max(initial=0)) < 1 << 8 * w)
    return bytes([wide]) + values.astype(f"<u{wide}").tobytes()


def _unpacked(raw: bytes, n: int) -> tuple[np.ndarray, bytes]:
    wide = raw[0]
    return np.frombuffer(raw, f"<u{wide}", n, 1).astype(np.int64), raw[1 + wide * n :]


def _block_row(shard: int, term: int, block: int, at: np.ndarray, parts: np.ndarray) -> tuple:
    return shard, term, block, int(at[0]), int(at[-1]), int(parts.max()), len(at), _packed(np.diff(at, prepend=at[:1])) + _packed(parts)


def _inverted(shard: int, held: list[pa.RecordBatch], docs: int, total: int) -> Iterator[tuple]:
    """The index rows of one shard, whose documents come in order."""
    whole = pa.Table.from_batches(held)
    ids = whole.column("doc_id").to_pylist()
    for b, lo in enumerate(range(0, len(ids), ID_BLOCK)):
        own = ids[lo : lo + ID_BLOCK]
        raw = np.array([x or 0 for x in own], np.int64).tobytes() + bytes(x is None for x in own)
        yield shard, IDS, b, lo, lo + len(own) - 1, 0, len(own), raw
    blobs = whole.column("terms").to_pylist()
    size = np.array([len(b) // 8 for b in blobs])
    term = np.frombuffer(b"".join(blobs), np.int64)
    times = np.frombuffer(b"".join(whole.column("times").to_pylist()), np.int32).astype(np.int64)
    at = np.repeat(np.arange(len(ids)), size)
    parts = part(times, np.repeat(whole.column("n").to_numpy(), size), docs, total)
    order = np.argsort(term, kind="stable")
    term, at, parts = term[order], at[order], parts[order]
    edges = [*np.flatnonzero(np.append(np.ones(min(1, len(term)), bool), term[1:] != term[:-1])), len(term)]
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        for b, k in enumerate(range(lo, hi, BLOCK)):
            yield _block_row(shard, int(term[lo]), b, at[k : min(k + BLOCK, hi)], parts[k : min(k + BLOCK, hi)])


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        shards = batch.column("shard").to_numpy()
        cuts = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1), len(shards)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if hi > lo:
                if held and shards[lo] != now:
                    yield now, held
                    held = []
                now = int(shards[lo])
                held.append(batch.slice(lo, hi - lo))
    if held:
        yield now, held


def build_index(docs: DataFrame, only: np.ndarray | None = None, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame, int]:
    """The index of ``docs`` (rows as above), the table (term, df), and the number of documents with terms.

    ``only``: sorted hashes of the terms whose postings are wanted; None indexes all.
    """
    forward = _forward(docs, doc_id, text, only)
    n, total, postings = forward.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.length("terms") / 8), F.lit(0))).first()
    shards = max(docs.sparkSession.sparkContext.defaultParallelism, math.ceil(postings / SHARD_POSTINGS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, held in _by_shard(batches):
            rows: list[tuple] = []
            for row in _inverted(shard, held, n, total):
                rows.append(row)
                if len(rows) == 4096:
                    yield _index_batch(rows)
                    rows = []
            if rows:
                yield _index_batch(rows)

    dealt = forward.withColumn("shard", F.pmod(F.xxhash64("doc_id", "row"), F.lit(shards)).cast("int"))
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "doc_id", "row")
    return written(dealt.mapInArrow(run, _INDEX), "index"), written(_frequencies(forward), "frequencies"), n


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in _INDEX.split(", ")])


class _List:
    """The blocks of one term in a shard."""

    def __init__(self, first: np.ndarray, last: np.ndarray, peak: np.ndarray, n: np.ndarray, packed: list[bytes]):
        self.first, self.last, self.peak, self.n, self.packed = first, last, peak, n, packed
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Document numbers and parts of a block, unpacked once."""
        if b not in self.open:
            gaps, rest = _unpacked(self.packed[b], self.n[b])
            parts, _ = _unpacked(rest, self.n[b])
            self.open[b] = (self.first[b] + np.cumsum(gaps), parts)
        return self.open[b]

    def between(self, lo: int, hi: int) -> range:
        """Numbers of the blocks that reach into documents lo to hi, hi excluded."""
        return range(int(np.searchsorted(self.last, lo)), int(np.searchsorted(self.first, hi)))


class Shard:
    """The lists of one shard, and the search in them."""

    def __init__(self, held: list[pa.RecordBatch]):
        whole = pa.Table.from_batches(held)
        term = whole.column("term").to_numpy()
        first, last, peak, n = (whole.column(c).to_numpy() for c in ("first", "last", "peak", "n"))
        packed = whole.column("packed").to_pylist()
        edges = [*np.flatnonzero(np.append(True, term[1:] != term[:-1])), len(term)]
        self.lists: dict[int, _List] = {}
        self.docs = 0
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if term[lo] == IDS:
                self.ids = np.concatenate([np.frombuffer(p, np.int64, k) for p, k in zip(packed[lo:hi], n[lo:hi], strict=True)])
                self.nulls = np.concatenate([np.frombuffer(p, np.uint8, k, 8 * k) for p, k in zip(packed[lo:hi], n[lo:hi], strict=True)]) > 0
                self.docs = len(self.ids)
            else:
                self.lists[int(term[lo])] = _List(first[lo:hi], last[lo:hi], peak[lo:hi], n[lo:hi], packed[lo:hi])

    def best(self, terms: list[tuple[int, int, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and scores of the k best documents for (term, weight, bound): highest score first, then lowest number."""
        mine = sorted(((w * bound, w, self.lists[t]) for t, w, bound in terms if t in self.lists and w > 0), key=lambda x: x[0])
        reach = np.cumsum([b for b, _, _ in mine])
        heap_at, heap = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for lo in range(0, self.docs, WINDOW):
            hi = min(lo + WINDOW, self.docs)
            floor = int(heap[-1]) if len(heap) == k else 0
            easy = int(np.searchsorted(reach, floor, side="right"))  # lists that cannot pass the floor together
            if easy == len(mine):
                break
            score, seen = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, bool)
            for _, w, postings in mine[easy:]:
                for b in postings.between(lo, hi):
                    self._add(postings, b, w, lo, hi, score, seen)
            at = np.flatnonzero(seen)
            for j in range(easy - 1, -1, -1):
                if not len(at):
                    break
                _, w, postings = mine[j]
                rest = int(reach[j - 1]) if j else 0
                block = np.minimum(np.searchsorted(postings.last, at + lo), len(postings.last) - 1)
                inside = (postings.first[block] <= at + lo) & (at + lo <= postings.last[block])
                most = score[at] + rest + np.where(inside, w * postings.peak[block], 0)
                at, block, inside = at[most > floor], block[most > floor], inside[most > floor]
                for b in np.unique(block[inside]):
                    self._add(postings, int(b), w, lo, hi, score, None)
            at = at[score[at] > floor]
            heap_at, heap = np.concatenate([heap_at, at + lo]), np.concatenate([heap, score[at]])
            order = np.lexsort((heap_at, -heap))[:k]
            heap_at, heap = heap_at[order], heap[order]
        return heap_at, heap

    @staticmethod
    def _add(postings: _List, b: int, w: int, lo: int, hi: int, score: np.ndarray, seen: np.ndarray | None) -> None:
        where, parts = postings.block(b)
        a, z = np.searchsorted(where, (lo, hi))
        score[where[a:z] - lo] += w * parts[a:z]  # a document stands once in a list
        if seen is not None:
            seen[where[a:z] - lo] = True


def _item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, item, term, times) of every distinct term of every row of ``items``; ``item`` tells rows apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column(2), lower=True):
                row, term, times = _counted(*_terms(s))
                at = pa.array(row + s.first)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(term), pa.array(times)], ["item_id", "item", "term", "times"])

    rows = items.select(F.col(item_id).alias("item_id").cast("long"), F.monotonically_increasing_id().alias("item"), F.col(text).cast("string").alias("text"))
    return written(rows.mapInArrow(run, "item_id long, item long, term long, times long"), "item-terms")


def search(index: DataFrame, frequencies: DataFrame, n: int, terms: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score) of the k best documents with a score above 0 for every item of ``terms``, as of :func:`_item_terms`.

    ``terms`` holds ITEM_TERMS rows at most; they go to every shard.
    """
    peaks = index.where(F.col("term") != IDS).groupBy("term").agg(F.max("peak").alias("bound"))
    asked = terms.join(frequencies, "term").join(peaks, "term").select("item_id", "item", "term", "times", "df", "bound").toArrow()
    items: dict[int, list[tuple[int, int, int]]] = {}
    for item, term, times, df, bound in zip(*(asked.column(c).to_pylist() for c in ("item", "term", "times", "df", "bound")), strict=True):
        items.setdefault(item, []).append((term, times * weight(df, n), bound))
    names = dict(zip(asked.column("item").to_pylist(), asked.column("item_id").to_pylist(), strict=True))
    known = index.sparkSession.sparkContext.broadcast((items, names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, called = known.value
        for _, held in _by_shard(batches):
            shard = Shard(held)
            for item, asks in wanted.items():
                at, score = shard.best(asks, k)
                if len(at):
                    ids = pa.array(shard.ids[at], mask=shard.nulls[at])
                    yield pa.RecordBatch.from_arrays([pa.array([called[item]] * len(at), pa.int64()), pa.array([item] * len(at), pa.int64()), ids, pa.array(score)], ["item_id", "item", "doc_id", "score"])

    shards = max(1, index.agg(F.max("shard")).first()[0] or 0) + 1
    heaps = index.repartition(shards, "shard").sortWithinPartitions("shard", "term", "block").mapInArrow(run, "item_id long, item long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc("doc_id")))
    return heaps.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """(item_id, rank, doc_id, score) of the k best of all ``docs`` for every row of ``items``; items go in blocks of ITEM_TERMS terms."""
    terms = _item_terms(items, item_id, text)
    blocks = max(1, math.ceil(terms.count() / ITEM_TERMS))
    out = None
    for b in range(blocks):
        mine = terms.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        only = np.sort(mine.select("term").distinct().toArrow().column(0).to_numpy())
        found = search(*build_index(docs, only, text, doc_id), mine, k)
        out = found if out is None else out.unionByName(found)
    return out


def op13_lexical_search(spark, sf_dir: str) -> DataFrame:
    return ranked(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op13_lexical_search": op13_lexical_search}
ORACLES = {
    "op13_lexical_search": r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS g FROM documents),
    g AS (SELECT count(*) AS nd, sum(len(g))::BIGINT AS nt FROM d WHERE len(g) > 0),
    q AS (SELECT item_id, t, count(*) AS c FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY item_id, t),
    p AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(g) AS n, unnest(g) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY doc_id, n, t),
    w AS (SELECT t, floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, g GROUP BY t, nd),
    s AS (SELECT item_id, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * nd) // nt)))))::BIGINT AS score
          FROM q JOIN p USING (t) JOIN w USING (t), g GROUP BY item_id, doc_id),
    r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
    SELECT * FROM r WHERE rank <= 20"""
}
