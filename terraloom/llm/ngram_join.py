"""Exact Jaccard self-join of documents on word n-grams, by universe partition and the pigeonhole principle.

Two sets with |X n Y| >= t |X u Y| differ in at most H = floor((1-t)/(1+t) (|X|+|Y|)) shingles.  Sizes fall into octave
bands; a band's universe is hashed into segments, so of any H + 1 segments the two sets agree in one.

* Most documents: a segment's signature hashes its shingles.  Segments are put in one global order by their cost - first
  those with a shingle that is not frequent, then larger ones - and a document indexes its H + 1 cheapest.  The cheapest
  segment that two sets share is preceded by at most H others in either, so both index it.  (Below SMALL shingles
  each shingle is a segment of its own.)
* Documents made mostly of frequent shingles would index what everybody has.  They use half as many, larger segments:
  of (H + 1) / 2 segments one differs in at most one shingle, so all are indexed with their one-deletion neighbourhoods.
  A linked pair's shares of frequent shingles differ by a factor of at most t, so documents in between index both ways.

A document whose partner may lie in the band below is indexed there too.  Frequent shingles come from lossy counting over
all documents: they steer cost only, never correctness.

Equal sets are one node from the start.  A signature's nodes form a star around the smallest; star pairs are verified
exactly, on the texts; signatures whose nodes are still in different components get further stars, and at last the pairs
across components, so that no pair under any signature is left both unverified and unconnected.  So no group is expanded to
all pairs while one component holds it, and no link between components is lost.  Before texts are fetched, pairs must pass a
bound that every link passes: sizes, and parities of the shingles by bit of a hash, of which each shingle that the sets do
not share flips one.  Sets too large for the bits that all have are told apart by as many bits as their size calls for.

Rows and sets are named by 128 bits, and each set by a number from then on; pairs are verified by the shingles of both texts.

Defined cases: null, empty or blank texts have no shingles and link to nothing (component_id is their own id); texts with
fewer than n words have their whole sequence as one shingle; repeated rows and copies share a component; rows that repeat
an id are separate documents; a null id never is a component_id unless all ids of the component are null; an empty table
gives an empty result; other columns of the input are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import small_batches, written
from ._text import Slice, gram_hash, mix, slices, span_hash
from .graph import components

N_WORDS = 5
#: The threshold as a fraction, so that comparisons are exact.
NUM, DEN = 3, 4
SMALL = 32
#: Shingles of more than 1 document in FREQUENT count as frequent.
FREQUENT = 1024
#: Above HIGH of frequent shingles only large segments, below HIGH * t only small ones, between them both.
HIGH = 0.7
#: The largest id list that is broadcast, by rows, about 50 MB; longer ones are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Longs of a set's parity sketch.
SKETCH = 16
_BITS = [f"p{k}" for k in range(SKETCH)]
#: Sets of more shingles have a wide sketch too: of more than about 1800, almost any two differ in fewer of 1024 parities than they may.
LARGE = 700


def shingles(s: Slice, n: int = N_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, and their rows (ascending)."""
    starts, ends, row = s.words()
    word = span_hash(s.prefix(), starts, ends)
    out, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    if len(word) >= n:
        at = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :])
        out.append(gram_hash(word, n)[at])
        rows.append(row[at])
    count = np.bincount(row, minlength=s.rows)
    first = np.cumsum(count) - count
    for k in range(1, n):
        few = np.flatnonzero(count == k)
        if len(few):
            out.append(gram_hash(word, k)[first[few]])
            rows.append(few)
    h, row = np.concatenate(out), np.concatenate(rows)
    one = _first_of_each(h + mix(row.astype(np.uint64) + np.uint64(1)))
    h, row = h[one], row[one]
    if len(out) > 2:
        order = np.argsort(row, kind="stable")
        h, row = h[order], row[order]
    return h, row


def _first_of_each(keys: np.ndarray) -> np.ndarray:
    """Mask: one place of each distinct key.  An unstable sort will do, since rows with equal keys are alike, and is several times faster."""
    order = np.argsort(keys)
    ranked = keys[order]
    out = np.ones(len(keys), bool)
    out[order[1:][ranked[1:] == ranked[:-1]]] = False
    return out


def _sums(row: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """Sum (mod 2**64) per row; row ascends."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    edge = np.searchsorted(row, np.arange(rows + 1))
    return total[edge[1:]] - total[edge[:-1]]


def _keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.select(_row_key("doc_id", "text").alias("row_key"), "doc_id", "text")


def _row_key(doc_id: str, text: str) -> Column:
    """A 128-bit name of a row: the same for equal id and text only."""
    return F.md5(F.concat(F.coalesce(F.col(doc_id).cast("long").cast("string"), F.lit("-")), F.lit(":"), F.coalesce(F.col(text).cast("string"), F.lit(""))))


def _parities(h: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Sketch of each set: bit b says whether an odd number of its shingles hash to b. One shingle more or less flips one bit."""
    out = np.zeros((rows, SKETCH), np.int64)
    wide = SKETCH * 64
    bit = (mix(h + np.uint64(11)) % np.uint64(wide)).astype(np.int64)
    for lo in range(0, rows, 1024):
        hi = min(rows, lo + 1024)
        i, j = np.searchsorted(row, (lo, hi))
        odd = np.bincount((row[i:j] - lo) * wide + bit[i:j], minlength=(hi - lo) * wide) & 1
        out[lo:hi] = np.packbits(odd.astype(bool).reshape(hi - lo, wide), axis=1).view(np.int64)
    return out


def _wide(h: np.ndarray, row: np.ndarray, rows: int) -> pa.Array:
    """Parities of each set of more than LARGE shingles by 2 to 4 bits a shingle, a power of two, as bytes; null for others."""
    edge = np.searchsorted(row, np.arange(rows + 1))
    out = []
    for lo, hi in zip(edge[:-1], edge[1:], strict=True):
        bits = max(64, 2 << int(hi - lo).bit_length())
        odd = np.bincount((mix(h[lo:hi] + np.uint64(11)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1 if hi - lo > LARGE else None
        out.append(None if odd is None else np.packbits(odd.astype(bool)).tobytes())
    return pa.array(out, pa.binary())


def _flipped(a: bytes, b: bytes) -> int:
    """Parities that differ between two wide sketches; the larger is folded to the bits of the other."""
    x, y = (np.frombuffer(v, np.uint64) for v in sorted((a, b), key=len))
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _still_near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The (a, b) of (a, b, size, wide_a, wide_b) in which no more parities differ than shingles may; size is of both sets."""
    for batch in batches:
        sizes, wide_a, wide_b = batch.column(2).to_numpy(), batch.column(3), batch.column(4)
        near = [(DEN + NUM) * _flipped(x.as_py(), y.as_py()) <= (DEN - NUM) * int(n) for n, x, y in zip(sizes, wide_a, wide_b, strict=True)]
        out = batch.filter(pa.array(near, pa.bool_()))
        yield pa.RecordBatch.from_arrays([out.column(0), out.column(1)], ["a", "b"])


def _may_link(a: str, b: str) -> Column:
    """Necessary for a link of two nodes whose sizes and sketches have these suffixes: the sizes are near enough, and no more parities differ than shingles may."""
    differ = sum((F.bit_count(F.col(f"p{k}{a}").bitwiseXOR(F.col(f"p{k}{b}"))) for k in range(1, SKETCH)), F.bit_count(F.col(f"p0{a}").bitwiseXOR(F.col(f"p0{b}"))))
    x, y = F.col(f"n_shingles{a}"), F.col(f"n_shingles{b}")
    return (NUM * F.greatest(x, y) <= DEN * F.least(x, y)) & ((DEN + NUM) * differ <= (DEN - NUM) * (x + y))


def _sketches(nodes: DataFrame, suffix: str) -> DataFrame:
    return nodes.select(F.col("node").alias(f"node{suffix}"), F.col("n_shingles").alias(f"n_shingles{suffix}"), *[F.col(p).alias(p + suffix) for p in _BITS])


def _sized(keyed: DataFrame, n: int) -> DataFrame:
    """(row_key, doc_id, n_shingles, name, name_2, sketch, wide): two hashes name the set; without shingles they are the row's own."""
    names = ["row_key", "doc_id", "n_shingles", "name", "name_2", *_BITS, "wide"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column(2), lower=True):
                h, row = shingles(s, n)
                size = np.bincount(row, minlength=s.rows)
                part = batch.slice(s.first, s.rows)
                name = [mix(_sums(row, mix(h + np.uint64(salt)), s.rows) + size.astype(np.uint64)).view(np.int64) for salt in (0, 29)]
                for i in np.flatnonzero(size == 0):
                    name[0][i] = int(part.column(0)[int(i)].as_py()[:15], 16)
                bits = _parities(h, row, s.rows)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(size.astype(np.int64)), *map(pa.array, name), *(pa.array(bits[:, k].copy()) for k in range(SKETCH)), _wide(h, row, s.rows)], names)

    kinds = {"row_key": "string", "wide": "binary"}
    return keyed.mapInArrow(run, ", ".join(f"{c} {kinds.get(c, 'long')}" for c in names))


def frequent_shingles(keyed: DataFrame, n: int, total: int) -> np.ndarray:
    """Sorted hashes of the shingles in more than 1 of FREQUENT documents.

    Lossy counting: a batch of 2 FREQUENT documents or more drops what fewer than 1 of 2 FREQUENT of them, or just one, have, so
    counts miss at most that share.  At most FREQUENT x (mean shingles of a document) come out, whatever the corpus.
    """

    def counts(found: list[np.ndarray], rows: int) -> pa.RecordBatch:
        h, count = np.unique(np.concatenate(found), return_counts=True)
        often = count >= max(2, rows / (2 * FREQUENT))
        return pa.RecordBatch.from_arrays([pa.array(h[often].view(np.int64)), pa.array(count[often].astype(np.int64))], ["shingle", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rows = [], 0
        for batch in batches:
            for s in slices(batch.column(2), lower=True):
                found.append(shingles(s, n)[0])
                rows += s.rows
                if rows >= 2 * FREQUENT:
                    yield counts(found, rows)
                    found, rows = [], 0
        if found:
            yield counts(found, rows)

    counted = keyed.mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    few = counted.where(F.col("n") > max(2, total / (2 * FREQUENT))).select("shingle")
    return np.sort(few.toArrow().column(0).to_numpy().view(np.uint64))


def _groups(row: np.ndarray, seg: np.ndarray, h: np.ndarray, light: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, segment, sum of hashes, size and lightness of each (row, segment)."""
    order = np.argsort((row.astype(np.uint64) << np.uint64(40)) + seg.astype(np.uint64))
    row, seg, h, light = row[order], seg[order], mix(h[order] + np.uint64(7)), light[order]
    heads = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (seg[1:] != seg[:-1]))) if len(row) else np.zeros(0, np.int64)
    total = np.add.reduceat(h, heads) if len(heads) else h
    size = np.diff(np.append(heads, len(row)))
    any_light = np.maximum.reduceat(light, heads) if len(heads) else light
    return row[heads], seg[heads], total, size, any_light


def _signature(band: np.ndarray, seg: np.ndarray, total: np.ndarray, size: np.ndarray) -> np.ndarray:
    return mix(mix(total + size.astype(np.uint64)) + mix(seg.astype(np.uint64) * np.uint64(128) + band.astype(np.uint64) + np.uint64(1)))


def _few_segments(row, h, light, band, need, rows):
    """The ``need`` cheapest segments of each row under its ``band`` (0: each shingle is a segment)."""
    use = need[row] > 0
    row, h, light = row[use], h[use], light[use]
    m = np.where(band > 0, (np.int64(1) << np.maximum(band, 1)) // 2 + 2, 1 << 40)
    # Band b covers sizes from 2**(b-1) up to 2**b.
    seg = (mix(h) % m[row].astype(np.uint64)).astype(np.int64)
    g_row, g_seg, total, size, fine = _groups(row, seg, h, light)
    sig = _signature(band[g_row], g_seg, total, size)
    cost = (g_row.astype(np.uint64) << np.uint64(40)) | ((~fine).astype(np.uint64) << np.uint64(38)) | (np.uint64(63) - np.minimum(size, 63).astype(np.uint64)) << np.uint64(32) | sig >> np.uint64(32)
    order = np.argsort(cost, kind="stable")
    g_row, sig = g_row[order], sig[order]
    have = np.bincount(g_row, minlength=rows)
    rank = np.arange(len(g_row)) - (np.cumsum(have) - have)[g_row]
    keep = rank < need[g_row]
    out, at = [sig[keep]], [g_row[keep]]
    for i in np.flatnonzero(have < need):  # then empty segments count too, in the order of their number
        taken = g_seg[order][g_row == i]
        spare = np.setdiff1d(np.arange(m[i]), taken)[: need[i] - have[i]]
        out.append(_signature(np.full(len(spare), band[i]), spare, np.zeros(len(spare), np.uint64), np.zeros(len(spare), np.int64)))
        at.append(np.full(len(spare), i))
    return np.concatenate(out), np.concatenate(at)


def _neighbourhoods(row, h, band, use):
    """All segments, half as many as H + 1, of the rows in ``use``, with their one-deletion neighbourhoods."""
    mine = use[row]
    row, h = row[mine], h[mine]
    top = np.where(band > 0, np.int64(1) << band, SMALL)
    m = (top // 3 + 1 + 1) // 2
    seg = (mix(h + np.uint64(5)) % m[row].astype(np.uint64)).astype(np.int64)
    g_row, g_seg, total, size, _ = _groups(row, seg, h, np.ones(len(h), bool))
    far = band + 64
    out, at = [_signature(far[g_row], g_seg, total, size)], [g_row]
    key = np.searchsorted(g_row * (np.int64(1) << 30) + g_seg, row * (np.int64(1) << 30) + seg)
    out.append(_signature(far[row], seg, total[key] - mix(h + np.uint64(7)), size[key] - 1))
    at.append(row)
    # Segments without a shingle are the one-deletion neighbours of single ones.
    count = np.bincount(g_row, minlength=len(use))
    for i in np.flatnonzero(use & (count < m)):
        spare = np.setdiff1d(np.arange(m[i]), g_seg[g_row == i])
        out.append(_signature(np.full(len(spare), far[i]), spare, np.zeros(len(spare), np.uint64), np.zeros(len(spare), np.int64)))
        at.append(np.full(len(spare), i))
    return np.concatenate(out), np.concatenate(at)


def signatures(s: Slice, n: int, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures and their rows."""
    h, row = shingles(s, n)
    size = np.bincount(row, minlength=s.rows)
    at = np.searchsorted(frequent, h)
    common = at < len(frequent)
    common[common] = frequent[at[common]] == h[common]
    share = np.bincount(row, common, minlength=s.rows) / np.maximum(size, 1)
    band = np.where(size < SMALL, 0, np.frexp(np.maximum(size, 1))[1]).astype(np.int64)
    least = np.where(band == 0, 0, np.int64(1) << np.maximum(band - 1, 0))
    own = (size + size * DEN // NUM) // 7
    below = (size + least - 1) // 7
    lower = np.where(band == np.frexp(SMALL)[1], 0, band - 1)
    crosses = (band > 0) & (size * NUM <= (least - 1) * DEN)
    near, far = share <= HIGH, share >= HIGH * NUM / DEN
    linkable = size > 2  # smaller sets link to equal ones only
    found = [
        _few_segments(row, h, ~common, band, np.where(linkable & near, own + 1, 0), s.rows),
        _few_segments(row, h, ~common, lower, np.where(crosses & near, below + 1, 0), s.rows),
        _neighbourhoods(row, h, band, linkable & far),
        _neighbourhoods(row, h, lower, crosses & far),
    ]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _indexed(reps: DataFrame, n: int, frequent) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column(1).to_numpy()
            for s in slices(batch.column(0), lower=True):
                sig, row = signatures(s, n, frequent.value)
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(node[s.first + row])], ["sig", "node"])

    return reps.select("text", "node").mapInArrow(run, "sig long, node long")


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of (sig, node): each later node of a signature with the first; sig is null where there are but two."""
    sig, node, first = np.zeros(0, np.int64), np.zeros(0, np.int64), None
    held = None  # the last signature so far, its first node, its last node
    for batch in batches:
        sig, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(sig):
            continue
        old = 0
        if held is not None:
            old = 2
            sig, node = np.concatenate([[held[0], held[0]], sig]), np.concatenate([[held[1], held[2]], node])
        head = np.append(True, sig[1:] != sig[:-1])
        group = np.cumsum(head) - 1
        first = node[np.flatnonzero(head)][group]
        new = np.append(True, (node[1:] != node[:-1]) | head[1:])
        new[:old] = False
        other = np.flatnonzero(new & (node != first))
        distinct = np.bincount(group, np.append(True, (node[1:] != node[:-1]) | head[1:]))
        open_end = group == group[-1]
        pair = (distinct[group] == 2) & ~open_end & (group > 0)
        yield pa.RecordBatch.from_arrays([pa.array(sig[other], pa.int64(), mask=pair[other]), pa.array(first[other]), pa.array(node[other])], ["sig", "rep", "node"])
        held = sig[-1], first[-1], node[-1]


def _verified(pairs: DataFrame, keyed: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose sets reach the threshold, from whole texts."""
    near = pairs.withColumnsRenamed({"a": "node_a", "b": "node_b"}).join(_sketches(nodes, "_a"), "node_a").join(_sketches(nodes, "_b"), "node_b").where(_may_link("_a", "_b"))
    x, y = F.col("n_shingles_a"), F.col("n_shingles_b")
    pairs = written(near.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), (x + y).alias("size"), (F.least(x, y) > LARGE).alias("large")), "pairs")
    large = pairs.where("large")
    if not large.isEmpty():
        wide = nodes.where("wide IS NOT NULL").select("node", "wide")
        large = large.join(wide.toDF("a", "wide_a"), "a").join(wide.toDF("b", "wide_b"), "b").select("a", "b", "size", "wide_a", "wide_b")
        pairs = written(pairs.where("NOT large").select("a", "b").unionByName(large.mapInArrow(_still_near, "a long, b long")), "pairs")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(nodes.select("node", "row_key"), "node")
    wanted = written(wanted, "wanted")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    texts = keyed.select("row_key", "text").join(wanted, "row_key").select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.maximum.accumulate(np.cumsum(np.asarray(batch.column(4)) + 1))
            lo = 0
            while lo < batch.num_rows:
                base = lengths[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(lengths, base + (1 << 21), side="right")))
                part = batch.slice(lo, hi - lo)
                sizes, keys = [], []
                for k in (2, 3):
                    h, row = shingles(Slice(part.column(k), 0, lower=True), n)
                    sizes.append(np.bincount(row, minlength=part.num_rows))
                    keys.append((row, h + mix(row.astype(np.uint64) + np.uint64(1))))
                row, key = np.concatenate([keys[0][0], keys[1][0]]), np.concatenate([keys[0][1], keys[1][1]])
                union = np.bincount(row[_first_of_each(key)], minlength=part.num_rows)
                linked = DEN * (sizes[0] + sizes[1] - union) >= NUM * union
                out = part.filter(pa.array(linked))
                yield pa.RecordBatch.from_arrays([out.column(0), out.column(1)], ["a", "b"])
                lo = hi

    both = pairs.select("a", "b").join(texts.toDF("b", "text_b"), "b").join(texts.toDF("a", "text_a"), "a")
    both = both.select("a", "b", "text_a", "text_b", (F.octet_length("text_a") + F.octet_length("text_b")).cast("long").alias("size"))
    return written(both.mapInArrow(run, "a long, b long").distinct(), "links")


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after more links: components of the graph of roots."""
    if links.isEmpty():
        return roots
    a, b = roots.toDF("a", "ra"), roots.toDF("b", "rb")
    between = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    up = written(components(between), "roots").toDF("root", "up")
    old = roots.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    return written(old.unionByName(up.select(F.col("root").alias("node"), F.col("up").alias("root")).join(roots, "node", "left_anti")), "roots")


def jaccard_components(docs: DataFrame, n: int = N_WORDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """See :func:`_components`; its jobs work in small batches."""
    with small_batches(docs.sparkSession):
        return _components(docs, n, text, doc_id)


def _components(docs: DataFrame, n: int, text: str, doc_id: str) -> DataFrame:
    """(doc_id, n_shingles, component_id, row_key, root) of every row; row_key is the same for equal rows only, and root for
    rows of one component only, whatever their ids (null without shingles)."""
    spark = docs.sparkSession
    keyed = _keyed(docs, text, doc_id)
    sized = written(_sized(keyed, n), "sized")
    nodes = sized.where("n_shingles > 0").groupBy("name", "name_2").agg(F.min("row_key").alias("row_key"), F.min("doc_id").alias("low"), *[F.first(c).alias(c) for c in ("n_shingles", *_BITS, "wide")])
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    total = sized.count()
    frequent = spark.sparkContext.broadcast(frequent_shingles(keyed, n, total))
    chosen = nodes.select("row_key", "node")
    if nodes.count() <= BROADCAST_ROWS:
        chosen = F.broadcast(chosen)
    index = _indexed(keyed.join(chosen, "row_key"), n, frequent)
    stars = written(index.repartition("sig").sortWithinPartitions("sig", "node").mapInArrow(_stars, "sig long, rep long, node long"), "stars")
    links = _verified(stars.select(F.col("rep").alias("a"), F.col("node").alias("b")).distinct(), keyed, nodes, n)
    roots = written(components(links), "roots")

    wide = stars.where("sig IS NOT NULL")
    members = written(wide.select("sig", "node").unionByName(wide.select("sig", F.col("rep").alias("node")).distinct()), "members")
    # Signatures that still join different components get another star, around a node of the component that has most of
    # their nodes, as long as the last star linked 1 in 100 of the nodes and the pairs across outnumber the nodes.
    turn, gain, apart = 0, 1, 0
    while True:
        placed = members.join(roots, "node", "left").select("sig", "node", F.coalesce("root", "node").alias("root"))
        by_root = placed.groupBy("sig", "root").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node")).alias("pick"))
        split = by_root.groupBy("sig").agg(F.count(F.lit(1)).alias("roots"), F.max(F.struct("n", "root", F.col("pick.node").alias("node"))).alias("c"), ((F.pow(F.sum("n"), 2) - F.sum(F.col("n") * F.col("n"))) / 2).alias("across")).where("roots > 1")
        members = written(placed.join(split.select("sig", F.col("c.node").alias("centre"), F.col("c.root").alias("centre_root"), "across"), "sig"), "members")
        size = members.groupBy("sig").agg(F.first("across").alias("across"), F.count(F.lit(1)).alias("n")).agg(F.sum("across"), F.sum("n")).first()
        if not size[1] or size[0] <= 2 * size[1] or 100 * gain < apart:
            break
        apart = members.select("node").distinct().count()
        more = _verified(members.where("root <> centre_root").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct(), keyed, nodes, n)
        roots, gain = _merged(roots, more), more.count()
        members, turn = members.select("sig", "node"), turn + 1
    rest = members.select("sig", "node", "root").join(nodes.select("node", "n_shingles", *_BITS), "node")
    left, right = (rest.withColumnsRenamed({c: f"{c}_{side}" for c in rest.columns}) for side in "ab")
    ahead = (F.col("sig_a") == F.col("sig_b")) & (F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b"))
    across = left.join(right, ahead & _may_link("_a", "_b"))
    more = _verified(across.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct(), keyed, nodes, n)
    roots = _merged(roots, more)

    named = roots.join(nodes.select("node", "low"), "node")
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    by_node = named.join(lowest, "root").select("node", "root", "component_id")
    final = nodes.join(by_node, "node", "left").select("name", "name_2", F.coalesce("root", "node").alias("root"), F.coalesce("component_id", "low").alias("component_id"))
    done = sized.join(final, ["name", "name_2"], "left")
    return done.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "row_key", "root")


def keep_one(docs: DataFrame, n: int = N_WORDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` without shingles, and of every component one row: the first by (id, row_key)."""
    found = written(jaccard_components(docs, n, text, doc_id), "found")
    first = found.where("n_shingles > 0 AND doc_id <=> component_id").groupBy("root").agg(F.min("row_key").alias("row_key")).select("row_key")
    chosen = written(first.unionByName(found.where("n_shingles = 0").select("row_key")).distinct(), "kept")
    twice = written(found.where("n_shingles > 0").groupBy("row_key").count().where("count > 1").select("row_key"), "twice")
    if chosen.count() <= BROADCAST_ROWS:
        chosen = F.broadcast(chosen)
    wide = docs.select(_row_key(doc_id, text).alias("row_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).join(chosen, "row_key", "left_semi")
    if not twice.isEmpty():  # equal rows with shingles are copies of each other too
        wide = wide.join(twice, "row_key", "left_anti").unionByName(wide.join(twice, "row_key", "left_semi").dropDuplicates(["row_key"]))
    return wide.select("row.*")


def op3_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


ORACLES = {
    "op3_ngram_jaccard": r"""
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
            ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) END AS g FROM d),
    e AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
    -- A linked pair shares one of the first n - ceil(3n/4) + 1 shingles by any one order of all shingles.
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY f, h) AS k FROM
           (SELECT *, count(*) OVER (PARTITION BY g) AS f, hash(g) AS h FROM e)),
    p AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM r a JOIN r b ON a.g = b.g AND a.doc_id < b.doc_id AND 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n)
           WHERE a.k <= a.n - (3 * a.n + 3) // 4 + 1 AND b.k <= b.n - (3 * b.n + 3) // 4 + 1),
    l AS (SELECT x, y FROM (SELECT x, y, a.g AS ga, b.g AS gb, len(list_intersect(a.g, b.g)) AS i FROM p JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y)
           WHERE 100 * i >= 75 * (len(ga) + len(gb) - i)),
    b AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
    c(doc_id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT c.doc_id, b.y FROM c JOIN b ON b.x = c.reach)
    SELECT c.doc_id, any_value(len(s.g))::BIGINT AS n_shingles, min(reach) AS component_id FROM c JOIN s ON s.doc_id = c.doc_id GROUP BY c.doc_id"""
}
QUERIES = {"op3_ngram_jaccard": op3_ngram_jaccard}
