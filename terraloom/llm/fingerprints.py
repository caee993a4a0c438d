"""I-Match document fingerprints: hashes of the terms that lie in a band of inverse document frequency.

Document frequencies are counted over the whole corpus, pre-aggregated by batch.  Terms whose idf, log2(N / df), lies
within the band make the lexicon.  A fingerprint has SUBSETS parts: part k hashes the document's distinct terms, in
sorted order of their hashes, that belong to randomised lexicon subset k.  The first SHARES subsets deal out the whole
lexicon, so each of its terms lies in some part; the others are drawn at several lower rates, so that short and long texts
both have parts of a few terms.  Likeness of two fingerprints is the share of equal parts among
those that either text fills; equal fingerprints have 1.

The lexicon's size is bounded whatever the corpus: each of its terms is in at least N / 2**HIGH_BITS documents, so there
are at most 2**HIGH_BITS x (mean distinct terms of a document) of them.  They are counted, and broadcast up to MAX_LEXICON;
a larger lexicon joins the (texts, term) pairs by a shuffle, and each batch of texts is hashed against its own terms of
the lexicon, with the same result.

Neighbours in order of doc_id: the ids are numbered over the whole table (dealt to partitions by quantiles, whatever they
are), each text goes to the block of BLOCK numbers that it belongs to, and the first text of a block to the one before too.

Defined cases: null text is the empty text; a text without terms has the fingerprint of zeros; one with no term in the
lexicon is hashed by all its terms; rows that repeat an id are ordered by the MD5 of id and text, equal rows are each other's next;
null ids come first; with one row,
its next document is itself; an empty table gives an empty result; other columns of the input are not returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import indexed, written
from ._text import mix, slices, span_hash

#: The band: idf from LOW_BITS to HIGH_BITS.
LOW_BITS, HIGH_BITS = 3.0, 11.0
SUBSETS = 64
#: So many subsets share out the lexicon, each term to one of them by its hash; a power of two.
SHARES = 16
#: Subset SHARES + k draws terms at the rate 2 ** -_RATE[k].
_RATE = 5 + np.arange(SUBSETS - SHARES) // 7
#: The largest lexicon that is broadcast, 32 MB; a larger one is joined by a shuffle.
MAX_LEXICON = 4_000_000
BLOCK = 2048
#: The longest list of numbered ids that is broadcast, about 40 MB; a longer one is joined by a shuffle.
BROADCAST_ROWS = 500_000
_SEEN = 1 << 22


def _term_documents(docs: DataFrame) -> DataFrame:
    """(term, df) of every term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for s in slices(batch.column(0), lower=True):
                starts, ends, row = s.words()
                h = span_hash(s.prefix(), starts, ends)
                _, one = np.unique(h + mix(row.astype(np.uint64) + np.uint64(1)), return_index=True)
                found.append(np.unique(h[one], return_counts=True))
            if found:
                terms, at = np.unique(np.concatenate([t for t, _ in found]), return_inverse=True)
                counts = np.bincount(at, np.concatenate([c for _, c in found])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(counts)], ["term", "df"])

    return docs.select("text").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def lexicon(docs: DataFrame, low_bits: float = LOW_BITS, high_bits: float = HIGH_BITS) -> DataFrame:
    """(term) of the terms in the band, by hash."""
    n = docs.count()
    return written(_term_documents(docs).where((F.col("df") <= n / 2**low_bits) & (F.col("df") >= n / 2**high_bits)).select("term"), "lexicon")


class Fingerprinter:
    """Fingerprints of many texts at once, against one lexicon."""

    def __init__(self, words: np.ndarray):
        self.lexicon = words
        self.seen = np.zeros(_SEEN, bool)
        self.seen[(words >> np.uint64(42)).astype(np.int64)] = True
        share = mix(words + np.uint64(977 * SUBSETS + 1)) % np.uint64(SHARES)
        member = [np.flatnonzero(share == k) for k in range(SHARES)]
        member += [np.flatnonzero((mix(words + np.uint64(977 * k + 1)) >> np.uint64(64 - int(r))) == 0) for k, r in enumerate(_RATE)]
        who = np.concatenate(member) if len(words) else np.zeros(0, np.int64)
        part = np.repeat(np.arange(SUBSETS), [len(m) for m in member])
        order = np.argsort(who, kind="stable")
        self.part = part[order]
        self.first = np.searchsorted(who[order], np.arange(len(words) + 1))

    def _rows(self, s) -> np.ndarray:
        out = np.zeros(s.rows * SUBSETS, np.uint64)
        starts, ends, row = s.words()
        h = span_hash(s.prefix(), starts, ends)
        near = self.seen[(h >> np.uint64(42)).astype(np.int64)]
        term, at_row = h[near], row[near]
        at = np.searchsorted(self.lexicon, term)
        hit = at < len(self.lexicon)
        hit[hit] = self.lexicon[at[hit]] == term[hit]
        pairs = np.unique(at_row[hit] * np.int64(max(1, len(self.lexicon))) + at[hit])
        at_row, at = np.divmod(pairs, np.int64(max(1, len(self.lexicon))))
        times = self.first[at + 1] - self.first[at]
        part = self.part[np.repeat(self.first[at] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())] if len(at) else at
        slot = np.repeat(at_row, times) * SUBSETS + part
        value = mix(np.repeat(self.lexicon[at], times) + part.astype(np.uint64))
        order = np.argsort(slot, kind="stable")
        slot, value = slot[order], value[order]
        if len(slot):
            heads = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
            out[slot[heads]] = mix(np.add.reduceat(value, heads)) | np.uint64(1 << 48)
        out = out.reshape(s.rows, SUBSETS)
        plain = np.flatnonzero(~out.any(axis=1) & (np.bincount(row, minlength=s.rows) > 0))
        if len(plain):
            for i in plain:
                terms = np.unique(h[np.searchsorted(row, i) : np.searchsorted(row, i, side="right")])
                out[i] = mix(np.add.reduce(mix(terms)) + np.arange(SUBSETS, dtype=np.uint64)) | np.uint64(1 << 48)
        return (out >> np.uint64(48)).astype(np.uint16)

    def __call__(self, texts: pa.Array) -> np.ndarray:
        """One row of SUBSETS parts for each text; 0 is an empty part."""
        found = [self._rows(s) for s in slices(texts, lower=True)]
        return np.concatenate(found) if found else np.zeros((0, SUBSETS), np.uint16)


def shown(prints: np.ndarray) -> list[str]:
    wide = SUBSETS * 4
    text = prints.astype(">u2").tobytes().hex()
    return [text[k : k + wide] for k in range(0, len(text), wide)]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal parts among those that either fills; 1 for equal rows, so also for two empty ones."""
    either = ((a | b) != 0).sum(axis=1)
    same = ((a == b) & (a != 0)).sum(axis=1)
    return np.where((a == b).all(axis=1), 1.0, same / np.maximum(either, 1))


def _rows(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def _terms(keyed: DataFrame, columns: list[str]) -> DataFrame:
    """(key, term) of every term of the texts of a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in columns:
                for s in slices(batch.column(name), lower=True):
                    starts, ends, row = s.words()
                    h = span_hash(s.prefix(), starts, ends)
                    _, one = np.unique(h + mix(row.astype(np.uint64) + np.uint64(1)), return_index=True)
                    yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(row[one] + s.first)), pa.array(h[one].view(np.int64))], ["key", "term"])

    return keyed.select("key", *columns).mapInArrow(run, "key string, term long")


def _printed(rows: DataFrame, words: DataFrame, prepare: Callable, columns: list[str], finish: Callable, schema: str) -> DataFrame:
    """``finish(batch, make)`` of each batch (doc_id, columns) that ``prepare`` makes of the batches of ``rows``; ``make`` gives fingerprints of texts of the batch."""
    if words.count() <= MAX_LEXICON:
        known = rows.sparkSession.sparkContext.broadcast(np.sort(words.toArrow().column(0).to_numpy().view(np.uint64)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            make = Fingerprinter(known.value)
            for batch in prepare(batches):
                yield finish(batch, make)

        return rows.mapInArrow(run, schema)

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                own = part.column("terms").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                yield finish(part, Fingerprinter(np.unique(own.view(np.uint64))))

    wide = rows.mapInArrow(prepare, ", ".join(["doc_id long", *[f"{c} string" for c in columns]]))
    keyed = wide.withColumn("key", F.md5(F.concat(*[F.md5(c) for c in columns])))
    held = _terms(keyed, columns).join(words, "term").groupBy("key").agg(F.collect_set("term").alias("terms"))
    return keyed.join(held, "key", "left").mapInArrow(run_joined, schema)


def fingerprint(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint) of every row."""
    rows = _rows(docs, text, doc_id)

    def finish(batch: pa.RecordBatch, make: Fingerprinter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shown(make(batch.column("text"))), pa.string())], ["doc_id", "fingerprint"])

    return _printed(rows, lexicon(rows), lambda batches: batches, ["text"], finish, "doc_id long, fingerprint string")


def _with_next(rows: DataFrame) -> DataFrame:
    """Rows by block in order of (doc_id, text), each block followed by the first rows of the next (``tail`` 1)."""
    keyed = rows.withColumn("key", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.col("text"))))
    order = written(indexed(keyed.select("doc_id", "key").distinct(), ["doc_id", "key"]).select("key", "idx"), "order")
    n = order.count()
    blocks = max(1, -(-n // BLOCK))
    if n <= BROADCAST_ROWS:
        order = F.broadcast(order)
    block = F.floor(F.col("idx") / BLOCK).cast("long")
    own = F.struct(block.alias("block"), F.lit(0).alias("tail"))
    before = F.struct(F.pmod(block - 1, F.lit(blocks)).cast("long").alias("block"), F.lit(1).alias("tail"))
    at = F.explode(F.when(F.col("idx") % BLOCK == 0, F.array(own, before)).otherwise(F.array(own)))
    placed = keyed.join(order, "key").select(at.alias("at"), "idx", "doc_id", "text")
    placed = placed.select("at.block", "at.tail", "idx", "doc_id", "text")
    return placed.repartition("block").sortWithinPartitions("block", "tail", "idx")


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, edited, next) of the rows of :func:`_with_next` but the tails."""
    kept: tuple | None = None  # the last row so far: tail, id, text
    for batch in batches:
        for k in range(0, batch.num_rows, 512):
            tail, ids, texts = (batch.slice(k, 512).column(c).to_pylist() for c in (1, 3, 4))
            if kept is not None:
                tail, ids, texts = [kept[0], *tail], [kept[1], *ids], [kept[2], *texts]
            kept = tail[-1], ids[-1], texts[-1]
            mine = [i for i in range(len(ids) - 1) if not tail[i]]
            if not mine:
                continue
            edited = [texts[i][: len(texts[i]) - len(texts[i]) // 2] + texts[i + 1][: len(texts[i]) // 2] for i in mine]
            wide = [[texts[i] for i in mine], edited, [texts[i + 1] for i in mine]]
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in mine], pa.int64()), *[pa.array(c, pa.string()) for c in wide]], ["doc_id", "text", "edited", "next"])


def half_edits(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Each document against its edit (its second half replaced by the start of the next document) and against the next."""
    rows = _rows(docs, text, doc_id)
    columns = ["text", "edited", "next"]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def finish(batch: pa.RecordBatch, make: Fingerprinter) -> pa.RecordBatch:
        texts = pa.concat_arrays([batch.column(c).cast(pa.large_string()) for c in columns]).dictionary_encode()
        own, other, then = make(texts.dictionary)[texts.indices.to_numpy()].reshape(3, batch.num_rows, SUBSETS)
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), pa.array([len(t) for t in batch.column("text").to_pylist()], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in batch.column("edited").to_pylist()], pa.string()), pa.array(shown(own), pa.string()), pa.array(shown(other), pa.string()),
                pa.array(likeness(own, other)), pa.array(likeness(own, then)),
            ],
            names,
        )

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _printed(_with_next(rows), lexicon(rows), _edits, columns, finish, schema)


def op9_imatch_fingerprints(spark, sf_dir: str) -> DataFrame:
    return half_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op9_imatch_fingerprints": op9_imatch_fingerprints}
ORACLES: dict = {}
