"""Personal data in whole texts, with information-theoretic sanitisation of the words that reveal it.

Base spans (e-mail, ip, card, phone) come from fixed patterns.  The method then estimates from the whole corpus how
strongly a term reveals a protected entity: over lines as contexts, n(e,t) lines hold both, n(t) the term.  The
entity's information left open once the term is known is ``IC(e) - PMI(e;t) = log2(n(t) / n(e,t))`` bits; where at most
``MAX_OPEN_BITS`` are left, and the two met in at least two different lines (copies of one line are one witness), the
term discloses the entity, and its occurrences in every text of the corpus, with or without the entity, become spans
of kind ``term``: a text that says the term alone reveals the entity too.

A term is a run of four or more ASCII letters or non-ASCII characters, compared with A-Z lower-cased, outside base spans.

Corpus counts are pre-aggregated by batch, and pairs are counted by aggregation.  The disclosing terms are counted, and up
to BROADCAST_TERMS of them (8 bytes each) are broadcast and looked up where the texts are read; more join the (text, term)
pairs of every text by a shuffle, with the same result.

Defined cases: null or empty text has no spans (counts 0, ``spans`` empty, ``base_sha256`` of the empty string);
repeated rows get one result each; null ids stay; an empty table gives an empty result; other columns, whatever their
names, are not returned by :func:`find` and are kept by :func:`sanitise`, which changes only the text (and ``n_chars``).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._shared import written
from ._text import Slice, mix, parts, slices, span_hash

#: Order of kinds in lists of spans.
KINDS = ("email", "ip", "card", "phone", "term")
MAX_OPEN_BITS = 1.0
MIN_TERM = 4
#: The most disclosing terms that are broadcast, 16 MB; more are joined by a shuffle.
BROADCAST_TERMS = 2_000_000
_SEEN = 1 << 22
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[A-Za-z\x80-\U0010ffff]{%d,}" % MIN_TERM)
_NOT_DIGIT = re.compile(r"[^0-9]+")
_TERM_BYTE = np.zeros(256, bool)
_TERM_BYTE[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True

Span = tuple[int, int, int]  # start, place in KINDS, end


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the whole pattern would match, but from each @ outwards, so that long runs take linear time."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            floor = m.end()
            yield start, floor
        at = text.find("@", max(floor, at + 1))


def base_spans(text: str) -> list[Span]:
    """Spans of the four base kinds, by start and then kind."""
    out = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and _luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def _entity(text: str, span: Span) -> str:
    value = text[span[0] : span[2]]
    return f"{KINDS[span[1]]}:{value.lower() if span[1] < 2 else _NOT_DIGIT.sub('', value)}"


def _free_terms(text: str, spans: list[Span], low: int = 0, high: int | None = None) -> Iterator[re.Match]:
    """Terms of text[low:high] that touch no span."""
    spans = [s for s in spans if s[2] > low and (high is None or s[0] < high)]
    k = 0
    for m in _TERM.finditer(text, low, len(text) if high is None else high):
        while k < len(spans) and spans[k][2] <= m.start():
            k += 1
        j = k
        while j < len(spans) and spans[j][0] < m.end() and spans[j][2] <= m.start():
            j += 1
        if j == len(spans) or spans[j][0] >= m.end():
            yield m


def _hashes(values: list[str]) -> np.ndarray:
    out = [span_hash(s.prefix(), s.bounds[:-1], s.bounds[1:]) for s in slices(pa.array(values, pa.large_string()), lower=True)]
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _may_hold(s: Slice) -> np.ndarray:
    """Rows with an @ or a digit: no other can have a base span."""
    at = np.flatnonzero((s.data == 64) | ((s.data >= 48) & (s.data <= 57)))
    return np.unique(np.searchsorted(s.bounds, at, side="right") - 1)


def _spans_of(column: pa.Array) -> dict[int, tuple[str, list[Span]]]:
    """Row number -> text and base spans, for the rows that have any."""
    out = {}
    for s in slices(column):
        for i in _may_hold(s) + s.first:
            text = column[int(i)].as_py()
            if text and (spans := base_spans(text)):
                out[int(i)] = (text, spans)
    return out


def _meetings(docs: DataFrame) -> DataFrame:
    """(entity, term, line) for each entity of a line, however often it stands there, and each term of the line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            entity, term, line = [], [], []
            for text, spans in _spans_of(batch.column(0)).values():
                seen: dict[tuple[int, int], tuple[str, list[str]]] = {}
                counted = set()
                for s in spans:
                    low = text.rfind("\n", 0, s[0]) + 1
                    high = text.find("\n", s[2])
                    high = len(text) if high < 0 else high
                    if (low, high) not in seen:
                        seen[low, high] = text[low:high], sorted({m[0] for m in _free_terms(text, spans, low, high)})
                    said, terms = seen[low, high]
                    if (one := (low, _entity(text, s))) in counted:
                        continue
                    counted.add(one)
                    entity += [one[1]] * len(terms)
                    term += terms
                    line += [said] * len(terms)
            if not term:
                continue
            codes, inverse = np.unique(np.array(line, dtype=object), return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(_hashes(entity).view(np.int64)), pa.array(_hashes(term).view(np.int64)), pa.array(_hashes(list(codes))[inverse].view(np.int64))],
                ["entity", "term", "line"],
            )

    return docs.mapInArrow(run, "entity long, term long, line long")


def _terms_at(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every term of a lower-cased slice."""
    letter = _TERM_BYTE[s.data]
    n = len(letter)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    edge = np.zeros(n + 1, bool)
    edge[s.bounds] = True
    starts = np.flatnonzero(letter & (np.append(True, ~letter[:-1]) | edge[:n]))
    ends = np.flatnonzero(letter & (np.append(~letter[1:], True) | edge[1:])) + 1
    points = s.points()
    long = points[ends] - points[starts] >= MIN_TERM
    starts, ends = starts[long], ends[long]
    return starts, span_hash(s.prefix(), starts, ends)


def _term_counts(docs: DataFrame) -> DataFrame:
    """(term, n): lines of the corpus that hold the term; summed within a batch first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for s in slices(batch.column(0), lower=True):
                starts, h = _terms_at(s)
                line = np.searchsorted(s.lines()[0], starts, side="right").astype(np.uint64)
                _, one = np.unique(h + mix(line), return_index=True)
                found.append(np.unique(h[one], return_counts=True))
            if found:
                terms, at = np.unique(np.concatenate([t for t, _ in found]), return_inverse=True)
                counts = np.bincount(at, np.concatenate([c for _, c in found])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(counts)], ["term", "n"])

    return docs.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def disclosing_terms(docs: DataFrame, max_open_bits: float = MAX_OPEN_BITS, text: str = "text") -> DataFrame:
    """(entity, term, open_bits), by hash, of the pairs past the threshold."""
    texts = docs.select(F.col(text).cast("string").alias("text"))
    pairs = _meetings(texts).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_both"), F.min("line").alias("low"), F.max("line").alias("high")).where("low <> high").drop("low", "high")
    pairs = pairs.join(_term_counts(texts), "term").withColumn("open_bits", F.log2(F.greatest(F.col("n"), F.col("n_both")) / F.col("n_both")))
    return pairs.where(F.col("open_bits") <= max_open_bits).select("entity", "term", "open_bits")


class _Known:
    """The disclosing terms, for looking up many at once."""

    def __init__(self, terms: np.ndarray):
        self.terms = terms
        self.seen = np.zeros(_SEEN, bool)
        self.seen[(terms >> np.uint64(42)).astype(np.int64)] = True

    def held(self, column: pa.Array) -> dict[int, np.ndarray]:
        """Row number -> its disclosing terms, for the rows that hold any."""
        out = {}
        for s in slices(column, lower=True):
            starts, h = _terms_at(s)
            near = self.seen[(h >> np.uint64(42)).astype(np.int64)]
            starts, h = starts[near], h[near]
            hit = np.searchsorted(self.terms, h, side="right") > np.searchsorted(self.terms, h)
            row = np.searchsorted(s.bounds, starts[hit], side="right") - 1
            rows, first = np.unique(row, return_index=True)
            for i, terms in zip(rows, np.split(h[hit], first[1:]), strict=False):
                out[s.first + int(i)] = np.unique(terms).view(np.int64)
        return out


def _term_places(placed: DataFrame) -> DataFrame:
    """(place, term) of every term of every text, once for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column("text"), lower=True):
                starts, h = _terms_at(s)
                row = np.searchsorted(s.bounds, starts, side="right") - 1
                _, one = np.unique(h + mix(row.astype(np.uint64) + np.uint64(1)), return_index=True)
                yield pa.RecordBatch.from_arrays([batch.column("place").take(pa.array(row[one] + s.first)), pa.array(h[one].view(np.int64))], ["place", "term"])

    return placed.select("place", "text").mapInArrow(run, "place string, term long")


def _with_held(rows: DataFrame, pairs: DataFrame, text: Column, texts_of: Callable[[pa.RecordBatch], pa.Array]) -> tuple[DataFrame, Callable[[pa.RecordBatch], dict[int, np.ndarray]]]:
    """``rows`` (place and others, with the texts as the column ``text``, in a batch by ``texts_of``) ready for a map by batch, and what
    gives row number -> disclosing terms of a batch."""
    terms = written(pairs.select("term").distinct(), "terms")
    if terms.count() <= BROADCAST_TERMS:
        known = rows.sparkSession.sparkContext.broadcast(np.sort(terms.toArrow().column(0).to_numpy().view(np.uint64)))
        return rows.drop("place"), lambda batch: _Known(known.value).held(texts_of(batch))
    by_text = _term_places(rows.select("place", text.alias("text"))).join(terms, "term").groupBy("place").agg(F.collect_set("term").alias("terms"))
    return rows.join(by_text, "place", "left"), lambda batch: {i: np.array(t, np.int64) for i, t in enumerate(batch.column("terms").to_pylist()) if t}


def _place(text: str):
    """A 128-bit name of the text, so that copies share it."""
    return F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))


def _with_terms(text: str, spans: list[Span], terms: np.ndarray | None) -> list[Span]:
    if terms is None:
        return spans
    found = list(_free_terms(text, spans))
    hits = np.isin(_hashes([m[0] for m in found]).view(np.int64), terms) if found else []
    return sorted(spans + [(m.start(), 4, m.end()) for m, hit in zip(found, hits, strict=True) if hit])


def find(docs: DataFrame, max_open_bits: float = MAX_OPEN_BITS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row: counts by kind, and ``base`` and ``all_spans`` as lists of ``kind:start:end`` (code points, end exclusive)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), _place(text).alias("place"), F.col(text).cast("string").alias("text"))
    rows, held = _with_held(rows, disclosing_terms(docs, max_open_bits, text), F.col("text"), lambda batch: batch.column("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said = lambda spans: [f"{KINDS[k]}:{a}:{b}" for a, k, b in spans]
        for batch in parts(batches):
            texts, terms = batch.column("text"), held(batch)
            found = _spans_of(texts)
            n = batch.num_rows
            base, every = [[] for _ in range(n)], [[] for _ in range(n)]
            counts = np.zeros((4, n), np.int64)
            for i in found.keys() | terms.keys():
                text, spans = found.get(i) or (texts[i].as_py(), [])
                base[i], every[i] = said(spans), said(_with_terms(text, spans, terms.get(i)))
                for s in spans:
                    counts[s[1], i] += 1
            kind = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, counts), pa.array(base, kind), pa.array(every, kind)], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "all_spans"])

    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base array<string>, all_spans array<string>")


def redact(text: str, spans: list[Span]) -> str:
    """Each span, or run of overlapping ones, becomes the upper-case name of its first kind in brackets."""
    out, end = [], 0
    for a, k, b in spans:
        if a >= end:
            out += [text[end:a], f"[{KINDS[k].upper()}]"]
        end = max(end, b)
    return "".join(out) + text[end:]


def sanitise(docs: DataFrame, max_open_bits: float = MAX_OPEN_BITS, text: str = "text") -> DataFrame:
    """``docs`` with every span of every text generalised to its kind; ``n_chars``, where there is one, follows the new text."""
    wide = docs.select(_place(text).alias("place"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    schema, place = StructType([wide.schema["row"]]).add("changed", "string"), docs.columns.index(text)
    wide, held = _with_held(wide, disclosing_terms(docs, max_open_bits, text), F.col(f"row.`{text}`").cast("string"), lambda batch: batch.column("row").field(place).cast(pa.large_string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts, terms = batch.column("row").field(place).cast(pa.large_string()), held(batch)
            found, new = _spans_of(texts), {}
            for i in found.keys() | terms.keys():
                said, spans = found.get(i) or (texts[i].as_py(), [])
                if spans := _with_terms(said, spans, terms.get(i)):
                    new[i] = redact(said, spans)
            changed = pa.array([new.get(i) for i in range(batch.num_rows)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("row"), changed], ["row", "changed"])

    done = wide.mapInArrow(run, schema)
    fresh = F.coalesce(F.col("changed"), F.col(f"row.`{text}`"))
    cols = [fresh.alias(c) if c == text else F.when(F.col("changed").isNull(), F.col("row.n_chars")).otherwise(F.length("changed")).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return done.select(*cols)


def op4_private_data(spark, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.concat_ws(",", "base"), 256).alias("base_sha256"), F.concat_ws(",", "all_spans").alias("spans"))


QUERIES = {"op4_private_data": op4_private_data}
ORACLES: dict = {}
