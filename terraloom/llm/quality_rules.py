"""Quality rules by repetition coverage: how much of a text lies inside duplicated n-grams and lines.

Rolling hashes of several n-gram lengths are compared within each text, in numpy, over slices of an Arrow batch.
An (n+1)-gram can only be a duplicate where the n-gram at its start is one, so longer lengths look at the few
places that shorter ones left.  No shuffle: every text is judged by itself, whole.

Defined cases: a null or empty text has no words, fails the base rule and is not kept; repeated rows are each
judged alike; a null id stays null; other columns of the input, whatever their names, are not returned by
:func:`measure` and are returned untouched by :func:`keep`.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._text import SPACE, Slice, gram_hash, mix, parts, repeated, slices, span_hash

#: Largest share of word characters inside later copies of n-grams, by n, as in public heuristics.
GRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest share of lines, and of their characters, that repeat an earlier line.
LINE_LIMIT, LINE_CHAR_LIMIT = 0.30, 0.20
#: A share is over its limit where chance alone, at the limit, would seldom (in one text of twenty) give as much to a text of its length: the limit plus so many
#: standard errors, the error being that of a share of the text's words (n-grams) or lines.  At every length; a text of three lines needs more than one alike.
DEVIATIONS = 1.64
MIN_WORDS, REPEAT_PERCENT = 50, 50
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "line_chars long, dup_line_chars long, n_lines long, dup_gram_chars array<long>, base_failed boolean, kept boolean"
)
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def _covered(at: np.ndarray, n: int, size: int) -> np.ndarray:
    """Mask of the words inside any of the n-grams that start at the given places."""
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return np.cumsum(edge[:-1]) > 0


def _measure_slice(s: Slice, lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    prefix, points = s.prefix(), s.points()
    starts, ends, row = s.words()
    chars = points[ends] - points[starts]
    word = span_hash(prefix, starts, ends)
    salt = mix(np.arange(s.rows, dtype=np.uint64) + np.uint64(1))
    out = {"n_words": s.per_row(row), "word_chars": s.per_row(row, chars)}
    symbols = np.flatnonzero(_SYMBOLS[s.data])
    out["n_symbols"] = s.per_row(np.searchsorted(s.bounds, symbols, side="right") - 1)

    begin, end, line_row = s.lines()
    black = np.zeros(len(s.data) + 1, np.int64)
    np.cumsum(~SPACE[s.data], out=black[1:])
    full = black[end] > black[begin]
    begin, end, line_row = begin[full], end[full], line_row[full]
    _, later = repeated(span_hash(prefix, begin, end) + salt[line_row])
    size = points[end] - points[begin]
    out["n_lines"], out["n_dup_lines"] = s.per_row(line_row), s.per_row(line_row[later])
    out["line_chars"], out["dup_line_chars"] = s.per_row(line_row, size), s.per_row(line_row[later], size[later])

    places, grams = np.arange(len(word)), []
    for n in (3, *lengths):
        places = places[places + n <= len(word)]
        places = places[row[places] == row[places + n - 1]]
        later = places
        if len(places):
            keys = gram_hash(word, n)[places] if n == 3 else _grams_at(word, places, n)
            often, again = repeated(keys + salt[row[places]])
            places, later = places[often], places[again]
        if n == 3:
            out["n_repeat_words"] = s.per_row(row[mask := _covered(places, n, len(word))])
        else:
            grams.append(s.per_row(row[mask := _covered(later, n, len(word))], chars[mask]))
    out["dup_gram_chars"] = np.stack(grams, axis=1) if grams else np.zeros((s.rows, 0), np.int64)
    return out


def _grams_at(word: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    out = word[at].copy()
    for k in range(1, n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + word[at + k]
    return mix(out + np.uint64(n))


def _error(limit: float) -> float:
    """What DEVIATIONS standard errors of a share at the limit come to, times the root of the number of items."""
    return DEVIATIONS * (limit * (1 - limit)) ** 0.5


def _over(part: np.ndarray, whole: np.ndarray, items: np.ndarray, limit: float) -> np.ndarray:
    return part > (limit + _error(limit) / np.sqrt(np.maximum(items, 1))) * whole


def _judge(m: dict[str, np.ndarray], limits: Mapping[int, float]) -> None:
    """Adds ``base_failed`` and ``kept`` to the measures; ``dup_gram_chars`` is by ascending length."""
    m["base_failed"] = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > REPEAT_PERCENT * m["n_words"])
    bad = _over(m["n_dup_lines"], m["n_lines"], m["n_lines"], LINE_LIMIT)
    bad |= _over(m["dup_line_chars"], m["line_chars"], m["n_lines"], LINE_CHAR_LIMIT)
    for k, n in enumerate(sorted(limits)):
        bad |= _over(m["dup_gram_chars"][:, k], m["word_chars"], m["n_words"], limits[n])
    m["kept"] = ~m["base_failed"] & ~bad


def _judged(column: pa.Array, limits: Mapping[int, float]) -> Iterator[tuple[Slice, dict[str, np.ndarray]]]:
    """Slices of a column with their measures and verdicts: the one place where rules are applied."""
    for s in slices(column):
        m = _measure_slice(s, tuple(sorted(limits)))
        _judge(m, limits)
        yield s, m


def measure(docs: DataFrame, limits: Mapping[int, float] = GRAM_LIMITS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: the counts that the rules are made of and the verdicts (see SCHEMA), ``dup_gram_chars`` by the lengths
    of ``limits`` (each 4 or more), ascending."""
    if min(limits, default=4) < 4:
        raise ValueError("lengths must be 4 or more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, got in _judged(batch.column(1), limits):
                grams = got.pop("dup_gram_chars")
                arrays = {k: pa.array(v) for k, v in got.items()}
                arrays["dup_gram_chars"] = pa.ListArray.from_arrays(pa.array(np.arange(s.rows + 1, dtype=np.int32) * grams.shape[1]), pa.array(grams.ravel(), pa.int64()))
                arrays["doc_id"] = batch.column(0).slice(s.first, s.rows)
                yield pa.RecordBatch.from_arrays([arrays[k] for k in _NAMES], _NAMES)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def keep(docs: DataFrame, limits: Mapping[int, float] = GRAM_LIMITS, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns; decided row by row, so repeated ids are no matter."""
    names = docs.columns
    wide = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    schema, place = StructType([wide.schema["row"]]).add("kept", "boolean"), names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            rows = batch.column(0)
            for s, m in _judged(rows.field(place).cast(pa.large_string()), limits):
                yield pa.RecordBatch.from_arrays([rows.slice(s.first, s.rows), pa.array(m["kept"])], ["row", "kept"])

    return wide.mapInArrow(run, schema).where("kept").select("row.*")


def op7_repetition_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return measure(docs)


def _oracle() -> str:
    cover = ",\n".join(
        f"""g{n} AS (SELECT w.k, sum(w.wc) AS c FROM w JOIN
          (SELECT DISTINCT k, unnest(range(i, i + {n})) AS i FROM (SELECT k, i, {'count(*) OVER (PARTITION BY k, g)' if n == 3 else 'row_number() OVER (PARTITION BY k, g ORDER BY i)'} AS n
             FROM (SELECT k, unnest(range(1, len(ws) - {n - 2})) AS i,
                     unnest(list_transform(range(1, len(ws) - {n - 2}), lambda i: hash(list_slice(ws, i, i + {n - 1})))) AS g FROM d)) WHERE n > 1) r
          ON w.k = r.k AND w.i = r.i GROUP BY w.k)"""
        for n in (3, *GRAM_LIMITS)
    )
    joins = "\n".join(f"LEFT JOIN g{n} ON g{n}.k = d.k" for n in (3, *GRAM_LIMITS))
    grams = ", ".join(f"coalesce(g{n}.c, 0)" for n in GRAM_LIMITS)
    # Numbers with an exponent are doubles.
    most = lambda limit, items, whole: f"({limit}e0 + {_error(limit)!r}e0 / sqrt(greatest({items}, 1)::DOUBLE)) * {whole}"
    fine = " AND ".join(f"coalesce(g{n}.c, 0) <= {most(v, 'len(ws)', 'word_chars')}" for n, v in GRAM_LIMITS.items())
    return f"""
    WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS k, doc_id, coalesce(text, '') AS text,
                 regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
    w AS (SELECT k, unnest(range(1, len(ws) + 1)) AS i, unnest(list_transform(ws, lambda x: length(x))) AS wc FROM d),
    {cover.replace("g3 AS (SELECT w.k, sum(w.wc) AS c", "g3 AS (SELECT w.k, count(*) AS c")},
    t AS (SELECT k, line, row_number() OVER (PARTITION BY k, line) > 1 AS later
          FROM (SELECT k, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
    l AS (SELECT k, count(*) AS n_lines, count(*) FILTER (later) AS n_dup_lines, sum(length(line)) AS line_chars,
            coalesce(sum(length(line)) FILTER (later), 0) AS dup_line_chars FROM t GROUP BY k),
    a AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, list_sum([0] || list_transform(ws, lambda x: length(x)))::BIGINT AS word_chars,
            length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(l.n_dup_lines, 0)::BIGINT AS n_dup_lines,
            coalesce(g3.c, 0)::BIGINT AS n_repeat_words, coalesce(l.line_chars, 0)::BIGINT AS line_chars,
            coalesce(l.dup_line_chars, 0)::BIGINT AS dup_line_chars, coalesce(l.n_lines, 0)::BIGINT AS n_lines,
            [{grams}]::BIGINT[] AS dup_gram_chars, {{fine}} AS fine
          FROM d {joins} LEFT JOIN l ON l.k = d.k)
    SELECT a.* EXCLUDE (fine), n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed,
      n_words >= {MIN_WORDS} AND 100 * n_repeat_words <= {REPEAT_PERCENT} * n_words AND fine
        AND n_dup_lines <= {most(LINE_LIMIT, 'n_lines', 'n_lines')} AND dup_line_chars <= {most(LINE_CHAR_LIMIT, 'n_lines', 'line_chars')} AS kept
    FROM a""".replace("{fine}", fine)


ORACLES = {"op7_repetition_quality": _oracle()}
QUERIES = {"op7_repetition_quality": op7_repetition_quality}
