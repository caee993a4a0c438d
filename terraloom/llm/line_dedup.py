"""Line dedup: repeated runs of lines found by distributed prefix doubling; later copies are deleted.

The corpus is one sequence of line identifiers in order of (doc_id, line).  A text that several documents hold stands in it
once, for the first of them: each other document is one run that was there before.  Only lines that occur twice or more can
lie in a repeated run, so the others cut the sequence into stretches; a suffix starts at each line of a stretch.

Ranks start as the number of suffixes with a smaller first line and are refined by doubling: suffixes of one rank are
ordered by the rank 2**k lines on, counted per pair first, so the rank is again the place at which the group starts in the
suffix array.  A group of equal rank after k doublings is the interval of the suffix array with a common prefix of 2**k
lines; its size is the number of copies, its smallest position the first one.  Doubling goes on until every group is a
single suffix or ends; documents without an open group drop out.  Up to ``min_words`` lines the prefixes of the lengths between two
powers are counted too (two overlapping ones of 2**k), since there the length decides whether a run has words enough.

So each suffix knows the longest of these prefixes that occurs earlier; overlapping ones of one document with the same
displacement to the copy cover its repeated runs, which is all that deletion asks.  The runs themselves (:func:`repeated_runs`) are the longest common prefixes
with an earlier suffix: :func:`longest_earlier` splits each interval by the ranks of half as many lines, then half of those, down to one.  A run with ``min_words`` words or more is deleted wherever an
earlier copy of it exists, so the first copy stays.

Lines are compared whole, by 128-bit hash until they are numbered; words are runs outside ``[\\x20\\x09-\\x0D]``.  Lines without
a word are no part of the sequence and stay.  Groups are counted and minimised by aggregation, tables of lines and texts are broadcast up
to BROADCAST_ROWS and else joined by a shuffle, joins of ranks are left to adaptive execution (size and skew); only the lines of one
document meet in one task.

Defined cases: null or empty text has one line without a word and stays as it is; rows that repeat both id and text count
as one document and get the same result; rows that repeat an id only are ordered by a hash of their text; null ids come
first; a document whose lines are all deleted gets the empty text; an empty table gives an empty result; other columns,
whatever their names, are kept by :func:`dedup_lines`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from ._shared import indexed, written
from ._text import parts, slices, span_hash

MIN_WORDS = 5
#: The largest table that is broadcast, by rows and by lines in their lists: about 40 MB; a larger one is joined by a shuffle.
BROADCAST_ROWS, BROADCAST_LINES = 500_000, 1_000_000
_BUCKET = 1 << 16
_WORD = re.compile(r"[^\x20\x09-\x0D]+")

def _in_document():
    return Window.partitionBy("start").orderBy("at")


def _before(value: str, by: list[str], order: str):
    """Sum of ``value`` over the earlier rows of a group."""
    return F.coalesce(F.sum(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _small(df: DataFrame, name: str) -> DataFrame:
    """``df``, written, to be joined: broadcast if it is small."""
    df = written(df, name)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _keyed(docs: DataFrame, text: str, doc_id: str, *more) -> DataFrame:
    said = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), said.alias("text"), F.md5(said).alias("text_key"), *more)
    return rows.withColumn("row_key", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.col("text_key"))))


def _lines(keyed: DataFrame) -> DataFrame:
    """(text_key, at, line_no, a, b, words) of each line with a word; ``at`` counts those lines only, ``a`` and ``b`` name the line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column(1)):
                starts, ends, row = s.lines()
                words = np.bincount(np.searchsorted(starts, s.words()[0], side="right") - 1, minlength=len(starts))
                # Lines that start at one offset are empty but for the last, to which searchsorted gives the words.
                number = np.arange(len(row)) - np.searchsorted(row, row)
                full = np.flatnonzero(words)
                row, number, words, starts, ends = row[full], number[full], words[full], starts[full], ends[full]
                at = np.arange(len(row)) - np.searchsorted(row, row)
                a, b = span_hash(s.prefix(), starts, ends), span_hash(s.prefix(True), starts, ends, True)
                columns = [batch.column(0).take(pa.array(s.first + row)), *map(pa.array, (at.astype(np.int32), number.astype(np.int32), a.view(np.int64), b.view(np.int64), words.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays(columns, ["text_key", "at", "line_no", "a", "b", "words"])

    return keyed.select("text_key", "text").mapInArrow(run, "text_key string, at int, line_no int, a long, b long, words int")


def _texts(keyed: DataFrame) -> DataFrame:
    """(text_key, row_key, copied, start) of each text: its first document, whether others hold it, and the lines before it."""
    size = (F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1).cast("long")
    first = F.min(F.struct("doc_id", "row_key"))
    texts = keyed.select("text_key", "row_key", "doc_id", size.alias("size")).distinct().groupBy("text_key").agg(first.alias("f"), (F.count(F.lit(1)) > 1).alias("copied"), F.min("size").alias("size"))
    texts = indexed(texts.select("text_key", "f.doc_id", "f.row_key", "copied", "size"), ["doc_id", "row_key"], "start", "size")
    return written(texts.select("text_key", "row_key", "copied", "start"), "texts")


def _suffixes(keyed: DataFrame, texts: DataFrame) -> DataFrame:
    """(start, at, line_no, words, last, pos, r, n, length, copies, source): the suffixes, ranked by their first line."""
    lines = written(_lines(keyed), "lines")
    place = F.xxhash64("text_key", "at")
    often = lines.groupBy("a", "b").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low < high").select("a", "b")
    found = lines.join(_small(often, "often"), ["a", "b"], "left_semi").distinct()
    starts = texts.select("text_key", "start")
    found = found.join(F.broadcast(starts) if texts.count() <= BROADCAST_ROWS else starts, "text_key").drop("text_key").withColumn("pos", F.col("start") + F.col("at"))
    found = written(found, "found")
    ranks = indexed(found.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("source")), ["a", "b"], "r", "n")
    ranked = found.join(ranks, ["a", "b"]).drop("a", "b")
    stretch = ranked.withColumn("stretch", F.col("at") - F.row_number().over(_in_document()))
    ranked = stretch.withColumn("last", F.max("at").over(Window.partitionBy("start", "stretch"))).drop("stretch")
    earlier = F.col("source") < F.col("pos")
    return ranked.withColumn("length", F.when(earlier, 1).otherwise(0)).withColumn("copies", F.when(earlier, F.col("n")).otherwise(1))


def _between(k: int, min_words: int) -> list[int]:
    """Lengths that decide between 2**k and 2**(k + 1)."""
    return list(range((1 << k) + 1, min(min_words + 1, 2 << k)))


def _paired(now: DataFrame, k: int, min_words: int) -> DataFrame:
    """Adds ``next``, the rank 2**k lines on, and o<length> for the lengths between; -1 where the stretch is shorter."""
    for n in (2 << k, *_between(k, min_words)):
        # A rank is refined by whatever follows; a length counts where the stretch holds it.
        least = 1 << k if n == 2 << k else n - 1
        after = F.when(F.col("at") + least <= F.col("last"), F.lead("r", n - (1 << k)).over(_in_document())).otherwise(F.lit(-1).cast("long"))
        now = now.withColumn("next" if n == 2 << k else f"o{n}", after)
    return now.withColumn("busy", F.max(F.expr("n > 1 AND next >= 0")).over(Window.partitionBy("start")))


def _refined(now: DataFrame) -> DataFrame:
    """(r, next, rank, m, low): rank, size and smallest position of each group two times as long.

    A group that is split has its ended suffixes first; those whose documents dropped out are its size less the sum.  The
    followers of one rank are summed in buckets of ranks, so that a frequent first line is no single task.
    """
    pairs = now.where("n > 1").groupBy("r", "next").agg(F.count(F.lit(1)).alias("m"), F.min("pos").alias("low"), F.first("n").alias("n"))
    pairs = pairs.withColumn("bucket", F.floor(F.col("next") / _BUCKET).cast("long"))
    sums = pairs.groupBy("r", "bucket").agg(F.sum("m").alias("s"))
    sums = sums.select("r", "bucket", _before("s", ["r"], "bucket").alias("offset"), F.sum("s").over(Window.partitionBy("r")).alias("whole"))
    inside = _before("m", ["r", "bucket"], "next")
    rank = F.col("r") + F.col("n") - F.col("whole") + F.col("offset") + F.col("inside")
    return pairs.withColumn("inside", inside).join(sums, ["r", "bucket"]).select("r", "next", rank.alias("rank"), "m", "low")


def suffix_array(keyed: DataFrame, texts: DataFrame, min_words: int = MIN_WORDS, levels: list[DataFrame] | None = None) -> DataFrame:
    """(start, at, line_no, words, pos, r, length, copies, source) of each suffix: in order of (r, pos) they are the suffix array.

    ``length`` is the longest prefix found that occurs earlier (0: none), ``copies`` how often it occurs, ``source`` where first.
    ``levels``, if given, gets the ranks by the first 1, 2, 4, ... lines, for :func:`longest_earlier`.
    """
    names = ["start", "at", "line_no", "words", "last", "pos", "r", "n", "length", "copies", "source"]
    now, k, done = written(_paired(_suffixes(keyed, texts), 0, min_words), "suffixes"), 0, []
    if levels is not None:
        levels.append(now)
    while k < min_words.bit_length() or not now.where("busy").isEmpty():
        joined = now.join(_refined(now), ["r", "next"], "left")
        for n in _between(k, min_words):
            found = now.where(f"n > 1 AND o{n} >= 0").groupBy("r", f"o{n}").agg(F.count(F.lit(1)).alias(f"m{n}"), F.min("pos").alias(f"low{n}")).where(f"m{n} > 1")
            joined = joined.join(found, ["r", f"o{n}"], "left")
            earlier = F.col(f"low{n}") < F.col("pos")
            for c, value in (("length", F.lit(n)), ("copies", F.col(f"m{n}")), ("source", F.col(f"low{n}"))):
                joined = joined.withColumn(c, F.when(earlier, value).otherwise(F.col(c)))
        earlier = (F.col("at") + (2 << k) - 1 <= F.col("last")) & (F.col("low") < F.col("pos"))
        for c, value in (("length", F.lit(2 << k)), ("copies", F.col("m")), ("source", F.col("low"))):
            joined = joined.withColumn(c, F.when(earlier, value).otherwise(F.col(c)))
        joined = joined.withColumn("r", F.coalesce("rank", "r")).withColumn("n", F.coalesce("m", F.lit(1).cast("long"))).select(names)
        k += 1
        now = written(_paired(joined, k, min_words), "suffixes")
        if levels is not None:
            levels.append(now)
        if k >= min_words.bit_length():
            done.append(now.where("NOT busy").select(names))
            now = now.where("busy")
    for part in done:
        now = now.select(names).unionByName(part)
    return now.drop("last", "n", "next", "busy")


def longest_earlier(levels: list[DataFrame]) -> DataFrame:
    """(pos, length, source, copies): the longest prefix of each suffix that occurs earlier, where first, and how often in all.

    An interval of the suffix array with a common prefix of ``length`` lines is a row for each of its members; the least is ``source``.  Only the first suffix
    of each interval twice as long is a member: the others have their answer further down, and all of one such interval share with an outsider what its first
    shares.  So an interval is split by the next 2**k lines, k descending: parts of two members or more are intervals of their own, and their
    first members stay to be told apart by fewer lines.  Each suffix waits for its answer in one interval only, so the rows stay as many.
    """
    whole = lambda k: F.col("at") + (1 << k) - 1 <= F.col("last")
    # Where a suffix starts, and where its stretch ends.
    place = F.struct("pos", "end").alias("place")
    alike, parts = [], []
    for k, now in enumerate(levels):
        now = now.where((F.col("n") > 1) & whole(k)).withColumn("end", F.col("pos") + F.col("last") - F.col("at"))
        alike.append(now.select(F.col("pos").alias("after"), F.col("r").alias("key")))
        twice = now.where(whole(k + 1)).groupBy("r", "next").agg(F.min(place).alias("place"), F.count(F.lit(1)).alias("w")).select("r", "place", "w")
        members = twice.unionByName(now.where(~whole(k + 1)).select("r", place, F.lit(1).cast("long").alias("w")))
        heads = members.groupBy("r").agg(F.min("place.pos").alias("source"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        parts.append(members.join(heads, "r").select(F.lit(1 << k).cast("long").alias("length"), "source", "place", "w"))
    rows = parts[-1]
    for k in range(len(levels) - 2, -1, -1):
        after = F.col("place.pos") + F.col("length")
        inside = rows.withColumn("after", F.when(after + (1 << k) - 1 <= F.col("place.end"), after).otherwise(-1 - F.col("place.pos")))
        keyed = written(inside.join(alike[k], "after", "left").drop("after"), "intervals")
        groups = keyed.where("key IS NOT NULL").groupBy("length", "source", "key").agg(F.min("place").alias("low"), F.sum("w").alias("whole"), F.count(F.lit(1)).alias("n"))
        longer = keyed.join(groups.where("n > 1"), ["length", "source", "key"]).select((F.col("length") + (1 << k)).alias("length"), F.col("low.pos").alias("source"), "place", "w")
        stay = groups.select("length", "source", F.col("low").alias("place"), F.col("whole").alias("w")).unionByName(keyed.where("key IS NULL").select("length", "source", "place", "w"))
        shared = stay.groupBy("length", "source").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        rows = longer.unionByName(stay.join(shared, ["length", "source"]).select("length", "source", "place", "w")).unionByName(parts[k])
    rows = rows.select("length", "source", "place.pos", "w")
    rows = written(rows, "intervals")
    return rows.join(rows.groupBy("length", "source").agg(F.sum("w").alias("copies")), ["length", "source"]).where("pos > source").select("pos", "length", "source", "copies")


def _runs(pos: np.ndarray, words: np.ndarray, length: np.ndarray, source: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs that are long enough: overlapping prefixes with one displacement; ``pos`` ascends."""
    total = np.concatenate([[0], np.cumsum(words)])
    here = np.arange(len(pos))
    end = np.minimum(here + length, len(pos))
    at = np.flatnonzero((length > 0) & (total[end] - total[here] >= min_words))
    if not len(at):
        return at, at
    order = np.lexsort((at, (pos - source)[at]))
    at = at[order]
    way, reach = (pos - source)[at], end[at]
    lift = np.cumsum(np.append(0, way[1:] != way[:-1])) * (len(pos) + 1)
    furthest = np.maximum.accumulate(reach + lift)
    first = np.append(True, at[1:] + lift[1:] > furthest[:-1])
    heads = np.flatnonzero(first)
    return at[heads], (furthest - lift)[np.append(heads[1:], len(at)) - 1]


def _cleaned(docs: DataFrame, min_words: int, text: str, doc_id: str) -> DataFrame:
    """Every row as struct ``row`` with its ``doc_id``, ``n_lines``, the numbers of its ``deleted`` lines, and the text ``kept``."""
    min_words = max(1, min_words)
    keyed = _keyed(docs, text, doc_id)
    texts = _texts(keyed)
    lists = suffix_array(keyed, texts, min_words).groupBy("start").agg(F.sort_array(F.collect_list(F.struct("at", "pos", "line_no", "words", "length", "source"))).alias("lines"), F.max("length").alias("most"))
    marks = texts.join(written(lists.where("most > 0").drop("most"), "lists"), "start", "left").where("copied OR lines IS NOT NULL").select("text_key", F.col("row_key").alias("first_key"), "lines")
    marks = written(marks, "marks")
    size = marks.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.greatest(F.size("lines"), F.lit(0))), F.lit(0))).first()
    if size[0] <= BROADCAST_ROWS and size[1] <= BROADCAST_LINES:
        marks = F.broadcast(marks)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    n_lines = (F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1).cast("long")
    wide = _keyed(docs, text, doc_id, whole.alias("row")).join(marks, "text_key", "left").select("doc_id", "row", n_lines.alias("n_lines"), (F.col("first_key") != F.col("row_key")).alias("later"), "lines")
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts, marked = batch.column(1).field(place), batch.column(3)
            kept: list[str | None] = [None] * batch.num_rows
            gone: list[list[int]] = [[] for _ in kept]
            for i in np.flatnonzero(marked.is_valid()):
                said = str(texts[i].as_py() or "")
                if marked[i].as_py():
                    if len(_WORD.findall(said)) >= min_words:
                        gone[i] = [k for k, line in enumerate(said.split("\n")) if _WORD.search(line)]
                elif batch.column(4)[i].is_valid:
                    _, pos, number, words, length, source = (batch.column(4)[i].values.field(k).to_numpy() for k in range(6))
                    edge = np.zeros(len(pos) + 1, np.int64)
                    for a, b in zip(*_runs(pos, words, length, source, min_words), strict=True):
                        edge[a] += 1
                        edge[b] -= 1
                    gone[i] = number[np.cumsum(edge[:-1]) > 0].tolist()
                if gone[i]:
                    away = set(gone[i])
                    kept[i] = "\n".join(x for k, x in enumerate(said.split("\n")) if k not in away)
            columns = [*batch.columns[:3], pa.array(kept, pa.string()), pa.array(gone, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "n_lines", "kept", "deleted"])

    schema = StructType([wide.schema[c] for c in ("doc_id", "row", "n_lines")]).add("kept", "string").add("deleted", ArrayType(IntegerType()))
    done = wide.mapInArrow(run, schema)
    return done.withColumn("kept", F.coalesce("kept", F.col(f"row.`{text}`").cast("string"), F.lit("")))


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, line, lines, copies) of each run of lines with ``min_words`` words or more that has an earlier copy and lies in no longer one.

    ``line`` is the number of its first line, ``lines`` counts those with a word, ``copies`` how often the run occurs in the sequence, in which a text that several
    documents hold stands once.  A later copy of a whole text is one run, of 0 copies that are not counted.
    """
    min_words = max(1, min_words)
    keyed, levels = _keyed(docs, text, doc_id), []
    texts = _texts(keyed)
    lines = suffix_array(keyed, texts, min_words, levels).select("start", "at", "line_no", "words", "pos")
    lines = lines.join(longest_earlier(levels).select("pos", "length", "copies"), "pos", "left").withColumn("length", F.coalesce("length", F.lit(0).cast("long")))
    before = F.when(F.lag("at").over(_in_document()) == F.col("at") - 1, F.lag("length").over(_in_document())).otherwise(F.lit(0))
    lines = written(lines.withColumn("before", F.coalesce(before, F.lit(0))).withColumn("total", F.sum("words").over(_in_document())), "runs")
    heads = lines.where("length > 0 AND length >= before").withColumn("end", F.col("pos") + F.col("length") - 1)
    ends = lines.select(F.col("pos").alias("end"), F.col("total").alias("at_end"))
    runs = heads.join(ends, "end").where(F.col("at_end") - F.col("total") + F.col("words") >= min_words).select("start", F.col("line_no").alias("line"), F.col("length").cast("int").alias("lines"), "copies")
    rows = keyed.select("doc_id", "text_key", "row_key", "text").join(texts.select("text_key", F.col("row_key").alias("first_key"), "start"), "text_key")
    full = F.filter(F.transform(F.split("text", "\n"), lambda line, k: F.when(line.rlike(_WORD.pattern), k)), lambda k: k.isNotNull())
    later = rows.where("row_key <> first_key").where(F.regexp_count("text", F.lit(_WORD.pattern)) >= min_words)
    later = later.select("doc_id", full[0].alias("line"), F.size(full).alias("lines"), F.lit(0).cast("long").alias("copies"))
    return rows.where("row_key = first_key").select("doc_id", "start").join(runs, "start").drop("start").unionByName(later)


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without later copies of repeated runs; documents left without a word, that had one, go; ``n_chars``, where there is one, follows."""
    done = _cleaned(docs, min_words, text, doc_id).where((F.size("deleted") == 0) | F.col("kept").rlike(r"[^\x20\x09-\x0D]"))
    touched = F.size("deleted") > 0
    cols = []
    for c in docs.columns:
        own = F.col(f"row.`{c}`")
        if c == text:
            own = F.when(touched, F.col("kept")).otherwise(own)
        elif c == "n_chars":
            own = F.when(touched, F.length("kept").cast(docs.schema[c].dataType)).otherwise(own)
        cols.append(own.alias(c))
    return done.select(*cols)


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    done = _cleaned(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), MIN_WORDS, "text", "doc_id")
    return done.select("doc_id", "n_lines", F.size("deleted").cast("long").alias("n_deleted"), F.concat_ws(",", F.col("deleted").cast("array<string>")).alias("deleted"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLES = {
    "op10_line_dedup": rf"""
    WITH l AS (SELECT doc_id, i - 1 AS no, s[i] AS line, len(regexp_extract_all(s[i], '[^\x20\x09-\x0D]+')) AS words
                 FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))),
    q AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS a FROM l WHERE words > 0),
    m AS (SELECT x.doc_id AS xd, x.a AS xa, x.no, x.words, y.doc_id AS yd, x.a - y.a AS diagonal FROM q x JOIN q y
            ON x.line = y.line AND (y.doc_id < x.doc_id OR y.doc_id = x.doc_id AND y.a < x.a)),
    g AS (SELECT *, xa - row_number() OVER (PARTITION BY xd, yd, diagonal ORDER BY xa) AS island FROM m),
    r AS (SELECT xd, no, sum(words) OVER (PARTITION BY xd, yd, diagonal, island) AS total FROM g),
    gone AS (SELECT DISTINCT xd AS doc_id, no FROM r WHERE total >= {MIN_WORDS})
    SELECT l.doc_id, count(*)::BIGINT AS n_lines, count(gone.no)::BIGINT AS n_deleted, coalesce(string_agg(gone.no::VARCHAR, ',' ORDER BY l.no) FILTER (gone.no IS NOT NULL), '') AS deleted,
      sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.no) FILTER (gone.no IS NULL), '')) AS kept_sha256
    FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.no = l.no GROUP BY l.doc_id"""
}
QUERIES = {"op10_line_dedup": op10_line_dedup}
