"""Token counts by field or section: whole documents are encoded once, and tokens are attributed by their offsets.

Each text is encoded as a whole, so counts add up to what a model sees.  Every token's characters come from the byte
lengths of the vocabulary; its span is joined to the sections' spans as intervals (both are sorted), and tokens that cross
a boundary are allocated by an explicit rule:

* ``first``: to the section of the token's first character; ``last``: of its last one;
* ``majority``: to the section with most of its characters, the earlier one on a tie.

A token that holds only part of a character's bytes counts as holding the character.  No shuffle: each text is counted by itself.

Defined cases: null and empty texts have no tokens, and one empty section; empty sections have none; repeated rows and
null ids are kept; an empty table gives an empty result; other columns of the input are not used.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public pre-tokenisation pattern of that vocabulary (a fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("first", "last", "majority")


@lru_cache(maxsize=4)
def encoder(path: str = VOCABULARY):
    """The encoding and the byte length of each of its tokens."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values(), default=0) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def token_spans(text: str, path: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, first characters and ends (exclusive, in code points) of the tokens of a whole text."""
    encoding, lengths = encoder(path)
    ids = np.array(encoding.encode_ordinary(text), np.int64)
    ends = np.cumsum(lengths[ids])
    starts = ends - lengths[ids]
    if len(text) == (ends[-1] if len(ends) else 0):
        return ids, starts, ends
    data = np.frombuffer(text.encode(), np.uint8)
    point = np.cumsum((data & 0xC0) != 0x80) - 1
    return ids, point[starts], point[ends - 1] + 1


def allocate(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section by the rule, and tokens of each that reach beyond it; section i is bounds[i] to bounds[i + 1]."""
    n = len(bounds) - 1
    # Of sections that begin at one place only the last has characters.
    first = np.searchsorted(bounds, starts, side="right") - 1
    last = np.searchsorted(bounds, ends - 1, side="right") - 1
    to = first.copy() if rule != "last" else last
    cross = np.flatnonzero(first != last)
    crossing = np.zeros(n, np.int64)
    for k in cross:
        held = np.arange(first[k], last[k] + 1)
        part = np.minimum(ends[k], bounds[held + 1]) - np.maximum(starts[k], bounds[held])
        crossing[held[part > 0]] += 1
        if rule == "majority":
            to[k] = held[np.argmax(part)]
    return np.bincount(to, minlength=n), crossing


def line_bounds(text: str) -> np.ndarray:
    """Bounds of the lines, each with its line feed."""
    at = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 10) + 1
    return np.concatenate([[0], at, [len(text)]])


def by_line(docs: DataFrame, rule: str = "first", vocabulary: str = VOCABULARY, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, section_no, start, end, n_tokens, n_crossing) for every line of every text."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    names = ["doc_id", "section_no", "start", "end", "n_tokens", "n_crossing"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = []
            ids = batch.column(0)
            for k, said in enumerate(batch.column(1)):
                said = said.as_py()
                _, starts, ends = token_spans(said, vocabulary)
                bounds = line_bounds(said)
                counts, crossing = allocate(starts, ends, bounds, rule)
                n = len(counts)
                out.append([np.full(n, k), np.arange(n), bounds[:-1], bounds[1:], counts, crossing])
            if out:
                row, *rest = (np.concatenate(c) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), *(pa.array(c.astype(np.int64)) for c in rest)], names)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def by_field(docs: DataFrame, fields: list[str], separator: str = "\n", rule: str = "first", vocabulary: str = VOCABULARY, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, total, tokens): documents made of several fields, joined by the separator (which belongs to the field before), encoded as one; ``tokens`` by field."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.zeros((batch.num_rows, len(fields)), np.int64)
            for k, parts in enumerate(batch.column(1).to_pylist()):
                parts = [p + separator for p in parts[:-1]] + parts[-1:]
                _, starts, ends = token_spans("".join(parts), vocabulary)
                counts[k] = allocate(starts, ends, np.concatenate([[0], np.cumsum([len(p) for p in parts])]), rule)[0]
            maps = pa.MapArray.from_arrays(np.arange(batch.num_rows + 1, dtype=np.int32) * len(fields), pa.array(fields * batch.num_rows, pa.string()), pa.array(counts.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts.sum(axis=1)), maps], ["doc_id", "total", "tokens"])

    said = F.array(*[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), said.alias("parts")).mapInArrow(run, "doc_id long, total long, tokens map<string,long>")


def with_token_count(docs: DataFrame, keep: list[Column], vocabulary: str = VOCABULARY, text: str = "text") -> DataFrame:
    """The ``keep`` columns of every row with ``n_tokens`` of its whole text."""
    rows = docs.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, _ = encoder(vocabulary)
        for batch in batches:
            counts = [len(encoding.encode_ordinary(x.as_py())) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], [*batch.schema.names[:-1], "n_tokens"])

    return rows.mapInArrow(run, f"{kinds}, n_tokens long")


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    return by_line(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op2_token_counts": op2_token_counts}
ORACLES: dict = {}
