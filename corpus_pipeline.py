"""A corpus pipeline: quality rules, line dedup, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on every row that its predecessor kept, and returns a DataFrame; all but the
last return the columns of documents.  ``run`` writes each stage's result as Parquet to the shared folder and reads it
again for the next stage, so a lost executor repeats one stage at most.  Each stage bounds the bytes that the session hands
to Python at once, since texts may be long.

Defined cases, for every stage: an empty table gives an empty table; null ids stay null; other columns, whatever their
names, are kept (but by packing).  Null or empty texts fail the quality rules; by themselves they pass line dedup and private data
as they are, are near duplicates of nothing, and have 0 tokens.  Rows that repeat id and text: quality rules, line dedup, private data and packing
treat each alike, near duplicates keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terraloom.llm._shared import bounded_batches, written
from terraloom.llm.line_dedup import dedup_lines
from terraloom.llm.ngram_join import keep_one
from terraloom.llm.packing import pack_documents
from terraloom.llm.private_data import sanitise
from terraloom.llm.quality_rules import keep


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules accept, unchanged."""
    bounded_batches(spark)
    return keep(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated runs of lines; those with nothing left go."""
    bounded_batches(spark)
    return dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id."""
    bounded_batches(spark)
    return keep_one(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data, and the terms that reveal it, generalised."""
    bounded_batches(spark)
    return sanitise(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, bucket, bound, batch, place) of every document."""
    bounded_batches(spark)
    return pack_documents(docs)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near duplicates", near_duplicates), ("private data", private_data), ("packing", packing)]

#: SQL cannot express token counts and the disclosing terms; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
    return docs
