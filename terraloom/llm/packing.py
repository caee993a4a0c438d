"""Length buckets of least padding, and batches within a token budget inside each bucket.

The global histogram of lengths is an aggregate; dynamic programming over it picks the bucket bounds that minimise
padding (each sequence is padded to its bucket's bound, the greatest length in the bucket).  Every length that occurs has
a bin of its own, so the bounds are optimal for the table.  The histogram that reaches the driver has at most
min(longest + 1, sqrt(2 x tokens of the corpus) + 1) rows, since distinct lengths sum to no more than the tokens.

Batches: in order of doc_id, a bucket's sequences fill batches of max(1, budget // bound).  The place in a bucket is the
place in the order of (bucket, doc_id) over the whole table, which is dealt to partitions by quantiles: no bucket is ordered
in one task, whatever the ids are, and the same rows get the same batches at every partitioning.

Defined cases: a null or empty text has length 0 and lies in the first bucket; a text longer than the budget is a batch
by itself; rows that repeat an id are ordered by length; null ids come first; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import indexed, written
from .token_counts import VOCABULARY, with_token_count

N_BUCKETS = 16
BUDGET = 65_536


def optimal_bounds(lengths: np.ndarray, counts: np.ndarray, totals: np.ndarray, n_buckets: int = N_BUCKETS) -> tuple[list[int], int]:
    """Greatest lengths of at most ``n_buckets`` buckets with the least padding, and that padding.

    ``lengths`` ascend (greatest of each bin), with the rows and the summed lengths of each bin.  The cost of a bucket
    satisfies the quadrangle inequality, so the best split points ascend and each layer takes n log n steps.
    """
    n = len(lengths)
    if not n:
        return [], 0
    c = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    s = np.concatenate([[0], np.cumsum(totals)]).astype(np.int64)
    best = lengths.astype(np.int64) * c[1:] - s[1:]  # one bucket for bins 0..j
    came = [np.zeros(n, np.int64)]
    for _ in range(1, min(n_buckets, n)):
        new, at = best.copy(), np.zeros(n, np.int64)
        at[:] = -1  # fewer buckets are as good
        todo = [(1, n - 1, 1, n - 1)]
        while todo:
            low, high, first, last = todo.pop()
            if low > high:
                continue
            j = (low + high) // 2
            i = np.arange(first, min(last, j) + 1)  # the last bucket holds bins i..j
            costs = best[i - 1] + lengths[j] * (c[j + 1] - c[i]) - (s[j + 1] - s[i])
            k = int(np.argmin(costs))
            if costs[k] < new[j]:
                new[j], at[j] = costs[k], i[k]
            todo += [(low, j - 1, first, int(i[k])), (j + 1, high, int(i[k]), last)]
        came.append(at)
        best = new
    bounds, j = [], n - 1
    for at in reversed(came):
        if at[j] == -1:
            continue
        bounds.append(int(lengths[j]))
        j = int(at[j]) - 1
        if j < 0:
            break
    return bounds[::-1], int(best[-1])


def histogram(lengths: DataFrame) -> DataFrame:
    """(n_tokens, n) of every length in a table."""
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n"))


def pack(lengths: DataFrame, n_buckets: int = N_BUCKETS, budget: int = BUDGET) -> DataFrame:
    """(doc_id, n_tokens, bucket, bound, batch, place) of every row of ``lengths`` (doc_id, n_tokens)."""
    lengths = written(lengths.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("n_tokens").cast("long").alias("n_tokens")), "lengths")
    found = histogram(lengths).orderBy("n_tokens").toArrow()
    each, n = (found.column(k).to_numpy() for k in ("n_tokens", "n"))
    bounds, _ = optimal_bounds(each, n, each * n, n_buckets)
    bucket, bound, first = F.lit(None).cast("int"), F.lit(None).cast("long"), F.lit(None).cast("long")
    earlier = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(each, [-1, *bounds[:-1]], side="right")] if bounds else []
    for k in range(len(bounds) - 1, -1, -1):
        inside = F.col("n_tokens") <= bounds[k]
        bucket = F.when(inside, F.lit(k)).otherwise(bucket)
        bound = F.when(inside, F.lit(bounds[k]).cast("long")).otherwise(bound)
        first = F.when(inside, F.lit(int(earlier[k])).cast("long")).otherwise(first)
    placed = lengths.withColumn("bucket", bucket).withColumn("bound", bound).withColumn("first", first).withColumn("tie", F.monotonically_increasing_id())
    numbered = indexed(placed, ["bucket", "doc_id", "n_tokens", "tie"]).withColumn("at", F.col("idx") - F.col("first"))
    size = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.greatest(F.col("bound"), F.lit(1))).cast("long"))
    return numbered.select("doc_id", "n_tokens", "bucket", "bound", F.floor(F.col("at") / size).cast("long").alias("batch"), (F.col("at") % size).cast("long").alias("place"))


def pack_documents(docs: DataFrame, n_buckets: int = N_BUCKETS, budget: int = BUDGET, vocabulary: str = VOCABULARY) -> DataFrame:
    """:func:`pack` over the tokens of whole texts."""
    return pack(with_token_count(docs, [F.col("doc_id").cast("long").alias("doc_id")], vocabulary), n_buckets, budget)


def op6_length_buckets(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op6_length_buckets": op6_length_buckets}
ORACLES: dict = {}
