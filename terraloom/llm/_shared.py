"""The folder that the driver and all executors share, and orders of whole tables."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a new temporary folder in a local session, as in tests, and else an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-terraloom-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read again: cuts the lineage, and survives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write
    if by:
        writer = writer.partitionBy(*by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 2000) -> Iterator[None]:
    """Jobs that are run inside hand at most ``rows`` rows at once to Python: pairs of whole texts need less memory so."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def bounded_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """From here on the session hands at most ``size`` bytes at once to Python, or the one row that is larger, unless its bound is lower.

    It is set for the session, since Spark reads it when a job runs: that is after the operator has returned its DataFrame.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(\d+)([kmgtp]?)b?", spark.conf.get(name).strip().lower()).groups()
    bound = int(number) << 10 * " kmgtp".index(unit or " ")
    if bound > size:
        spark.conf.set(name, str(size))


def indexed(rows: DataFrame, by: list[str], name: str = "idx", weight: str | None = None) -> DataFrame:
    """``rows`` with ``name``: the number of rows (or sum of ``weight``) before each in the order of ``by``, over the whole table.

    Rows are dealt to partitions by sampled quantiles of ``by``, whatever its values; each partition is summed and sorted by
    itself, and only the sums, a row for each partition, are ordered as a whole.  ``by`` should tell all rows apart.
    """
    one = F.col(weight) if weight else F.lit(1)
    spread = written(rows.repartitionByRange(*by).withColumn("__part", F.spark_partition_id()), "ranges")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    sums = spread.groupBy("__part").agg(F.sum(one).alias("__n"))
    sums = sums.select("__part", F.coalesce(F.sum("__n").over(before.orderBy("__part")), F.lit(0)).alias("__offset"))
    inside = F.coalesce(F.sum(one).over(before.partitionBy("__part").orderBy(*by)), F.lit(0))
    placed = spread.withColumn("__inside", inside).join(F.broadcast(sums), "__part")
    return placed.withColumn(name, (F.col("__offset") + F.col("__inside")).cast("long")).drop("__part", "__offset", "__inside")
