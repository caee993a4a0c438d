"""The folder that every executor reaches, and cutting lineage in loops."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a new temporary folder in a local session, as in tests, and else an error."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-terraloom-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once, for loops: as :func:`kept`. checkpoint() keeps the plan's estimate of bytes, which is a product over joins: in a loop its digits multiply each round until the driver has no memory left."""
    return kept(df)


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once, by a Parquet table in the shared folder; unlike checkpoint(), which runs a plan once to know it and once more to write it."""
    spark = df.sparkSession
    path = scratch(spark, "kept")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
