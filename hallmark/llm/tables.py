"""Step tables in the shared folder, and Arrow settings for long texts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from hallmark.session import shared_dir

# Rows of a batch are bounded by bytes as well, for texts of any length.
BATCH_BYTES = 8 << 20


def settled(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches that Python workers get."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def folder(spark: SparkSession) -> str:
    """A new folder's path in the shared folder."""
    return f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}"


def step(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read again: a lineage cut that survives
    the loss of executors."""
    spark = df.sparkSession
    path = folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return settled(spark).read.parquet(f"{sf_dir}/{name}.parquet")
