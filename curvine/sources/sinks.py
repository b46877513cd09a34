"""Writers for result frames, metric rows and selections."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from curvine.session import ensure_checkpoint_dir


def write_partitions(df: DataFrame, path: str, by: str) -> None:
    """Parquet, one folder per value of ``by``; hot values are written by several tasks.

    No shuffle by value: every task writes what it has, so a value with a third of
    the rows is not one task's work.
    """
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def write_round(df: DataFrame, path: str, column: str, value: int) -> None:
    """Replace one round's partition and leave the other rounds alone."""
    df.write.mode("overwrite").parquet(f"{path}/{column}={int(value)}")


def append_metrics(df: DataFrame, path: str, kind: str = "json") -> None:
    """Append metric rows as JSON lines or as CSV with a header."""
    writer = df.write.mode("append")
    if kind == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.json(path)


def scratch_folder(spark: SparkSession) -> str:
    """A fresh folder in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    base = spark.sparkContext.getCheckpointDir()
    return f"{base}/scratch-{uuid.uuid4().hex}"
