"""Tables that may travel whole: only after a check of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# 64 MB of doubles: what one task may hold beside its own block.
MAX_BROADCAST_BYTES = 64 * 1024 * 1024
MAX_ROWS = 100_000


class TooLarge(ValueError):
    """A table that was to travel whole is larger than its bound."""


def collect_bounded(df: DataFrame, max_rows: int = MAX_ROWS) -> list:
    """Collect a table whose size is bounded by a parameter, and fail if it is not."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise TooLarge(f"more than {max_rows} rows")
    return rows


def fits(rows: int, width: int) -> bool:
    return rows * max(1, width) * 8 <= MAX_BROADCAST_BYTES


def broadcast_if_small(df: DataFrame, max_rows: int, row_bytes: int = 64) -> DataFrame:
    """Hint a broadcast when the given bound on the rows proves that it is small.

    Otherwise the plain table is returned, and the join shuffles.
    """
    if max_rows * row_bytes <= MAX_BROADCAST_BYTES:
        return F.broadcast(df)
    return df


def local_table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)
