"""Block joins: all-against-all work inside groups, cut into bounded tasks.

Both sides get a block number inside their group, and one task sees one pair of
blocks. A group with a third of all rows becomes many blocks, so no task ever
holds a whole group, and a task reports only its answers (the k nearest, one
maximum, a spanning forest), never its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvine.functions.vectors import any_of

# Larger blocks copy each row less often (once per block on the other side), but two of
# them must fit into a task beside a chunk of distances: at most so many rows, and so
# many bytes of doubles.
BLOCK_ROWS = 16384
BLOCK_BYTES = 128 * 1024 * 1024
ALL = "_all"
# Rows that a kernel's answer takes along in one batch.
BATCH_ROWS = 1 << 16


def _blocks(count, block_rows: Column):
    return F.greatest(F.lit(1), F.ceil(F.coalesce(count, F.lit(0)) / block_rows)).cast("int")


def _row_limit(df: DataFrame, block_rows: int) -> Column:
    """Rows of a block: ``block_rows``, or fewer if that many vectors ``vec`` as long as the first take too many bytes."""
    if "vec" not in df.columns:
        return F.lit(block_rows)
    width = df.select(F.size("vec").alias("w")).limit(1).scalar()
    return F.greatest(F.lit(1), F.least(F.lit(block_rows), F.floor(F.lit(BLOCK_BYTES) / (8 * F.greatest(F.coalesce(width, F.lit(1)), F.lit(1)))))).cast("int")


def _scalar_count(df: DataFrame):
    return df.agg(F.count(F.lit(1)).alias("n")).scalar()


def _with_block_counts(df: DataFrame, names: list[str], sizes: DataFrame | None, totals, block_rows):
    """Attach how many blocks the group has on each side.

    Only groups above one block are looked up, at most rows / block_rows of them:
    100 TB of 4 KB vectors give at most 1.6 million entries, about 60 MB. They are
    broadcast, so the vectors are not shuffled just to learn their block count.
    """
    if sizes is None:
        return df.select("*", *[_blocks(t, block_rows).alias(n) for n, t in zip(names, totals)])
    hot = sizes.filter(any_of([F.col(n) > block_rows for n in names]))
    return df.join(F.broadcast(hot), "g", "left").withColumns({n: _blocks(F.col(n), block_rows) for n in names})


def block_join(
    left: DataFrame,
    right: DataFrame,
    kernel: Callable[[tuple, pa.Table, pa.Table], pa.Table],
    schema: str,
    grouped: bool,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Run ``kernel(group, left block, right block)`` over every pair of blocks in a group.

    Both inputs have the same columns; with ``grouped`` one of them is ``g``.
    """
    limit = _row_limit(right, block_rows)
    sizes, totals = None, None
    if grouped:
        sizes = (
            left.select("g", F.lit(1).alias("l"), F.lit(0).alias("r"))
            .unionByName(right.select("g", F.lit(0).alias("l"), F.lit(1).alias("r")))
            .groupBy("g")
            .agg(F.sum("l").alias("nl"), F.sum("r").alias("nr"))
        )
    else:
        totals = (_scalar_count(left), _scalar_count(right))
        left, right = (d.withColumn("g", F.lit(0)) for d in (left, right))
    left = _with_block_counts(left, ["nl", "nr"], sizes, totals, limit)
    right = _with_block_counts(right, ["nl", "nr"], sizes, totals, limit)
    left = left.select(
        "*",
        F.lit(0).alias("side"),
        F.pmod(F.xxhash64("id"), F.col("nl")).cast("int").alias("lb"),
        F.explode(F.sequence(F.lit(0), F.col("nr") - 1)).alias("rb"),
    )
    right = right.select(
        "*",
        F.lit(1).alias("side"),
        F.explode(F.sequence(F.lit(0), F.col("nl") - 1)).alias("lb"),
        F.pmod(F.xxhash64("id"), F.col("nr")).cast("int").alias("rb"),
    )

    def run(key: tuple, table: pa.Table) -> pa.Table:
        is_right = table.column("side").to_numpy() == 1
        return kernel(
            key[0].as_py(), table.filter(pa.array(~is_right)), table.filter(pa.array(is_right))
        )

    return (
        left.unionByName(right).drop("nl", "nr").groupBy("g", "lb", "rb").applyInArrow(run, schema)
    )


def self_block_join(
    df: DataFrame,
    kernel: Callable[[object, pa.Table, pa.Table | None], pa.Table | Iterator[pa.Table]],
    schema: str,
    grouped: bool,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Every unordered pair of blocks once; the second block is None for a block with itself.

    A kernel whose answer may be large gives it in parts, which leave the task one by one.
    """
    limit = _row_limit(df, block_rows)
    sizes, totals = None, None
    if grouped:
        sizes = df.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    else:
        totals = (_scalar_count(df),)
        df = df.withColumn("g", F.lit(0))
    df = _with_block_counts(df, ["n"], sizes, totals, limit)
    own = df.withColumn("own", F.pmod(F.xxhash64("id"), F.col("n")).cast("int")).select(
        "*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other")
    )
    tasks = own.select(
        *[c for c in df.columns if c != "n"],
        "own",
        F.least("own", "other").alias("lb"),
        F.greatest("own", "other").alias("rb"),
    )

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        group, lb, rb = (k.as_py() for k in key)
        if lb == rb:
            found = kernel(group, table, None)
        else:
            first = pa.array(table.column("own").to_numpy() == lb)
            found = kernel(group, table.filter(first), table.filter(pc.invert(first)))
        for part in [found] if isinstance(found, pa.Table) else found:
            yield from part.to_batches(max_chunksize=BATCH_ROWS)

    return tasks.groupBy("g", "lb", "rb").applyInArrow(run, schema)
