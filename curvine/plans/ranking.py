"""Ranks, running totals and selections that never pull a group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvine.session import checkpoint


def top_k_within(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of every group, for a small k.

    Spark limits each group before the shuffle (WindowGroupLimit), so a task
    never receives more than k rows per group and input partition.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w).cast("bigint")).filter(F.col(rank) <= k)


def running_totals(
    df: DataFrame, order: Sequence[Column], sums: dict[str, Column], group: Sequence[str] = (), totals_too: bool = False,
    settle: bool = False, few: bool = False,
) -> DataFrame:
    """Add inclusive running totals of ``sums`` in the given order, inside each group.

    ``totals_too`` also adds the total of the whole group as ``<name>_total``.
    Range partitioning reads its input twice, once for a sample; ``settle`` writes
    the few columns down first, for inputs that are costly to compute. ``few``
    says that the caller has counted the rows and one task may hold them all,
    which then needs neither a range partitioning nor offsets.

    Rows are range partitioned by (group, order), so a hot group spreads over many
    partitions; totals per partition give the offsets, and each partition then
    accumulates on its own. ``order`` must name every row uniquely.
    """
    group = list(group)
    if few:
        whole = Window.partitionBy(*group)
        upto = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        summed = df.coalesce(1).withColumns({f"_v_{n}": c for n, c in sums.items()})
        return summed.select(
            *df.columns, *[F.sum(f"_v_{n}").over(upto).alias(n) for n in sums], *[F.sum(f"_v_{n}").over(whole).alias(f"{n}_total") for n in sums if totals_too]
        )
    prepared = (checkpoint(df) if settle else df).withColumns({f"_v_{n}": c for n, c in sums.items()})
    # fixed by the checkpoint: a rerun task could draw other range bounds
    parts = checkpoint(
        prepared.repartitionByRange(*[F.col(g) for g in group], *order).withColumn("_part", F.spark_partition_id())
    )
    totals = parts.groupBy(*group, "_part").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    # one row per partition and group: this table is as small as the partition count
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    offsets = totals.select(
        *group,
        "_part",
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *[F.sum(f"_t_{n}").over(whole).alias(f"{n}_total") for n in sums],
    )
    local = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = parts.join(offsets, [*group, "_part"])
    return joined.select(
        *df.columns,
        *[(F.col(f"_o_{n}") + F.sum(f"_v_{n}").over(local)).alias(n) for n in sums],
        *[f"{n}_total" for n in sums if totals_too],
    )


def rank_rows(df: DataFrame, order: Sequence[Column], group: Sequence[str] = (), rank: str = "rank", totals_too: bool = False, settle: bool = False) -> DataFrame:
    """Exact 1-based rank inside each group, at any group size; also the group's size on request."""
    return running_totals(df, order, {rank: F.lit(1).cast("bigint")}, group, totals_too, settle)


def half_even(value: Column) -> Column:
    """Round to a whole number, halves to even; for DECIMAL or double input."""
    return F.bround(value, 0).cast("bigint")
