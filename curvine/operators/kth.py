"""The distance to the k-th nearest row, for a large k, without sending k rows from every block.

Blocks of the base are drawn by a hash of the id, so any of them is a random sample. The
first pass looks at one of them: its distance of a rank a little above k / blocks is a
bound for nearly every query. The second pass meets all blocks, and only distances below
the bound leave a task, about k of them a query in all, with the number of those that
equal it. Whether that settles the k-th distance is counted, never assumed; the few
queries left are answered by a full search.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvine.functions import kernels
from curvine.operators import knn
from curvine.plans.blocks import BLOCK_BYTES, BLOCK_ROWS, block_join
from curvine.session import checkpoint

# Standard deviations that the rank in the sample lies above its expectation.
MARGIN = 4.0
KTH, BELOW = "query_id bigint, dist double", "query_id bigint, below array<double>, ties bigint"


def _kth_kernel(_group, left: pa.Table, right: pa.Table, *, k: int, metric: str, skip_same: bool) -> pa.Table:
    """The k-th distance of every query that has one in this block."""
    q_ids, b_ids = left.column("id").to_numpy(), right.column("id").to_numpy()
    qi, _, dist = kernels.top_k(metric, kernels.matrix(left.column("vec")), kernels.matrix(right.column("vec")), k, q_ids, b_ids, skip_same, tie_ids=b_ids)
    last = np.searchsorted(qi, qi, side="left") + k - 1 == np.arange(len(qi))
    return pa.table({"query_id": pa.array(q_ids[qi[last]], pa.int64()), "dist": pa.array(dist[last], pa.float64())})


def _below_kernel(_group, left: pa.Table, right: pa.Table, *, metric: str, skip_same: bool) -> pa.Table:
    """Per query the distances below its bound, and how many equal it."""
    q_ids, b_ids = left.column("id").to_numpy(), right.column("id").to_numpy()
    bound = left.column("bound").to_numpy()
    qi, dist = kernels.up_to(metric, kernels.matrix(left.column("vec")), kernels.matrix(right.column("vec")), bound, q_ids, b_ids, skip_same)
    ties = np.bincount(qi[dist == bound[qi]], minlength=len(q_ids))
    less = dist < bound[qi]
    order = np.argsort(qi[less], kind="stable")
    counts = np.bincount(qi[less], minlength=len(q_ids))
    some = (counts > 0) | (ties > 0)
    ends = np.concatenate([[0], np.cumsum(counts[some])]).astype(np.int32)
    return pa.table({
        "query_id": pa.array(q_ids[some], pa.int64()),
        "below": pa.ListArray.from_arrays(pa.array(ends), pa.array(dist[less][order], pa.float64())),
        "ties": pa.array(ties[some], pa.int64()),
    })


def sample_rank(k: int, blocks: int) -> int:
    """The rank in one block that lies beyond the k-th row of all, but for very few queries."""
    share = k / blocks
    return math.ceil(share + MARGIN * math.sqrt(share) + MARGIN)


def below_bounds(queries: DataFrame, base: DataFrame, bounds: DataFrame, metric: str, exclude_self: bool, block_rows: int) -> DataFrame:
    """``(query_id, below array<double>, ties)``, a row per query and base block, for sides ``(id, vec)`` and ``bounds (query_id, dist)``."""
    left = queries.join(bounds.select(F.col("query_id").alias("id"), F.col("dist").alias("bound")), "id")
    right = base.withColumn("bound", F.lit(None).cast("double"))
    return block_join(left.select("id", "vec", "bound"), right.select("id", "vec", "bound"), partial(_below_kernel, metric=metric, skip_same=exclude_self), BELOW, False, block_rows)


def kth_nearest(
    queries: DataFrame, base: DataFrame, k: int, metric: str = "sq_l2", *, exclude_self: bool = False, id_col="vec_id", vec_col="embedding",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(query_id, dist)``: the distance to the k-th nearest base row; queries with fewer rows are absent.

    Ids of queries are distinct. A base of one block, or one small enough to travel,
    sends one row a query.
    """
    left, right = (knn._side(df, id_col, vec_col, None) for df in (queries, base))
    kernel = partial(_kth_kernel, k=k, metric=metric, skip_same=exclude_self)
    if (few := knn.small_side(right)) is not None:
        held = base.sparkSession.sparkContext.broadcast(few)

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    yield from kernel(None, pa.Table.from_batches([batch]), held.value).to_batches()

        return left.mapInArrow(run, KTH)
    rows, width = right.select("id").count(), right.select(F.size("vec")).first()[0]
    block_rows = max(1, min(block_rows, BLOCK_BYTES // (8 * max(1, width))))
    blocks = math.ceil(rows / block_rows)
    if blocks == 1:
        return block_join(left, right, kernel, KTH, False, block_rows)
    sample = right.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == 0)
    first = partial(_kth_kernel, k=sample_rank(k, blocks), metric=metric, skip_same=exclude_self)
    # one block, whatever the luck of the draw
    bounds = checkpoint(block_join(left, sample, first, KTH, False, 4 * block_rows))
    found = below_bounds(left, right, bounds, metric, exclude_self, block_rows)
    # the rows of a query hold about k numbers in all
    whole = found.groupBy("query_id").agg(F.array_sort(F.flatten(F.collect_list("below"))).alias("below"), F.sum("ties").alias("ties")).join(bounds, "query_id")
    reached = F.when(F.size("below") >= k, F.element_at("below", k)).when(F.size("below") + F.col("ties") >= k, F.col("dist"))
    settled = checkpoint(whole.select("query_id", reached.alias("dist")).filter("dist IS NOT NULL"))
    rest = queries.join(settled.select(F.col("query_id").alias(id_col)), id_col, "left_anti")
    searched = knn.knn_join(rest, base, k, metric, id_col=id_col, vec_col=vec_col, exclude_self=exclude_self, block_rows=block_rows)
    return settled.unionByName(searched.filter(F.col("rank") == k).select("query_id", "dist"))


def kth_score(queries: DataFrame, base: DataFrame, k: int, metric: str = "sq_l2", *, id_col="vec_id", **options) -> DataFrame:
    """``(id, score)``, one row per query: minus the k-th distance, NULL with fewer than k rows."""
    kth = kth_nearest(queries, base, k, metric, id_col=id_col, **options).select(F.col("query_id").alias(id_col), (-F.col("dist")).alias("score"))
    return queries.select(id_col).join(kth, id_col, "left")
