"""Groups of similar sets from shared buckets: every link is verified on the whole sets.

Sets that share a bucket are candidates. They are brought in line by bucket in one range
shuffle that spreads a crowded bucket over many tasks. Each set is first verified with one
other: the set of its buckets that meets the most others, for a text that many resemble
shares most buckets. One pair per set joins most groups of near copies.

Buckets that still hold several groups are then compared whole. Small ones list their
pairs, each different pair once. Large ones are cut into pairs of blocks, in which only
the sets outside the largest group look at the others, and a task reports one link for
each two groups it joins. Large buckets with sets in common are compared together
where that means fewer comparisons than bucket by bucket. No pair of a bucket is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvine.operators.dedup import connected_components
from curvine.plans.blocks import block_join
from curvine.session import checkpoint

# A bucket of up to so many sets lists its pairs, a larger one is cut into blocks.
SMALL_BUCKET, BLOCK_ROWS = 64, 512
EDGE = 1e-9


def number_sets(prints: DataFrame, order: Column) -> DataFrame:
    """``(set_id, key, size, buckets, n, first)``, one row per distinct key of ``(key, size, buckets, ...)``, written down.

    ``first`` is the least ``order`` of the key's rows, ``n`` their number.
    """
    classes = prints.groupBy("key").agg(F.any_value("size").alias("size"), F.any_value("buckets").alias("buckets"), F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return checkpoint(classes.withColumn("set_id", F.monotonically_increasing_id()))


def shared_buckets(classes: DataFrame) -> DataFrame:
    """``(bucket, id, size)``: the sets of buckets with more than one set.

    The first and the last row of a task stay too, as their bucket may go on in the next
    task.
    """
    names = ["bucket", "id", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shared = None, True
        for batch in batches:
            rows = [batch.column(c).to_numpy() for c in names]
            if held is not None:
                rows = [np.append(h, r) for h, r in zip(held, rows)]
            if not len(rows[0]):
                continue
            # ``shared`` says whether the first row is known to stay
            same = rows[0][1:] == rows[0][:-1]
            stay = np.append(shared, same) | np.append(same, False)
            yield pa.RecordBatch.from_arrays([pa.array(r[:-1][stay[:-1]]) for r in rows], names=names)
            held, shared = [r[-1:] for r in rows], bool(stay[-1])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(h) for h in held], names=names)

    rows = classes.select(F.explode("buckets").alias("bucket"), F.col("set_id").alias("id"), F.col("size").cast("bigint").alias("size"))
    return rows.repartitionByRange("bucket", "id").sortWithinPartitions("bucket", "id").mapInArrow(run, "bucket bigint, id bigint, size bigint")


def _with_hub(shared: DataFrame, similarity: float) -> DataFrame:
    """``(id_a, id_b)``: each set and the one of its buckets whose buckets are the largest, where the sizes allow a link."""
    rows = shared.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    weight = shared.join(rows, "bucket").groupBy("id").agg(F.sum("n").alias("weight"))
    weighed = shared.join(weight, "id")
    hubs = weighed.groupBy("bucket").agg(F.max(F.struct("weight", "id", "size")).alias("hub"))
    best = F.max(F.struct("hub.weight", "hub.id", "hub.size")).alias("hub")
    picks = weighed.join(hubs, "bucket").filter(F.col("hub.id") != F.col("id")).groupBy("id", "size").agg(best)
    fits = F.least("size", "hub.size") >= similarity * F.greatest("size", "hub.size") - EDGE
    return picks.filter(fits).select(F.least("id", "hub.id").alias("id_a"), F.greatest("id", "hub.id").alias("id_b")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``(id_a, id_b)`` whose ``sets (id, parts)`` have at least this Jaccard similarity."""
    side = lambda s: sets.select(F.col("id").alias(f"id_{s}"), F.col("parts").alias(f"parts_{s}"))
    both = F.size(F.array_intersect("parts_a", "parts_b"))
    close = both >= similarity * (F.size("parts_a") + F.size("parts_b") - both) - EDGE
    # the second of a pair first: the first may be one that many are compared with
    return pairs.join(side("b"), "id_b").join(side("a"), "id_a").filter(close).select("id_a", "id_b")


def _joins(similarity: float):
    """A kernel for two blocks ``(id, parts, component)``: one verified link for each two components it joins."""

    def kernel(_, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, other = (t.column("id").to_numpy() for t in (left, right))
        flat, starts, sizes = zip(*[_flat(t) for t in (left, right)])
        names, named = np.unique(np.concatenate([t.column("component").to_numpy() for t in (left, right)]), return_inverse=True)
        mine, theirs = named[: len(ids)], named[len(ids) :]
        label = np.arange(len(names))
        values, place = np.unique(np.concatenate(flat), return_inverse=True)
        own, facing = place[: len(flat[0])], place[len(flat[0]) :]
        mark = np.zeros(len(values), np.int32)
        a, b = [], []
        for i in range(len(ids)):
            apart = label[theirs] != label[mine[i]]
            if not apart.any():
                continue
            here = own[starts[0][i] : starts[0][i] + sizes[0][i]]
            mark[here] = 1
            both = np.add.reduceat(mark[facing], starts[1])
            mark[here] = 0
            for j in np.flatnonzero(apart & (both >= similarity * (sizes[0][i] + sizes[1] - both) - EDGE)):
                if label[theirs[j]] != label[mine[i]]:
                    label[label == label[theirs[j]]] = label[mine[i]]
                    a.append(ids[i])
                    b.append(other[j])
        return pa.table({"id_a": pa.array(a, pa.int64()), "id_b": pa.array(b, pa.int64())})

    return kernel


def _flat(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All parts in a row, where each set starts, and the sizes; no set is empty."""
    sets = table.column("parts").combine_chunks()
    sizes = sets.value_lengths().to_numpy().astype(np.int64)
    return sets.flatten().to_numpy(), np.cumsum(sizes) - sizes, sizes


def _crowds(large: DataFrame, mixed: DataFrame) -> DataFrame:
    """``(g, id, component, outside)``: the sets to compare in blocks, for rows ``(bucket, id, component)`` of large buckets.

    ``mixed (bucket, rows, main, n_main)`` tells of each bucket its largest component.
    Buckets with sets in common form a cluster; a cluster is one group if that takes
    fewer comparisons than its buckets one by one.
    """
    first = large.groupBy("bucket").agg(F.min("id").alias("first"))
    star = large.join(first, "bucket").select(F.col("first").alias("id_a"), F.col("id").alias("id_b"))
    clusters = checkpoint(connected_components(star).select("id", F.col("component").alias("cluster")))
    inside = large.select("id", "component").distinct().join(clusters, "id")
    shares = inside.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("n"))
    most = shares.groupBy("cluster").agg(F.sum("n").alias("sets"), F.max(F.struct("n", "component")).alias("most"))
    of_bucket = first.join(clusters.withColumnRenamed("id", "first"), "first").join(mixed, "bucket")
    apart = of_bucket.groupBy("cluster").agg(F.sum(F.col("rows").cast("double") * (F.col("rows") - F.col("n_main"))).alias("cost"))
    together = F.col("sets").cast("double") * (F.col("sets") - F.col("most.n")) <= F.col("cost")
    chosen = checkpoint(most.join(apart, "cluster").select("cluster", F.col("most.component").alias("main"), together.alias("together")))
    whole = inside.join(chosen.filter("together"), "cluster").select(F.concat_ws(":", F.lit("c"), "cluster").alias("g"), "id", "component", (F.col("component") != F.col("main")).alias("outside"))
    alone = of_bucket.select("bucket", "cluster", "main").join(chosen.filter("NOT together").select("cluster"), "cluster").select("bucket", "main")
    single = large.join(alone, "bucket").select(F.concat_ws(":", F.lit("b"), "bucket").alias("g"), "id", "component", (F.col("component") != F.col("main")).alias("outside"))
    return whole.unionByName(single)


def linked_sets(
    classes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float, small_bucket: int = SMALL_BUCKET, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``(id, component)`` of every set that is linked with another, the component named by its smallest id.

    ``classes`` has ``(set_id, size, buckets)``, and ``sets_of`` gives ``(id, parts)``, whole
    sets without repeats, of the ids it is handed.
    """
    shared = checkpoint(shared_buckets(classes))
    sets = checkpoint(sets_of(shared.select("id").distinct()))
    tried = checkpoint(_with_hub(shared, similarity))
    links = checkpoint(verified(tried, sets, similarity))
    known = connected_components(links).select("id", "component")
    members = checkpoint(shared.join(known, "id", "left").withColumn("component", F.coalesce("component", "id")))
    # buckets of one component are done
    shares = members.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    of_bucket = shares.groupBy("bucket").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("kinds"), F.max(F.struct("n", "component")).alias("most"))
    mixed = checkpoint(of_bucket.filter("kinds > 1").select("bucket", "rows", F.col("most.component").alias("main"), F.col("most.n").alias("n_main")))
    few = members.join(mixed.filter(F.col("rows") <= small_bucket).select("bucket"), "bucket")
    large = mixed.filter(F.col("rows") > small_bucket)

    a, b = few.alias("a"), few.alias("b")
    may = (F.col("a.size") >= similarity * F.col("b.size") - EDGE) & (F.col("b.size") >= similarity * F.col("a.size") - EDGE)
    beside = a.join(b, (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.component") != F.col("b.component")) & (F.col("a.id") < F.col("b.id")) & may)
    untried = beside.select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b")).distinct().join(tried, ["id_a", "id_b"], "left_anti")

    crowd = _crowds(checkpoint(members.join(large.select("bucket"), "bucket").select("bucket", "id", "component")), large).join(sets, "id")
    blocks = block_join(crowd.filter("outside").drop("outside"), crowd.drop("outside"), _joins(similarity), "id_a bigint, id_b bigint", True, block_rows)
    more = verified(untried, sets, similarity).unionByName(blocks)
    return connected_components(links.unionByName(more)).select("id", "component")
