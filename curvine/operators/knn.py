"""Nearest-neighbour and similarity joins.

Every operator takes ``id_col``/``vec_col`` names and returns rows
``(query_id, rank, neighbor_id, dist)``; a missing neighbour is an absent row.
Smaller ``dist`` is nearer for every metric: ``sq_l2``, ``l1``, ``cosine``
(1 - cosine), ``ip`` (minus the inner product), ``kl`` (KL of the base row from
the query) and ``cross`` (minus the sum of query * log base).
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvine.functions import kernels
from curvine.plans.blocks import BLOCK_ROWS, block_join, self_block_join
from curvine.plans.bounded import collect_bounded
from curvine.plans.ranking import top_k_within
from curvine.session import checkpoint

NEIGHBOR_SCHEMA = "query_id bigint, neighbor_id bigint, dist double"


def _side(df: DataFrame, id_col: str, vec_col: str, within: str | None, id_prefix: str = "") -> DataFrame:
    cols = [F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("vec")]
    if within:
        cols.append(F.col(within).alias("g"))
    return df.filter(F.col(vec_col).isNotNull()).select(*cols)


def _neighbors(q_ids, b_ids, dist) -> pa.Table:
    return pa.table(
        {"query_id": pa.array(q_ids, pa.int64()), "neighbor_id": pa.array(b_ids, pa.int64()), "dist": pa.array(dist, pa.float64())}
    )


def _nearest_kernel(_group, left: pa.Table, right: pa.Table, *, k, metric, skip_same) -> pa.Table:
    q, b = kernels.matrix(left.column("vec")), kernels.matrix(right.column("vec"))
    q_ids, b_ids = left.column("id").to_numpy(), right.column("id").to_numpy()
    qi, bi, dist = kernels.top_k(metric, q, b, k, q_ids, b_ids, skip_same, tie_ids=b_ids)
    return _neighbors(q_ids[qi], b_ids[bi], dist)


# A base of at most so many bytes of doubles is sent to the queries.
SMALL_BYTES = 16 * 1024 * 1024


def small_side(side: DataFrame, most_bytes: int | None = None) -> pa.Table | None:
    """Rows ``(id, vec)`` as a table if they take at most ``most_bytes``, else None."""
    most_bytes = SMALL_BYTES if most_bytes is None else most_bytes
    first = side.select(F.size("vec")).limit(1).collect()
    if not first:
        return None
    most = most_bytes // (8 * max(1, first[0][0]))
    if side.select("id").limit(most + 1).count() > most:
        return None
    return side.toArrow()


def candidates(
    queries: DataFrame, base: DataFrame, k: int, metric: str, *, id_col="vec_id", vec_col="embedding",
    within: str | None = None, exclude_self: bool = False, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The k nearest per query and base block; at most k rows leave a task per query.

    A base that is proved small by its bytes travels to the queries instead, which are
    then not shuffled; the kernel and its answer are the same.
    """
    if within is None and (few := small_side(_side(base, id_col, vec_col, None))) is not None:
        held = base.sparkSession.sparkContext.broadcast(few)

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    yield from _nearest_kernel(None, pa.Table.from_batches([batch]), held.value, k=k, metric=metric, skip_same=exclude_self).to_batches()

        return _side(queries, id_col, vec_col, None).mapInArrow(run, NEIGHBOR_SCHEMA)
    return block_join(
        _side(queries, id_col, vec_col, within),
        _side(base, id_col, vec_col, within),
        partial(_nearest_kernel, k=k, metric=metric, skip_same=exclude_self),
        NEIGHBOR_SCHEMA,
        grouped=within is not None,
        block_rows=block_rows,
    )


def merge_candidates(found: DataFrame, k: int, distinct: bool = False) -> DataFrame:
    """Keep the k nearest of all candidates of a query; ``distinct`` when groups overlap."""
    if distinct:
        found = found.groupBy("query_id", "neighbor_id").agg(F.min("dist").alias("dist"))
    ranked = top_k_within(found, ["query_id"], [F.col("dist"), F.col("neighbor_id")], k)
    return ranked.select("query_id", "rank", "neighbor_id", "dist")


def knn_join(queries: DataFrame, base: DataFrame, k: int, metric: str = "sq_l2", *, overlapping: bool = False, **options) -> DataFrame:
    """Exact k nearest base rows for every query, optionally only inside equal ``within`` keys."""
    return merge_candidates(candidates(queries, base, k, metric, **options), k, distinct=overlapping)


def kth_distance(neighbors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id") -> DataFrame:
    """Negated distance to the k-th neighbour; NULL when a query has fewer than k."""
    kth = neighbors.filter(F.col("rank") == k).select(F.col("query_id").alias(id_col), (-F.col("dist")).alias("score"))
    return queries.select(id_col).join(kth, id_col, "left")


# --- maximum similarity and pairs inside groups -----------------------------


def _max_kernel(_group, first: pa.Table, second: pa.Table | None, *, metric) -> pa.Table:
    a, a_ids = kernels.matrix(first.column("vec")), first.column("id").to_numpy()
    if second is None:
        qi, bi, dist = kernels.top_k(metric, a, a, 1, a_ids, a_ids, True, tie_ids=a_ids)
        return _neighbors(a_ids[qi], a_ids[bi], dist)
    b, b_ids = kernels.matrix(second.column("vec")), second.column("id").to_numpy()
    qi, bi, d1 = kernels.top_k(metric, a, b, 1, a_ids, b_ids, True, tie_ids=b_ids)
    qj, bj, d2 = kernels.top_k(metric, b, a, 1, b_ids, a_ids, True, tie_ids=a_ids)
    return _neighbors(
        np.concatenate([a_ids[qi], b_ids[qj]]), np.concatenate([b_ids[bi], a_ids[bj]]), np.concatenate([d1, d2])
    )


def nearest_other(
    df: DataFrame, *, within: str | None, metric: str = "ip", id_col="vec_id", vec_col="embedding",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """For every row the nearest *other* row of its group: ``(query_id, neighbor_id, dist)``.

    Rows without a partner are absent. Groups may overlap (a row may be in several);
    the best over all of them is kept.
    """
    found = self_block_join(
        _side(df, id_col, vec_col, within), partial(_max_kernel, metric=metric), NEIGHBOR_SCHEMA,
        grouped=within is not None, block_rows=block_rows,
    )
    best = found.groupBy("query_id").agg(F.min(F.struct("dist", "neighbor_id")).alias("best"))
    return best.select("query_id", F.col("best.neighbor_id").alias("neighbor_id"), F.col("best.dist").alias("dist"))


def _max_kernel_all(group, first: pa.Table, second: pa.Table | None, *, metric) -> pa.Table:
    """As ``_max_kernel``, with the group, and with every row of a block once even without a partner."""
    found = _max_kernel(group, first, second, metric=metric)
    if second is None:
        n = first.num_rows
        every = pa.table(
            {"query_id": first.column("id"), "neighbor_id": pa.nulls(n, pa.int64()), "dist": pa.nulls(n, pa.float64())}
        )
        found = pa.concat_tables([every, found])
    return found.append_column("g", pa.array(np.full(found.num_rows, group), pa.int64()))


def max_similarity_all(df: DataFrame, *, within: str, id_col="vec_id", vec_col="embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(id, group, max_sim)`` of every row, NULL without a partner.

    The tasks report the lone rows too, so the input is not joined back.
    """
    found = self_block_join(
        _side(df.withColumn(within, F.col(within).cast("bigint")), id_col, vec_col, within), partial(_max_kernel_all, metric="ip"),
        NEIGHBOR_SCHEMA + ", g bigint", grouped=True, block_rows=block_rows,
    )
    return found.groupBy(F.col("query_id").alias(id_col), F.col("g").alias(within)).agg((-F.min("dist")).alias("max_sim"))


def max_similarity(df: DataFrame, *, within: str | None, id_col="vec_id", **options) -> DataFrame:
    """``(id, max_sim)``: the largest similarity to any other member of the group."""
    return nearest_other(df, within=within, id_col=id_col, **options).select(
        F.col("query_id").alias(id_col), _similarity(F.col("dist"), options.get("metric", "ip")).alias("max_sim")
    )


def _similarity(dist, metric: str):
    return -dist if metric == "ip" else F.lit(1.0) - dist


def _forest_kernel(_group, first: pa.Table, second: pa.Table | None, *, metric, limit) -> pa.Table:
    a, a_ids = kernels.matrix(first.column("vec")), first.column("id").to_numpy()
    if second is None:
        b, b_ids = a, a_ids
        i, j, dist = kernels.pairs_below(metric, a, a, limit)
        once = a_ids[i] < a_ids[j]
        i, j, dist = i[once], j[once], dist[once]
    else:
        b, b_ids = kernels.matrix(second.column("vec")), second.column("id").to_numpy()
        i, j, dist = kernels.pairs_below(metric, a, b, limit)
    left, right = a_ids[i], b_ids[j]
    if len(left):
        nodes, flat = np.unique(np.concatenate([left, right]), return_inverse=True)
        p, q, weight = kernels.spanning_forest(len(nodes), flat[: len(left)], flat[len(left) :], -dist)
        left, right, dist = nodes[p], nodes[q], -weight
    return _neighbors(np.minimum(left, right), np.maximum(left, right), dist)


def _pairs_in_parts(_group, first: pa.Table, second: pa.Table | None, *, metric, limit):
    """All pairs, which may be very many: a part at a time."""
    a, a_ids = kernels.matrix(first.column("vec")), first.column("id").to_numpy()
    b, b_ids = (a, a_ids) if second is None else (kernels.matrix(second.column("vec")), second.column("id").to_numpy())
    for i, j, dist in kernels.pairs_below_parts(metric, a, b, limit):
        if second is None:
            once = a_ids[i] < a_ids[j]
            i, j, dist = i[once], j[once], dist[once]
        left, right = a_ids[i], b_ids[j]
        yield _neighbors(np.minimum(left, right), np.maximum(left, right), dist)


def _pair_join(df, within, metric, min_sim, forest, id_col, vec_col, block_rows, overlapping):
    limit = -min_sim if metric == "ip" else 1.0 - min_sim
    found = self_block_join(
        _side(df, id_col, vec_col, within), partial(_forest_kernel if forest else _pairs_in_parts, metric=metric, limit=limit),
        NEIGHBOR_SCHEMA, grouped=within is not None, block_rows=block_rows,
    )
    pairs = found.select(
        F.col("query_id").alias("id_a"), F.col("neighbor_id").alias("id_b"), _similarity(F.col("dist"), metric).alias("sim")
    )
    if overlapping:
        pairs = pairs.groupBy("id_a", "id_b").agg(F.max("sim").alias("sim"))
    return pairs


def similar_pairs(
    df: DataFrame, min_sim: float, *, within: str | None, metric: str = "ip", id_col="vec_id", vec_col="embedding",
    block_rows: int = BLOCK_ROWS, overlapping: bool = False,
) -> DataFrame:
    """All pairs ``(id_a < id_b, sim)`` with a similarity above ``min_sim``.

    The answer itself is quadratic in a group of copies; to find groups of
    duplicates use ``similarity_forest``, which is not.
    """
    return _pair_join(df, within, metric, min_sim, False, id_col, vec_col, block_rows, overlapping)


def similarity_forest(
    df: DataFrame, min_sim: float, *, within: str | None, metric: str = "ip", id_col="vec_id", vec_col="embedding",
    block_rows: int = 2048, overlapping: bool = False,
) -> DataFrame:
    """Edges ``(id_a, id_b, sim)`` that connect the same rows as all pairs do, at every threshold
    from ``min_sim`` up, while a task emits fewer edges than it has rows."""
    return _pair_join(df, within, metric, min_sim, True, id_col, vec_col, block_rows, overlapping)


def similar_pairs_topk(df: DataFrame, k: int, min_sim: float, *, within: str, metric="ip", id_col="vec_id", **options) -> DataFrame:
    """Pairs among the k nearest of each row, each pair once with its larger similarity."""
    near = knn_join(df, df, k, metric, within=within, exclude_self=True, id_col=id_col, **options)
    sim = _similarity(F.col("dist"), metric)
    return (
        near.groupBy(F.least("query_id", "neighbor_id").alias("id_a"), F.greatest("query_id", "neighbor_id").alias("id_b"))
        .agg(F.max(sim).alias("sim"))
        .filter(F.col("sim") > min_sim)
    )


# --- assignment to a bounded set of centroids -------------------------------


# Doubles of all centroids: 100 000 of 768 dimensions take 0.6 GB. Their number is a
# parameter of the caller, never a function of the rows.
CENTROID_BYTES = 1 << 30


def centroid_matrix(centroids: DataFrame, cid_col: str = "cid", vec_col: str = "centroid") -> tuple[np.ndarray, np.ndarray] | None:
    """Centroids as arrays when they are few enough to travel to every task, else None."""
    first = centroids.select(F.size(vec_col)).limit(1).collect()
    if not first:
        raise ValueError("no centroids")
    most = CENTROID_BYTES // (8 * max(1, first[0][0]))
    found = centroids.select(F.col(cid_col).cast("bigint").alias("c"), F.col(vec_col).cast("array<double>").alias("v")).limit(most + 1).toArrow()
    if found.num_rows > most:
        return None
    found = found.sort_by("c")
    return found.column("c").to_numpy(), kernels.matrix(found.column("v"))


def assign(
    df: DataFrame, centroids: DataFrame, *, metric: str = "sq_l2", probes: int = 1, id_col="vec_id", vec_col="embedding",
    cid_col: str = "cid",
) -> DataFrame:
    """Nearest centroid of every row, as columns ``cid`` and ``cdist`` beside the input columns.

    With ``probes`` > 1 each row repeats once per probed centroid, with ``probe`` 1, 2, ...
    The distance is carried so that later steps need not compute it again. Few
    centroids travel to the tasks; too many of them take the block join.
    """
    small = centroid_matrix(centroids, cid_col)
    if small is None:
        near = knn_join(
            df.select(F.col(id_col).alias("id_"), F.col(vec_col).alias("v_")),
            centroids.select(F.col(cid_col).alias("id_"), F.col("centroid").alias("v_")),
            probes, metric, id_col="id_", vec_col="v_",
        ).select(F.col("query_id").alias(id_col), F.col("neighbor_id").alias("cid"), F.col("dist").alias("cdist"), F.col("rank").alias("probe"))
        joined = df.join(near, id_col)
        return joined if probes > 1 else joined.drop("probe")
    return assign_to(df, *small, metric=metric, probes=probes, vec_col=vec_col)


def assign_to(df: DataFrame, cids: np.ndarray, vectors: np.ndarray, *, metric="sq_l2", probes=1, vec_col="embedding") -> DataFrame:
    """``assign`` for centroids already held as arrays; also works on a streaming DataFrame."""
    kept = df.filter(F.col(vec_col).isNotNull())
    at = df.columns.index(vec_col)
    sent = df.sparkSession.sparkContext.broadcast((cids, vectors))

    def run(batches):
        cids, vectors = sent.value
        for batch in batches:
            if batch.num_rows == 0:
                continue
            qi, bi, dist = kernels.top_k(metric, kernels.matrix(batch.column(at)), vectors, probes, tie_ids=cids)
            out = batch.take(pa.array(qi)) if probes > 1 else batch
            arrays = [*out.columns, pa.array(cids[bi], pa.int64()), pa.array(dist, pa.float64())]
            names = [*out.schema.names, "cid", "cdist"]
            if probes > 1:
                first = np.searchsorted(qi, qi, side="left")
                arrays.append(pa.array(np.arange(len(qi)) - first + 1, pa.int64()))
                names.append("probe")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    extra = ", cid bigint, cdist double" + (", probe bigint" if probes > 1 else "")
    return kept.mapInArrow(run, schema + extra)


def nearest_to_few(
    few: dict, base: DataFrame, k: int, metric: str = "sq_l2", *, class_col: str | None = None, id_col="vec_id", vec_col="embedding"
) -> DataFrame:
    """k nearest base rows to each of a few given vectors, in one pass that does not shuffle the base.

    ``few`` maps a query id to its vector, or with ``class_col`` to (class, vector),
    and then only base rows of that class count. A task emits at most k rows per query.
    """
    items = sorted(few.items())
    q_ids = np.array([i for i, _ in items], dtype=np.int64)
    vectors = np.array([v[1] if class_col else v for _, v in items], dtype=np.float64)
    classes = np.array([v[0] for _, v in items]) if class_col else None
    cols = [F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("vec")] + ([F.col(class_col).alias("c")] if class_col else [])

    def best_of(rows):
        q, i, d = (np.concatenate(p) for p in zip(*rows))
        order = np.lexsort((i, d, q))
        q, i, d = q[order], i[order], d[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q, side="left") < k
        return q[keep], i[keep], d[keep]

    def run(batches):
        held = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids, x = batch.column(0).to_numpy(), kernels.matrix(batch.column(1))
            groups = [(slice(None), slice(None))]
            if class_col:
                own = batch.column(2).to_numpy(zero_copy_only=False)
                groups = [(np.nonzero(classes == c)[0], np.nonzero(own == c)[0]) for c in np.unique(own)]
            for qs, rows in groups:
                q_part, x_part, i_part = q_ids[qs], x[rows], ids[rows]
                if len(q_part) == 0 or len(x_part) == 0:
                    continue
                qi, bi, dist = kernels.top_k(metric, vectors[qs], x_part, k, tie_ids=i_part)
                held.append((q_part[qi], i_part[bi], dist))
            if len(held) > 16:
                held = [best_of(held)]
        if held:
            q, i, d = best_of(held)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(d, pa.float64())], names=["query_id", "neighbor_id", "dist"])

    found = base.filter(F.col(vec_col).isNotNull()).select(*cols).mapInArrow(run, NEIGHBOR_SCHEMA)
    return merge_candidates(found, k)


# --- inverted-file search ----------------------------------------------------


def ivf_knn_join(
    queries: DataFrame, base: DataFrame, centroids: DataFrame, k: int, nprobe: int, metric: str = "sq_l2", *,
    id_col="vec_id", vec_col="embedding", exclude_self=False, within: str | None = None, cell_metric: str | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """k nearest among the base rows of the ``nprobe`` cells nearest to each query.

    A query whose probed cells hold nothing is answered exactly.
    """
    cell_metric = cell_metric or metric
    keep = [id_col, vec_col] + ([within] if within else [])
    cells = assign(base.select(*keep), centroids, metric=cell_metric, id_col=id_col, vec_col=vec_col)
    probed = assign(queries.select(*keep), centroids, metric=cell_metric, probes=nprobe, id_col=id_col, vec_col=vec_col)
    if within:
        cells, probed = (d.withColumn("cid", F.struct(within, "cid")) for d in (cells, probed))
    found = candidates(
        probed, cells, k, metric, id_col=id_col, vec_col=vec_col, within="cid", exclude_self=exclude_self, block_rows=block_rows
    )
    # written down once: the answer and the rescue of queries without any both read it
    near = checkpoint(merge_candidates(found, k))
    empty = queries.join(near.select(F.col("query_id").alias(id_col)).distinct(), id_col, "left_anti")
    rescued = knn_join(
        empty, base, k, metric, id_col=id_col, vec_col=vec_col, within=within, exclude_self=exclude_self, block_rows=block_rows
    )
    return near.unionByName(rescued)


def two_stage_knn_join(
    queries: DataFrame, base: DataFrame, matrix: np.ndarray, k: int, *, widen: int = 2, id_col="vec_id", vec_col="embedding",
    exclude_self=False, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Shortlist ``widen * k`` neighbours in a low-dimensional projection, then rank them exactly.

    The shortlist is ids; full vectors meet by blocks (``pair_distance``).
    """
    rough = knn_join(
        project_rows(queries, matrix, id_col, vec_col), project_rows(base, matrix, id_col, vec_col), widen * k, "sq_l2",
        id_col=id_col, vec_col=vec_col, exclude_self=exclude_self, block_rows=block_rows,
    )
    # both sides of the second step read it
    scored = pair_distance(checkpoint(rough.select("query_id", "neighbor_id")), queries, base, id_col=id_col, vec_col=vec_col, block_rows=block_rows)
    return merge_candidates(scored, k)


def project_rows(df: DataFrame, matrix: np.ndarray, id_col="vec_id", vec_col="embedding") -> DataFrame:
    """Low-dimensional projection of every row, one matrix product per Arrow batch."""

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = kernels.matrix(batch.column(1))
            low = np.zeros((len(x), matrix.shape[0]))
            for d in range(matrix.shape[1]):  # left to right, so results repeat
                low += x[:, d, None] * matrix[None, :, d]
            yield pa.RecordBatch.from_arrays([batch.column(0), kernels.list_column(low, pa.float64())], names=[id_col, vec_col])

    kept = df.filter(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("bigint").alias(id_col), vec_col)
    return kept.mapInArrow(run, f"{id_col} bigint, {vec_col} array<double>")


def _pairs_of_blocks(_key, asks: pa.Table, refs: pa.Table, *, metric: str) -> pa.Table:
    """Distances of the pairs listed by the queries ``(query_id, vec, others)`` with the rows ``(neighbor_id, vec)``."""
    if not asks.num_rows or not refs.num_rows:
        return _neighbors([], [], [])
    others = asks.column("others").combine_chunks()
    q_ids, wanted = asks.column("query_id").to_numpy(), others.flatten().to_numpy()
    qi = np.repeat(np.arange(asks.num_rows), others.value_lengths().to_numpy())
    refs = refs.sort_by("neighbor_id")
    b_ids = refs.column("neighbor_id").to_numpy()
    bi = np.minimum(np.searchsorted(b_ids, wanted), len(b_ids) - 1)
    there = b_ids[bi] == wanted
    qi, bi = qi[there], bi[there]
    dist = kernels.exact(metric, kernels.matrix(asks.column("vec")), kernels.matrix(refs.column("vec")), qi, bi) if len(qi) else np.empty(0)
    return _neighbors(q_ids[qi], b_ids[bi], dist)


def pair_distance(
    pairs: DataFrame, queries: DataFrame, base: DataFrame, metric: str = "sq_l2", *, id_col="vec_id", vec_col="embedding", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Exact distances of given distinct ``(query_id, neighbor_id)`` pairs; ids are distinct on either side.

    Pairs are grouped by the blocks of their two rows. A query's vector goes once to each
    block that it asks, a base vector once to each block of queries that asks for it,
    however many pairs they are in, and a pair itself is two ids.
    """
    q, b = (_side(df, id_col, vec_col, None) for df in (queries, base))
    n_q, n_b = (max(1, -(-side.select("id").count() // block_rows)) for side in (q, b))
    block = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    named = pairs.select("query_id", "neighbor_id", block("query_id", n_q).alias("qb"), block("neighbor_id", n_b).alias("bb"))
    # a query's list is as long as its shortlist at most
    lists = named.groupBy("qb", "bb", "query_id").agg(F.collect_list("neighbor_id").alias("others"))
    asks = lists.join(q.withColumnRenamed("id", "query_id"), "query_id").select("qb", "bb", "query_id", "vec", "others")
    refs = named.select("qb", "bb", "neighbor_id").distinct().join(b.withColumnRenamed("id", "neighbor_id"), "neighbor_id").select(F.col("qb").alias("ask"), F.col("bb").alias("ref"), "neighbor_id", "vec")

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return _pairs_of_blocks(key, left, right, metric=metric)

    return asks.groupBy("qb", "bb").cogroup(refs.groupBy("ask", "ref")).applyInArrow(run, NEIGHBOR_SCHEMA)


def nearest_to_centers(df: DataFrame, centers: DataFrame, *, id_col="vec_id", vec_col="embedding", cid_col="cid", seed: int = 0) -> DataFrame:
    """One distinct row per centre: the nearest row, or a random other row when centres share one.

    Returns ``(vec_id, filled)`` with as many rows as there are centres.
    """
    from curvine.functions.hashing import id_hash

    few = {r[0]: r[1] for r in collect_bounded(centers.select(cid_col, "centroid"))}
    near = nearest_to_few(few, df, 1, id_col=id_col, vec_col=vec_col)
    found = sorted({r[0] for r in collect_bounded(near.select("neighbor_id"))})
    picked = df.sparkSession.createDataFrame([(i,) for i in found], f"{id_col} bigint")
    missing = len(few) - len(found)
    rest = df.select(id_col).join(F.broadcast(picked), id_col, "left_anti")
    fill = rest.orderBy(id_hash(id_col, seed), id_col).limit(missing)
    return picked.withColumn("filled", F.lit(False)).unionByName(fill.withColumn("filled", F.lit(True)))


def ivf_refresh(previous: DataFrame, current: DataFrame, *, max_new_share: float = 0.3, same_dim: bool = True, flat: bool = False) -> DataFrame:
    """Whether an index over ``previous`` ids may be extended to ``current`` ids instead of rebuilt.

    One row: previous, current, gone, added and ``reuse``. Extending needs every
    previous id to be still there, the same dimension, and, except for a flat
    index, a share of new rows among the current ones below ``max_new_share``.
    """
    both = previous.select(F.col("id"), F.lit(1).alias("p"), F.lit(0).alias("c")).unionByName(
        current.select(F.col("id"), F.lit(0).alias("p"), F.lit(1).alias("c"))
    )
    per_id = both.groupBy("id").agg(F.max("p").alias("p"), F.max("c").alias("c"))
    counts = per_id.agg(
        F.sum("p").alias("n_previous"), F.sum("c").alias("n_current"),
        F.count_if((F.col("p") == 1) & (F.col("c") == 0)).alias("n_gone"),
        F.count_if((F.col("p") == 0) & (F.col("c") == 1)).alias("n_added"),
    )
    small_change = F.lit(flat) | (F.try_divide(F.col("n_added").cast("double"), F.col("n_current")) < max_new_share)
    return counts.withColumn("reuse", F.lit(same_dim) & (F.col("n_gone") == 0) & F.coalesce(small_change, F.lit(False)))


def common_neighbors(first: DataFrame, second: DataFrame) -> DataFrame:
    """How many neighbours each query shares between two neighbour tables."""
    shared = first.select("query_id", "neighbor_id").join(second.select("query_id", "neighbor_id"), ["query_id", "neighbor_id"])
    counts = shared.groupBy("query_id").agg(F.count(F.lit(1)).alias("common_neighbours"))
    queries = first.select("query_id").distinct()
    return queries.join(counts, "query_id", "left").fillna(0, ["common_neighbours"])
