"""Semantic and fair deduplication over clustered vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvine.functions import vectors as V
from curvine.operators import knn, lsh
from curvine.operators.cluster import group_means
from curvine.plans.blocks import BLOCK_ROWS
from curvine.plans.join_hot import MAX_HOT_KEYS, join_lookup
from curvine.session import checkpoint


def flag_name(eps: float) -> str:
    return f"remove_e{round(eps * 100):02d}"


def semdedup(
    assigned: DataFrame, eps: list[float], *, mode: str = "exact", matrix=None, bits: int = 8, centroids: DataFrame | None = None,
    nprobe: int = 1, id_col="vec_id", vec_col="embedding", cid_col="cid", block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Flag rows whose nearest other member of the cluster is closer than each threshold.

    Both members of a close pair are flagged; a row without a partner is kept. The
    maximum is found once, and every threshold is one more column on it.
    ``mode="lsh"`` looks only at rows sharing a bucket, ``mode="ivf"`` only at the
    ``nprobe`` nearest cells inside the cluster.
    """
    flags = [F.coalesce(F.col("max_sim") > 1.0 - e, F.lit(False)).alias(flag_name(e)) for e in eps]
    if mode == "exact":
        rows = knn.max_similarity_all(assigned, within=cid_col, id_col=id_col, vec_col=vec_col, block_rows=block_rows)
        return rows.select(id_col, cid_col, "max_sim", *flags)
    if mode == "lsh":
        best = lsh.max_similarity_lsh(assigned, matrix, bits, within=cid_col, id_col=id_col, vec_col=vec_col)
    elif mode == "ivf":
        cells = assigned.select(id_col, F.col(cid_col).alias("_group"), vec_col)
        near = knn.ivf_knn_join(
            cells, cells, centroids, 1, nprobe, "ip", within="_group", exclude_self=True, id_col=id_col, vec_col=vec_col,
            cell_metric="sq_l2", block_rows=block_rows,
        )
        best = near.select(F.col("query_id").alias(id_col), (-F.col("dist")).alias("max_sim"))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    rows = assigned.select(id_col, cid_col).join(best, id_col, "left")
    return rows.select(id_col, cid_col, "max_sim", *flags)


# --- connected components ---------------------------------------------------------


# Edges that a task contracts at once.
CONTRACT_ROWS = 1 << 20


def connected_components(edges: DataFrame, part_col: str | None = None, task_edges: int = CONTRACT_ROWS) -> DataFrame:
    """``(part, id, component)`` for every endpoint, the component named by its smallest id.

    Tasks first contract the edges they hold to stars; where fewer than ``task_edges`` are
    left, one more task contracts these, and its stars are the answer. Several graphs
    (``part_col``) else advance together, by alternating large-star and small-star rounds
    (Kiveris et al., 2014), which shorten long chains quickly, until the stars of all tasks agree.
    """
    part = F.col(part_col).cast("bigint") if part_col else F.lit(0).cast("bigint")
    stars = checkpoint(_contracted(edges.select(part.alias("part"), F.greatest("id_a", "id_b").alias("u"), F.least("id_a", "id_b").alias("v")).filter("u <> v")))
    # as many as a task holds before it would pass any on
    if stars.count() < min(task_edges, CONTRACT_ROWS):
        stars = checkpoint(_contracted(stars.coalesce(1)))
    else:
        stars = _agreed(stars)
    roots = stars.select("part", F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return stars.select("part", F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def _stars(part: np.ndarray, u: np.ndarray, v: np.ndarray) -> list[np.ndarray]:
    """Edges ``(part, node, smallest node of its component)`` that connect what the given edges connect."""
    out: list[list[np.ndarray]] = [[], [], []]
    for p in np.unique(part):
        here = part == p
        nodes, flat = np.unique(np.concatenate([u[here], v[here]]), return_inverse=True)
        a, b = flat[: here.sum()], flat[here.sum() :]
        label = np.arange(len(nodes))
        while True:
            low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
            if np.array_equal(low, high):
                break
            np.minimum.at(label, high, low)
            while not np.array_equal(label[label], label):
                label = label[label]
        rest = label != np.arange(len(nodes))
        for column, values in zip(out, (np.full(rest.sum(), p), nodes[rest], nodes[label[rest]])):
            column.append(values)
    return [np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64) for c in out]


def _contracted(edges: DataFrame) -> DataFrame:
    """``(part, u, v)`` as stars, contracted inside each task; a bounded number of edges is held."""

    def run(batches):
        names = ["part", "u", "v"]
        held, rows = [[], [], []], 0
        for batch in batches:
            for column, name in zip(held, names):
                column.append(batch.column(name).to_numpy())
            rows += batch.num_rows
            if rows >= CONTRACT_ROWS:
                star = _stars(*[np.concatenate(c) for c in held])
                held, rows = [[c] for c in star], len(star[0])
                if rows >= CONTRACT_ROWS // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in star], names=names)
                    held, rows = [[], [], []], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in _stars(*[np.concatenate(c) for c in held])], names=names)

    return edges.select("part", F.col("u").cast("bigint").alias("u"), F.col("v").cast("bigint").alias("v")).mapInArrow(run, "part bigint, u bigint, v bigint")


def _agreed(edges: DataFrame) -> DataFrame:
    """Stars of whole components: every node has one edge to its root, and no root has one."""
    while True:
        ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("child")), F.struct(F.col("v").alias("node"), F.lit(0).alias("child")))).alias("e")
        nodes = edges.select("part", ends).groupBy("part", "e.node").agg(F.sum("e.child").alias("above"), F.min("e.child").alias("least"))
        total, open_ = nodes.agg(F.sum("above"), F.count_if((F.col("above") > 1) | ((F.col("above") == 1) & (F.col("least") == 0)))).first()
        if not open_:
            return edges
        edges = checkpoint(_contracted(_small_star(_large_star(edges, total), total)))


def _with_lowest(rows: DataFrame, total: int) -> DataFrame:
    """Attach to every (part, u, v) row the smallest v of its u, or u itself if smaller.

    A hub may touch a third of all edges, so hubs are looked up by broadcast and
    their rows are not shuffled to one task.
    """
    keyed = rows.withColumn("node", F.struct("part", "u"))
    lowest = keyed.groupBy("node").agg(F.min("v").alias("low"), F.count(F.lit(1)).alias("degree"))
    hot_from = max(1_000_000, 2 * total // MAX_HOT_KEYS)
    if total < hot_from // 2:
        joined = keyed.join(lowest, "node")
    else:
        joined = join_lookup(keyed, lowest, "node", hot_from, "degree")
    return joined.select("part", "u", "v", F.least("u", "low").alias("low"))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select("part", F.col("v").alias("u"), F.col("u").alias("v")))
    linked = _with_lowest(both, 2 * total).filter(F.col("v") > F.col("u"))
    return linked.select("part", F.col("v").alias("u"), F.col("low").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    linked = _with_lowest(edges, total)
    return (
        linked.select("part", F.explode(F.array("u", "v")).alias("u"), F.col("low").alias("v")).filter("u <> v").distinct()
    )


# --- prototypes ----------------------------------------------------------------------


def prototypes(members: DataFrame, *, id_col="vec_id", vec_col="embedding", normalize: bool = False) -> DataFrame:
    """The member of each ``(part, component)`` most similar to the direction of its mean.

    ``normalize`` compares unit rows instead of the rows as they are.
    """
    means = group_means(members, ["part", "component"], vec_col)
    aim = means.select("part", "component", V.l2_normalize("mean").alias("aim"))
    row = V.l2_normalize(vec_col) if normalize else F.col(vec_col)
    scored = members.join(aim, ["part", "component"]).select(
        "part", "component", id_col, F.round(V.dot(row, "aim"), 12).alias("sim")
    )
    return scored.groupBy("part", "component").agg(
        F.max_by(F.struct(F.col(id_col).alias("id"), "sim"), F.struct("sim", (-F.col(id_col)).alias("first"))).alias("best")
    ).select("part", "component", F.col("best.id").alias("prototype"), F.col("best.sim").alias("sim"))


def duplicate_groups(edges: DataFrame, eps: list[float]) -> DataFrame:
    """Components of the edges above each threshold: ``(part, id, component)``, part = position of eps."""
    parts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(1.0 - e).alias("floor")) for i, e in enumerate(eps)])
    keyed = edges.select("id_a", "id_b", "sim", F.explode(parts).alias("p")).filter(F.col("sim") > F.col("p.floor"))
    return connected_components(keyed.select("id_a", "id_b", F.col("p.i").alias("part")), "part")


def fairdedup(
    assigned: DataFrame, eps: list[float], *, mode: str = "exact", ann_k: int = 20, normalize: bool = False, id_col="vec_id",
    vec_col="embedding", cid_col="cid",
) -> DataFrame:
    """Keep one prototype of every group of linked duplicates, at each threshold.

    The links are found once for the widest threshold, as spanning forests; every
    threshold then cuts the same links (``mode="topk"`` links only the ``ann_k``
    nearest of each row).
    """
    floor = 1.0 - max(eps)
    if mode == "topk":
        edges = knn.similar_pairs_topk(assigned, ann_k, floor, within=cid_col, id_col=id_col, vec_col=vec_col)
    else:
        edges = knn.similarity_forest(assigned, floor, within=cid_col, id_col=id_col, vec_col=vec_col)
    groups = checkpoint(duplicate_groups(edges, eps)).withColumnRenamed("id", id_col)
    members = groups.join(assigned.select(id_col, vec_col), id_col)
    best = prototypes(members, id_col=id_col, vec_col=vec_col, normalize=normalize)
    dropped = groups.join(best, (groups["part"] == best["part"]) & (groups[id_col] == best["prototype"]), "left_anti")
    flags = dropped.groupBy(id_col).agg(*[F.max(F.col("part") == i).alias(flag_name(e)) for i, e in enumerate(eps)])
    return assigned.select(id_col, cid_col).join(flags, id_col, "left").select(
        id_col, cid_col, *[F.coalesce(flag_name(e), F.lit(False)).alias(flag_name(e)) for e in eps]
    )


# --- results -----------------------------------------------------------------------------


def kept_ids(flags: DataFrame, eps: float, id_col="vec_id") -> DataFrame:
    return flags.filter(~F.col(flag_name(eps))).select(id_col)


def dedup_stats(flags: DataFrame, eps: list[float]) -> DataFrame:
    """Per threshold: rows, duplicates, kept and the share removed; one pass over the flags."""
    counts = flags.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(flag_name(e))).alias(flag_name(e)) for e in eps])
    rows = F.explode(F.array(*[F.struct(F.lit(e).alias("eps"), F.col(flag_name(e)).alias("removed")) for e in eps])).alias("r")
    return counts.select("total", rows).select(
        "r.eps", "total", "r.removed", (F.col("total") - F.col("r.removed")).alias("kept"),
        F.round(F.try_divide(100.0 * F.col("r.removed"), F.col("total")), 4).alias("percent"),
    )


def dedup_compare(truth: DataFrame, other: DataFrame, truth_flag: Column, other_flag: Column, id_col="vec_id") -> DataFrame:
    """Agreement of two runs on what to remove: both, one only, recall, precision."""
    a = truth.select(F.col(id_col), truth_flag.alias("a"))
    b = other.select(F.col(id_col), other_flag.alias("b"))
    both = a.join(b, id_col, "full_outer").select(F.coalesce("a", F.lit(False)).alias("a"), F.coalesce("b", F.lit(False)).alias("b"))
    counts = both.agg(
        F.count_if(F.col("a") & F.col("b")).alias("both"), F.count_if(F.col("a") & ~F.col("b")).alias("only_first"),
        F.count_if(~F.col("a") & F.col("b")).alias("only_second"),
    )
    n, x, y = F.col("both"), F.col("only_first"), F.col("only_second")
    return counts.select(
        "both", "only_first", "only_second", F.round(F.try_divide(n, n + x), 6).alias("recall"),
        F.round(F.try_divide(n, n + y), 6).alias("precision"), (x == y).alias("same_count"),
    )
