"""Clustering: Lloyd rounds, seeding, cluster tables and their scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvine.functions import kernels
from curvine.functions import vectors as V
from curvine.functions.hashing import id_hash
from curvine.operators import knn
from curvine.plans.bounded import TooLarge, collect_bounded
from curvine.plans.ranking import rank_rows
from curvine.session import checkpoint
from curvine.sources.sinks import scratch_folder

SCALE = 1e9
FLUSH_GROUPS = 4096


# --- per-group vector sums ----------------------------------------------------


def _reduce(keys: np.ndarray, counts: np.ndarray, sums: np.ndarray):
    uniq, inverse = np.unique(keys, axis=0, return_inverse=True)
    inverse = inverse.ravel()
    order = np.argsort(inverse, kind="stable")
    starts = np.searchsorted(inverse[order], np.arange(len(uniq)))
    return uniq, np.add.reduceat(counts[order], starts), np.add.reduceat(sums[order], starts, axis=0)


def _partial_sums(n_keys: int):
    """Arrow batches (keys..., vector) to partial (keys..., n, fixed-point sums) rows."""

    def emit(keys, counts, sums):
        arrays = [pa.array(keys[:, i], pa.int64()) for i in range(n_keys)]
        arrays += [pa.array(counts, pa.int64()), kernels.list_column(sums, pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, names=[f"k{i}" for i in range(n_keys)] + ["n", "sums"])

    def run(batches):
        held = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys)])
            part = (keys, np.ones(len(keys), np.int64), kernels.fixed_point(kernels.matrix(batch.column(n_keys)), SCALE))
            held = _reduce(*part) if held is None else _reduce(*(np.concatenate(p) for p in zip(held, _reduce(*part))))
            if len(held[0]) > FLUSH_GROUPS:
                yield emit(*held)
                held = None
        if held is not None:
            yield emit(*held)

    return run


def group_means(df: DataFrame, keys: list[str], vec_col: str, mean_col: str = "mean") -> DataFrame:
    """Count and mean vector per group of integer keys.

    Each task adds up its own rows first, so a hot group reaches the shuffle as a
    few rows. Sums are whole numbers and so independent of the order of the rows.
    """
    rows = df.filter(F.col(vec_col).isNotNull()).select(*[F.col(k).cast("bigint").alias(f"k{i}") for i, k in enumerate(keys)], F.col(vec_col).alias("v"))
    key_names = [f"k{i}" for i in range(len(keys))]
    partial = rows.mapInArrow(_partial_sums(len(keys)), ", ".join(f"{k} bigint" for k in key_names) + ", n bigint, sums array<bigint>")
    per_dim = (
        partial.select(*key_names, "n", F.posexplode("sums").alias("pos", "s"))
        .groupBy(*key_names, "pos")
        .agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"))
    )
    means = per_dim.groupBy(*key_names).agg(
        F.max("n").alias("n"),
        F.sort_array(F.collect_list(F.struct("pos", (F.col("s").cast("double") / F.lit(SCALE) / F.col("n")).alias("m")))).alias("m"),
    )
    return means.select(*[F.col(k).alias(name) for k, name in zip(key_names, keys)], "n", F.col("m.m").alias(mean_col))


# --- centroids ------------------------------------------------------------------


def sample_rows(df: DataFrame, k: int, *, seed: int = 0, id_col="vec_id", vec_col="embedding") -> DataFrame:
    """k distinct rows in hash order as initial centroids ``(cid, centroid)``."""
    picked = df.filter(F.col(vec_col).isNotNull()).select(id_col, vec_col).orderBy(id_hash(id_col, seed), id_col).limit(k)
    order = Window.orderBy(id_hash(id_col, seed), F.col(id_col))  # over k rows only
    return picked.select(
        (F.row_number().over(order) - 1).cast("bigint").alias("cid"), F.col(vec_col).cast("array<double>").alias("centroid")
    )


def centroid_frame(df: DataFrame, cids: np.ndarray, vectors: np.ndarray) -> DataFrame:
    table = pa.table({"cid": pa.array(cids, pa.int64()), "centroid": kernels.list_column(np.asarray(vectors, np.float64), pa.float64())})
    return df.sparkSession.createDataFrame(table)


def _normalized(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def kmeans(
    df: DataFrame, init: DataFrame, *, max_iter: int = 50, tol: float = 1e-4, spherical: bool = False, coarse: int = 0,
    nprobe: int = 1, id_col="vec_id", vec_col="embedding", seed: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """Lloyd rounds from given centroids: ``(assigned rows, centroids)``.

    A round is one pass over the vectors that assigns and adds up; only the
    centroids come back to the driver. It stops when the centroids move less than
    ``tol`` of their norm. An empty cluster restarts from a random row. With
    ``coarse`` > 0 assignment looks only at the centroids in the ``nprobe``
    nearest of ``coarse`` groups of centroids.
    """
    cids, vectors = _require_small(init)
    metric = "ip" if spherical else "sq_l2"
    rows = df.select(id_col, vec_col)
    for step in range(max_iter):
        assigned = assign_rows(rows, cids, vectors, metric, coarse, nprobe, vec_col)
        # one row per centroid at most
        found = {r["cid"]: r["mean"] for r in collect_bounded(group_means(assigned, ["cid"], vec_col), len(cids))}
        new = vectors.copy()
        for i, cid in enumerate(cids):
            if int(cid) in found:
                new[i] = found[int(cid)]
        lost = [i for i, cid in enumerate(cids) if int(cid) not in found]
        if lost:
            fresh = sample_rows(df, len(lost), seed=seed + step + 1, id_col=id_col, vec_col=vec_col)
            for i, row in zip(lost, fresh.orderBy("cid").collect()):
                new[i] = row["centroid"]
        if spherical:
            new = _normalized(new)
        moved = np.sqrt(((new - vectors) ** 2).sum()) / max(np.sqrt((vectors**2).sum()), 1e-12)
        vectors = new
        if moved < tol:
            break
    return assign_rows(df, cids, vectors, metric, coarse, nprobe, vec_col), centroid_frame(df, cids, vectors)


def minibatch_kmeans(
    df: DataFrame, init: DataFrame, *, batches: int, epochs: int = 1, spherical: bool = False, seed: int = 0, id_col="vec_id", vec_col="embedding"
) -> tuple[DataFrame, DataFrame]:
    """Mini-batch k-means (Sculley, 2010) from given centroids: ``(assigned rows, centroids)``.

    A hash of the id deals the rows into ``batches`` parts, written once, and a step reads
    one part: its rows go to their nearest centroid, and every centroid moves towards the
    mean of its rows by their share among all rows it has seen, so its rate falls as
    it learns. A centroid without rows in a batch stays. Rows that are not in the sample of
    a step cost nothing; an epoch reads every row once, where a round of ``kmeans``
    moves the centroids once. ``spherical`` compares directions and returns unit centroids.
    """
    cids, vectors = _require_small(init)
    vectors, metric = vectors.copy(), "ip" if spherical else "sq_l2"
    spark, path = df.sparkSession, scratch_folder(df.sparkSession)
    dealt = df.filter(F.col(vec_col).isNotNull()).select(id_col, vec_col, F.pmod(id_hash(id_col, seed), F.lit(batches)).alias("batch"))
    dealt.write.partitionBy("batch").parquet(path)
    rows, seen = spark.read.parquet(path), np.zeros(len(cids))
    for step in range(epochs * batches):
        part = rows.filter(F.col("batch") == step % batches).select(id_col, vec_col)
        # one row per centroid at most
        found = {r["cid"]: r for r in collect_bounded(group_means(knn.assign_to(part, cids, vectors, metric=metric, vec_col=vec_col), ["cid"], vec_col), len(cids))}
        for i, cid in enumerate(cids):
            if int(cid) in found:
                n, mean = found[int(cid)]["n"], np.array(found[int(cid)]["mean"])
                seen[i] += n
                vectors[i] = vectors[i] + (mean - vectors[i]) * (n / seen[i])
        if spherical:
            vectors = _normalized(vectors)
    return knn.assign_to(df, cids, vectors, metric=metric, vec_col=vec_col), centroid_frame(df, cids, vectors)


def _require_small(centroids: DataFrame):
    small = knn.centroid_matrix(centroids)
    if small is None:
        raise TooLarge(f"the centroids take more than {knn.CENTROID_BYTES} bytes")
    return small


def assign_rows(df, cids, vectors, metric="sq_l2", coarse=0, nprobe=1, vec_col="embedding") -> DataFrame:
    if coarse <= 0:
        return knn.assign_to(df, cids, vectors, metric=metric, vec_col=vec_col)
    return _assign_two_level(df, cids, vectors, metric, coarse, nprobe, vec_col)


def _assign_two_level(df, cids, vectors, metric, coarse, nprobe, vec_col) -> DataFrame:
    """Nearest centroid among those in the ``nprobe`` nearest coarse groups.

    The first ``coarse`` centroids lead the groups; every centroid joins its nearest leader.
    """
    _, group, _ = kernels.top_k(metric, vectors, vectors[:coarse], 1)
    at = df.columns.index(vec_col)
    sent = df.sparkSession.sparkContext.broadcast((cids, vectors, group))

    def run(batches):
        cids, vectors, group = sent.value
        leaders = vectors[:coarse]
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = kernels.matrix(batch.column(at))
            qi, gi, _ = kernels.top_k(metric, x, leaders, nprobe)
            best, dist = np.full(len(x), -1), np.full(len(x), np.inf)
            for g in range(len(leaders)):
                rows, members = qi[gi == g], np.nonzero(group == g)[0]
                if len(rows) == 0 or len(members) == 0:
                    continue
                _, bi, d = kernels.top_k(metric, x[rows], vectors[members], 1, tie_ids=cids[members])
                cand = cids[members[bi]]
                better = (d < dist[rows]) | ((d == dist[rows]) & (cand < best[rows]))
                best[rows[better]], dist[rows[better]] = cand[better], d[better]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(best, pa.int64()), pa.array(dist, pa.float64())], names=[*batch.schema.names, "cid", "cdist"]
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.filter(F.col(vec_col).isNotNull()).mapInArrow(run, schema + ", cid bigint, cdist double")


def mllib_kmeans(
    df: DataFrame, k: int, *, cosine: bool, max_iter: int = 20, seed: int = 42, fit_share: float = 1.0,
    normalize_centroids: bool = False, id_col="vec_id", vec_col="embedding",
) -> tuple[DataFrame, DataFrame]:
    """MLlib k-means, optionally spherical or fitted on a repeatable sample of the rows."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from curvine.functions.hashing import in_sample

    fit_on = df if fit_share >= 1.0 else df.filter(in_sample(id_col, fit_share, seed))
    if cosine:
        # a zero vector has no direction; it is assigned, but cannot be fitted
        fit_on = fit_on.filter(F.aggregate(V.doubles(vec_col), F.lit(0.0), lambda a, x: a + x * x) > 0)
    ready = fit_on.select(array_to_vector(V.doubles(vec_col)).alias("features"))
    model = KMeans(k=k, maxIter=max_iter, seed=seed, distanceMeasure="cosine" if cosine else "euclidean").fit(ready)
    centers = np.array(model.clusterCenters())
    if normalize_centroids or cosine:
        centers = _normalized(centers)
    cids = np.arange(len(centers), dtype=np.int64)
    return knn.assign_to(df, cids, centers, metric="ip" if cosine else "sq_l2", vec_col=vec_col), centroid_frame(df, cids, centers)


# --- cluster tables -----------------------------------------------------------


def cluster_sizes(assigned: DataFrame, cid_col: str = "cid") -> DataFrame:
    return assigned.groupBy(cid_col).agg(F.count(F.lit(1)).alias("n"))


def cluster_sorted(assigned: DataFrame, similarity, *, id_col="vec_id", cid_col="cid") -> DataFrame:
    """Members of each cluster ranked by centroid similarity, largest first."""
    rows = assigned.select(id_col, cid_col, similarity.alias("sim"))
    return rank_rows(rows, [F.col("sim").desc(), F.col(id_col)], [cid_col], settle=True)


# --- seeding ---------------------------------------------------------------------


def _nearest_so_far(df: DataFrame, new: np.ndarray, vec_col: str) -> DataFrame:
    """Lower the carried ``mind`` by the distances to the newest centres only."""
    at, kept = df.columns.index(vec_col), df.columns.index("mind")
    tie = np.arange(len(new))

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            _, _, dist = kernels.top_k("sq_l2", kernels.matrix(batch.column(at)), new, 1, tie_ids=tie)
            old = batch.column(kept).to_numpy(zero_copy_only=False)
            columns = list(batch.columns)
            columns[kept] = pa.array(np.fmin(old, dist), pa.float64())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return df.mapInArrow(run, df.schema)


def seed_centers(
    df: DataFrame, k: int, *, how: str, existing: DataFrame | None = None, seed: int = 0, id_col="vec_id", vec_col="embedding",
    keep_every: int = 16,
) -> DataFrame:
    """k rows spread out, as ``(step, vec_id, mind)``, conditioned on ``existing`` centres.

    ``how="farthest"`` takes the row farthest from all centres so far;
    ``how="weighted"`` draws a row with probability proportional to its squared
    distance, by the smallest exponential time ``-ln(u) / d`` with u from a hash of
    the id, which is one aggregate instead of a running sum. Without existing
    centres the first row is the one with the smallest hash. A round is one pass;
    the distances so far are kept every few rounds.
    """
    state = df.filter(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("bigint").alias(id_col), F.col(vec_col), F.lit(float("inf")).alias("mind"))
    pending: list[np.ndarray] = []
    picks: list[tuple[int, int, float | None]] = []
    if existing is not None:
        small = _require_small(existing)
        pending.append(small[1])
    else:
        first = state.orderBy(id_hash(id_col, seed), id_col).limit(1).collect()[0]
        pending.append(np.array([first[vec_col]], dtype=np.float64))
        picks.append((0, first[id_col], None))
    while len(picks) < k:
        step = len(picks)
        now = _nearest_so_far(state, np.concatenate(pending), vec_col)
        if len(pending) >= keep_every:
            now = state = checkpoint(now)
            pending = []
        if how == "farthest":
            score = F.struct(F.col("mind"), (-F.col(id_col)).alias("tie"))
            best = F.max_by(F.struct(id_col, vec_col, "mind"), score)
        else:
            u = (id_hash(id_col, seed + step) + 1).cast("double") / F.lit(2147483648.0)
            time = F.when(F.col("mind") > 0, -F.ln(u) / F.col("mind")).otherwise(F.lit(float("inf")))
            best = F.min_by(F.struct(id_col, vec_col, "mind"), F.struct(time.alias("t"), F.col(id_col)))
        row = now.agg(best.alias("best")).collect()[0]["best"]
        if row is None or row["mind"] <= 0:
            break
        picks.append((step, row[id_col], row["mind"]))
        pending.append(np.array([row[vec_col]], dtype=np.float64))
    return df.sparkSession.createDataFrame(picks, f"step bigint, {id_col} bigint, mind double")


def cluster_pick(
    pool: DataFrame, k: int, *, how: str, labeled: DataFrame | None = None, rounds: int = 10, seed: int = 0, id_col="vec_id", vec_col="embedding",
) -> DataFrame:
    """k pool rows ``(vec_id)`` spread over the vectors, all scaled to length 1.

    ``how="kmeans"`` takes the nearest row to each centre of k-means over the pool;
    ``weighted`` (k-means++) and ``farthest`` pick one row after the other, away from
    the rows of ``labeled`` as well. A row is picked once.
    """
    unit = pool.filter(F.col(vec_col).isNotNull()).select(id_col, V.l2_normalize(vec_col, 1e-12).alias(vec_col))
    if how == "kmeans":
        _, centers = kmeans(unit, sample_rows(unit, k, seed=seed, id_col=id_col, vec_col=vec_col), max_iter=rounds, tol=0.0, id_col=id_col, vec_col=vec_col, seed=seed)
        return knn.nearest_to_centers(unit, centers, id_col=id_col, vec_col=vec_col, seed=seed).select(id_col)
    if how not in ("weighted", "farthest"):
        raise ValueError(f"unknown method {how!r}")
    existing = None
    if labeled is not None:
        existing = labeled.filter(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("cid"), V.l2_normalize(vec_col, 1e-12).alias("centroid"))
    return seed_centers(unit, k, how=how, existing=existing, seed=seed, id_col=id_col, vec_col=vec_col).select(id_col)


# --- scores -------------------------------------------------------------------------


def _whole(value) -> Column:
    """Billionths as a whole number without a 64-bit bound, so that sums do not depend on their order."""
    return F.floor((value * 1e9 + 0.5).cast("decimal(38,9)")).cast("decimal(38,0)")


def calinski_harabasz(assigned: DataFrame, *, cid_col="cid", vec_col="embedding") -> DataFrame:
    """Between-cluster over within-cluster dispersion, each per degree of freedom.

    Within = total of |x|^2 minus the total of n |mean|^2, so the rows are read
    once and never meet their cluster's mean.
    """
    means = group_means(assigned, [cid_col], vec_col)
    grand = group_means(assigned.withColumn("_one", F.lit(0)), ["_one"], vec_col, "grand").select("grand", F.col("n").alias("total"))
    squares = assigned.agg(F.sum(_whole(V.dot(vec_col, vec_col))).cast("double").alias("sq"))
    per = means.agg(
        F.sum(_whole(F.col("n") * V.dot("mean", "mean"))).cast("double").alias("between"), F.count(F.lit(1)).alias("k")
    )
    one = F.lit(1)
    joined = per.withColumn("_j", one).join(grand.withColumn("_j", one), "_j").join(squares.withColumn("_j", one), "_j")
    between = F.col("between") / 1e9 - F.col("total") * V.dot("grand", "grand")
    within = (F.col("sq") - F.col("between")) / 1e9
    return joined.select(
        "k", "total", F.try_divide(between / (F.col("k") - 1), within / (F.col("total") - F.col("k"))).alias("score")
    )


def cluster_contingency(df: DataFrame, pred: str, truth: str) -> DataFrame:
    return df.groupBy(pred, truth).agg(F.count(F.lit(1)).alias("n"))


def matched_accuracy(df: DataFrame, pred: str, truth: str) -> DataFrame:
    """Accuracy under the one-to-one match of clusters to labels that agrees most.

    Only the table of counts, one row per (cluster, label), reaches the driver.
    """
    counts = collect_bounded(cluster_contingency(df, pred, truth))
    rows = sorted({r[0] for r in counts})
    cols = sorted({r[1] for r in counts})
    size = max(len(rows), len(cols))
    gain = np.zeros((size, size))
    for r in counts:
        gain[rows.index(r[0]), cols.index(r[1])] = r["n"]
    match = _best_matching(gain)
    hits = int(sum(gain[i, j] for i, j in enumerate(match)))
    total = int(gain.sum())
    return df.sparkSession.createDataFrame([(hits, total, hits / total if total else None)], "hits bigint, total bigint, accuracy double")


def _best_matching(gain: np.ndarray) -> list[int]:
    """Start from any matching and swap along improving cycles until none is left.

    With the current partner's gain as the price, a positive cycle in the swap
    graph is an improvement; Bellman-Ford finds one in O(n^3).
    """
    n = len(gain)
    match = list(range(n))
    while True:
        value = np.array([[gain[i, match[j]] - gain[i, match[i]] for j in range(n)] for i in range(n)])
        reach, parent = np.zeros(n), np.full(n, -1)
        last = -1
        for _ in range(n):
            last = -1
            for i in range(n):
                better = reach[i] + value[i] > reach + 1e-9
                if better.any():
                    reach[better] = reach[i] + value[i][better]
                    parent[better] = i
                    last = int(np.nonzero(better)[0][0])
        if last < 0:
            return match
        for _ in range(n):
            last = parent[last]
        cycle, node = [last], parent[last]
        while node != last:
            cycle.append(node)
            node = parent[node]
        # cycle lists j, parent(j), ...: parent(j) takes the partner of j
        old = {c: match[c] for c in cycle}
        for j in cycle:
            match[parent[j]] = old[j]
