"""Out-of-distribution scores and detection metrics. Higher scores mean in-distribution."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvine.functions import kernels
from curvine.functions import vectors as V
from curvine.operators import knn
from curvine.operators.kth import kth_score
from curvine.plans.bounded import collect_bounded, fits
from curvine.plans.ranking import rank_rows, running_totals

# --- scores ------------------------------------------------------------------------


def ood_knn_score(
    queries: DataFrame, train: DataFrame, k: int, *, mode: str = "exact", exclude_self: bool = False, id_col="vec_id", vec_col="embedding", **options
) -> DataFrame:
    """Minus the squared distance to the k-th training row; NULL when there are fewer than k."""
    if mode == "exact":
        return kth_score(queries, train, k, id_col=id_col, vec_col=vec_col, exclude_self=exclude_self, **options)
    joins = {
        "two_stage": lambda: knn.two_stage_knn_join(queries, train, options["matrix"], k, id_col=id_col, vec_col=vec_col, exclude_self=exclude_self),
        "ivf": lambda: knn.ivf_knn_join(
            queries, train, options["centroids"], k, options["nprobe"], id_col=id_col, vec_col=vec_col, exclude_self=exclude_self
        ),
        "lsh": lambda: _lsh_join(queries, train, k, options, id_col, vec_col, exclude_self),
    }
    return knn.kth_distance(joins[mode](), queries, k, id_col)


def _lsh_join(queries, train, k, options, id_col, vec_col, exclude_self):
    from curvine.operators import lsh

    return lsh.lsh_knn_join(
        queries, train, k, bucket=options["bucket"], overlapping=options.get("overlapping", True), id_col=id_col, vec_col=vec_col,
        exclude_self=exclude_self,
    )


def msp_score(logits) -> Column:
    return F.array_max(V.softmax(logits))


def energy_score(logits, temperature: float = 1.0) -> Column:
    return F.lit(temperature) * V.logsumexp(V.scale(logits, F.lit(1.0 / temperature)))


# --- Mahalanobis ----------------------------------------------------------------------


# Tasks whose sums are added up together first.
FAN_IN = 1024


class GaussianFit:
    """Class means and precision matrices; small arrays on the driver."""

    def __init__(self, classes, means, precision, dims=None):
        self.classes, self.means, self.precision, self.dims = classes, means, precision, dims


def _scatter(df: DataFrame, class_col: str, vec_col: str, per_class: bool) -> tuple[dict, dict]:
    """Per-class counts and sums, and summed outer products, each task adding up its own rows."""
    rows = df.filter(F.col(vec_col).isNotNull()).select(F.col(class_col).cast("bigint").alias("c"), F.col(vec_col).alias("v"))

    def run(batches):
        sums, outer = {}, {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            own, x = batch.column(0).to_numpy(), kernels.matrix(batch.column(1))
            for c in np.unique(own):
                at = x[own == c]
                n, s = sums.get(int(c), (0, 0.0))
                sums[int(c)] = (n + len(at), s + at.sum(axis=0))
                key = int(c) if per_class else -1
                outer[key] = outer.get(key, 0.0) + at.T @ at
        if sums:
            rows_out = [(0, c, -1, n, s) for c, (n, s) in sums.items()]
            rows_out += [(1, c, i, 0, line) for c, m in outer.items() for i, line in enumerate(m)]
            kind, c, i, n, v = zip(*rows_out)
            task = np.full(len(kind), TaskContext.get().partitionId())
            yield pa.RecordBatch.from_arrays(
                [pa.array(kind, pa.int64()), pa.array(c, pa.int64()), pa.array(i, pa.int64()), pa.array(n, pa.int64()), kernels.list_column(np.array(v), pa.float64()), pa.array(task, pa.int64())],
                names=["kind", "c", "i", "n", "v", "task"],
            )

    def add_up(key, table):
        # in the order of the tasks, so that a repeated run adds up alike
        table = table.sort_by("task")
        total = kernels.matrix(table.column("v")).sum(axis=0, keepdims=True)
        return pa.table(
            {
                **{name: pa.array([k.as_py()], pa.int64()) for name, k in zip(("kind", "c", "i"), key)},
                "n": pa.array([int(table.column("n").to_numpy().sum())], pa.int64()),
                "v": kernels.list_column(total, pa.float64()),
                "task": table.column("task").slice(0, 1),
            }
        )

    schema = "kind bigint, c bigint, i bigint, n bigint, v array<double>, task bigint"
    # one line per task and matrix row, added up in two steps: no group holds more than tasks / FAN_IN or FAN_IN lines
    lines = rows.mapInArrow(run, schema)
    some = lines.withColumn("some", F.expr(f"task div {FAN_IN}")).groupBy("kind", "c", "i", "some").applyInArrow(add_up, schema)
    parts = collect_bounded(some.groupBy("kind", "c", "i").applyInArrow(add_up, schema))
    sums = {r["c"]: (r["n"], np.array(r["v"])) for r in parts if r["kind"] == 0}
    outer: dict = {}
    for r in sorted((r for r in parts if r["kind"] == 1), key=lambda r: (r["c"], r["i"])):
        outer.setdefault(r["c"], []).append(r["v"])
    return sums, {c: np.array(m) for c, m in outer.items()}


def fit_gaussians(
    df: DataFrame, *, per_class: bool = False, diagonal: bool = False, dims: dict[int, list[int]] | None = None, class_col="label", vec_col="embedding"
) -> GaussianFit:
    """Class means with one shared precision matrix, or one per class.

    One pass sums rows and outer products; the matrices, whose size depends only on
    the dimension, are inverted on the driver. ``dims`` limits a class to some of
    the features.
    """
    sums, outer = _scatter(df, class_col, vec_col, per_class)
    classes = sorted(sums)
    means = np.array([sums[c][1] / sums[c][0] for c in classes])
    total = sum(n for n, _ in sums.values())

    def invert(cov):
        return np.diag(1.0 / np.diag(cov)) if diagonal else np.linalg.pinv(cov, hermitian=True)

    if per_class:
        precision = np.array([invert(outer[c] / sums[c][0] - np.outer(m, m)) for c, m in zip(classes, means)])
    else:
        within = outer[-1] - sum(sums[c][0] * np.outer(m, m) for c, m in zip(classes, means))
        precision = np.array([invert(within / total)])
    return GaussianFit(np.array(classes), means, precision, dims)


def mahalanobis_score(df: DataFrame, fit: GaussianFit, *, id_col="vec_id", vec_col="embedding") -> DataFrame:
    """Largest over the classes of -1/2 (x - mean)' P (x - mean), and that class."""
    if not fits(fit.precision.shape[0] * fit.precision.shape[1], fit.precision.shape[2]):
        raise ValueError("the precision matrices are too large for one task")

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = kernels.matrix(batch.column(1))
            scores = np.empty((len(x), len(fit.classes)))
            for j, c in enumerate(fit.classes):
                p = fit.precision[j if len(fit.precision) > 1 else 0]
                z = x - fit.means[j]
                if fit.dims is not None:
                    keep = fit.dims[int(c)]
                    z, p = z[:, keep], p[np.ix_(keep, keep)]
                scores[:, j] = -0.5 * ((z @ p) * z).sum(axis=1)
            best = scores.argmax(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores[np.arange(len(x)), best]), pa.array(fit.classes[best], pa.int64())], names=[id_col, "score", "class"]
            )

    kept = df.filter(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("bigint").alias(id_col), vec_col)
    return kept.mapInArrow(run, f"{id_col} bigint, score double, class bigint")


def top_contributions(means: np.ndarray, weights: np.ndarray, classes, drop_percent: float) -> dict[int, list[int]]:
    """Features that contribute most to each class: the largest mean * weight, without ``drop_percent`` of them."""
    keep = int((1 - drop_percent / 100) * means.shape[1])
    order = np.argsort(-(means * weights), axis=1, kind="stable")[:, :keep]
    return {int(c): sorted(int(i) for i in row) for c, row in zip(classes, order)}


def standardize(df: DataFrame, reference: DataFrame, vec_col="embedding") -> DataFrame:
    """Z-score every feature by the mean and deviation it has in ``reference``."""
    sums, outer = _scatter(reference.withColumn("_one", F.lit(0)), "_one", vec_col, False)
    n, s = sums[0]
    mean = s / n
    std = np.sqrt(np.maximum(np.diag(outer[-1]) / n - mean**2, 0.0))
    std[std == 0] = 1.0
    params = F.array(*[F.struct(F.lit(float(m)).alias("m"), F.lit(float(d)).alias("s")) for m, d in zip(mean, std)])
    return df.withColumn(vec_col, F.zip_with(V.doubles(vec_col), params, lambda x, p: (x - p["m"]) / p["s"]))


# --- Gram deviations -------------------------------------------------------------------------


def gram_stats(df: DataFrame, layers: dict[int, Column], powers: list[int], *, id_col="vec_id", keep: list[str] = ()) -> DataFrame:
    """Per row, layer and power one value per channel: ``(id, layer, power, g)``.

    A layer is ``array<array<double>>``, channels by positions. The value of a
    channel is the sum of its Gram row for the p-th powers, brought back by the
    p-th root with its sign.
    """
    maps = F.explode(F.array(*[F.struct(F.lit(i).alias("layer"), c.alias("map")) for i, c in layers.items()])).alias("l")
    rows = df.select(id_col, *keep, maps).select(
        id_col, *keep, F.col("l.layer").alias("layer"), F.col("l.map").alias("map"), F.explode(F.array(*[F.lit(p) for p in powers])).alias("power")
    )
    raised = F.transform("map", lambda ch: F.transform(ch, lambda x: F.pow(x.cast("double"), F.col("power"))))
    rows = rows.select(id_col, *keep, "layer", "power", raised.alias("r"))
    summed = V.mean_of_rows("r", F.lit(1.0))
    rows = rows.select(id_col, *keep, "layer", "power", "r", summed.alias("all"))
    root = F.transform(
        "r", lambda ch: V.let(V.dot(ch, "all"), lambda t: F.signum(t) * F.pow(F.abs(t), F.lit(1.0) / F.col("power")))
    )
    return rows.select(id_col, *keep, "layer", "power", root.alias("g"))


def gram_ranges(stats: DataFrame, class_col: str) -> DataFrame:
    """Smallest and largest value of every channel per class, layer and power, as arrays."""
    flat = stats.select(class_col, "layer", "power", F.posexplode("g").alias("ch", "x"))
    per = flat.groupBy(class_col, "layer", "power", "ch").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    packed = per.groupBy(class_col, "layer", "power").agg(F.sort_array(F.collect_list(F.struct("ch", "lo", "hi"))).alias("b"))
    return packed.select(class_col, "layer", "power", F.col("b.lo").alias("lo"), F.col("b.hi").alias("hi"))


def gram_layer_deviation(stats: DataFrame, ranges: DataFrame, class_col: str, *, id_col="vec_id", keep: list[str] = ()) -> DataFrame:
    """Relative distance outside the class's range, per row and layer."""
    joined = stats.join(ranges, [class_col, "layer", "power"])
    below = V.total(F.zip_with("g", "lo", lambda x, lo: F.greatest(lo - x, F.lit(0.0)) / F.abs(lo + 1e-6)))
    above = V.total(F.zip_with("g", "hi", lambda x, hi: F.greatest(x - hi, F.lit(0.0)) / F.abs(hi + 1e-6)))
    return joined.groupBy(id_col, *keep, "layer").agg(F.sum(below + above).alias("dev"))


def gram_deviation(layer_dev: DataFrame, expected: DataFrame, confidence_col: str, *, id_col="vec_id") -> DataFrame:
    """Sum over layers of deviation / expected deviation of the layer / confidence of the row."""
    # one row per layer
    scaled = layer_dev.join(F.broadcast(expected), "layer")
    return scaled.groupBy(id_col).agg(F.sum(F.try_divide(F.col("dev"), F.col("eva") * F.col(confidence_col))).alias("deviation"))


# --- detection metrics -------------------------------------------------------------------------


def roc_points(known: DataFrame, novel: DataFrame, score_col: str = "score", by: str | None = None) -> DataFrame:
    """One row per distinct score: how many known and novel rows have it, and how many lie above it.

    Equal scores are one point. Scores are added up per value first and the running
    totals go by ranges of scores, so no task sees all of them. With ``by`` (a column
    of ``novel``) every set of novel rows is held against all known rows.
    """
    n = novel.select(F.col(score_col).alias("s"), (F.col(by) if by else F.lit(0)).alias("set"), F.lit(0).alias("k"), F.lit(1).alias("n"))
    if by:
        sets = [r[0] for r in collect_bounded(novel.select(by).distinct())]
        which = F.explode(F.array(*[F.lit(s) for s in sorted(sets)]))
    else:
        which = F.lit(0)
    k = known.select(F.col(score_col).alias("s"), which.alias("set"), F.lit(1).alias("k"), F.lit(0).alias("n"))
    counts = k.unionByName(n).filter(F.col("s").isNotNull()).groupBy("set", "s").agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
    run = running_totals(counts, [F.col("s")], {"ck": F.col("k"), "cn": F.col("n")}, ["set"], totals_too=True)
    return run.select(
        "set", "s", "k", "n", "ck", "cn", F.col("ck_total").alias("n_known"), F.col("cn_total").alias("n_novel"),
        (F.col("ck_total") - F.col("ck")).alias("tp"), (F.col("cn_total") - F.col("cn")).alias("fp"),
    )


def ood_metrics(points: DataFrame) -> DataFrame:
    """FPR at 95 % of the known, AUROC, detection error, and areas under both precision-recall curves.

    The point before a score follows from its own counts, so no row needs its neighbour.
    """
    tp, fp, k, n, K, N = (F.col(c) for c in ("tp", "fp", "k", "n", "n_known", "n_novel"))
    tp0, fp0 = tp + k, fp + n
    width_t, width_f = k / K, n / N

    def inside(t, f):
        return F.coalesce(F.try_divide(t, t + f), F.lit(0.0))

    def outside(t, f):
        return F.coalesce(F.try_divide(N - f, (K - t) + (N - f)), F.lit(0.0))

    at = F.bround(F.lit(0.05) * K, 0)
    return points.groupBy("set").agg(
        F.min_by(fp / N, F.when(F.col("ck") > at, F.col("s"))).alias("fpr95"),
        F.sum(width_t * ((1 - fp0 / N) + (1 - fp / N)) / 2).alias("auroc"),
        F.least(F.min((K - tp + fp) / (K + N)), F.max(N / (K + N))).alias("dterr"),
        F.sum(width_t * (inside(tp0, fp0) + inside(tp, fp)) / 2).alias("auin"),
        F.sum(width_f * (outside(tp0, fp0) + outside(tp, fp)) / 2).alias("auout"),
    )


def ood_measures(points: DataFrame, recall: float = 0.95) -> DataFrame:
    """AUROC, average precision for both sides, and the FPR at the point nearest to the recall."""
    tp, fp, k, n, K, N = (F.col(c) for c in ("tp", "fp", "k", "n", "n_known", "n_novel"))
    hit, miss = tp + k, fp + n  # at or above the score
    off = F.round(F.abs(hit / K - recall), 12)
    reached = F.when(tp < K, F.struct(off.alias("off"), (-hit / K).alias("r"), (-F.col("s")).alias("s")))
    # scores below every known one add novel rows at full recall and are not points
    usable = F.when(F.col("ck") - k < K, reached)
    return points.groupBy("set").agg(
        F.sum((k / K) * ((1 - miss / N) + (1 - fp / N)) / 2).alias("auroc"),
        F.sum((k / K) * F.coalesce(F.try_divide(hit, hit + miss), F.lit(0.0))).alias("ap_in"),
        F.sum((n / N) * F.coalesce(F.try_divide(N - fp, (N - fp) + (K - tp)), F.lit(0.0))).alias("ap_out"),
        F.min_by(miss / N, usable).alias("fpr"),
    )


def in_report(df: DataFrame, points: DataFrame, *, score_col="score", pred_col="pred", label_col="label") -> DataFrame:
    """Rows of the known set below the 95 % threshold, accuracy, and accuracy counting only accepted rows."""
    threshold = points.agg(F.min(F.when(F.col("ck") > F.bround(F.lit(0.05) * F.col("n_known"), 0), F.col("s"))).alias("t")).scalar()
    rows = df.select((F.col(score_col) > threshold).alias("ok"), (F.col(pred_col) == F.col(label_col)).alias("right"))
    return rows.agg(
        F.round(F.avg((~F.col("ok")).cast("double")), 6).alias("fnr"), F.round(F.avg(F.col("right").cast("double")), 6).alias("accuracy"),
        F.round(F.avg((F.col("right") & F.col("ok")).cast("double")), 6).alias("end_to_end_accuracy"),
    )


def average_metrics(per_set: DataFrame, names: list[str]) -> DataFrame:
    return per_set.agg(F.count(F.lit(1)).alias("sets"), *[F.round(F.avg(n), 6).alias(n) for n in names])


def score_stats(scores: DataFrame, set_col: str, score_col: str = "score") -> DataFrame:
    return scores.groupBy(set_col).agg(
        F.count(score_col).alias("n"), F.round(F.avg(score_col), 6).alias("mean"), F.round(F.stddev_pop(score_col), 6).alias("std")
    )


def flag_recall(exact: DataFrame, approx: DataFrame, *, quantile: float = 0.95, score_col="dist", id_col="vec_id") -> DataFrame:
    """Of the rows at or above the exact run's quantile, the share an approximate run also puts there; 1 if there are none.

    The quantile lies between two neighbouring ranks, which are found by distributed ranks.
    """
    own = exact.filter(F.col(score_col).isNotNull()).select(id_col, F.col(score_col).cast("double").alias("s"))
    ranked = rank_rows(own, [F.col("s"), F.col(id_col)], totals_too=True, settle=True)
    at = (F.col("rank_total") - 1) * F.lit(quantile)
    beside = ranked.filter((F.col("rank") - 1 == F.floor(at)) | (F.col("rank") - 1 == F.ceil(at))).agg(F.min("s").alias("low"), F.max("s").alias("high"), F.max(at - F.floor(at)).alias("part"))
    cut = beside.agg(F.max(F.round(F.col("low") + (F.col("high") - F.col("low")) * F.col("part"), 9)).alias("t")).scalar()
    a = exact.select(id_col, (F.round(score_col, 9) >= cut).alias("a"))
    b = approx.select(id_col, (F.round(score_col, 9) >= cut).alias("b"))
    joined = a.join(b, id_col, "left").select("a", F.coalesce("b", F.lit(False)).alias("b"))
    counts = joined.agg(F.count_if("a").alias("flagged"), F.count_if(F.col("a") & F.col("b")).alias("both"))
    return counts.select("flagged", "both", F.coalesce(F.round(F.try_divide(F.col("both").cast("double"), F.col("flagged")), 6), F.lit(1.0)).alias("recall"))
