"""Active learning: acquisition scores, selection and round bookkeeping."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvine.functions import kernels
from curvine.functions import vectors as V
from curvine.functions.hashing import id_hash
from curvine.operators import knn
from curvine.plans.bounded import TooLarge, collect_bounded
from curvine.plans.ranking import rank_rows

# --- selection -----------------------------------------------------------------


def pick_top(scores: DataFrame, b: int, *, reverse: bool = False, score_col="score", id_col="vec_id") -> DataFrame:
    """The b highest (or with ``reverse`` lowest) scores, ties to the smaller id."""
    order = F.col(score_col).asc() if reverse else F.col(score_col).desc()
    return first_rows(scores, [order, F.col(id_col)], b)


# Up to here the first rows are merged in one task; more of them are ranked in parallel.
MAX_HEAP = 100_000


def first_rows(df: DataFrame, order: list[Column], b: int) -> DataFrame:
    if b <= MAX_HEAP:
        return df.orderBy(*order).limit(b)
    return rank_rows(df, order, settle=True).filter(F.col("rank") <= b).drop("rank")


def pick_random(df: DataFrame, b: int, *, seed: int = 0, id_col="vec_id") -> DataFrame:
    """b distinct random rows, the same in every run."""
    return first_rows(df.select(id_col), [id_hash(id_col, seed), F.col(id_col)], b)


# --- contrastive acquisition ---------------------------------------------------


def neighbor_divergence(
    neighbors: DataFrame, pool: DataFrame, labeled: DataFrame, *, loss: str = "kl", conf_thresh: float | None = None, id_col="vec_id",
    logits_col="logits", label_col="label",
) -> DataFrame:
    """Divergence between each pool row and each of its labelled neighbours.

    Probabilities, their entropies and the log-probabilities are computed once per
    row, below the join, not once per pair. ``kl`` is KL(neighbour || candidate);
    ``ce`` the cross-entropy of the candidate with the neighbour's label.
    Returns ``(query_id, neighbor_id, rank, div, same_class)``.
    """
    probs = V.softmax(logits_col)
    theirs = labeled.select(F.col(id_col).alias("neighbor_id"), probs.alias("_p"), F.col(label_col).alias("_y")).select(
        "neighbor_id", "_y", "_p", V.total(F.transform("_p", lambda x: F.when(x > 0, x * F.ln(x)).otherwise(F.lit(0.0)))).alias("_ne"),
        F.array_max("_p").alias("_conf"), V.argmax("_p").alias("_pred"),
    )
    own = pool.select(F.col(id_col).alias("query_id"), V.log_softmax(logits_col).alias("_lq"), V.argmax(logits_col).alias("_own"))
    if loss == "kl":
        div = V.kl_from_parts("_ne", "_p", "_lq")
        if conf_thresh is not None:
            div = F.when(F.col("_conf") > conf_thresh, div).otherwise(F.lit(0.0))
    elif loss == "ce":
        div = -F.element_at("_lq", (F.col("_y") + 1).cast("int"))
    else:
        raise ValueError(f"unknown loss {loss!r}")
    joined = neighbors.join(theirs, "neighbor_id").join(own, "query_id")
    return joined.select("query_id", "neighbor_id", "rank", div.alias("div"), (F.col("_pred") == F.col("_own")).alias("same_class"))


def _combine(operator: str) -> Column:
    if operator == "mean":
        return F.avg("div")
    if operator == "max":
        return F.max("div")
    if operator == "median":
        return F.percentile("div", 0.5)
    raise ValueError(f"unknown operator {operator!r}")


def cal_scores(divergence: DataFrame, operators: list[str] | str = "mean", *, digits: int = 9, id_col="vec_id") -> DataFrame:
    """One score per pool row and operator, and the agreement with the neighbours' predictions."""
    names = [operators] if isinstance(operators, str) else operators
    aggs = [F.round(_combine(o), digits).alias("score" if isinstance(operators, str) else f"score_{o}") for o in names]
    return divergence.groupBy(F.col("query_id").alias(id_col)).agg(
        *aggs, F.count_if("same_class").alias("n_agree"), F.bool_or("same_class").alias("any_agree")
    )


def cal_select(
    pool: DataFrame, labeled: DataFrame, *, k: int = 10, b: int, operator: str = "mean", conf_thresh: float | None = None, loss: str = "kl",
    reverse: bool = False, neighbors: DataFrame | None = None, id_col="vec_id", vec_col="embedding", logits_col="logits", label_col="label",
) -> DataFrame:
    """The b pool rows whose predictions differ most from those of their labelled neighbours."""
    near = neighbors if neighbors is not None else knn.knn_join(pool, labeled, k, "sq_l2", id_col=id_col, vec_col=vec_col)
    div = neighbor_divergence(near, pool, labeled, loss=loss, conf_thresh=conf_thresh, id_col=id_col, logits_col=logits_col, label_col=label_col)
    return pick_top(cal_scores(div, operator, id_col=id_col), b, reverse=reverse, id_col=id_col)


def labeled_centric_scores(divergence: DataFrame, *, id_col="vec_id") -> DataFrame:
    """Ablation: neighbours of the *labelled* rows, folded in their order by s <- (s + d) / 2 from 0.

    ``divergence`` has the labelled row as ``neighbor_id`` and the pool row as
    ``query_id``. The fold is a sum of d / 2^r with r counted from the last row; every
    term counts, and a pool row near every labelled row is ranked over many tasks.
    """
    ranked = rank_rows(divergence.select("query_id", "neighbor_id", "div"), [F.col("neighbor_id").desc()], ["query_id"], rank="r", settle=True)
    return ranked.groupBy(F.col("query_id").alias(id_col)).agg(F.sum(F.col("div") * F.pow(F.lit(0.5), F.col("r"))).alias("score"))


def reuse_stats(neighbors: DataFrame) -> DataFrame:
    """How often neighbour results are reused: distinct rows, accesses, hits, savings, average reuse."""
    per = neighbors.groupBy("neighbor_id").agg(F.count(F.lit(1)).alias("n"))
    totals = per.agg(F.count(F.lit(1)).alias("distinct_neighbors"), F.sum("n").alias("accesses"))
    hits = F.col("accesses") - F.col("distinct_neighbors")
    return totals.select(
        "distinct_neighbors", "accesses", hits.alias("hits"), F.round(F.try_divide(100.0 * hits, F.col("accesses")), 6).alias("savings_percent"),
        F.round(F.try_divide(F.col("accesses").cast("double"), F.col("distinct_neighbors")), 6).alias("average_reuse"),
    )


# --- uncertainty -------------------------------------------------------------------

UNCERTAINTY = ("least_conf", "margin", "ratio", "entropy", "std", "bald")


def mc_probabilities(df: DataFrame, logits_col: str, input: str = "logits") -> DataFrame:
    """Add ``_probs`` (samples x classes) and their mean ``_mean``; plain logits count as one sample."""
    kind = df.schema[logits_col].dataType.simpleString()
    rows = F.col(logits_col) if kind.startswith("array<array") else F.array(logits_col)
    one = (lambda x: F.transform(x, lambda v: F.exp(v.cast("double")))) if input == "log_prob" else V.softmax
    return df.withColumn("_probs", F.transform(rows, one)).withColumn("_mean", V.mean_of_rows("_probs", F.size("_probs")))


def _entropy(p) -> Column:
    return -V.total(F.transform(p, lambda x: F.when(x > 0, x * F.ln(x)).otherwise(F.lit(0.0))))


def uncertainty_scores(df: DataFrame, logits_col: str, methods=UNCERTAINTY, *, input: str = "logits", id_col="vec_id") -> DataFrame:
    """One column per method, from logits or from several sampled passes of them."""
    ready = mc_probabilities(df, logits_col, input)
    first, second = V.top2("_mean")
    n = F.size("_probs")

    def class_std(c):
        values = F.transform("_probs", lambda row: F.element_at(row, c + 1))
        mean = V.total(values) / n
        return F.sqrt(F.try_divide(V.let(mean, lambda m: V.total(F.transform(values, lambda x: (x - m) * (x - m)))), n - 1))

    exprs = {
        "least_conf": F.lit(1.0) - first,
        "margin": F.lit(1.0) - (first - second),
        "ratio": F.try_divide(second, first),
        "entropy": _entropy(F.col("_mean")),
        "std": V.total(F.transform(F.sequence(F.lit(0), F.size("_mean") - 1), class_std)) / F.size("_mean"),
        "bald": _entropy(F.col("_mean")) - V.total(F.transform("_probs", _entropy)) / n,
    }
    return ready.select(id_col, *[exprs[m].alias(m) for m in methods])


# Doubles in a chunk of mixed distributions.
CHUNK_CELLS = 4_000_000


def batchbald_select(
    df: DataFrame, b: int, *, probs_col="probs", samples: int, classes: int, method: str = "exact", max_configs: int = 40_000, seed: int = 0, id_col="vec_id"
) -> DataFrame:
    """Greedy batch by joint mutual information: ``(step, id, score)``.

    ``probs`` is a flat array, ``samples`` rows of ``classes``. Every round scores the
    pool in one pass against the joint table of the picks so far; only that bounded
    table and the winner move. ``method="exact"`` keeps every label combination of the
    picks and fails beyond ``max_configs`` of them; ``method="sampled"`` draws that many
    from the picks' own distributions, from the second step on.
    """
    if method not in ("exact", "sampled"):
        raise ValueError(f"unknown method {method!r}")
    if method == "exact" and classes ** max(0, b - 1) > max_configs:
        raise TooLarge(f"{classes}^{b - 1} label combinations are more than {max_configs}; use method='sampled'")
    k, c = samples, classes
    kept = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(probs_col).alias("probs"))
    joint = np.ones((1, k))
    sampled = False
    chosen: list[np.ndarray] = []
    picked: list[int] = []
    spent, rows = 0.0, []
    for step in range(b):

        def run(batches, joint=joint, sampled=sampled, picked=tuple(picked)):
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                ids = batch.column(0).to_numpy()
                p = kernels.matrix(batch.column(1)).reshape(-1, k, c)
                cond = _nats(p).sum(axis=2).mean(axis=1)
                score = np.empty(len(p))
                step_rows = max(1, CHUNK_CELLS // (len(joint) * c))
                for at in range(0, len(p), step_rows):  # a chunk of rows against all configurations
                    mixed = np.einsum("jk,rkc->rjc", joint, p[at : at + step_rows]) / k
                    score[at : at + step_rows] = _sampled_entropy(mixed, joint) if sampled else _nats(mixed).sum(axis=(1, 2))
                score -= cond
                free = ~np.isin(ids, picked)
                if free.any():
                    i = np.nonzero(free)[0]
                    best = i[np.lexsort((ids[i], -score[i]))[0]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids[best]], pa.int64()), pa.array([score[best]]), pa.array([cond[best]]), batch.column(1).take(pa.array([best]))],
                        names=["id", "score", "cond", "probs"],
                    )

        found = kept.mapInArrow(run, "id bigint, score double, cond double, probs array<double>")
        top = found.orderBy(F.col("score").desc(), "id").limit(1).collect()
        if not top:
            break
        win = top[0]
        rows.append((step, win["id"], win["score"] - spent))
        spent += win["cond"]
        picked.append(win["id"])
        chosen.append(np.array(win["probs"]).reshape(k, c))
        if step == b - 1:
            break
        if method == "exact":
            joint = (joint[:, None, :] * chosen[-1].T[None, :, :]).reshape(-1, k)
        else:
            sampled, joint = True, _sample_joint(chosen, max(1, max_configs // k), seed + step)
    return df.sparkSession.createDataFrame(rows, f"step bigint, {id_col} bigint, score double")


def _nats(p: np.ndarray) -> np.ndarray:
    return -p * np.log(p, out=np.zeros_like(p), where=p > 0)


def _sampled_entropy(mixed: np.ndarray, joint: np.ndarray):
    """Joint entropy from drawn configurations; ``mixed`` may hold many rows."""
    weight = joint.mean(axis=1)[:, None]
    return (_nats(mixed) / weight).sum(axis=(-2, -1)) / len(joint)


def _sample_joint(chosen: list[np.ndarray], per_sample: int, seed: int) -> np.ndarray:
    """Joint probabilities of label draws: ``per_sample`` draws from every model sample."""
    rng = np.random.default_rng(seed)
    k = chosen[0].shape[0]
    joint = np.ones((k * per_sample, k))
    source = np.repeat(np.arange(k), per_sample)
    for p in chosen:
        cumulative = p[source].cumsum(axis=1)
        draw = (rng.random((len(source), 1)) > cumulative / cumulative[:, -1:]).sum(axis=1)
        joint *= p[:, draw].T
    return joint


# --- splits and rounds ----------------------------------------------------------------


def stratified_sizes(counts: dict, total: int) -> dict:
    """Rows per class for a sample of ``total``: proportional, largest remainders first."""
    n = sum(counts.values())
    exact = {c: total * m / n for c, m in counts.items()}
    sizes = {c: math.floor(x) for c, x in exact.items()}
    order = sorted(counts, key=lambda c: (sizes[c] - exact[c], c))
    for c in order[: total - sum(sizes.values())]:
        sizes[c] += 1
    return sizes


def stratified_split(df: DataFrame, total: int, *, seed: int = 0, id_col="vec_id", class_col="label") -> DataFrame:
    """Add ``selected``: a random sample of ``total`` rows with the class shares of the whole."""
    counts = {r[0]: r["n"] for r in collect_bounded(df.groupBy(class_col).agg(F.count(F.lit(1)).alias("n")))}
    quota = df.sparkSession.createDataFrame([(c, n) for c, n in stratified_sizes(counts, total).items()], f"{class_col} bigint, quota bigint")
    ranked = rank_rows(df.select(id_col, class_col), [id_hash(id_col, seed), F.col(id_col)], [class_col])
    return ranked.join(F.broadcast(quota), class_col).select(id_col, class_col, (F.col("rank") <= F.col("quota")).alias("selected"))


def round_plan(pool: int, budget: float, batch: float) -> tuple[int, int, int]:
    """Whole-number (budget, batch, rounds); shares below 1 count as parts of the pool."""
    budget_rows = int(budget * pool) if budget < 1 else int(budget)
    batch_rows = max(1, int(batch * pool) if batch < 1 else int(batch))
    return budget_rows, batch_rows, math.ceil(budget_rows / batch_rows)


def batch_size(budget: int, batch: int, labeled: int, initial: int) -> int:
    """Rows to ask for next; the last round takes only what the budget leaves."""
    return max(0, min(batch, budget - (labeled - initial)))


def round_update(state: DataFrame, picked: DataFrame, round_no: int, id_col="vec_id") -> DataFrame:
    """Move the picked pool rows to the labelled set; ``state`` has ``(id, state, round)``."""
    marked = state.join(picked.select(id_col).withColumn("_hit", F.lit(True)), id_col, "left")
    hit = F.col("_hit").isNotNull() & (F.col("state") == "pool")
    return marked.select(
        id_col, F.when(hit, "labeled").otherwise(F.col("state")).alias("state"), F.when(hit, F.lit(round_no)).otherwise(F.col("round")).alias("round")
    )


def round_checks(before: DataFrame, after: DataFrame, picked: DataFrame, id_col="vec_id") -> DataFrame:
    """The invariants of a round as one row of booleans and counts."""
    tagged = (
        before.select(id_col, F.col("state").alias("b"), F.lit(None).cast("string").alias("a"), F.lit(0).alias("p"))
        .unionByName(after.select(id_col, F.lit(None).cast("string").alias("b"), F.col("state").alias("a"), F.lit(0).alias("p")))
        .unionByName(picked.select(id_col, F.lit(None).cast("string").alias("b"), F.lit(None).cast("string").alias("a"), F.lit(1).alias("p")))
    )
    per = tagged.groupBy(id_col).agg(
        F.max("b").alias("b"), F.max("a").alias("a"), F.count("b").alias("nb"), F.count("a").alias("na"), F.sum("p").alias("np")
    )
    return per.agg(
        F.count_if((F.col("a") == "labeled")).alias("n_labeled"), F.count_if(F.col("a") == "pool").alias("n_pool"),
        F.sum("np").alias("n_picked"), F.bool_and(F.col("np") <= 1).alias("picks_unique"),
        F.bool_and((F.col("np") == 0) | (F.col("b") == "pool")).alias("picks_from_pool"),
        F.bool_and((F.col("na") == 1) & (F.col("nb") == 1)).alias("disjoint_and_covering"),
    )


def selection_stats(rows: DataFrame, *, selected: Column, labeled: Column, text_col: str, class_col: str) -> tuple[DataFrame, DataFrame]:
    """Token lengths of the selected rows, and class percentages before, selected and after."""
    words = F.size(F.filter(F.split(text_col, r"\s+"), lambda w: w != ""))
    lengths = rows.filter(selected).select(words.alias("n")).agg(
        F.round(F.avg("n"), 6).alias("mean"), F.round(F.stddev_pop("n"), 6).alias("std"), F.min("n").cast("bigint").alias("min"), F.max("n").cast("bigint").alias("max")
    )
    per = rows.groupBy(class_col).agg(
        F.count_if(labeled).alias("b"), F.count_if(selected).alias("s"), F.count_if(labeled | selected).alias("a")
    )
    totals = per.agg(*[F.sum(c).alias(f"t{c}") for c in "bsa"]).withColumn("_j", F.lit(1))
    joined = per.withColumn("_j", F.lit(1)).join(F.broadcast(totals), "_j")
    shares = [F.round(F.try_divide(100.0 * F.col(c), F.col(f"t{c}")), 6).alias(name) for c, name in zip("bsa", ("before", "selected", "after"))]
    return lengths, joined.select(class_col, *shares)
