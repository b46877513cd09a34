"""Nearest-neighbour classification over probability vectors, and few-shot sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvine.functions import vectors as V
from curvine.functions.hashing import id_hash
from curvine.operators import knn
from curvine.plans.ranking import top_k_within


def few_shot_sample(df: DataFrame, n: int, *, exclude: DataFrame | None = None, seed: int = 0, id_col: str, class_col: str) -> DataFrame:
    """n random rows per class outside ``exclude``, in a random order ``(id, class, position)``."""
    rows = df.select(id_col, class_col)
    if exclude is not None:
        rows = rows.join(exclude.select(id_col), id_col, "left_anti")
    shots = top_k_within(rows, [class_col], [id_hash(id_col, seed), F.col(id_col)], n).drop("rank")
    return shots.withColumn("position", id_hash(id_col, seed + 1))


def prepare_anchors(anchors: DataFrame, *, id_col: str, label_col: str, prob_col: str) -> DataFrame:
    """Anchor rows with their log probabilities and negative entropy, computed once."""
    return anchors.select(
        id_col, label_col, V.doubles(prob_col).alias(prob_col), V.log_smooth(prob_col).alias("log_p"), V.neg_entropy(prob_col).alias("neg_entropy")
    )


def vote(neighbors: DataFrame, labels: DataFrame, *, id_col: str, label_col: str) -> DataFrame:
    """Majority label of each query's neighbours, ties to the smallest label: ``(query_id, pred)``."""
    joined = neighbors.join(labels.select(F.col(id_col).alias("neighbor_id"), F.col(label_col).alias("y")), "neighbor_id")
    counts = joined.groupBy("query_id", "y").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("query_id").agg(F.min_by("y", F.struct((-F.col("n")).alias("a"), F.col("y"))).alias("pred"))


# Metrics whose anchors can be prepared: the distance is minus an inner product with what is stored.
PREPARED = ("kl", "cross")


def stored_anchors(anchors: DataFrame, metric: str, *, id_col: str, label_col: str, prob_col: str) -> DataFrame:
    """``(id, label, ready)``: anchors as a vote takes them, with every logarithm of theirs taken once.

    KL(anchor || query) is the anchor's negative entropy minus the sum of its
    probabilities times the query's logs, so ``ready`` is the probabilities and the negative
    entropy; for ``cross`` it is the log probabilities.
    """
    made = prepare_anchors(anchors, id_col=id_col, label_col=label_col, prob_col=prob_col)
    ready = F.concat(F.col(prob_col), F.array("neg_entropy")) if metric == "kl" else F.col("log_p")
    return made.select(id_col, label_col, ready.alias("ready"))


def vote_stored(queries: DataFrame, stored: DataFrame, k: int, *, metric: str = "kl", id_col: str, label_col: str, vec_col: str, exclude_self: bool = False) -> DataFrame:
    """Classify by the k nearest of ``stored_anchors``; nothing about an anchor is computed again."""
    if metric not in PREPARED:
        raise ValueError(f"anchors cannot be prepared for {metric!r}")
    asked = F.concat(V.log_smooth(vec_col), F.array(F.lit(-1.0))) if metric == "kl" else V.doubles(vec_col)
    near = knn.knn_join(queries.select(id_col, asked.alias("ready")), stored, k, "ip", id_col=id_col, vec_col="ready", exclude_self=exclude_self)
    return vote(near, stored, id_col=id_col, label_col=label_col)


def knn_vote(
    queries: DataFrame, anchors: DataFrame, k: int, *, metric: str = "kl", id_col: str, label_col: str, vec_col: str, exclude_self: bool = False
) -> DataFrame:
    """Classify by the k nearest anchors: ``kl`` is KL(anchor || query), ``cross`` ranks by sum of query * log anchor."""
    if metric in PREPARED:
        stored = stored_anchors(anchors, metric, id_col=id_col, label_col=label_col, prob_col=vec_col)
        return vote_stored(queries, stored, k, metric=metric, id_col=id_col, label_col=label_col, vec_col=vec_col, exclude_self=exclude_self)
    near = knn.knn_join(queries, anchors, k, metric, id_col=id_col, vec_col=vec_col, exclude_self=exclude_self)
    return vote(near, anchors, id_col=id_col, label_col=label_col)


def icl_predict(prob_col: str, token_ids: Column) -> Column:
    """Position of the label word with the highest probability; ``token_ids`` counts from 0."""
    return V.argmax(F.transform(token_ids, lambda t: F.element_at(V.doubles(prob_col), (t + 1).cast("int"))))
