"""Batch operators applied to arriving rows, with checkpointed progress.

Every job writes one folder per micro-batch and replaces it when a batch is
repeated, so the results of a restarted job are the same.
"""

from __future__ import annotations

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from curvine.operators import knn, ood, prompting


def read_arrivals(spark: SparkSession, folder: str, pattern: str, schema: str, files_per_batch: int | None = 1) -> DataFrame:
    """Parquet files of a folder as they arrive; without ``files_per_batch`` a batch takes all that wait."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    return (reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)).parquet(folder)


def _start(writer, checkpoint: str, once: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def assign_stream(
    arrivals: DataFrame, cids: np.ndarray, vectors: np.ndarray, out: str, checkpoint: str, *, metric="sq_l2", vec_col="embedding", once: bool = False
) -> StreamingQuery:
    """Nearest fixed centroid of every arriving row; no state, no shuffle."""
    assigned = knn.assign_to(arrivals, cids, vectors, metric=metric, vec_col=vec_col).drop(vec_col)
    return _start(assigned.writeStream.format("parquet").option("path", out).outputMode("append"), checkpoint, once)


def ood_score_stream(
    arrivals: DataFrame, train: DataFrame, k: int, out: str, checkpoint: str, *, once: bool = False, id_col="vec_id", **options
) -> StreamingQuery:
    """k-th neighbour score of arriving rows against a fixed training table."""

    def score(batch: DataFrame, batch_id: int) -> None:
        ood.ood_knn_score(batch, train, k, id_col=id_col, **options).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return _start(arrivals.writeStream.foreachBatch(score), checkpoint, once)


def _anchors_upto(spark: SparkSession, store: str, batch_id: int) -> DataFrame:
    """All anchors of batches 0 to ``batch_id``: the last compacted table and the batches behind it."""
    upto = -1
    try:
        upto = spark.read.parquet(f"{store}/marks").filter(F.col("upto") <= batch_id).agg(F.max("upto")).first()[0]
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
    upto = -1 if upto is None else upto
    rows = spark.read.parquet(f"{store}/rows").filter((F.col("batch") > upto) & (F.col("batch") <= batch_id)).drop("batch")
    return rows if upto < 0 else rows.unionByName(spark.read.parquet(f"{store}/compact/upto={upto}"))


def anchor_stream(
    arrivals: DataFrame, store: str, out: str, checkpoint: str, k: int, *, id_col: str, label_col: str, prob_col: str, metric: str = "kl", once: bool = False,
    compact_every: int = 32,
) -> StreamingQuery:
    """Labelled arrivals join the anchor store, unlabelled ones are classified by it.

    A batch first adds its labelled rows, then classifies against everything stored
    up to and including itself. Anchors are stored as a vote takes them
    (``prompting.stored_anchors``). Every ``compact_every`` batches all anchors are written as
    one table, marked when it is whole, so a batch reads that and at most as many small
    folders; a repeated batch writes the same again.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        labeled = prompting.stored_anchors(batch.filter(F.col(label_col).isNotNull()), metric, id_col=id_col, label_col=label_col, prob_col=prob_col)
        labeled.write.mode("overwrite").parquet(f"{store}/rows/batch={batch_id}")
        anchors = _anchors_upto(spark, store, batch_id)
        if batch_id % compact_every == compact_every - 1:
            anchors.write.mode("overwrite").parquet(f"{store}/compact/upto={batch_id}")
            spark.range(1).write.mode("overwrite").parquet(f"{store}/marks/upto={batch_id}")
            anchors = _anchors_upto(spark, store, batch_id)
        waiting = batch.filter(F.col(label_col).isNull())
        votes = prompting.vote_stored(waiting, anchors, k, metric=metric, id_col=id_col, label_col=label_col, vec_col=prob_col)
        votes.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return _start(arrivals.writeStream.foreachBatch(step), checkpoint, once)
