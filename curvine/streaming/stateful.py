"""Streams with state: a near-duplicate filter for vectors and windowed statistics of events.

State lives in RocksDB, one entry per key, and progress in the checkpoint folder, so a
restarted job goes on where it stopped and a repeated micro-batch replaces its output.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from curvine.operators import lsh

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextlib.contextmanager
def rocksdb(spark: SparkSession):
    """State of the queries started inside goes to RocksDB: on the executors' disks, with copies in the checkpoint folder."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


# --- near-duplicate filter --------------------------------------------------------------


def similarities(rows: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Inner products, summed left to right, so that they repeat bit for bit."""
    out = np.zeros(len(rows))
    for d in range(len(one)):
        out += rows[:, d] * one[d]
    return out


class KeepFirst(StatefulProcessor):
    """Per bucket the survivors of the last ``keep_us`` microseconds; a row survives unless one of them is too similar."""

    def __init__(self, min_sim: float, keep_us: int) -> None:
        self.min_sim, self.keep_us = min_sim, keep_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getMapState("kept", "id bigint", "us bigint, vec array<double>")

    # Spark hands the arguments over by these names
    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows)).sort_values(["us", "id"], kind="stable")
        width = len(arrived["vec"].iloc[0])
        stored = sorted(((k[0], v[0], v[1]) for k, v in self.kept.iterator()), key=lambda s: s[1])
        room = len(stored) + len(arrived)
        vec, us, n = np.zeros((room, width)), np.zeros(room, np.int64), len(stored)
        for i, (_, at, v) in enumerate(stored):
            vec[i], us[i] = v, at
        out, first = [], 0
        for id_, at, v in zip(arrived["id"], arrived["us"], arrived["vec"]):
            one = np.asarray(v, np.float64)
            # rows come by time: who is too old for this one is so for all that follow
            while first < n and us[first] <= at - self.keep_us:
                first += 1
            near = (similarities(vec[first:n], one) > self.min_sim) & (us[first:n] > at - self.keep_us)
            if near.any():
                continue
            vec[n], us[n] = one, at
            n += 1
            self.kept.updateValue((int(id_),), (int(at), one.tolist()))
            # the bucket looks at its survivors again once this one is too old, once for all of a stretch as long as ``keep``
            self.handle.registerTimer((int(at) // self.keep_us + 2) * self.keep_us // 1000 + 1)
            out.append((int(id_), int(at), one.tolist()))
        yield pd.DataFrame(out, columns=["id", "us", "vec"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        for k in [k for k, v in self.kept.iterator() if v[0] + self.keep_us <= now]:
            self.kept.removeKey(k)
        yield pd.DataFrame({"id": pd.Series(dtype="int64"), "us": pd.Series(dtype="int64"), "vec": pd.Series(dtype="object")})

    def close(self) -> None:
        pass


def near_duplicate_stream(
    arrivals: DataFrame, matrix: np.ndarray, bits: int, min_sim: float, out: str, checkpoint: str, *, keep: str = "7 days", late: str = "1 hour",
    id_col="vec_id", time_col="ts", vec_col="embedding", once: bool = False,
) -> StreamingQuery:
    """Rows ``(id, us, vec)`` that resemble no survivor of their bucket, in the order of arrival.

    A bucket is the ``bits`` signs of one table of planes, so a pair on two sides of a
    plane is not found, as in a search of one table. A row is dropped if a survivor of the last
    ``keep`` has an inner product above ``min_sim`` with it; rows of one micro-batch come
    by event time, then id. State grows with the survivors, never with copies: it is
    cleared by event time, ``keep`` to twice that after a survivor's own. Rows more than ``late`` behind
    the watermark are not looked at. More bits cut a crowded bucket into smaller ones.
    """
    spark = arrivals.sparkSession
    keep_us = int(pd.Timedelta(keep).total_seconds() * 1_000_000)
    coded = lsh.sign_codes(arrivals.select(id_col, time_col, vec_col), matrix, bits, id_col=id_col, vec_col=vec_col)
    rows = coded.withWatermark(time_col, late).select(
        F.col(id_col).cast("bigint").alias("id"), F.unix_micros(F.col(time_col).cast("timestamp")).alias("us"), F.col(time_col).alias("time"),
        F.col(vec_col).cast("array<double>").alias("vec"), F.col("codes")[0].alias("bucket"),
    )
    survivors = rows.groupBy("bucket").transformWithStateInPandas(
        KeepFirst(min_sim, keep_us), "id bigint, us bigint, vec array<double>", "Append", "EventTime"
    )
    writer = survivors.writeStream.format("parquet").option("path", out).outputMode("append").option("checkpointLocation", checkpoint)
    with rocksdb(spark):
        return (writer.trigger(availableNow=True) if once else writer).start()


# --- windowed statistics -----------------------------------------------------------------


def window_stats(events: DataFrame, flagged: Column, *, window: str = "1 day", late: str = "1 day", time_col="ts", value_col="value", by: tuple[str, ...] = ()) -> DataFrame:
    """Per tumbling window (and ``by``): rows, mean, standard deviation and the share of ``flagged`` rows.

    On a stream, rows whose window has ended ``late`` before the latest event seen are
    left out, and a window comes out once, when no row can reach it any more; on a table
    every row counts. The sums are taken in whole thousandths, so they do not depend on the
    order of arrival.
    """
    units = F.round(F.col(value_col) * 1000).cast("decimal(38,0)")
    rows = events.withWatermark(time_col, late) if events.isStreaming else events
    groups = rows.groupBy(F.window(time_col, window).alias("w"), *by).agg(
        F.count(value_col).alias("n"), F.sum(units).alias("s"), F.sum(units * units).alias("q"), F.count_if(flagged).alias("n_flagged")
    )
    n, s, q = F.col("n").cast("double"), F.col("s").cast("double"), F.col("q").cast("double")
    mean = F.try_divide(s, n)
    return groups.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n", "n_flagged", (mean / 1000).alias("mean"),
        (F.sqrt(F.greatest(F.try_divide(q, n) - mean * mean, F.lit(0.0))) / 1000).alias("std"), F.try_divide(F.col("n_flagged").cast("double"), n).alias("flagged_share"),
    )


def window_stats_stream(events: DataFrame, flagged: Column, out: str, checkpoint: str, *, once: bool = False, **options) -> StreamingQuery:
    """``window_stats`` of arriving events as Parquet, each window written once."""
    writer = window_stats(events, flagged, **options).writeStream.format("parquet").option("path", out).outputMode("append").option("checkpointLocation", checkpoint)
    with rocksdb(events.sparkSession):
        return (writer.trigger(availableNow=True) if once else writer).start()


def drift(stats: DataFrame, reference: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """``window_stats`` beside a reference ``(by..., mean, std)``: by how many of its deviations the mean has moved."""
    past = reference.select(*by, F.col("mean").alias("mean_before"), F.col("std").alias("std_before"))
    return stats.join(past, list(by), "left").withColumn("shift", F.try_divide(F.col("mean") - F.col("mean_before"), F.col("std_before")))
