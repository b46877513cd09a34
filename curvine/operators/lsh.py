"""Locality-sensitive hashing: bucket equi-joins in place of all-against-all work.

A bucket that holds a large share of the rows is cut into blocks like any other
group, so no candidate is dropped and no bucket sits in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvine.functions import kernels
from curvine.functions.hashing import gaussian_matrix, sign_matrix
from curvine.operators import knn
from curvine.session import checkpoint


def planes(tables: int, bits: int, dim: int, seed: int, kind: str = "signs") -> np.ndarray:
    """Hyperplanes, ``bits`` rows per table: repeatable +-1 entries or Gaussian ones."""
    make = sign_matrix if kind == "signs" else gaussian_matrix
    return make(tables * bits, dim, seed)


def _with_codes(df, matrix, code, id_col, vec_col) -> DataFrame:
    """Append ``codes`` computed from the projection, in the pass that reads the vectors."""
    at = df.columns.index(vec_col)

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = kernels.matrix(batch.column(at))
            low = np.zeros((len(x), matrix.shape[0]))
            for d in range(matrix.shape[1]):
                low += x[:, d, None] * matrix[None, :, d]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, kernels.list_column(code(low), pa.int64())], names=[*batch.schema.names, "codes"]
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.filter(F.col(vec_col).isNotNull()).mapInArrow(run, schema + ", codes array<bigint>")


def sign_codes(df: DataFrame, matrix: np.ndarray, bits: int, *, id_col="vec_id", vec_col="embedding") -> DataFrame:
    """Add ``codes``: for each table, the signs of its projections as the bits of one number."""
    weights = 2 ** np.arange(bits - 1, -1, -1, dtype=np.int64)

    def code(low):
        return ((low >= 0).reshape(len(low), -1, bits) * weights).sum(axis=2)

    return _with_codes(df, matrix, code, id_col, vec_col)


def width_codes(df: DataFrame, matrix: np.ndarray, width: float, *, id_col="vec_id", vec_col="embedding") -> DataFrame:
    """Add ``codes``: every projection divided by ``width`` and rounded down."""
    return _with_codes(df, matrix, lambda low: np.floor(low / width).astype(np.int64), id_col, vec_col)


def by_table(coded: DataFrame, within: str | None = None, key: str = "bucket") -> DataFrame:
    """One row per (row, table) with the bucket key, optionally inside a group."""
    rows = coded.select("*", F.posexplode("codes").alias("table", "code")).drop("codes")
    parts = ([F.col(within)] if within else []) + [F.col("table"), F.col("code")]
    return rows.withColumn(key, F.struct(*parts)).drop("table", "code")


def by_all(coded: DataFrame, key: str = "bucket") -> DataFrame:
    """One row per row; all codes together are the bucket key."""
    return coded.withColumn(key, F.col("codes")).drop("codes")


def max_similarity_lsh(df: DataFrame, matrix, bits: int, *, within: str | None, metric="ip", id_col="vec_id", vec_col="embedding") -> DataFrame:
    """Largest similarity to any row that shares a bucket; rows without a candidate are absent."""
    keep = [id_col, vec_col] + ([within] if within else [])
    buckets = by_table(sign_codes(df.select(*keep), matrix, bits, id_col=id_col, vec_col=vec_col), within)
    return knn.max_similarity(buckets, within="bucket", metric=metric, id_col=id_col, vec_col=vec_col)


def candidate_pairs(df: DataFrame, matrix, bits: int, *, min_sim: float, within=None, metric="ip", id_col="vec_id", vec_col="embedding") -> DataFrame:
    """Pairs that share a bucket in some table and are more similar than ``min_sim``, each once."""
    keep = [id_col, vec_col] + ([within] if within else [])
    buckets = by_table(sign_codes(df.select(*keep), matrix, bits, id_col=id_col, vec_col=vec_col), within)
    return knn.similar_pairs(buckets, min_sim, within="bucket", metric=metric, id_col=id_col, vec_col=vec_col, overlapping=True)


def lsh_knn_join(
    queries: DataFrame, base: DataFrame, k: int, *, bucket, overlapping: bool, fallback: str = "exact", metric="sq_l2",
    id_col="vec_id", vec_col="embedding", exclude_self=False,
) -> DataFrame:
    """k nearest among the base rows that share a bucket with the query.

    ``bucket`` maps a DataFrame to one with a ``bucket`` column. Queries with
    fewer than k candidates are answered exactly when ``fallback="exact"``.
    """
    keep = [id_col, vec_col]
    found = knn.candidates(
        bucket(queries.select(*keep)), bucket(base.select(*keep)), k, metric, within="bucket", id_col=id_col, vec_col=vec_col,
        exclude_self=exclude_self,
    )
    near = knn.merge_candidates(found, k, distinct=overlapping)
    if fallback == "none":
        return near
    near = checkpoint(near)
    full = near.filter(F.col("rank") == k).select(F.col("query_id").alias(id_col))
    short = queries.select(*keep).join(full, id_col, "left_anti")
    rescued = knn.knn_join(short, base, k, metric, id_col=id_col, vec_col=vec_col, exclude_self=exclude_self)
    return near.join(full.select(F.col(id_col).alias("query_id")), "query_id", "left_semi").unionByName(rescued)
