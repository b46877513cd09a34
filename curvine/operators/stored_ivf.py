"""A stored inverted-file index: vectors in folders by cell, added to round by round.

Below the index folder lie

* ``centroids/version=V``: the cell centres ``(cid, centroid)`` of a version,
* ``cells/version=V/round=R/cid=C``: the vectors ``(id, vec)``, partitioned by cell,
* ``rounds/version=V/round=R``: how many vectors each cell got, ``(cid, n, dim)``.

A round counts once its ``rounds`` folder is there, which is written last, so a job that
dies leaves nothing behind that a search would see, and its repetition replaces the
round. Rounds are appended with the centres of their version; a rebuild or a compaction
makes a new version and leaves the old ones readable. A search reads only the folders of
the cells it probes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvine.operators import knn
from curvine.plans.blocks import BLOCK_ROWS
from curvine.plans.bounded import collect_bounded

# Rounds and versions of one index; rows of the manifest are at most cells * rounds.
MAX_ROUNDS = 10_000


@dataclass(frozen=True)
class IvfIndex:
    """One version of an index up to one round; searches of it give the same answer for ever."""

    spark: SparkSession
    path: str
    version: int
    round: int
    metric: str = "sq_l2"

    @property
    def centroids(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/centroids/version={self.version}").select("cid", "centroid")

    @property
    def manifest(self) -> DataFrame:
        """``(version, round, cid, n, dim)`` of the rounds seen."""
        rounds = _read(self.spark, self.path, "rounds")
        return rounds.filter((F.col("version") == self.version) & (F.col("round") <= self.round))

    @property
    def vectors(self) -> DataFrame:
        """``(id, vec, round, cid)`` of all rounds seen; filters on ``round`` and ``cid`` choose folders."""
        cells = _read(self.spark, self.path, "cells")
        return cells.filter((F.col("version") == self.version) & (F.col("round") <= self.round)).select("id", "vec", "round", "cid")

    def sizes(self) -> DataFrame:
        """``(cid, n)`` of the cells that hold vectors."""
        return self.manifest.groupBy("cid").agg(F.sum("n").alias("n"))


def _read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.option("basePath", f"{path}/{kind}").parquet(f"{path}/{kind}")


def _latest(spark: SparkSession, path: str) -> tuple[int, int] | None:
    """The last complete version and its last round."""
    try:
        rounds = _read(spark, path, "rounds")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return None
        raise
    last = rounds.agg(F.max(F.struct("version", "round")).alias("m")).first()["m"]
    return (int(last["version"]), int(last["round"])) if last else None


def open_index(spark: SparkSession, path: str, version: int | None = None, round: int | None = None, metric: str = "sq_l2") -> IvfIndex:
    """The last version and round, or the ones asked for."""
    last = _latest(spark, path)
    if last is None:
        raise ValueError(f"no index in {path}")
    if version is None:
        version = last[0]
    if round is None:
        round = _read(spark, path, "rounds").filter(F.col("version") == version).agg(F.max("round")).first()[0]
        if round is None:
            raise ValueError(f"no version {version} in {path}")
    return IvfIndex(spark, path, int(version), int(round), metric)


def _write_round(index: IvfIndex, rows: DataFrame) -> IvfIndex:
    """Write ``(id, vec, cid)`` as the index's round: the vectors first, what makes them count last."""
    where = f"version={index.version}/round={index.round}"
    # large cells are split over tasks and files, small ones share a task
    spread = rows.select("id", "vec", F.col("cid").cast("int").alias("cid")).hint("rebalance", F.col("cid"))
    spread.write.mode("overwrite").partitionBy("cid").parquet(f"{index.path}/cells/{where}")
    written = _read(index.spark, index.path, "cells").filter((F.col("version") == index.version) & (F.col("round") == index.round))
    sizes = written.groupBy("cid").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dim"))
    sizes.coalesce(1).write.mode("overwrite").parquet(f"{index.path}/rounds/{where}")
    return index


def _assigned(index: IvfIndex, df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("vec"))
    return knn.assign(rows, index.centroids, metric=index.metric, id_col="id", vec_col="vec").select("id", "vec", "cid")


def build_index(df: DataFrame, centroids: DataFrame, path: str, *, metric: str = "sq_l2", id_col="vec_id", vec_col="embedding") -> IvfIndex:
    """A new version with ``df`` as its round 0, in cells around ``centroids (cid, centroid)``.

    Rows without a vector are left out. An empty table makes an index without cells.
    """
    spark = df.sparkSession
    last = _latest(spark, path)
    index = IvfIndex(spark, path, last[0] + 1 if last else 0, 0, metric)
    centroids.select(F.col("cid").cast("bigint").alias("cid"), F.col("centroid").cast("array<double>").alias("centroid")).write.mode("overwrite").parquet(f"{path}/centroids/version={index.version}")
    rows = _assigned(index, df, id_col, vec_col)
    if rows.isEmpty():
        # a folder without rows has no cells to read
        raise ValueError("an index needs at least one vector")
    return _write_round(index, rows)


def append_round(index: IvfIndex, df: DataFrame, *, id_col="vec_id", vec_col="embedding") -> IvfIndex:
    """The index with the rows of ``df`` as its next round; only these are assigned and written.

    Rows whose id the index has already are left out, so a round may be handed over
    twice. Without new rows the index stays as it is.
    """
    rows = df.filter(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("vec"))
    fresh = rows.join(index.vectors.select("id"), "id", "left_anti")
    if fresh.isEmpty():
        return index
    _check_width(index, fresh)
    after = IvfIndex(index.spark, index.path, index.version, index.round + 1, index.metric)
    return _write_round(after, _assigned(after, fresh, "id", "vec"))


def _check_width(index: IvfIndex, rows: DataFrame) -> None:
    width, dim = rows.select(F.max(F.size("vec"))).first()[0], index.manifest.agg(F.max("dim")).first()[0]
    if dim is not None and width != dim:
        raise ValueError(f"vectors of {width} dimensions for an index of {dim}")


def refresh_index(
    index: IvfIndex, current: DataFrame, centroids: DataFrame | None = None, *, max_new_share: float = 0.3, id_col="vec_id", vec_col="embedding"
) -> IvfIndex:
    """The index over ``current``: its new rows appended where the rule of ``knn.ivf_refresh`` allows, else rebuilt.

    A rebuild takes ``centroids``, or the present ones, and makes a new version.
    """
    rows = current.filter(F.col(vec_col).isNotNull())
    width, dim = rows.select(F.max(F.size(vec_col))).first()[0], index.manifest.agg(F.max("dim")).first()[0]
    rule = knn.ivf_refresh(index.vectors.select("id"), rows.select(F.col(id_col).alias("id")), max_new_share=max_new_share, same_dim=width == dim)
    if rule.first()["reuse"]:
        return append_round(index, rows, id_col=id_col, vec_col=vec_col)
    return build_index(rows, index.centroids if centroids is None else centroids, index.path, metric=index.metric, id_col=id_col, vec_col=vec_col)


def compact(index: IvfIndex) -> IvfIndex:
    """A new version with all rounds seen as one, so that a cell is few files again; no vector is assigned anew."""
    after = IvfIndex(index.spark, index.path, _latest(index.spark, index.path)[0] + 1, 0, index.metric)
    index.centroids.write.mode("overwrite").parquet(f"{index.path}/centroids/version={after.version}")
    return _write_round(after, index.vectors.select("id", "vec", "cid"))


def probed_cells(index: IvfIndex, queries: DataFrame, nprobe: int, *, id_col="vec_id", vec_col="embedding") -> DataFrame:
    """The queries, once for each of the ``nprobe`` nearest cells that hold vectors, with ``cid``."""
    filled = index.centroids.join(F.broadcast(index.sizes().select("cid")), "cid", "left_semi")
    return knn.assign(queries.select(id_col, vec_col), filled, metric=index.metric, probes=nprobe, id_col=id_col, vec_col=vec_col)


def search(
    index: IvfIndex, queries: DataFrame, k: int, nprobe: int, *, metric: str | None = None, id_col="vec_id", vec_col="embedding",
    exclude_self: bool = False, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(query_id, rank, neighbor_id, dist)``: the k nearest vectors of the cells nearest to each query.

    Only the folders of probed cells are read: their numbers, at most as many as there
    are centres, go into the scan as a partition filter. Cells that hold nothing are not
    probed, so a query needs no other way.
    """
    probed = probed_cells(index, queries, nprobe, id_col=id_col, vec_col=vec_col).drop("cdist", "probe")
    wanted = sorted(r["cid"] for r in collect_bounded(probed.select("cid").distinct(), knn.CENTROID_BYTES // 8))
    base = index.vectors.filter(F.col("cid").isin(wanted)).select(F.col("id").alias(id_col), F.col("vec").alias(vec_col), F.col("cid").cast("bigint").alias("cid"))
    found = knn.candidates(
        probed, base, k, metric or index.metric, id_col=id_col, vec_col=vec_col, within="cid", exclude_self=exclude_self, block_rows=block_rows
    )
    return knn.merge_candidates(found, k)
