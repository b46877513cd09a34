"""Session settings the operators are written for."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "curvine", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow on; ``conf`` entries override."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # the skew split may add a shuffle; a hot key costs more than that
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # k-th neighbour queries ask for ranks above the default of 1000
        "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once per application, so that tasks can import it anywhere.

    Not needed where the package is installed on the cluster, and harmless there.
    """
    sc = spark.sparkContext
    if not getattr(sc, "_curvine_shipped", False):
        root = os.path.dirname(os.path.abspath(__file__))
        # the driver serves the archive to the executors while the application runs
        archive = os.path.join(tempfile.mkdtemp(prefix="curvine-code-"), "curvine.zip")
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
            for folder, _, files in os.walk(root):
                for name in sorted(files):
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        out.write(path, os.path.join("curvine", os.path.relpath(path, root)))
        sc.addPyFile(archive)
        sc._curvine_shipped = True
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; a local run without one gets a fresh folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="curvine-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


# With this setting on, a finished query removes its shuffle files.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is planned and run inside removes its shuffle files at its end."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which survives lost executors.

    The shuffles that led to it are removed at once, not when the driver next collects its garbage.
    """
    ensure_checkpoint_dir(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        # the setting holds for frames made under it
        return df.select("*").checkpoint(eager=True)
