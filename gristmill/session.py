"""Session helpers: lineage cuts, table reads, and the bounds under which a side may be broadcast."""

from __future__ import annotations

import os
import pathlib
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession, functions as F

#: A side is broadcast only if it is known to have no more rows than this.
BROADCAST_ROWS = 200_000
#: Whether an execution deletes the shuffle files it wrote when it ends.
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a context."""
    sc = spark.sparkContext
    if getattr(sc, "_gristmill_shipped", False) or os.environ.get("GRISTMILL_NO_SHIP"):
        return
    sc._gristmill_shipped = True
    root = pathlib.Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="gristmill-"), "gristmill-package.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(archive)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a folder of our own only in local mode where none is set, as in tests; on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "gristmill-checkpoints")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write `df` once to the shared checkpoint folder and go on from there.

    Used where a result feeds several later steps: the work is done once, and a lost executor costs no recomputation. What was shuffled on the way
    is deleted once the result is written, since nothing reads it again.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    before = spark.conf.get(_FREED, None)
    spark.conf.set(_FREED, "true")
    try:
        # The setting holds for plans made under it.
        return df.select("*").checkpoint(eager=True)
    finally:
        if before is None:
            spark.conf.unset(_FREED)
        else:
            spark.conf.set(_FREED, before)


def broadcast_if_small(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only for a side whose row count is known to be small."""
    return F.broadcast(df) if rows <= most else df
