"""Session settings and the shared folder for cut lineage and staged tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def prepare(spark: SparkSession) -> SparkSession:
    """Pin what results depend on: UTC timestamps, run-time re-planning and skew splitting."""
    for key, value in (
        ("spark.sql.session.timeZone", "UTC"),
        ("spark.sql.adaptive.enabled", "true"),
        ("spark.sql.adaptive.skewJoin.enabled", "true"),
    ):
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below the one that every executor sees; it is deleted when the application ends.

    A local session without a shared folder gets a temporary one, a cluster session without it is refused.
    """
    sc = spark.sparkContext
    configured = spark.conf.get(CHECKPOINT_KEY, None) or sc.getConf().get(CHECKPOINT_KEY)
    if not configured:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder all executors can reach")
        configured = _temporary(sc)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(configured)
    folder = f"{configured.rstrip('/')}/newsflow-{sc.applicationId}"
    if folder not in _made:
        target = sc._jvm.org.apache.hadoop.fs.Path(folder)
        files = target.getFileSystem(sc._jsc.hadoopConfiguration())
        files.mkdirs(target)
        files.deleteOnExit(target)
        _made.add(folder)
    return folder


_made: set[str] = set()


def _temporary(sc) -> str:
    if not sc.getCheckpointDir():
        folder = tempfile.mkdtemp(prefix="newsflow-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage through a written table in the shared folder.

    Unlike a row checkpoint the table keeps column pruning and a known size, so later joins can be
    planned as broadcasts, and losing executors loses nothing.
    """
    spark = df.sparkSession
    path = fresh_path(spark, "cut")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
