"""Session helpers shared by operators: table access, lineage cuts, sizing.

Nothing here sets cluster-wide configuration; a session made elsewhere is used as it is.
"""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, app: str = "quillgraph") -> SparkSession:
    """A local session for tests and the bench."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("QUILL_DRIVER_MEMORY", "8g"))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; ``sf_dir`` holds a parquet file or folder for each."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a folder of our own only where it is unset and the master is local."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = _own_folder()
    return at


@cache
def _own_folder() -> str:
    """A folder for a local master that names none; it goes with the process."""
    at = tempfile.mkdtemp(prefix="quillgraph-checkpoints-")
    atexit.register(shutil.rmtree, at, ignore_errors=True)
    return at


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage by a reliable checkpoint in the shared folder: survives the loss of any executor.

    Where the session has spark.cleaner.referenceTracking.cleanCheckpoints, a checkpoint goes once nothing refers to it.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(checkpoint_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let shuffle files and checkpoints that nothing refers to go now, not when the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def scratch(spark: SparkSession) -> str:
    """A fresh folder beside the checkpoints, for files that a result is read from; it goes when the process ends."""
    at = f"{checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, at)
    return at


def _remove(spark: SparkSession, at: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the JVM is gone
        shutil.rmtree(at, ignore_errors=True)


def parts(spark: SparkSession) -> int:
    """Shuffle partitions of the session, the unit in which Python stages are spread out."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give executors this package for their Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    at = tempfile.mkdtemp(prefix="quillgraph-")
    atexit.register(shutil.rmtree, at, ignore_errors=True)
    sc.addPyFile(shutil.make_archive(os.path.join(at, "quillgraph-src"), "zip", root, "quillgraph"))
    _shipped.add(sc.applicationId)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Rows over at least as many partitions as there are cores, for stages of heavy work per row; a no-op on input of many splits."""
    want = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(max(want, parts(df.sparkSession)), *by)


def once_per(df: DataFrame, key: str) -> DataFrame:
    """One row per key, where keys are meant to be unique: only ids are shuffled, and rows only of keys that do repeat."""
    many = cut(df.groupBy(key).count().where("count > 1").select(key))
    if many.isEmpty():
        return df
    return df.join(many, key, "left_anti").unionByName(df.join(many, key, "left_semi").dropDuplicates([key]))
