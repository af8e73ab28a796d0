"""Session settings the operators rely on, and stored intermediate results."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a skewed join is split even where that costs one more exchange
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # file contents cross to Python in small batches
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


# Folder of what a phase stores on its way.
_home: ContextVar[str | None] = ContextVar("home", default=None)


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else made."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build(app: str, cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session, for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
    )
    return configure(builder.getOrCreate())


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only on a local master."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    shared = shared or spark.sparkContext.getCheckpointDir()
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        shared = tempfile.mkdtemp(prefix="commitloom-")
        spark.sparkContext.setCheckpointDir(shared)
    return shared


def run_folder(spark: SparkSession) -> str:
    """Where this application keeps its intermediates, below the shared folder."""
    return f"{checkpoint_dir(spark)}/commitloom-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete this application's intermediates; results still to be read need them."""
    _delete(spark, spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark)))


def _delete(spark: SparkSession, folder) -> None:
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """Write a result to the shared folder and go on from the stored table.

    The lineage ends there, so a lost executor costs no replay; readers prune
    columns, and joins see the table's real size.
    """
    path = f"{_home.get() or run_folder(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(stored: DataFrame) -> None:
    """Delete a table of :func:`checkpoint` that no result still to be read needs."""
    spark = stored.sparkSession
    for folder in {file.rpartition("/")[0] for file in stored.inputFiles()}:
        _delete(spark, spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder)))


def phase(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """The result of ``make``, stored; all that it stored on the way is deleted, as are its shuffle files."""
    folder = f"{run_folder(spark)}/{uuid.uuid4().hex}"
    before = _home.set(folder)
    try:
        result = make()
    finally:
        _home.reset(before)
    stored = checkpoint(result)
    _delete(spark, spark._jvm.org.apache.hadoop.fs.Path(folder))
    free(spark)
    return stored


def free(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans nobody holds any more.

    It does so when the driver's JVM collects them, which may be long after; a job of
    several phases would keep every phase's files on the executors' disks to its end.
    """
    for _ in range(2):  # what Python lets go first reaches the JVM a moment later
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)
