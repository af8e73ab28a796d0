"""What the operators of this package share: inputs, stored tables, worker state."""

from __future__ import annotations

import ctypes
import gc
import pickle
import sys
import time
import types
import uuid

from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from commitloom import session

#: rows of one Arrow batch; a batch of ordinary texts is then a few MB
BATCH_ROWS = 500


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings the operators rely on; worker code travels by value."""
    cloudpickle.register_pickle_by_value(sys.modules["commitloom"])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def store(df: DataFrame, **options: str) -> DataFrame:
    """Write to the shared checkpoint folder and go on from the written table."""
    path = new_folder(df.sparkSession)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans nobody holds any more.

    It does so when the driver's JVM collects them, which a driver that makes
    little garbage does rarely; a job of several phases would keep every phase's
    files on the executors' disks to its end.
    """
    for _ in range(2):  # what Python lets go first reaches the JVM a moment later
        release()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def release() -> None:
    """Give memory that Python no longer uses back to the system, where the C library keeps it."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def new_folder(spark: SparkSession) -> str:
    return f"{session.run_folder(spark)}/llm-{uuid.uuid4().hex}"


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def worker_state(name: str, make):
    """A value kept for the life of a Python worker, over all its tasks.

    Functions reach the workers by value and bring fresh module globals with
    every task, so what should outlive a task hangs on a module of its own.
    """
    home = sys.modules.setdefault("_commitloom_worker", types.ModuleType("_commitloom_worker"))
    if not hasattr(home, name):
        setattr(home, name, make())
    return getattr(home, name)


def send(spark: SparkSession, value) -> Broadcast:
    """Broadcast a value of this package's classes together with their code."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(sent: Broadcast):
    """What was sent, unpacked; once a task."""
    return pickle.loads(sent.value)


def binary(column):
    """An Arrow string column as Python byte strings; null is empty."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [value or b"" for value in column.cast(kind).to_pylist()]
