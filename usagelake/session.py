"""Session settings and durable lineage cuts."""

from __future__ import annotations

import gc
import os
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are planned for."""
    builder = SparkSession.builder.appName("usagelake")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Checkpoint files go when nothing refers to them any more.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        # Streams keep state per exchange; RocksDB keeps that off the heap.
        "spark.sql.streaming.stateStore.providerClass": (
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
        ),
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage.

    What earlier cuts have made needless goes first (``release``), so that a long job holds the files of a step or two.

    The folder is the one the cluster names in ``spark.checkpoint.dir``.  Only
    when a session has none (tests, a laptop) is one chosen here, and then only
    on a local master, where every executor sees the same disk.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if context.master.split("[")[0] != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="spark-usagelake-", dir=os.environ.get("TMPDIR"))
        context.setCheckpointDir(folder)
    release(spark)
    return df.checkpoint(eager=True)


def sizeless(df: DataFrame) -> DataFrame:
    """A cut ``df`` without the size that Spark hands down to it, for what is joined to itself again and again.

    That size is a product over all joins so far: it gets twice as many digits with each, until planning takes hours.
    """
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(df._jdf.toJavaRDD(), df._jdf.schema()), spark)


#: Seconds from one release to the next.
RELEASE_S = 10
_released = 0.0


def release(spark: SparkSession) -> None:
    """Let go of shuffle and checkpoint files that nothing refers to any more.

    Spark deletes them when the driver collects its garbage, which it otherwise does by memory or each half hour:
    files of all steps of a job would stay on the disks until its end.
    """
    global _released
    if time.monotonic() - _released < RELEASE_S:
        return
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    _released = time.monotonic()
