"""Helpers that the training-data operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.  ``bytes.split()`` cuts at exactly these characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Only a local master without that setting (tests, a laptop) gets a folder chosen here.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="spark-llm-", dir=os.environ.get("TMPDIR"))
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def keep(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage: what follows reads files that outlive any executor, and Python passes run once.
    The files go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def dealt_rank(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rank", per_task: int = 20_000
) -> DataFrame:
    """Ranks 0, 1, 2, ... within each key, also where one key holds a third of all rows.

    A key's rows are dealt by the hash of ``order`` to so many buckets that a bucket has about ``per_task``
    rows; a row's rank is the size of the buckets before it plus its place in its own.  Rows alike in
    ``order`` may take each other's rank.  ``df`` is read three times and must be cheap to read.
    """
    largest = df.groupBy(*keys).agg(F.count("*").alias("_n")).agg(F.max("_n")).head()[0] or 0
    buckets = -(-largest // per_task)
    if buckets <= 1:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
        return df.withColumn(name, place.cast("long"))
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
        .withColumnsRenamed({k: f"_k_{k}" for k in keys} | {"_bucket": "_k_bucket"})
    )
    place = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)) - 1
    same: Column = F.col("_bucket") == F.col("_k_bucket")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return (
        dealt.withColumn("_place", place)
        .join(offsets, same)
        .withColumn(name, (F.col("_place") + F.col("_before")).cast("long"))
        .drop("_bucket", "_place", "_before", "_k_bucket", *(f"_k_{k}" for k in keys))
    )
