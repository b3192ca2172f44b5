"""Line-JSON files as numbered records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from usagelake.functions.ordered import top_per_key
from usagelake.session import cut

# Fixed value: larger records are reported, not read.
MAX_RECORD_BYTES = 64 * 1024 * 1024
# Splits whose sizes may be broadcast (about 150 bytes each); beyond it the
# join shuffles, and no split is larger than maxPartitionBytes.
BROADCAST_SPLITS = 200_000


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Session files below ``root`` from the listing alone: file, mtime_us, bytes.  No file is opened."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").load(root)
        .select(F.col("_metadata.file_path").alias("file"), F.unix_micros("modificationTime").alias("mtime_us"),
                F.col("length").alias("bytes"))
    )


def newest_files(files: DataFrame, n: int) -> DataFrame:
    """The ``n`` most recently changed files of a listing (or of lines); of equal times the lesser names."""
    listed = files.select("file", "mtime_us").distinct().withColumn("_all", F.lit(1))
    return top_per_key(listed, ["_all"], [F.col("mtime_us").desc(), F.col("file").asc()], n).select("file", "mtime_us")


def read_lines(spark: SparkSession, root: str, max_bytes: int = MAX_RECORD_BYTES, newest: int | None = None) -> DataFrame:
    """Records of all ``*.jsonl`` files below ``root``: file, line, raw, oversized, mtime_us.

    Lines are numbered from 1, blank ones included.  A file may be read in many
    splits; a line's number is the number of lines in the splits before its own
    plus its place there, so nothing but split sizes is ever ordered.  These are
    counted once, in a scan without values, and kept; the texts are read once.

    ``newest`` reads only so many files, the last changed ones, chosen from the listing;
    the others are not opened.  A record above Spark's 2 GB for a string fails the read.
    """
    texts = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").option("lineSep", "\n").text(root)
    if newest is not None:
        names = [r["file"] for r in newest_files(list_files(spark, root), newest).collect()]
        texts = texts.where(F.col("_metadata.file_path").isin(names))
    scanned = texts.select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"),
        F.unix_micros("_metadata.file_modification_time").alias("mtime_us"),
        F.monotonically_increasing_id().alias("_id"))
    splits = scanned.groupBy("file", "_start").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    splits = cut(splits)
    before = Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("file", "_start", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    if splits.limit(BROADCAST_SPLITS + 1).count() <= BROADCAST_SPLITS:
        offsets = F.broadcast(offsets)
    raw = F.rtrim(F.col("value"), F.lit("\r"))
    oversized = F.octet_length("value") > max_bytes
    return scanned.join(offsets, ["file", "_start"]).select(
        "file", (F.col("_offset") + F.col("_id") - F.col("_first") + 1).alias("line"),
        F.when(~oversized, raw).alias("raw"), oversized.alias("oversized"), "mtime_us")


def file_stem(path: str = "file"):
    """Name of a file without folder and extension."""
    return F.regexp_replace(F.substring_index(F.col(path), "/", -1), r"\.[^.]*$", "")
