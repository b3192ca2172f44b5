"""Live captures into a table, one folder per profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from usagelake.sources.exchanges import SCHEMA


def capture_stream(spark: SparkSession, path: str, max_files: int = 10_000) -> DataFrame:
    """New capture files under ``path`` as a stream."""
    return (
        spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json*")
        .option("maxFilesPerTrigger", max_files).json(path))


def ingest(captures: DataFrame, table_path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append captures as Parquet by profile; a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumns({"_batch": F.lit(batch_id), "_profile": F.col("profile")})
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("_profile", "_batch").parquet(table_path))

    writer = captures.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()
