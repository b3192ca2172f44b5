"""Captured calls on disk: schema, scan, append, and removal of a profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The capture record.
USAGE = (
    "inputTokens bigint, cacheCreationInputTokens bigint, cacheReadInputTokens bigint, outputTokens bigint, "
    "reasoningOutputTokens bigint, totalInputTokens bigint, totalTokens bigint, source string"
)
CAPTURE = "struct<state: string, capturedBytes: bigint, totalBytes: bigint, limitBytes: bigint>"
COMPONENT = (
    "struct<kind: string, position: bigint, source: string, record: string, path: string, contentHash: string, "
    "observation: string, measurement: struct<value: bigint, kind: string>, toolCallId: string, toolName: string, "
    "contentBytes: bigint, completeness: string>"
)
METADATA = (
    "struct<anthropicMessages: struct<messages: array<struct<index: int, role: string, blocks: array<struct<index: int, "
    "type: string, toolUseId: string, toolResultToolUseId: string>>>>>, openaiResponses: struct<previousResponseId: string, "
    "functionCallIds: array<string>, functionCallOutputIds: array<string>, items: array<struct<index: int, type: string, "
    "itemId: string, callId: string, outputCallId: string>>>>"
)
SCHEMA = (
    "schemaVersion int, id string, profile string, source string, protocol string, startedAt timestamp, upstream string, "
    "model string, kind string, outcome string, "
    f"request struct<method: string, endpoint: string, bytes: bigint, bodyHash: string, capture: {CAPTURE}, "
    f"components: array<{COMPONENT}>, metadata: {METADATA}>, "
    f"response struct<status: int, providerRequestId: string, responseObjectId: string, model: string, latencyMs: bigint, "
    f"usage: struct<rawInput: bigint, cached: bigint, cacheCreation: bigint, totalInput: bigint, output: bigint, "
    f"reasoning: bigint, total: bigint, source: string, truncated: boolean>, "
    f"providerUsage: struct<{', '.join(f.replace(' ', ': ', 1) for f in USAGE.split(', '))}>, stream: boolean, "
    f"capture: {CAPTURE}, openaiResponses: struct<responseId: string, outputItemCallIDs: array<string>>>"
)


def read_captures(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Captured calls; a bad line fails the read, or with ``strict=False`` is kept apart.

    Partition columns of the layout (``profile=``) come back as columns.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json*")
    if strict:
        return reader.schema(SCHEMA).option("mode", "FAILFAST").json(path)
    return reader.schema(SCHEMA + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)


def in_start_order(captures: DataFrame, newest_first: bool = False) -> DataFrame:
    start = F.col("startedAt")
    return captures.orderBy(start.desc() if newest_first else start.asc(), "id")


def flatten(captures: DataFrame) -> DataFrame:
    """Captured calls with the flat usage columns the operators expect."""
    usage = "response.providerUsage"
    names = {
        "input_tokens": "inputTokens", "cache_creation_input_tokens": "cacheCreationInputTokens",
        "cache_read_input_tokens": "cacheReadInputTokens", "output_tokens": "outputTokens",
        "reasoning_output_tokens": "reasoningOutputTokens", "total_input_tokens": "totalInputTokens",
        "total_tokens": "totalTokens",
    }
    return captures.select(
        "id", "profile", F.coalesce("source", F.lit("")).alias("source_hint"), "protocol",
        F.unix_micros("startedAt").alias("started_us"), F.coalesce("model", F.lit("")).alias("model"),
        F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("outcome", F.lit("")).alias("outcome"),
        F.col("request.method").alias("method"), F.col("request.endpoint").alias("endpoint"),
        F.col("request.bytes").alias("payload_bytes"), F.col("response.status").alias("status"),
        F.col("response.providerRequestId").alias("provider_request_id"),
        F.col("response.responseObjectId").alias("response_object_id"), F.col("response.model").alias("response_model"),
        F.col("request.metadata.openaiResponses.previousResponseId").alias("previous_response_id"),
        F.when(F.col(usage).isNotNull(), F.coalesce(F.col(f"{usage}.source"), F.lit(""))).alias("usage_source"),
        *[F.col(f"{usage}.{field}").alias(name) for name, field in names.items()])


def components(captures: DataFrame) -> DataFrame:
    """Request components as rows."""
    return captures.select(F.col("id").alias("exchange_id"), "profile", F.explode("request.components").alias("c")).select(
        "exchange_id", "profile", "c.position", "c.kind", F.coalesce("c.path", F.lit("")).alias("path"),
        F.coalesce("c.contentHash", F.lit("")).alias("content_hash"), F.col("c.measurement.value").alias("tokens"),
        F.col("c.measurement.kind").alias("tokens_kind"))


def check_profile(profile: str) -> str:
    """A profile name that is safe as a folder name."""
    if not profile or profile in (".", "..") or any(c in profile for c in "/\\\0"):
        raise ValueError(f"invalid capture profile {profile!r}")
    return profile


def append_captures(captures: DataFrame, path: str) -> None:
    """Add captured calls as JSON lines, one folder per profile (the column stays in the rows)."""
    captures.withColumn("_profile", F.col("profile")).write.mode("append").partitionBy("_profile").json(path)


def purge_profile(spark: SparkSession, path: str, profile: str, journal: str | None = None) -> bool:
    """Remove one profile's captures and, below ``journal``, its journal of failures.

    Journals are laid out like captures, or are files named after the profile.  Doing it again changes nothing.
    True if anything was removed.
    """
    name = check_profile(profile)
    places = [f"{path}/_profile={name}"]
    if journal:
        places += [f"{journal}/_profile={name}", f"{journal}/{name}.jsonl"]
    gone = False
    for place in places:
        target = spark._jvm.org.apache.hadoop.fs.Path(place)
        gone = target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True) or gone
    return gone


def write_findings(findings: DataFrame, path: str) -> None:
    """Findings as JSON lines, without digests."""
    hidden = [c for c in ("content_hash", "tool_call_fingerprint") if c in findings.columns]
    findings.drop(*hidden).write.mode("overwrite").json(path)
