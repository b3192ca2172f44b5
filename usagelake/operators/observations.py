"""Projection of turns, sessions and captured calls to observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelake.functions.measure import KINDS, OBSERVATION_FIELDS, available, kind_of

# Observation vocabulary.
CHANNELS = ("gateway", "agent_telemetry", "session_transcript")
SCOPES = ("request", "turn", "session")
OUTCOMES = ("succeeded", "provider_error", "transport_failure", "canceled", "truncated", "unknown")
COMPLETENESS = ("complete", "partial", "unknown")
OUTCOME_OF = {
    "upstream_ok": "succeeded",
    "upstream_http_error": "provider_error",
    "transport_failure": "transport_failure",
    "client_canceled": "canceled",
    "stream_truncated": "truncated",
}
SCHEMA_VERSION = 1


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _measure(name: str, value: Column, kind: Column) -> list[Column]:
    return [value.alias(name), kind.alias(f"{name}_kind")]


def _shape(df: DataFrame, prefix: str, source: str, scope: str, usage: dict[str, tuple[Column, Column]],
           completeness: Column, session: Column) -> DataFrame:
    fields = []
    for name in OBSERVATION_FIELDS:
        value, kind = usage.get(name, (_none("long"), _none("string")))
        fields += _measure(name, value, kind)
    turn = scope == "turn"
    return df.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.concat(F.lit(f"{prefix}:{scope}:"), F.col("turn_id") if turn else session).alias("id"),
        F.lit("session_transcript").alias("channel"), F.lit(scope).alias("scope"), F.lit(source).alias("source"),
        session.alias("session_id"), (F.col("turn_id") if turn else _none("string")).alias("turn_id"),
        F.col("ts_us" if turn else "started_us").alias("started_us"), _none("long").alias("finished_us"),
        F.coalesce("model", F.lit("")).alias("model"),
        *fields, F.lit("unknown").alias("outcome"), completeness.alias("completeness"))


def from_counter_usage(df: DataFrame, scope: str, prefix: str = "codex") -> DataFrame:
    """Observations of a source whose input includes cached input."""
    both = available("input") & available("cached")
    fresh = F.col("input") - F.col("cached")
    usage = {
        "fresh_input": (F.when(both & (fresh >= 0), fresh),
                        F.when(both & (fresh >= 0), "derived").when(both, "unknown")),
        "cached_input": (F.col("cached"), kind_of("cached")),
        "total_input": (F.col("input"), kind_of("input")),
        "output": (F.col("output"), kind_of("output")),
        "reasoning_output": (F.col("reasoning"), kind_of("reasoning")),
        "total": (F.col("total"), kind_of("total")),
    }
    some = available("input") | available("cached") | available("output") | available("reasoning") | available("total")
    complete = F.when(~some, "unknown").when(
        available("input") & available("output") & available("total"), "complete").otherwise("partial")
    return _shape(df, prefix, prefix, scope, usage, complete, F.col("session_id"))


def from_message_usage(df: DataFrame, scope: str, prefix: str = "claude") -> DataFrame:
    """Observations of a source that reports fresh, cached and created input apart."""
    names = {"fresh_input": "input", "output": "output"}
    if scope == "turn":
        names |= {"cached_input": "billable_cache_read", "cache_creation_input": "billable_cache_write"}
    else:
        names |= {"cached_input": "cache_read", "cache_creation_input": "cache_write"}
    usage: dict[str, tuple[Column, Column]] = {}
    for field, column in names.items():
        good = available(column)
        if scope == "turn":
            good = good & (kind_of(column) == "measured")
        usage[field] = (
            F.when(good, F.col(column)),
            F.when(good, "measured" if scope == "turn" else "derived").when(kind_of(column).isNotNull(), "unknown"))
    whole = usage["fresh_input"][0] + usage["cached_input"][0] + usage["cache_creation_input"][0]
    total = whole + usage["output"][0]
    usage["total_input"] = (whole, F.when(whole.isNotNull(), "derived"))
    usage["total"] = (total, F.when(total.isNotNull(), "derived"))
    recorded = F.lit(False)
    for value, kind in usage.values():
        recorded = recorded | kind.isNotNull()
    complete = F.when(~recorded, "unknown").when(total.isNotNull(), "complete").otherwise("partial")
    return _shape(df, prefix, prefix, scope, usage, complete, F.col("session_id"))


def from_exchanges(exchanges: DataFrame) -> DataFrame:
    """Observations of captured model calls.  Expects the normalised usage columns."""
    calls = exchanges.where((F.col("kind") == "model") & (F.col("id") != "") & (F.col("profile") != ""))
    known = F.col("usage_source").isin("anthropic_messages", "openai_responses")
    messages = F.col("usage_source") == "anthropic_messages"
    present = {n: F.col(n).isNotNull() for n in ("input_tokens", "total_input_tokens", "output_tokens", "total_tokens",
                                                 "cache_read_input_tokens")}
    has_input = present["input_tokens"] | present["total_input_tokens"]
    fresh = F.when(messages, F.col("input_tokens")).when(
        known & has_input & present["cache_read_input_tokens"], F.col("obs_fresh"))
    total_input = (
        F.when(present["total_input_tokens"], F.col("total_input_tokens"))
        .when(messages & present["input_tokens"], F.col("obs_total_input"))
        .when(known & present["input_tokens"], F.col("input_tokens")))
    total = F.when(present["total_tokens"], F.col("total_tokens")).when(
        known & has_input & present["output_tokens"], F.col("obs_total"))
    usage = {
        "fresh_input": (fresh, "kind_fresh"),
        "cached_input": (F.when(known, F.col("cache_read_input_tokens")), "kind_cached"),
        "cache_creation_input": (F.when(messages, F.col("cache_creation_input_tokens")), "kind_cache_creation"),
        "total_input": (total_input, "kind_total_input"),
        "output": (F.col("output_tokens"), "kind_output"),
        "reasoning_output": (F.col("reasoning_output_tokens"), "kind_reasoning"),
        "total": (total, "kind_total"),
    }
    outcome = F.lit("unknown")
    for name, mapped in OUTCOME_OF.items():
        outcome = F.when(F.col("outcome") == name, mapped).otherwise(outcome)
    full = F.when(messages, present["input_tokens"]).when(known, has_input) & present["output_tokens"]
    completeness = (
        F.when(F.col("outcome") == "stream_truncated", "partial")
        .when(F.col("outcome").isin("upstream_http_error", "transport_failure", "client_canceled"), "complete")
        .when(F.col("outcome") == "upstream_ok", F.when(full, "complete").otherwise("partial"))
        .otherwise("unknown"))

    def optional(name: str) -> Column:
        return F.col(name) if name in calls.columns else _none("string")

    hint = F.coalesce(optional("source_hint"), F.lit(""))
    seen_model = F.coalesce(optional("response_model"), F.lit(""))
    return calls.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.concat_ws(":", F.lit("gateway"), "profile", "id").alias("id"),
        F.lit("gateway").alias("channel"), F.lit("request").alias("scope"),
        F.when(hint != "", hint).otherwise(F.col("profile")).alias("source"),
        F.col("id").alias("exchange_id"), optional("provider_request_id").alias("provider_request_id"),
        optional("response_object_id").alias("response_object_id"),
        optional("previous_response_id").alias("parent_response_object_id"),
        "started_us", _none("long").alias("finished_us"),
        F.when(seen_model != "", seen_model).otherwise(F.coalesce("model", F.lit(""))).alias("model"),
        *[c for name, (value, kind) in usage.items()
          for c in _measure(name, value, F.when(value.isNotNull(), F.col(kind)))],
        outcome.alias("outcome"), completeness.alias("completeness"))


def problems(observations: DataFrame) -> DataFrame:
    """Everything that makes an observation invalid, one row per problem."""

    def text(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(""))

    checks = [
        F.when(~F.coalesce(F.col("schema_version") == SCHEMA_VERSION, F.lit(False)), "unsupported schema version"),
        F.when(text("id") == "", "id is required"),
        F.when(~text("channel").isin(*CHANNELS), "invalid channel"),
        F.when(~text("scope").isin(*SCOPES), "invalid scope"),
        F.when(text("source") == "", "source is required"),
        F.when(~text("completeness").isin(*COMPLETENESS), "invalid completeness"),
        F.when(~text("outcome").isin(*OUTCOMES), "invalid outcome"),
        F.when(F.col("finished_us") < F.col("started_us"), "finishedAt precedes startedAt"),
    ]
    for name in OBSERVATION_FIELDS:
        kind, value = text(f"{name}_kind"), F.col(name)
        checks += [
            F.when((kind != "") & ~kind.isin(*KINDS), f"{name}: unrecognized measurement kind"),
            F.when(value.isNull() & kind.isin(*[k for k in KINDS if k != "unknown"]), f"{name}: kind requires a value"),
            F.when(value.isNotNull() & (kind == ""), f"{name}: value requires a kind"),
            F.when(value.isNotNull() & (kind == "unknown"), f"{name}: value requires a usable kind"),
        ]
    found = F.filter(F.array(*checks), lambda c: c.isNotNull())
    own = observations.select("id", F.explode(found).alias("problem"))
    repeated = observations.groupBy("id").agg(F.count("*").alias("_n")).where("_n > 1").select(
        "id", F.lit("duplicate observation id").alias("problem"))
    return own.unionByName(repeated)


def split_valid(observations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid observations, and the rejected ones with their problems."""
    bad = problems(observations)
    return observations.join(bad.select("id").distinct(), "id", "left_anti"), bad
