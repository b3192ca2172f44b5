"""Usage of streamed responses: the last value of each field wins.

The fold is the same in batch and in a stream.  Batch: plain aggregates, combined
before the shuffle.  Stream: per exchange a small state, with a timer for
responses that never end.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from usagelake.functions.ordered import lookup_join
from usagelake.operators.gateway import MESSAGES, RESPONSES
from usagelake.sources.records import get, integers_ok, objects_ok, parsed, strings_ok, text, typed

# The state function travels with the job, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Largest event that is read, and the events that end a response.
MAX_EVENT_BYTES = 1024 * 1024
ENDS = ("response.completed", "response.done", "response.usage")

FIELDS = (
    "input_tokens",
    "cache_creation_input_tokens",
    "cache_read_input_tokens",
    "output_tokens",
    "reasoning_output_tokens",
    "total_tokens",
)
# Fields that a present but empty details object sets back to missing.
DETAILS = {"cache_read_input_tokens": "has_input_details", "reasoning_output_tokens": "has_output_details"}


def _may_say() -> Column:
    """False only for events that say nothing: most of a stream is text, and need not be parsed.

    Names may be written with escapes, so a payload with a backslash may say anything.
    """
    def holds(*parts: str) -> Column:
        found = F.contains("payload", F.lit("\\"))
        for part in parts:
            found = found | F.contains("payload", F.lit(part))
        return found

    return F.when(F.col("protocol") == MESSAGES, holds("message_")).when(
        F.col("protocol") == RESPONSES, holds('"usage"', '"response"', *ENDS)).otherwise(False)


def read_frames(frames: DataFrame) -> DataFrame:
    """What each event says: usage fields, end, response id.  Other events say nothing.

    ``frames`` has exchange_id, seq, protocol and payload.
    """
    read = frames.withColumns({
        "oversized": F.octet_length("payload") > MAX_EVENT_BYTES,
        "v": F.when((F.octet_length("payload") <= MAX_EVENT_BYTES) & _may_say(), parsed("payload"))})
    messages = F.col("protocol") == MESSAGES
    kind = text(".type")
    start, delta, stop = kind == "message_start", kind == "message_delta", kind == "message_stop"
    names = ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")
    sound_messages = strings_ok(".type", ".message.id") & objects_ok(".message", ".message.usage", ".usage") & integers_ok(
        *[f".usage.{n}" for n in names], *[f".message.usage.{n}" for n in names])
    sound_responses = strings_ok(".type", ".response.id") & objects_ok(
        ".response", ".usage", ".usage.input_tokens_details", ".usage.output_tokens_details") & integers_ok(
        ".usage.input_tokens", ".usage.output_tokens", ".usage.total_tokens",
        ".usage.input_tokens_details.cached_tokens", ".usage.output_tokens_details.reasoning_tokens")
    m = messages & F.coalesce(sound_messages, F.lit(False)) & (start | delta | stop)
    r = (F.col("protocol") == RESPONSES) & F.coalesce(sound_responses, F.lit(False))

    def from_messages(name: str) -> Column:
        own = get(f".usage.{name}", "bigint")
        return F.when(m & start, F.coalesce(own, get(f".message.usage.{name}", "bigint"))).when(m & delta, own)

    def from_responses(path: str) -> Column:
        return F.when(r, get(f".usage.{path}", "bigint"))

    def present(path: str) -> Column:
        return F.coalesce(r & typed(f".usage.{path}").startswith("OBJECT"), F.lit(False))

    fields = {
        "input_tokens": F.coalesce(from_messages("input_tokens"), from_responses("input_tokens")),
        "cache_creation_input_tokens": from_messages("cache_creation_input_tokens"),
        "cache_read_input_tokens": F.coalesce(
            from_messages("cache_read_input_tokens"), from_responses("input_tokens_details.cached_tokens")),
        "output_tokens": F.coalesce(from_messages("output_tokens"), from_responses("output_tokens")),
        "reasoning_output_tokens": from_responses("output_tokens_details.reasoning_tokens"),
        "total_tokens": from_responses("total_tokens"),
    }
    named = F.when(m & start, text(".message.id")).when(r, text(".response.id"))
    return read.select(
        "exchange_id", "seq", "protocol", "oversized",
        *[value.alias(name) for name, value in fields.items()],
        present("input_tokens_details").alias("has_input_details"),
        present("output_tokens_details").alias("has_output_details"),
        ((m & stop) | (r & kind.isin(*ENDS))).alias("ends"),
        F.when(named != "", named).alias("response_id"))


def _result(folded: DataFrame, *more: str) -> DataFrame:
    any_field = F.coalesce(*[F.col(f) for f in FIELDS]).isNotNull()
    cut_off = ~F.col("terminal") & (F.col("protocol") == MESSAGES)
    return folded.select(
        "exchange_id", "protocol", *FIELDS, F.when(any_field, F.col("protocol")).alias("usage_source"),
        F.coalesce("response_id", F.lit("")).alias("response_object_id"), "terminal",
        F.when(cut_off, "stream_truncated").otherwise("upstream_ok").alias("outcome"), *more)


def fold_frames(frames: DataFrame) -> DataFrame:
    """One row per exchange from all its stream events."""
    read = read_frames(frames)
    # Nothing after an event that is too large is read.
    limits = read.where("oversized").groupBy("exchange_id").agg(F.min("seq").alias("_limit"))
    kept = lookup_join(read, limits, ["exchange_id"]).withColumn(
        "_read", F.col("_limit").isNull() | (F.col("seq") < F.col("_limit")))

    def last(name: str) -> Column:
        said = F.col(name).isNotNull()
        if name in DETAILS:
            said = said | F.col(DETAILS[name])
        return F.max_by(F.struct(F.col(name).alias("x")), F.when(F.col("_read") & said, F.col("seq")))["x"].alias(name)

    folded = kept.groupBy("exchange_id", "protocol").agg(
        *[last(f) for f in FIELDS],
        F.max_by("response_id", F.when(F.col("_read") & F.col("response_id").isNotNull(), F.col("seq"))).alias("response_id"),
        F.bool_or(F.col("_read") & F.col("ends")).alias("terminal"))
    return _result(folded)


_STATE = (
    "values array<bigint>, places array<bigint>, response_id string, named_at bigint, terminal boolean, stop bigint, "
    "final boolean")
_OUT = ", ".join([
    "exchange_id string", "protocol string", *[f"{f} bigint" for f in FIELDS], "response_id string", "terminal boolean",
    "final boolean"])
#: How many timeouts a finished exchange is remembered, so that late events do not open it again.
REMEMBERED = 6
_NEVER = 2**63 - 1


def fold_stream(frames: DataFrame, timeout_ms: int = 600_000) -> DataFrame:
    """The same fold over a stream of events; one updated row per exchange and trigger.

    The place of an event is its ``seq``, not when it arrives: the state keeps where each value was said, so any
    order inside a trigger and over triggers gives the same row.  Only an event that is too large has to come before
    those it cuts off.  A row is final when the response ended or nothing came for ``timeout_ms``; what comes after
    that timeout is ignored.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        empty = ([None] * len(FIELDS), [None] * len(FIELDS), None, None, False, _NEVER, False)
        values, places, named, named_at, ended, stop, final = state.get if state.exists else empty
        if state.hasTimedOut:
            if final:
                state.remove()
                return
            state.update((values, places, named, named_at, ended, stop, True))
            state.setTimeoutDuration(REMEMBERED * timeout_ms)
            yield _row(key, values, named, ended, True)
            return
        values, places, changed = list(values), list(places), False
        for batch in batches:
            if final:
                continue
            changed = True
            large = batch.loc[batch["oversized"].astype(bool), "seq"]
            stop = min(stop, int(large.min())) if len(large) else stop
            read = batch[batch["seq"] < stop]
            seqs = read["seq"].to_numpy()
            for place, name in enumerate(FIELDS):
                said = read[name].notna().to_numpy()
                if name in DETAILS:
                    said = said | read[DETAILS[name]].to_numpy(dtype=bool)
                if said.any():
                    at = int(seqs[said].max())
                    if places[place] is None or at >= places[place]:
                        value = read[name].to_numpy(dtype=object)[said][seqs[said].argmax()]
                        values[place], places[place] = None if pd.isna(value) else int(value), at
            known = read["response_id"].notna().to_numpy()
            if known.any():
                at = int(seqs[known].max())
                if named_at is None or at >= named_at:
                    named, named_at = read["response_id"].to_numpy(dtype=object)[known][seqs[known].argmax()], at
            ended = ended or bool(read["ends"].astype(bool).any())
        state.update((values, places, named, named_at, ended, stop, final))
        state.setTimeoutDuration(REMEMBERED * timeout_ms if final else timeout_ms)
        if changed:
            yield _row(key, values, named, ended, ended)

    folded = read_frames(frames).groupBy("exchange_id", "protocol").applyInPandasWithState(
        fold, _OUT, _STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)
    return _result(folded, "final")


def _row(key: tuple, values: list, named: str | None, ended: bool, final: bool) -> pd.DataFrame:
    row = {name: None if value is None or pd.isna(value) else int(value) for name, value in zip(FIELDS, values)}
    frame = pd.DataFrame([{"exchange_id": key[0], "protocol": key[1], **row, "response_id": named, "terminal": ended,
                           "final": final}])
    return frame.astype({f: "Int64" for f in FIELDS})
