"""Codex-shape transcripts: cumulative counters, response items, events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelake.functions.measure import USAGE_METRICS
from usagelake.functions.ordered import BLOCK, lookup_join
from usagelake.functions.text import parse_time
from usagelake.operators import context, usage
from usagelake.session import cut
from usagelake.sources.jsonl import file_stem
from usagelake.sources.rawjson import freeform_fingerprint, member_facts, structured_fingerprint
from usagelake.sources.records import (
    block_text,
    get,
    integers_ok,
    objects_ok,
    parsed,
    strings_ok,
    text,
    typed,
)
from usagelake.sources.transcripts import Transcripts, component, finish_components, place, text_facts, unreadable

SOURCE = "codex_rollout"
AGENT = "codex"

# Record and payload types.
READ_TYPES = ("session_meta", "turn_context", "response_item", "event_msg")
CALLS = ("function_call", "custom_tool_call")
OUTPUTS = ("function_call_output", "custom_tool_call_output")
# Counters of a usage report, by the name used here.
COUNTER_FIELDS = {
    "input": "input_tokens",
    "cached": "cached_input_tokens",
    "output": "output_tokens",
    "reasoning": "reasoning_output_tokens",
    "total": "total_tokens",
}
REPORTS = (".payload.info.total_token_usage", ".payload.info.last_token_usage")


def classify(lines: DataFrame) -> DataFrame:
    """Parse records and say which cannot be read.

    A record that is not one JSON object, or that holds a member of the wrong
    type, is unreadable as a whole.
    """
    records = lines.where("oversized OR raw <> ''").withColumn("v", parsed())
    kind = text(".type")
    payload = typed(".payload")
    shape = typed("")
    envelope = F.col("v").isNotNull() & (shape.startswith("OBJECT") | (shape == "VOID")) & strings_ok(".type", ".timestamp")
    is_object = payload.startswith("OBJECT") | (payload == "VOID")
    counts = integers_ok(*[f"{r}.{f}" for r in REPORTS for f in COUNTER_FIELDS.values()])
    event = text(".payload.type")
    fits = (
        F.when(kind == "session_meta", strings_ok(".payload.id"))
        .when(kind == "turn_context", strings_ok(".payload.model"))
        .when(kind == "response_item", strings_ok(
            ".payload.type", ".payload.id", ".payload.role", ".payload.name", ".payload.call_id", ".payload.arguments"))
        .when(kind == "event_msg", strings_ok(".payload.type", ".payload.message") & (
            (event != "token_count") | (objects_ok(".payload.info", *REPORTS) & counts)))
        .otherwise(F.lit(True)))
    wanted = kind.isin(*READ_TYPES) & payload.isNotNull()
    readable = envelope & (~wanted | (is_object & fits))
    return records.withColumns({
        "envelope": F.coalesce(envelope, F.lit(False)),
        "readable": ~F.col("oversized") & F.coalesce(readable, F.lit(False)),
        "type": F.when(F.coalesce(wanted, F.lit(False)), kind).otherwise(""),
        "timestamp": text(".timestamp"), "item": event,
    })


def _reduce(records: DataFrame) -> DataFrame:
    """One slim row per record: everything later steps need, without its texts.

    The files are parsed once, here.  Raw text goes to Python only for the few
    records whose output or input is not a plain string.
    """
    kind, item = F.col("type"), F.col("item")
    message = (kind == "response_item") & (item == "message")
    prompt = (kind == "event_msg") & (item == "user_message")
    output = (kind == "response_item") & item.isin(*OUTPUTS)
    call = (kind == "response_item") & item.isin(*CALLS)
    output_kind, input_kind = typed(".payload.output"), typed(".payload.input")
    flagged = records.where("readable").withColumns({
        "_output": output, "_call": call,
        "_plain": F.coalesce(output & (output_kind == "STRING"), F.lit(False)),
        "_free": F.coalesce(call & (item == "custom_tool_call") & (input_kind == "STRING"), F.lit(False)),
        "_raw_output": F.coalesce(output & ~output_kind.isin("STRING", "VOID"), F.lit(False)),
        "_raw_input": F.coalesce(call & (item == "custom_tool_call") & ~input_kind.isin("STRING", "VOID"), F.lit(False)),
        "name": text(".payload.name"),
    })
    facts = member_facts(
        F.when(F.col("_raw_output") | F.col("_raw_input"), F.col("raw")),
        F.when(F.col("_raw_output"), "payload.output").otherwise("payload.input"))
    seen = flagged.withColumn("_facts", facts)
    arguments = F.when(F.col("_call"), F.when(item == "function_call", text(".payload.arguments")).otherwise(F.col("_facts.text")))
    body = (
        F.when(message, block_text(".payload.content")).when(prompt, text(".payload.message"))
        .when(F.col("_plain"), text(".payload.output")).when(F.col("_output"), F.coalesce("_facts.said", F.lit("")))
        .otherwise(""))
    seen = seen.withColumns({"_body": body, "_structured": structured_fingerprint("name", arguments)})
    role = text(".payload.role")
    component_kind = (
        F.when(prompt, "user_prompt").when(F.col("_output"), "tool_result")
        .when(message & role.isin("developer", "system"), "instructions").when(message & (role == "user"), "user_prompt")
        .when(message & (role == "assistant"), "history"))
    free = freeform_fingerprint(F.col("name"), text(".payload.input"))
    counter = (kind == "event_msg") & (item == "token_count")
    kept = seen.select(
        "file", "line", "mtime_us", "oversized", "readable", "envelope", "timestamp", "type", "item",
        component_kind.alias("component"), counter.alias("counter"), F.col("_call").alias("call"), "name",
        F.when(kind == "response_item", text(".payload.id")).otherwise("").alias("item_id"),
        text(".payload.call_id").alias("call_id"),
        F.when(kind == "session_meta", text(".payload.id")).alias("meta_id"),
        F.when(kind == "turn_context", text(".payload.model")).alias("meta_model"),
        *text_facts(F.col("_body")),
        F.when(F.col("_plain"), F.octet_length("_body").cast("long")).when(F.col("_output"), F.col("_facts.size"))
        .alias("content_bytes"),
        F.when(F.col("_free"), free).otherwise(F.col("_structured")).alias("fingerprint"),
        F.when(F.col("_call"), F.expr(
            "try_variant_get(try_parse_json(variant_get(v, '$.a[0].payload.arguments', 'string')), '$.cmd', 'string')")).alias("cmd"),
        *[F.when(counter, get(f"{REPORTS[0]}.{field}", "bigint")).alias(name) for name, field in COUNTER_FIELDS.items()])
    lost = records.where("NOT readable").select("file", "line", "mtime_us", "oversized", "readable", "envelope", "timestamp")
    return kept.unionByName(lost, allowMissingColumns=True)


def read(lines: DataFrame, block: int = BLOCK) -> Transcripts:
    """Sessions, turns and components of Codex-shape files (one session per file)."""
    records = cut(_reduce(classify(lines)))
    line = F.col("line")

    # -------------------------------------------------------------- counters
    zero = F.lit(0).cast("long")
    counters = records.where("counter").select(
        "file", line.alias("ord"), F.unix_micros(parse_time(F.col("timestamp"))).alias("ts_us"),
        *[F.col(n) if n == "reasoning" else F.coalesce(n, zero).alias(n) for n in COUNTER_FIELDS])

    # ------------------------------------------------------------- components
    by_line = F.concat(F.lit(f"{SOURCE}#line:"), line.cast("string"))
    is_item = F.col("type") == "response_item"
    record = F.when(is_item & (F.col("item_id") != ""), F.col("item_id")).when(
        is_item & (F.col("call_id") != ""), F.col("call_id")).otherwise(by_line)
    result = F.col("component") == "tool_result"
    told = records.where("component IS NOT NULL").select(*component(
        F.col("component"), SOURCE, record, place(line, F.lit(1)), completeness=F.when(result, "complete"),
        call_id=F.when(result, F.col("call_id")).otherwise(""), size=F.when(result, F.col("content_bytes"))))
    commands = records.where("call AND cmd <> ''").select(
        "file", "line", record.alias("record"), F.col("name").alias("tool_name"), "cmd")
    reads = context.read_files(commands).select(*component(
        F.col("kind"), SOURCE, F.col("record"), place(line, F.col("position")), measured=False, path=F.col("path")))
    components = unreadable(records, SOURCE).unionByName(told).unionByName(reads)
    calls = records.where("call AND name <> ''").select(
        "file", place(line, F.lit(0)).alias("ord"), "name", F.coalesce("fingerprint", F.lit("")).alias("fingerprint"),
        F.explode(F.array_distinct(F.filter(F.array("call_id", "item_id"), lambda k: k != ""))).alias("call_id"))
    closes = counters.select("file", place(F.col("ord"), F.lit(0)).alias("ord"))

    # --------------------------------------------------------------- sessions
    span = F.when(F.col("envelope") & (F.col("timestamp") != ""), line)
    totals = usage.counter_session_usage(counters, ["file"])
    # All facts of a file in one aggregate; the counters add one row per file.
    named = records.groupBy("file").agg(
        F.max("mtime_us").alias("mtime_us"),
        F.min_by("timestamp", span).alias("started"), F.max_by("timestamp", span).alias("updated"),
        F.max_by("meta_id", F.when(F.col("meta_id") != "", line)).alias("_id"),
        F.max_by("meta_model", F.when(F.col("meta_model") != "", line)).alias("model"))
    sessions = named.join(totals, "file", "left").select(
        "file", F.lit(AGENT).alias("source"),
        F.when(F.coalesce("_id", F.lit("")) != "", F.col("_id")).otherwise(file_stem()).alias("session_id"),
        F.coalesce("model", F.lit("")).alias("model"),
        F.unix_micros(parse_time(F.col("started"))).alias("started_us"),
        F.coalesce(F.unix_micros(parse_time(F.col("updated"))), F.col("mtime_us")).alias("updated_us"),
        *[c for m in USAGE_METRICS for c in (F.col(m), F.col(f"{m}_kind"))])
    # One session row per file meets many turns: spread them.
    turns = lookup_join(
        usage.counter_deltas(counters, ["file"], "ord", block), sessions.select("file", "session_id", "model"), ["file"],
        "inner",
    ).withColumns({
        "source": F.lit(AGENT), "turn_id": F.concat_ws("#", "session_id", "sequence"),
        "billable_input": F.col("input"), "billable_input_kind": F.col("input_kind"),
        "billable_cache_read": F.col("cached"), "billable_cache_read_kind": F.col("cached_kind"),
        "billable_cache_write": F.lit(None).cast("long"), "billable_cache_write_kind": F.lit(None).cast("string"),
        "billable_output": F.col("output"), "billable_output_kind": F.col("output_kind")})
    return Transcripts(sessions, turns, finish_components(components, closes, calls, block))
