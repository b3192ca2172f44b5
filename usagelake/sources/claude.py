"""Claude-shape transcripts: messages with their own usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelake.functions.ordered import BLOCK, carry, last_value, running_count, running_sum, lookup_join
from usagelake.functions.text import parse_time
from usagelake.operators import usage
from usagelake.session import cut
from usagelake.sources.jsonl import file_stem
from usagelake.sources.rawjson import content_facts
from usagelake.sources.records import get, integers_ok, objects_ok, parsed, strings_ok, text, typed
from usagelake.sources.transcripts import Transcripts, component, finish_components, place, text_facts, unreadable

SOURCE = "claude_session"
AGENT = "claude"
# Usage fields by the name used here.
USAGE_FIELDS = {
    "input": "input_tokens",
    "cache_read": "cache_read_input_tokens",
    "cache_write": "cache_creation_input_tokens",
    "output": "output_tokens",
}


def classify(lines: DataFrame) -> DataFrame:
    """Parse records and say which cannot be read; pull out the plain members."""
    records = lines.where("oversized OR raw <> ''").withColumn("v", parsed())
    shape = typed("")
    ok = (
        F.col("v").isNotNull() & (shape.startswith("OBJECT") | (shape == "VOID"))
        & strings_ok(".uuid", ".parentUuid", ".timestamp", ".type", ".message.id", ".message.role", ".message.model")
        & objects_ok(".message", ".message.usage")
        & integers_ok(*[f".message.usage.{f}" for f in USAGE_FIELDS.values()]))
    return records.withColumns({
        "readable": ~F.col("oversized") & F.coalesce(ok, F.lit(False)),
        "type": text(".type"), "uuid": text(".uuid"), "timestamp": text(".timestamp"),
        "message_id": text(".message.id"), "role": text(".message.role"), "model": text(".message.model"),
        "content_kind": typed(".message.content"),
        **{name: get(f".message.usage.{field}", "bigint") for name, field in USAGE_FIELDS.items()},
    })


def _reduce(records: DataFrame) -> DataFrame:
    """One slim row per record: flags, usage, and what is kept of its texts and blocks."""
    is_array = F.coalesce(F.col("content_kind").startswith("ARRAY"), F.lit(False))
    items = get(".message.content", "array<variant>")

    def sound(item: Column) -> Column:
        shape = F.schema_of_variant(item)
        ok = (shape == "VOID") | shape.startswith("OBJECT")
        for name in ("type", "id", "name", "tool_use_id"):
            inner = F.schema_of_variant(F.try_variant_get(item, f"$.{name}", "variant"))
            ok = ok & (inner.isNull() | inner.isin("STRING", "VOID"))
        return ok

    def field(item: Column, name: str) -> Column:
        return F.coalesce(F.try_variant_get(item, f"$.{name}", "string"), F.lit(""))

    def some(test) -> Column:
        return is_array & F.coalesce(F.exists(items, test), F.lit(False))

    has_tools = some(lambda i: field(i, "type").isin("tool_use", "tool_result"))
    # Blocks without text of their own may hold text further down.
    nested = some(lambda i: (field(i, "text") == "") & F.try_variant_get(i, "$.content", "variant").isNotNull())
    seen = records.where("readable").withColumns({
        "_sound": is_array & F.coalesce(F.forall(items, sound), F.lit(False)),
        "_facts": content_facts("message.content")(F.when(has_tools, F.col("raw")), F.when(nested, F.col("raw"))),
    })
    flat = F.array_join(F.transform(items, lambda i: field(i, "text")), "")
    body = F.coalesce(
        F.when(F.col("content_kind") == "STRING", text(".message.content")), F.col("_facts.deep.said"),
        F.when(is_array, flat), F.lit(""))

    def facts(item: Column, i: Column) -> Column:
        tool = F.get("_facts.tools", i)
        said = F.coalesce(tool["said"], F.lit(""))
        return F.struct(
            field(item, "type").alias("type"), field(item, "id").alias("id"), field(item, "name").alias("name"),
            field(item, "tool_use_id").alias("tool_use_id"), *text_facts(said), tool["size"].alias("size"),
            F.coalesce(tool["fingerprint"], F.lit("")).alias("fingerprint"))

    kept = [c for c in records.columns if c not in ("v", "raw", "content_kind")]
    slim = seen.withColumn("_body", body).select(
        *kept, *text_facts(F.col("_body")), F.when(F.col("_sound"), F.transform(items, facts)).alias("items"))
    return slim.unionByName(records.where("NOT readable").select(*kept), allowMissingColumns=True)


def read(lines: DataFrame, block: int = BLOCK) -> Transcripts:
    """Sessions, turns and components of Claude-shape files (one session per file)."""
    records = cut(_reduce(classify(lines)))
    good = records.where("readable")
    assistant = (F.col("type") == "assistant") & (F.col("role") == "assistant")
    synthetic = F.col("model") == usage.SYNTHETIC_MODEL
    has_usage = F.lit(False)
    for name in USAGE_FIELDS:
        has_usage = has_usage | F.col(name).isNotNull()
    bearing = assistant & ~synthetic & has_usage
    results = F.size(F.filter(F.coalesce("items", F.array()), lambda i: i["type"] == "tool_result"))
    marked = good.withColumns({"_assistant": assistant, "_bearing": bearing, "_results": F.when(
        F.col("items").isNotNull(), results).otherwise(0)})
    # The first record of a message id closes a turn; repeats close nothing.
    firsts = marked.where("_bearing AND message_id <> ''").groupBy("file", "message_id").agg(F.min("line").alias("_first"))
    joined = lookup_join(marked, firsts, ["file", "message_id"])
    closing = F.col("_bearing") & ((F.col("message_id") == "") | (F.col("line") == F.col("_first")))
    counts = (
        F.when(~F.col("_assistant"), F.col("role") != "")
        .otherwise(~(F.col("model") == usage.SYNTHETIC_MODEL) & (~F.col("_bearing") | closing)))
    state = joined.withColumns({"_closes": closing, "_counts": counts}).drop("_first")
    begins = state.where("_counts").groupBy("file").agg(F.min("line").alias("_history_from"))
    state = lookup_join(state, begins, ["file"])
    speaks = F.when(F.col("_assistant"), F.col("_counts")).otherwise(F.col("role") == "assistant")
    state = state.withColumns({
        # The first message of a file has no history before it to be part of.
        "_history": F.coalesce(speaks & (F.col("line") > F.col("_history_from")), F.lit(False)),
        "_user": ~F.col("_assistant") & (F.col("role") == "user"),
    })
    emitted = F.when(F.col("_user"), F.greatest(F.col("_results"), F.lit(1))).when(F.col("_history"), 1).otherwise(0)
    state = cut(state.withColumn("_emits", emitted.cast("long")))
    unread = unreadable(records, SOURCE)

    # Records without any id are named by how much was read before them.
    tally = state.select("file", "line", "_closes", "_counts", "_emits").unionByName(
        unread.select("file", "line", F.lit(False).alias("_closes"), F.lit(False).alias("_counts"),
                      F.lit(1).cast("long").alias("_emits")))
    run = carry(tally, ["file"], "line", {
        "_sent": running_sum(F.col("_emits")), "_turns": running_count(F.col("_closes")),
        "_spoken": running_count(F.col("_counts"))}, block)
    run = run.withColumn("_sent", F.coalesce("_sent", F.lit(0)))
    run = carry(run, ["file"], "line", {"_cut": last_value(F.when(F.col("_closes"), F.col("_sent")))}, block)
    position = F.coalesce("_turns", F.lit(0)) + F.col("_sent") - F.coalesce("_cut", F.lit(0)) + F.coalesce("_spoken", F.lit(0)) + 1
    numbered = state.join(run.select("file", "line", position.alias("_n")), ["file", "line"])
    rows = cut(numbered.withColumn("record", F.when(F.col("uuid") != "", F.col("uuid")).when(
        F.col("message_id") != "", F.col("message_id")).otherwise(
        F.concat(F.lit(f"{SOURCE}#record:"), F.col("_n").cast("string")))))

    # ------------------------------------------------------------- components
    line = F.col("line")
    prompts = rows.where("_user AND _results = 0").select(
        *component(F.lit("user_prompt"), SOURCE, F.col("record"), place(line, F.lit(1))))
    history = rows.where("_history").select(
        *component(F.lit("history"), SOURCE, F.col("record"), place(line, F.lit(1))))
    blocks = rows.where("items IS NOT NULL").select(
        "file", "line", "record", "role", "_user", F.posexplode("items").alias("_i", "_b")).select(
        "file", "line", "record", "role", "_user", "_i", "_b.*")
    outputs = blocks.where("_user AND type = 'tool_result'").select(*component(
        F.lit("tool_result"), SOURCE,
        F.concat(F.col("record"), F.lit("#tool_result:"), (F.col("_i") + 1).cast("string")),
        place(line, F.col("_i") + 1), completeness=F.lit("complete"), call_id=F.col("tool_use_id"), size=F.col("size")))
    components = unread.unionByName(prompts).unionByName(history).unionByName(outputs)
    calls = blocks.where("role = 'assistant' AND type = 'tool_use' AND id <> '' AND name <> ''").select(
        "file", place(line, F.col("_i")).alias("ord"), F.col("id").alias("call_id"), "name", "fingerprint")
    closes = rows.where("_closes").select("file", place(line, F.lit(0)).alias("ord"))

    # ------------------------------------------------------- turns, sessions
    messages = rows.where("_assistant").select(
        "file", line.alias("ord"), "message_id", "model", F.unix_micros(parse_time(F.col("timestamp"))).alias("ts_us"),
        *USAGE_FIELDS)
    kept = cut(usage.dedup_messages(usage.usage_bearing(messages), ["file"]))
    totals = usage.message_session_usage(kept, ["file"]).where("has_reported_usage")
    models = usage.session_model(messages, ["file"])
    spans = usage.session_span(good, ["file"], "line", "timestamp")
    files = records.groupBy("file").agg(F.max("mtime_us").alias("mtime_us"))
    sessions = totals.join(files, "file").join(spans, "file", "left").join(models, "file", "left").select(
        "file", F.lit(AGENT).alias("source"), file_stem().alias("session_id"), F.coalesce("model", F.lit("")).alias("model"),
        F.unix_micros(parse_time(F.col("started"))).alias("started_us"),
        F.coalesce(F.unix_micros(parse_time(F.col("updated"))), F.col("mtime_us")).alias("updated_us"),
        *[c for c in totals.columns if c != "file"])
    turns = usage.message_turns(kept, ["file"], "ord", block).drop("turn_id")
    turns = lookup_join(turns, sessions.select("file", "session_id"), ["file"], "inner").withColumns({
        "source": F.lit(AGENT),
        "turn_id": F.when(F.col("message_id") != "", F.col("message_id")).otherwise(F.concat_ws("#", "session_id", "sequence"))})
    finished = lookup_join(
        finish_components(components, closes, calls, block), sessions.select("file"), ["file"], "inner")
    return Transcripts(sessions, turns, finished)
