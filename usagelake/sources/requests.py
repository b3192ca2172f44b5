"""Request and response bodies as components, metadata, identities and usage.

A body is at most a few MiB, so its parts are worked out within the row; only
then do they become rows of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelake.operators.gateway import MESSAGES, RESPONSES, USAGE_COLUMNS, dedup_request_components
from usagelake.sources.rawjson import request_facts
from usagelake.sources.records import get, integers_ok, objects_ok, parsed, strings_ok, text, typed
from usagelake.sources.transcripts import text_facts

# Fixed value: position step between messages of a request.
STEP = 1000

PART_COLUMNS = ("position", "kind", "body", "path", "record", "tool_call_id", "tool_name", "content_bytes", "completeness")


def _field(item: Column, name: str) -> Column:
    return F.coalesce(F.try_variant_get(item, f"$.{name}", "string"), F.lit(""))


def _plain(item: Column, *names: str) -> Column:
    """The block is an object and the named members are strings, null or absent."""
    shape = F.schema_of_variant(item)
    ok = shape.startswith("OBJECT") | (shape == "VOID")
    for name in names:
        inner = F.schema_of_variant(F.try_variant_get(item, f"$.{name}", "variant"))
        ok = ok & (inner.isNull() | inner.isin("STRING", "VOID"))
    return ok


def _part(position: Column, kind: Column, body: Column, path: Column | None = None, record: Column | None = None,
          call: Column | None = None, name: Column | None = None, size: Column | None = None,
          completeness: Column | None = None) -> Column:
    blank = F.lit("")
    return F.struct(
        position.cast("long").alias("position"), kind.alias("kind"), F.coalesce(body, blank).alias("body"),
        (blank if path is None else path).alias("path"), (blank if record is None else record).alias("record"),
        (blank if call is None else call).alias("tool_call_id"), F.coalesce(blank if name is None else name, blank).alias("tool_name"),
        (F.lit(None) if size is None else size).cast("long").alias("content_bytes"),
        (F.lit(None) if completeness is None else completeness).cast("string").alias("completeness"))


def _none_of(part: Column) -> Column:
    return F.filter(F.array(part), lambda p: F.lit(False))


def _last_name(calls: Column, wanted: Column) -> Column:
    """Name given by the last declared call with that id."""
    return F.element_at(F.concat(F.array(F.lit("")), F.transform(
        F.filter(calls, lambda c: c["id"] == wanted), lambda c: c["name"])), -1)


def _message_parts() -> tuple[Column, Column, Column, Column]:
    messages = F.coalesce(get(".messages", "array<variant>"), F.array())
    blocks_of = lambda m: F.coalesce(F.try_variant_get(m, "$.content", "array<variant>"), F.array())
    declared = F.flatten(F.transform(messages, lambda m: F.transform(
        F.filter(blocks_of(m), lambda b: (_field(b, "type") == "tool_use") & (_field(b, "id") != "") & (_field(b, "name") != "")),
        lambda b: F.struct(_field(b, "id").alias("id"), _field(b, "name").alias("name")))))
    latest = F.array_max(F.transform(messages, lambda m, i: F.when(_field(m, "role") == "user", i)))
    return messages, declared, latest, F.size(messages)


def _one_message(m: Column, i: Column) -> Column:
    role = _field(m, "role")
    text_kind = F.when((role == "user") & (i == F.col("_latest")), "other").otherwise("history")
    start = F.lit(STEP) + i * STEP
    kind = F.schema_of_variant(F.try_variant_get(m, "$.content", "variant"))
    where = F.concat(F.lit("messages["), i.cast("string"), F.lit("].content"))
    blocks = F.try_variant_get(m, "$.content", "array<variant>")

    def one(b: Column, j: Column) -> Column:
        declared_type = _field(b, "type")
        fact = F.get(F.get("_facts.blocks", i), j)
        path = F.coalesce(*[F.when(_field(b, n) != "", _field(b, n)) for n in ("path", "file", "filename", "name")], F.lit(""))
        own = _field(b, "text")
        deep = F.when(own != "", own).otherwise(fact["said"])
        is_text, is_result, is_use = declared_type.isin("", "text"), declared_type == "tool_result", declared_type == "tool_use"
        part_kind = (
            F.when(is_text, F.when(path != "", "file").otherwise(text_kind)).when(is_result, "tool_result")
            .when(is_use, "history").when((path != "") & (F.coalesce(deep, F.lit("")) != ""), "file").otherwise("other"))
        body = F.when(is_text, own).when(is_result, fact["said"]).when(is_use, fact["written"]).otherwise(deep)
        call = F.when(is_result, _field(b, "tool_use_id")).when(is_use, _field(b, "id")).otherwise("")
        name = F.when(is_result, _last_name(F.col("_declared"), _field(b, "tool_use_id"))).when(is_use, _field(b, "name"))
        part = _part(
            start + j, part_kind, body, F.when(is_result | is_use, "").otherwise(path),
            F.concat(where, F.lit("["), j.cast("string"), F.lit("]")), call, name, F.when(is_result, fact["size"]),
            F.when(is_result, "complete"))
        sound = _plain(b, "type", "id", "text", "tool_use_id", "path", "file", "name", "filename")
        return F.when(sound, part)

    whole = _part(start, text_kind, F.try_variant_get(m, "$.content", "string"), record=where)
    listed = F.filter(F.transform(blocks, one), lambda p: p.isNotNull())
    parts = F.when(kind == "STRING", F.array(whole)).when(kind.startswith("ARRAY"), listed).otherwise(_none_of(whole))
    return F.when(role.isin("user", "assistant"), F.coalesce(parts, _none_of(whole))).otherwise(_none_of(whole))


def _item_parts() -> Column:
    items = F.coalesce(get(".input", "array<variant>"), F.array())

    def said(item: Column) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(item, "$.content", "variant"))
        inner = F.try_variant_get(item, "$.content", "array<variant>")
        joined = F.array_join(F.transform(inner, lambda b: _field(b, "content")), "")
        sound = F.coalesce(F.forall(inner, lambda b: _plain(b, "content")), F.lit(False))
        return F.when(kind == "STRING", F.try_variant_get(item, "$.content", "string")).when(
            kind.startswith("ARRAY") & sound, joined).otherwise("")

    def one(item: Column, i: Column) -> Column:
        role, kind = _field(item, "role"), _field(item, "type")
        call = F.when(_field(item, "call_id") != "", _field(item, "call_id")).otherwise(_field(item, "callId"))
        fact = F.get("_facts.outputs", i)
        spoken = (
            F.when(role == "user", "user_prompt").when(role.isin("system", "developer"), "instructions")
            .when(role == "assistant", "history"))
        result = kind == "function_call_output"
        part = _part(
            F.lit(0), F.when(result, "tool_result").otherwise(spoken), F.when(result, fact["said"]).otherwise(said(item)),
            call=F.when(result, call).otherwise(""), name=F.when(result, _last_name(F.col("_declared"), call)),
            size=F.when(result, fact["size"]), completeness=F.when(result, "complete"))
        return F.when(_plain(item, "type", "role", "call_id", "callId") & (result | spoken.isNotNull()), part)

    return F.filter(F.transform(items, one), lambda p: p.isNotNull())


def request_components(bodies: DataFrame) -> DataFrame:
    """Components of captured request bodies: exchange_id, protocol, body.

    Bodies that were cut off are not parsed; filter on the capture state first.
    """
    read = bodies.withColumns({"v": parsed("body"), "_facts": request_facts("body")})
    messages = F.col("protocol") == MESSAGES
    roles = F.coalesce(F.forall(F.coalesce(get(".messages", "array<variant>"), F.array()), lambda m: _plain(m, "role")), F.lit(True))
    lists = (typed(".messages").startswith("ARRAY") | typed(".messages").isNull() | (typed(".messages") == "VOID")) \
        & (typed(".tools").startswith("ARRAY") | typed(".tools").isNull() | (typed(".tools") == "VOID"))
    items_ok = typed(".input").startswith("ARRAY") | typed(".input").isNull() | (typed(".input") == "VOID")
    tools = F.coalesce(get(".tools", "array<variant>"), F.array())
    message_list, declared, latest, count = _message_parts()

    # ------------------------------------------------- the messages protocol
    first = read.where(messages & F.coalesce(lists & strings_ok(".model") & roles, F.lit(False))).withColumns(
        {"_declared": declared, "_latest": latest, "_count": count, "_tools": F.size(tools)})
    system = _part(F.lit(0), F.lit("instructions"), F.col("_facts.system"), record=F.lit("system"))
    toolset = _part(STEP + F.col("_count") * STEP, F.lit("tool_definition"), F.col("_facts.tools"), record=F.lit("tools"))
    listed = F.concat(
        F.filter(F.array(system), lambda p: p["body"] != ""),
        F.flatten(F.transform(message_list, _one_message)),
        F.when(F.col("_tools") > 0, F.array(toolset)).otherwise(_none_of(toolset)))
    parts = first.select("exchange_id", "protocol", F.explode(listed).alias("p"))

    # ------------------------------------------------ the responses protocol
    items = F.coalesce(get(".input", "array<variant>"), F.array())
    calls = F.transform(
        F.filter(items, lambda i: (_field(i, "type") == "function_call") & (_field(i, "call_id") != "") & (_field(i, "name") != "")),
        lambda i: F.struct(_field(i, "call_id").alias("id"), _field(i, "name").alias("name")))
    second = read.where((F.col("protocol") == RESPONSES) & F.coalesce(items_ok & lists & strings_ok(".model"), F.lit(False))).withColumns(
        {"_declared": calls, "_tools": F.size(tools)})
    told = typed(".instructions")
    inner = get(".instructions", "array<variant>")
    instructions = F.when(told == "STRING", text(".instructions")).when(
        told.startswith("ARRAY") & F.coalesce(F.forall(inner, lambda b: _plain(b, "content")), F.lit(False)),
        F.array_join(F.transform(inner, lambda b: _field(b, "content")), "")).otherwise("")
    head = _part(F.lit(0), F.lit("instructions"), instructions)
    tail = _part(F.lit(0), F.lit("tool_definition"), F.col("_facts.tools"))
    in_order = F.concat(
        F.filter(F.array(head), lambda p: p["body"] != ""), _item_parts(),
        F.when(F.col("_tools") > 0, F.array(tail)).otherwise(_none_of(tail)))
    ordered = F.transform(in_order, lambda p, i: p.withField("position", i.cast("long")))
    parts = parts.unionByName(second.select("exchange_id", "protocol", F.explode(ordered).alias("p")))
    flat = parts.select("exchange_id", "protocol", "p.*")
    rest = [c for c in PART_COLUMNS if c != "body"]
    return dedup_request_components(flat.select("exchange_id", "protocol", *rest, *text_facts(F.col("body"))))


def request_metadata(bodies: DataFrame) -> DataFrame:
    """Roles, block types and tool ids of requests; no text."""
    read = bodies.withColumn("v", parsed("body"))
    listed = F.coalesce(get(".messages", "array<variant>"), F.array())

    def block(b: Column, j: Column) -> Column:
        kind = F.when(_field(b, "type") != "", _field(b, "type")).otherwise("text")
        return F.when(_plain(b, "type", "id", "tool_use_id"), F.struct(
            j.alias("index"), kind.alias("type"), F.when(kind == "tool_use", _field(b, "id")).otherwise("").alias("toolUseId"),
            F.when(kind == "tool_result", _field(b, "tool_use_id")).otherwise("").alias("toolResultToolUseId")))

    def message(m: Column, i: Column) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(m, "$.content", "variant"))
        one = F.struct(F.lit(0).alias("index"), F.lit("text").alias("type"), F.lit("").alias("toolUseId"),
                       F.lit("").alias("toolResultToolUseId"))
        many = F.filter(F.transform(F.try_variant_get(m, "$.content", "array<variant>"), block), lambda b: b.isNotNull())
        blocks = F.when(kind == "STRING", F.array(one)).when(kind.startswith("ARRAY"), many)
        return F.struct(i.alias("index"), _field(m, "role").alias("role"), blocks.alias("blocks"))

    items = F.coalesce(get(".input", "array<variant>"), F.array())

    def entry(item: Column, i: Column) -> Column:
        kind = _field(item, "type")
        call = F.when(_field(item, "call_id") != "", _field(item, "call_id")).otherwise(_field(item, "callId"))
        return F.when(_plain(item, "type", "id", "call_id", "callId"), F.struct(
            i.alias("index"), kind.alias("type"), _field(item, "id").alias("itemId"),
            F.when(kind == "function_call", call).otherwise("").alias("callId"),
            F.when(kind == "function_call_output", call).otherwise("").alias("outputCallId")))

    entries = F.filter(F.transform(items, entry), lambda e: e.isNotNull())
    previous = text(".previous_response_id")

    def ids(field: str) -> Column:
        return F.filter(F.transform(entries, lambda e: e[field]), lambda i: i != "")

    is_messages = (F.col("protocol") == MESSAGES) & (F.size(listed) > 0)
    is_responses = (F.col("protocol") == RESPONSES) & strings_ok(".previous_response_id") \
        & ((previous != "") | (F.size(entries) > 0))
    return read.select(
        "exchange_id", "protocol",
        F.struct(
            F.when(is_messages, F.struct(F.transform(listed, message).alias("messages"))).alias("anthropicMessages"),
            F.when(is_responses, F.struct(
                previous.alias("previousResponseId"), ids("callId").alias("functionCallIds"),
                ids("outputCallId").alias("functionCallOutputIds"), entries.alias("items"))).alias("openaiResponses"),
        ).alias("metadata"))


def response_facts(bodies: DataFrame) -> DataFrame:
    """Usage, response id and tool call ids of response bodies."""
    read = bodies.withColumn("v", parsed("body"))
    messages = F.col("protocol") == MESSAGES
    details = ("input_tokens_details", "output_tokens_details")
    names = ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")
    sound = objects_ok(".usage") & integers_ok(".usage.input_tokens", ".usage.output_tokens") & F.when(
        messages, integers_ok(*[f".usage.{n}" for n in names[2:]])).otherwise(
        integers_ok(".usage.total_tokens", ".usage.input_tokens_details.cached_tokens",
                    ".usage.output_tokens_details.reasoning_tokens") & objects_ok(*[f".usage.{d}" for d in details]))

    def count(path: str, when: Column | None = None) -> Column:
        value = get(f".usage.{path}", "bigint")
        return F.when(F.coalesce(sound, F.lit(False)) & (F.lit(True) if when is None else when), value)

    usage = {
        "input_tokens": count("input_tokens"),
        "cache_creation_input_tokens": count("cache_creation_input_tokens", messages),
        "cache_read_input_tokens": F.coalesce(
            count("cache_read_input_tokens", messages), count("input_tokens_details.cached_tokens", ~messages)),
        "output_tokens": count("output_tokens"),
        "reasoning_output_tokens": count("output_tokens_details.reasoning_tokens", ~messages),
        "total_input_tokens": F.lit(None).cast("long"),
        "total_tokens": count("total_tokens", ~messages),
    }
    any_field = F.coalesce(*usage.values()).isNotNull()
    output = F.coalesce(get(".output", "array<variant>"), F.array())
    calls = F.transform(
        F.filter(output, lambda i: _plain(i, "type", "call_id") & (_field(i, "type") == "function_call") & (_field(i, "call_id") != "")),
        lambda i: _field(i, "call_id"))
    return read.select(
        "exchange_id", "protocol", F.when(strings_ok(".id"), text(".id")).otherwise("").alias("response_object_id"),
        F.when(~messages, calls).alias("output_call_ids"),
        *[usage[n].alias(n) for n in USAGE_COLUMNS], F.when(any_field, F.col("protocol")).alias("usage_source"))
