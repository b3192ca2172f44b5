"""Request and response bodies on hand-written examples."""

import hashlib
import json

from usagelake.operators import chains, gateway
from usagelake.sources import rawjson, requests

MESSAGES, RESPONSES = gateway.MESSAGES, gateway.RESPONSES


def digest(text):
    return "sha256:" + hashlib.sha256(text.encode()).hexdigest()


def bodies(spark, *rows):
    return spark.createDataFrame(
        [(str(i), p, b if isinstance(b, str) else json.dumps(b)) for i, (p, b) in enumerate(rows)],
        "exchange_id string, protocol string, body string")


def test_messages_request(spark):
    use = '{"type":"tool_use",  "id":"t1","name":"Read","input":{"p":"<a>"}}'
    body = (
        '{"model":"m","system":[{"type":"text","text":"be "},{"text":"brief"}],"messages":['
        '{"role":"user","content":"first"},'
        '{"role":"assistant","content":[{"type":"text","text":"hm"},' + use + "]},"
        '{"role":"user","content":[{"type":"tool_result","tool_use_id":"t1","content":[{"type":"text","text":"done"}]},'
        '{"type":"text","text":"next"},{"type":"text","text":"body","path":"/x"},{"type":"doc","name":"n.md","content":"in"},'
        '{"type":"image"},7]},'
        '{"role":"system","content":"dropped"}],"tools":[ {"name":"Read"} ]}')
    got = requests.request_components(bodies(spark, (MESSAGES, body), (MESSAGES, "{"), (MESSAGES, {"messages": [{"role": 5}]})))
    rows = sorted(got.collect(), key=lambda r: r.position)
    assert {r.exchange_id for r in rows} == {"0"}
    compacted = '{"type":"tool_use","id":"t1","name":"Read","input":{"p":"\\u003ca\\u003e"}}'
    want = [
        (0, "instructions", "be brief", ""), (1000, "history", "first", ""), (2000, "history", "hm", ""),
        (2001, "history", compacted, ""), (3000, "tool_result", "done", ""), (3001, "other", "next", ""),
        (3002, "file", "body", "/x"), (3003, "file", "in", "n.md"), (3004, "other", "", ""),
        (5000, "tool_definition", '[{"name":"Read"}]', "")]
    assert [(r.position, r.kind, r.content_hash, r.path) for r in rows] == [
        (p, k, digest(t) if t else "", path) for p, k, t, path in want]
    result = rows[4]
    assert (result.tool_call_id, result.tool_name, result.completeness) == ("t1", "Read", "complete")
    assert result.content_bytes == len('[{"type":"text","text":"done"}]')
    assert rows[8].tokens is None and rows[8].tokens_kind == "unknown"


def test_responses_request(spark):
    body = {
        "model": "m", "instructions": "rules", "previous_response_id": "r0",
        "input": [
            {"type": "message", "role": "user", "content": [{"content": "a"}, {"content": "b"}], "id": "i1"},
            {"role": "developer", "content": "dev"}, {"type": "reasoning"},
            {"type": "function_call", "call_id": "c1", "name": "run", "arguments": "{}"},
            {"type": "function_call_output", "call_id": "c1", "output": "héé"},
            {"type": "function_call_output", "callId": "c9", "output": None}, {"role": "assistant", "content": 5}],
        "tools": [{"n": 1}]}
    source = bodies(spark, (RESPONSES, body), (RESPONSES, {"input": "text"}))
    rows = sorted(requests.request_components(source).collect(), key=lambda r: r.position)
    assert [(r.position, r.kind, r.tool_call_id, r.tool_name) for r in rows] == [
        (0, "instructions", "", ""), (1, "user_prompt", "", ""), (2, "instructions", "", ""), (3, "tool_result", "c1", "run"),
        (4, "tool_result", "c9", ""), (5, "history", "", ""), (6, "tool_definition", "", "")]
    assert rows[1].content_hash == digest("ab") and rows[3].content_bytes == 5 and rows[4].content_bytes is None
    meta = {r.exchange_id: r.metadata for r in requests.request_metadata(source).collect()}
    assert meta["1"].openaiResponses is None
    found = meta["0"].openaiResponses
    assert (found.previousResponseId, found.functionCallIds, found.functionCallOutputIds) == ("r0", ["c1"], ["c1", "c9"])
    assert found["items"][0].itemId == "i1" and len(found["items"]) == 7


def test_messages_metadata(spark):
    body = {"messages": [{"role": "user", "content": "x"}, {"role": "assistant", "content": [
        {"type": "tool_use", "id": "t", "name": "n"}, {"text": "y"}, 3]}]}
    (row,) = requests.request_metadata(bodies(spark, (MESSAGES, body))).collect()
    messages = row.metadata.anthropicMessages.messages
    assert [(m.role, [(b["index"], b.type, b.toolUseId) for b in m.blocks]) for m in messages] == [
        ("user", [(0, "text", "")]), ("assistant", [(0, "tool_use", "t"), (1, "text", "")])]


def test_response_facts(spark):
    rows = {r.exchange_id: r for r in requests.response_facts(bodies(
        spark,
        (MESSAGES, {"id": "m1", "usage": {"input_tokens": 3, "cache_read_input_tokens": 0}}),
        (RESPONSES, {"id": "r1", "output": [{"type": "function_call", "call_id": "c"}, {"type": "x", "call_id": "d"}],
                     "usage": {"input_tokens": 5, "total_tokens": 9, "input_tokens_details": {"cached_tokens": 2}}}),
        (RESPONSES, {"id": "r2", "usage": {"input_tokens": "5"}}), (MESSAGES, {"id": "m2", "usage": {}}))).collect()}
    assert (rows["0"].input_tokens, rows["0"].cache_read_input_tokens, rows["0"].output_tokens) == (3, 0, None)
    assert rows["0"].usage_source == MESSAGES and rows["0"].response_object_id == "m1"
    assert (rows["1"].total_tokens, rows["1"].cache_read_input_tokens, rows["1"].output_call_ids) == (9, 2, ["c"])
    assert rows["2"].usage_source is None and rows["3"].usage_source is None


def test_compact():
    assert rawjson.compact('{ "a b" : [1, "x \\" y"] }') == '{"a b":[1,"x \\" y"]}'
    assert rawjson.compact('"< "') == '"\\u003c\\u2028"'


def test_start_shapes_of_captures(spark):
    from usagelake.sources.exchanges import SCHEMA

    def capture(i, protocol, metadata, method="POST", endpoint=None):
        endpoint = endpoint or ("/v1/messages" if protocol == MESSAGES else "/v1/responses")
        return json.dumps({"id": f"gw-{i}", "profile": "p", "protocol": protocol, "startedAt": f"2026-01-01T00:00:0{i}Z",
                           "request": {"method": method, "endpoint": endpoint, "metadata": metadata}, "response": {}})

    def messages(*blocks):
        return {"anthropicMessages": {"messages": [{"index": 0, "role": "user", "blocks": list(blocks)}]}}

    def items(*entries):
        return {"openaiResponses": {"items": list(entries)}}

    lines = [
        capture(0, MESSAGES, messages({"index": 0, "type": "text"})),
        capture(1, MESSAGES, messages({"index": 0, "type": "tool_result", "toolResultToolUseId": "t"})),
        capture(2, RESPONSES, items({"index": 0, "type": "message"})),
        capture(3, RESPONSES, items({"index": 1, "type": "message"})),
        capture(4, RESPONSES, items({"index": 1, "type": "message", "itemId": "i"})),
        capture(5, RESPONSES, {}),
        # No model calls: a read, a token count, a listing, another protocol's endpoint.
        capture(6, MESSAGES, {}, "GET"), capture(7, MESSAGES, {}, "POST", "/v1/messages/count_tokens"),
        capture(8, RESPONSES, {}, "POST", "/v1/models"), capture(9, RESPONSES, {}, "", "/v1/messages"),
    ]
    frame = spark.read.schema(SCHEMA).json(spark.createDataFrame([(x,) for x in lines], "value string").rdd.map(lambda r: r[0]))
    calls = {r.id: r for r in chains.calls_from_exchanges(frame).collect()}
    assert [calls[f"gw-{i}"].start_shape for i in range(6)] == [True, False, True, False, True, False]
    assert calls["gw-1"].tool_asks == ["t"] and len(calls) == 6


def test_records_are_sealed(spark):
    from pyspark.sql import functions as F

    from usagelake.sources.records import get, parsed

    good = ['{"a":1}', '[1,2]', '7', '"x"', ' {"type":"t"} ', '{"z":[{"r":1}]}']
    bad = ['{"a":1},"x":1', '{"a":1}],"a":[1', '1,2', '{"a":1} extra', '', '{', '{"a":1,"a":2}', 'nul', '{"a":1}]}']
    rows = spark.createDataFrame([(r, r in good) for r in good + bad], "raw string, ok boolean").withColumn("v", parsed())
    assert all(r.read == r.ok for r in rows.select("ok", F.col("v").isNotNull().alias("read")).collect())
    assert rows.where("raw = '{\"a\":1}'").select(get(".a", "bigint")).head()[0] == 1


def test_a_very_long_string_is_read(spark):
    from pyspark.sql import functions as F

    from usagelake.sources.records import get, parsed

    rows = spark.range(1).select(F.concat(F.lit('{"t":"'), F.repeat(F.lit("x"), 40_000_000), F.lit('","n":5}')).alias("raw"))
    got = rows.withColumn("v", parsed()).select(get(".n", "bigint").alias("n"), F.length(get(".t")).alias("size")).head()
    assert (got.n, got.size) == (5, 40_000_000)
