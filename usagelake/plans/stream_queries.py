"""Registered queries: stream events, request bodies and transcripts built from the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from usagelake.plans.registry import query
from usagelake.plans.twins import table, twin
from usagelake.sources import claude, codex, rawjson, requests
from usagelake.streaming import frames


@query("st1_stream_usage", ("ev",), """
WITH f AS (SELECT 'x' || CAST(user_id AS VARCHAR) || '-' || CAST(ts_us // 86400000000 AS VARCHAR) AS exchange_id,
             CASE WHEN user_id % 2 = 0 THEN 'anthropic_messages' ELSE 'openai_responses' END AS protocol,
             event_id AS seq, user_id % 2 = 0 AS am, k % 10 AS c, k, v FROM ev),
g AS (SELECT exchange_id, protocol,
  max_by(CASE WHEN am THEN v ELSE k END, seq) FILTER ((am AND c = 0) OR (NOT am AND c BETWEEN 3 AND 7)) AS input_tokens,
  max_by(k, seq) FILTER ((am AND c = 0) OR (NOT am AND c = 2)) AS cache_read_input_tokens,
  max_by(v, seq) FILTER (c BETWEEN 3 AND 7) AS output_tokens,
  max_by(v, seq) FILTER (NOT am AND c = 2) AS total_tokens,
  max_by(CASE WHEN am THEN 'm' ELSE 'r' END || CAST(k AS VARCHAR), seq) FILTER (c = 0) AS rid,
  bool_or(c = 1 OR (NOT am AND c = 2)) AS terminal FROM f GROUP BY ALL)
SELECT exchange_id, protocol, input_tokens, cache_read_input_tokens, output_tokens, total_tokens,
  CASE WHEN coalesce(input_tokens, cache_read_input_tokens, output_tokens, total_tokens) IS NOT NULL THEN protocol END AS usage_source,
  coalesce(rid, '') AS response_object_id, terminal,
  CASE WHEN NOT terminal AND protocol = 'anthropic_messages' THEN 'stream_truncated' ELSE 'upstream_ok' END AS outcome FROM g""")
def st1(spark, sf_dir):
    return frames.fold_frames(twin(spark, sf_dir, "frames")).select(
        "exchange_id", "protocol", "input_tokens", "cache_read_input_tokens", "output_tokens", "total_tokens",
        "usage_source", "response_object_id", "terminal", "outcome")


def _bodies(spark, sf_dir):
    """One request per conversation turn, in the protocol its conversation uses."""
    said = table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("exchange_id"), "role", "text", (F.col("conv_id") % 2 == 0).alias("even"))
    message = F.to_json(F.struct(
        F.lit("m").alias("model"), F.lit("be brief").alias("system"),
        F.array(F.struct(F.lit("user").alias("role"), F.lit("first").alias("content")),
                F.struct(F.col("role"), F.col("text").alias("content"))).alias("messages")))
    response = F.to_json(F.struct(
        F.lit("m").alias("model"), F.concat(F.lit("r-"), F.col("exchange_id")).alias("previous_response_id"),
        F.array(F.struct(F.lit("message").alias("type"), F.col("role"), F.col("text").alias("content"))).alias("input")))
    return said.select(
        "exchange_id", F.when(F.col("even"), "anthropic_messages").otherwise("openai_responses").alias("protocol"),
        F.when(F.col("even"), message).otherwise(response).alias("body"))


@query("p10_request_components", (), """
WITH c AS (SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS exchange_id, conv_id % 2 = 0 AS even, role, text
           FROM conversations),
p AS (
  SELECT exchange_id, 0 AS position, 'instructions' AS kind, 'be brief' AS body FROM c WHERE even
  UNION ALL SELECT exchange_id, 1000, CASE WHEN role = 'user' THEN 'history' ELSE 'other' END, 'first' FROM c WHERE even
  UNION ALL SELECT exchange_id, 2000, CASE WHEN role = 'user' THEN 'other' ELSE 'history' END, text FROM c
            WHERE even AND role IN ('user', 'assistant')
  UNION ALL SELECT exchange_id, 0, CASE role WHEN 'user' THEN 'user_prompt' WHEN 'assistant' THEN 'history'
                   ELSE 'instructions' END, text FROM c WHERE NOT even)
SELECT exchange_id, CAST(position AS BIGINT) AS position, kind, (length(body) + 3) // 4 AS tokens,
       'sha256:' || sha256(body) AS content_hash FROM p""")
def p10(spark, sf_dir):
    return requests.request_components(_bodies(spark, sf_dir)).select(
        "exchange_id", "position", "kind", "tokens", "content_hash")


@query("p13_request_metadata", (), """
SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS exchange_id,
  CASE WHEN conv_id % 2 = 0 THEN 'user,' || role END AS roles,
  CASE WHEN conv_id % 2 = 1 THEN 'r-' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) END AS previous,
  CASE WHEN conv_id % 2 = 1 THEN 'message' END AS item_types FROM conversations""")
def p13(spark, sf_dir):
    read = requests.request_metadata(_bodies(spark, sf_dir))
    return read.select(
        "exchange_id",
        F.array_join(F.col("metadata.anthropicMessages.messages.role"), ",").alias("roles"),
        F.col("metadata.openaiResponses.previousResponseId").alias("previous"),
        F.array_join(F.col("metadata.openaiResponses.items.type"), ",").alias("item_types"))


@query("p14_response_usage", ("ev",), """
SELECT 'e' || CAST(event_id AS VARCHAR) AS exchange_id, 'r' || CAST(k AS VARCHAR) AS response_object_id, v AS input_tokens,
       k AS cache_read_input_tokens, CASE WHEN event_id % 3 > 0 THEN v + k END AS total_tokens,
       'openai_responses' AS usage_source FROM ev""")
def p14(spark, sf_dir):
    bodies = twin(spark, sf_dir, "ev").select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("exchange_id"),
        F.lit("openai_responses").alias("protocol"),
        F.to_json(F.struct(
            F.concat(F.lit("r"), F.col("k").cast("string")).alias("id"),
            F.struct(F.col("v").alias("input_tokens"), F.when(F.col("event_id") % 3 > 0, F.col("v") + F.col("k")).alias("total_tokens"),
                     F.struct(F.col("k").alias("cached_tokens")).alias("input_tokens_details")).alias("usage"))).alias("body"))
    return requests.response_facts(bodies).select(
        "exchange_id", "response_object_id", "input_tokens", "cache_read_input_tokens", "total_tokens", "usage_source")


def _transcript_lines(spark, sf_dir):
    """Conversations written as transcript lines: one file each, a counter after every turn."""
    said = table(spark, sf_dir, "conversations")
    at = F.col("turn") * 2 + 1
    item = F.to_json(F.struct(F.lit("response_item").alias("type"), F.struct(
        F.lit("message").alias("type"), "role", F.col("text").alias("content")).alias("payload")))
    count = F.to_json(F.struct(F.lit("event_msg").alias("type"), F.struct(
        F.lit("token_count").alias("type"),
        F.struct(F.struct((at * 10).alias("input_tokens"), (at * 2).alias("output_tokens"), (at * 12).alias("total_tokens"),
                          F.lit(0).alias("cached_input_tokens")).alias("total_token_usage")).alias("info")).alias("payload")))
    return said.select(
        F.concat(F.lit("/c"), F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("file"),
        F.explode(F.array(F.struct(at.alias("line"), item.alias("raw")), F.struct((at + 1).alias("line"), count.alias("raw")))).alias("l"),
    ).select("file", "l.line", "l.raw", F.lit(False).alias("oversized"), F.lit(0).cast("long").alias("mtime_us"))


@query("p3_transcript_components", (), """
SELECT 'c' || CAST(conv_id AS VARCHAR) AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn_sequence,
       CASE role WHEN 'user' THEN 'user_prompt' WHEN 'assistant' THEN 'history' ELSE 'instructions' END AS kind,
       (length(text) + 3) // 4 AS tokens, 'sha256:' || sha256(text) AS content_hash FROM conversations""")
def p3(spark, sf_dir):
    read = codex.read(_transcript_lines(spark, sf_dir))
    return read.components.select(
        F.regexp_extract("file", "(c[0-9]+)", 1).alias("session_id"), "turn_sequence", "kind", "tokens", "content_hash")


@query("p1_transcript_turns", (), """
SELECT 'c' || CAST(conv_id AS VARCHAR) AS session_id, row_number() OVER w AS sequence,
       (turn * 2 + 1) * 12 - coalesce(lag((turn * 2 + 1) * 12) OVER w, 0) AS total FROM conversations
WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def p1(spark, sf_dir):
    return codex.read(_transcript_lines(spark, sf_dir)).turns.select("session_id", "sequence", "total")


def _message_lines(spark, sf_dir):
    """Conversations written as message transcripts: assistant turns report usage."""
    said = table(spark, sf_dir, "conversations")
    use = F.when(F.col("role") == "assistant", F.struct(
        F.col("turn").alias("input_tokens"), F.lit(1).cast("long").alias("output_tokens"),
        F.lit(0).cast("long").alias("cache_read_input_tokens"), F.lit(0).cast("long").alias("cache_creation_input_tokens")))
    raw = F.to_json(F.struct(
        F.col("role").alias("type"), F.concat_ws("-", "conv_id", "turn").alias("uuid"),
        F.struct("role", F.lit("m").alias("model"), F.col("text").alias("content"), use.alias("usage")).alias("message")))
    return said.select(
        F.concat(F.lit("/c"), F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("file"),
        (F.col("turn") + 1).alias("line"), raw.alias("raw"), F.lit(False).alias("oversized"),
        F.lit(0).cast("long").alias("mtime_us"))


@query("p5_message_components", (), """
WITH w AS (SELECT *, count(*) FILTER (role = 'assistant') OVER (PARTITION BY conv_id) AS n,
             count(*) FILTER (role = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
             count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier
           FROM conversations)
SELECT 'c' || CAST(conv_id AS VARCHAR) AS session_id, CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS record,
       CASE role WHEN 'user' THEN 'user_prompt' ELSE 'history' END AS kind,
       CASE WHEN before + 1 + CASE WHEN role = 'assistant' THEN 1 ELSE 0 END <= n
            THEN before + 1 + CASE WHEN role = 'assistant' THEN 1 ELSE 0 END END AS turn_sequence,
       'sha256:' || sha256(text) AS content_hash
FROM w WHERE n > 0 AND (role = 'user' OR (role = 'assistant' AND earlier > 0))""")
def p5(spark, sf_dir):
    return claude.read(_message_lines(spark, sf_dir)).components.select(
        F.regexp_extract("file", "(c[0-9]+)", 1).alias("session_id"), "record", "kind", "turn_sequence", "content_hash")


@query("p2_unreadable_records", ("ev",), """
SELECT 'u' || CAST(user_id AS VARCHAR) AS session_id, event_id AS line,
       CASE WHEN k % 7 = 6 THEN 'truncated' ELSE 'unavailable' END AS completeness
FROM ev WHERE k % 7 IN (1, 2, 3, 4, 6)""")
def p2(spark, sf_dir):
    # Trailing text: a word, a member that closes the record early, another value, another element.
    tails = F.element_at(F.array(*map(F.lit, (' extra', ',"x":1', '],"x":[1', '{}'))), (F.col("event_id") % 4 + 1).cast("int"))
    bad = F.when(F.col("k") % 7 == 1, "not json").when(F.col("k") % 7 == 2, F.concat(F.lit('{"type":"event_msg"}'), tails)).when(
        F.col("k") % 7 == 3, '{"type":7}').when(
        F.col("k") % 7 == 4,
        '{"type":"event_msg","payload":{"type":"token_count","info":{"total_token_usage":{"input_tokens":"5"}}}}').when(
        F.col("k") % 7 == 5, "").otherwise('{"type":"other","payload":[1]}')
    lines = twin(spark, sf_dir, "ev").select(
        F.concat(F.lit("/u"), F.col("user_id").cast("string"), F.lit(".jsonl")).alias("file"), F.col("event_id").alias("line"),
        F.when(F.col("k") % 7 != 6, bad).alias("raw"), (F.col("k") % 7 == 6).alias("oversized"),
        F.lit(0).cast("long").alias("mtime_us"))
    lost = codex.classify(lines).where("NOT readable")
    return lost.select(F.regexp_extract("file", "(u[0-9]+)", 1).alias("session_id"), "line",
                       F.when(F.col("oversized"), "truncated").otherwise("unavailable").alias("completeness"))


@query("p7_output_text_and_x3_bytes", (), """
SELECT doc_id, length(text) AS said_length, sha256(text) AS said_hash,
       CAST(CASE WHEN doc_id % 2 = 0 THEN octet_length(encode(text))
            ELSE octet_length(encode('[{"text":"","content":[{"text":' || to_json(text) || '}]}]')) END AS BIGINT) AS size
FROM documents""")
def p7(spark, sf_dir):
    plain = F.to_json(F.struct(F.col("text").alias("output")))
    nested = F.to_json(F.struct(F.array(F.struct(
        F.lit("").alias("text"), F.array(F.struct("text")).alias("content"))).alias("output")))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 2 == 0, plain).otherwise(nested).alias("raw"))
    facts = docs.withColumn("f", rawjson.member_facts("raw", F.lit("output")))
    return facts.select(
        "doc_id", F.length("f.said").cast("long").alias("said_length"), F.sha2("f.said", 256).alias("said_hash"),
        F.col("f.size").alias("size"))


@query("x4_structured_fingerprint", ("ev",), """
SELECT event_type, k, event_id % 3 = 2 AS written_as_float, count(*) AS calls, 1 AS fingerprints FROM ev GROUP BY ALL""")
def x4(spark, sf_dir):
    k = F.col("k").cast("string")
    # Key order and blanks do not matter, how a number is written does.
    ordered = F.concat(F.lit('{"a":'), k, F.lit(',"b":[1,"x"]}'))
    spaced = F.concat(F.lit('{ "b" : [1, "x"], "a": '), k, F.lit("}"))
    floated = F.concat(F.lit('{"a":'), k, F.lit('.0,"b":[1,"x"]}'))
    shape = F.col("event_id") % 3
    calls = twin(spark, sf_dir, "ev").select(
        "event_type", "k", (shape == 2).alias("written_as_float"),
        rawjson.structured_fingerprint("event_type", F.when(shape == 0, ordered).when(shape == 1, spaced).otherwise(floated))
        .alias("fingerprint"))
    by_print = calls.groupBy("event_type", "k", "written_as_float", "fingerprint").agg(F.count("*").alias("calls"))
    return by_print.groupBy("event_type", "k", "written_as_float").agg(
        F.sum("calls").alias("calls"), F.count("*").cast("int").alias("fingerprints"))


@query("x5_freeform_fingerprint", (), """
SELECT text_hash, copies FROM (SELECT sha256(text) AS text_hash, count(*) AS copies FROM documents WHERE length(text) > 0
GROUP BY text) q""")
def x5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        rawjson.freeform_fingerprint(F.lit(" run "), F.col("text")).alias("fingerprint"), F.sha2("text", 256).alias("text_hash"))
    return docs.where("fingerprint IS NOT NULL").groupBy("fingerprint").agg(
        F.min("text_hash").alias("text_hash"), F.count("*").alias("copies")).drop("fingerprint")
