"""Domain tables derived from the shared analytics tables.

The shared tables hold no transcripts, so each domain table is a deterministic
projection of them, written once as SQL that Spark and DuckDB both run.  The
projections use no windows: they cost one scan at any scale.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("events", "orders", "documents", "conversations", "labels", "pages")

TWINS = {
    "ev": """
        SELECT event_id, @US[ts] AS ts_us, user_id, event_type,
               CAST(floor(value) AS BIGINT) AS v,
               CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k
        FROM events""",
    # Cumulative counters per session; they start over every 1013 events.
    "counters": """
        SELECT session_id, source, ord, ts_us, input, cached, output, reasoning,
               input + output AS total
        FROM (SELECT 'u' || CAST(user_id AS STRING) AS session_id,
                     CASE WHEN user_id % 3 = 0 THEN 'codex' ELSE 'other' END AS source,
                     event_id AS ord, ts_us,
                     (event_id % 1013) * 20 + k % 17 AS input,
                     CASE WHEN event_id % 211 = 0 THEN 0
                          ELSE (event_id % 1013) * 7 + k % 5 END AS cached,
                     (event_id % 1013) * 3 + v % 3 AS output,
                     CASE WHEN event_id % 7 = 0 THEN NULL
                          ELSE (event_id % 1013) * 2 END AS reasoning
              FROM ev) c""",
    # Per-message usage with repeats, conflicts, gaps and invalid values.
    "messages": """
        SELECT 'u' || CAST(user_id AS STRING) AS session_id,
               'g' || CAST(user_id % 4 AS STRING) AS source,
               event_id AS ord, ts_us,
               CASE WHEN k % 20 = 19 THEN ''
                    ELSE CAST(user_id AS STRING) || '-' || CAST(k % 20 AS STRING) END AS message_id,
               CASE WHEN k % 20 = 13 THEN '<synthetic>'
                    WHEN user_id % 5 = 0 THEN event_type
                    WHEN user_id % 7 = 0 THEN ''
                    ELSE 'model-' || CAST(user_id % 3 AS STRING) END AS model,
               CASE WHEN k % 20 = 3 AND user_id % 2 = 0 THEN NULL
                    WHEN k % 20 = 11 AND user_id % 3 = 0 THEN -1
                    ELSE (k % 20) * 10 + CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END END AS input,
               CASE WHEN k % 20 = 7 AND user_id % 4 = 1 THEN NULL ELSE (k % 20) * 4 END AS cache_read,
               CASE WHEN user_id % 6 = 2 THEN NULL ELSE (k % 20) * 2 END AS cache_write,
               CASE WHEN k % 20 = 5 AND user_id % 5 = 1 THEN NULL ELSE (k % 20) + 1 END AS output
        FROM ev""",
    # Context components: conversation turns and documents as tool results.
    "components": """
        SELECT 'c' || CAST(conv_id AS STRING) AS session_id,
               CASE WHEN conv_id % 2 = 0 THEN 'codex' ELSE 'claude' END AS source,
               turn + 1 AS turn_sequence, CAST(conv_id * 100 + turn AS BIGINT) AS ord,
               CASE role WHEN 'system' THEN 'instructions' WHEN 'user' THEN 'user_prompt'
                         ELSE 'history' END AS kind,
               'conv-' || CAST(conv_id AS STRING) || '-' || CAST(turn % 4 AS STRING) AS record,
               '' AS path, text,
               CAST(NULL AS STRING) AS completeness, CAST(NULL AS BIGINT) AS content_bytes,
               '' AS tool_call_id, '' AS tool_name
        FROM conversations
        UNION ALL
        SELECT 'c' || CAST(doc_id % 97 AS STRING),
               CASE WHEN (doc_id % 97) % 2 = 0 THEN 'codex' ELSE 'claude' END,
               CASE WHEN doc_id % 13 = 0 THEN NULL ELSE doc_id @DIV@ 97 + 1 END,
               CAST(1000000 + doc_id AS BIGINT),
               CASE WHEN doc_id % 5 = 4 THEN 'file' WHEN doc_id % 31 = 0 THEN 'unknown'
                    ELSE 'tool_result' END,
               'doc-' || CAST(doc_id % 400 AS STRING),
               CASE WHEN doc_id % 5 = 4 THEN '/' || lang || '/' || source ELSE '' END, text,
               CASE WHEN doc_id % 10 < 7 THEN 'complete' WHEN doc_id % 10 = 7 THEN 'truncated'
                    WHEN doc_id % 10 = 8 THEN 'unavailable' ELSE NULL END,
               CASE WHEN doc_id % 11 = 0 THEN NULL ELSE CAST(@BYTES[text] AS BIGINT) END,
               CASE WHEN doc_id % 9 = 0 THEN '' ELSE 'call-' || CAST(doc_id AS STRING) END,
               CASE WHEN doc_id % 8 = 0 THEN '' ELSE source END
        FROM documents""",
    # Measured components: an estimate from the text, a few counted ones.
    "context": """
        SELECT session_id, source, turn_sequence, ord, kind, record, path, completeness,
               content_bytes, tool_call_id, tool_name,
               CASE WHEN ord % 6 = 5 OR length(text) = 0 THEN NULL
                    ELSE CAST((length(text) + 3) @DIV@ 4 AS BIGINT) END AS tokens,
               CASE WHEN ord % 6 = 5 OR length(text) = 0 THEN 'unknown'
                    WHEN ord % 6 = 4 THEN 'counted' WHEN ord % 29 = 3 THEN 'measured'
                    ELSE 'estimated' END AS tokens_kind,
               CASE WHEN length(text) = 0 THEN '' ELSE 'sha256:' || @SHA[text] END AS content_hash
        FROM components""",
    "context_turns": """
        SELECT session_id, source, turn_sequence,
               CASE WHEN min(ord) % 7 = 0 THEN NULL ELSE 100 + (min(ord) % 50) * 40 END AS input,
               CASE WHEN min(ord) % 7 = 0 THEN NULL WHEN min(ord) % 7 = 1 THEN 'estimated'
                    ELSE 'derived' END AS input_kind,
               CASE WHEN min(ord) % 4 = 0 THEN NULL ELSE min(ord) % 90 END AS cached,
               CASE WHEN min(ord) % 4 = 0 THEN NULL ELSE 'derived' END AS cached_kind
        FROM context WHERE turn_sequence IS NOT NULL GROUP BY session_id, source, turn_sequence""",
    "context_sessions": """
        SELECT session_id, source FROM context GROUP BY session_id, source""",
    # Tool results of a session: name, argument fingerprint, output hash.
    "tool_results": """
        SELECT 'u' || CAST(user_id AS STRING) AS session_id, event_id AS ord,
               CASE WHEN event_id % 23 = 0 THEN NULL ELSE event_id END AS turn_sequence,
               'tool_result' AS kind,
               CASE WHEN event_id % 19 = 0 THEN 'truncated' ELSE 'complete' END AS completeness,
               CASE WHEN event_id % 17 = 0 THEN '' ELSE 'call-' || CAST(event_id - event_id % 3 AS STRING) END
                 AS tool_call_id,
               CASE WHEN event_id % 29 = 0 THEN '' ELSE event_type END AS tool_name,
               'v1:' || CAST(k % 6 AS STRING) AS tool_call_fingerprint,
               'sha256:' || CAST(v % 3 AS STRING) AS content_hash,
               v * 2000 AS content_bytes,
               CASE WHEN event_id % 5 = 0 THEN NULL ELSE v END AS tokens,
               CASE WHEN event_id % 5 = 0 THEN 'unknown' ELSE 'estimated' END AS tokens_kind
        FROM ev""",
    # Calls and results that refer to them by call id.
    "tool_links": """
        SELECT 'u' || CAST(user_id AS STRING) AS session_id, event_id AS ord,
               CASE WHEN event_id % 2 = 0 THEN 'call' ELSE 'result' END AS role,
               CASE WHEN event_id % 31 = 0 THEN '' ELSE 'k' || CAST(k % 9 AS STRING) END AS call_id,
               CASE WHEN event_id % 14 = 0 THEN '' ELSE event_type END AS name,
               'v1:' || CAST(k AS STRING) AS fingerprint
        FROM ev""",
    "usage_events": """
        SELECT 'u' || CAST(user_id AS STRING) AS session_id, event_id AS ord,
               event_id % 5 = 0 AS closes_turn,
               CASE event_type WHEN 'view' THEN 'history' WHEN 'click' THEN 'user_prompt'
                    ELSE 'tool_result' END AS kind,
               'codex_rollout' AS source, 'r' || CAST(k % 8 AS STRING) AS record, '' AS path
        FROM ev""",
    # Two channels that saw partly the same requests, at a coarse clock.
    "observations": """
        SELECT 'o' || CAST(event_id AS STRING) AS id,
               CASE WHEN event_id % 2 = 0 THEN 'gateway' ELSE 'session_transcript' END AS channel,
               CASE WHEN event_id % 2 = 0 THEN 'request' ELSE 'turn' END AS scope,
               's' || CAST(user_id % 2 AS STRING) AS source,
               CASE WHEN event_id % 97 = 0 THEN NULL
                    ELSE (ts_us @DIV@ 600000000) * 30000000 END AS started_us,
               CASE WHEN k % 4 = 3 THEN '' WHEN event_id % 3 = 0 THEN 'Model-' || CAST(k % 3 AS STRING)
                    ELSE ' model-' || CAST(k % 3 AS STRING) END AS model,
               CASE WHEN event_id % 11 = 0 THEN 'x' || CAST(event_id @DIV@ 22 AS STRING)
                    WHEN event_id % 13 = 0 THEN 'y' || CAST(event_id @DIV@ 52 AS STRING)
                    ELSE '' END AS response_object_id,
               CASE WHEN event_id % 17 = 0 THEN 'z' || CAST(event_id @DIV@ 34 AS STRING) ELSE '' END AS turn_id,
               CASE WHEN event_id % 4 = 0 THEN NULL ELSE v % 4 END AS fresh_input,
               CASE WHEN event_id % 5 = 0 THEN NULL ELSE k % 5 END AS cached_input,
               CAST(NULL AS BIGINT) AS cache_creation_input,
               v % 4 + k % 5 AS total_input,
               CASE WHEN event_id % 6 = 0 THEN NULL ELSE v % 3 END AS output,
               CASE WHEN event_id % 3 = 0 THEN NULL ELSE k % 2 END AS reasoning_output,
               CASE WHEN event_id % 8 = 0 THEN NULL ELSE v % 4 + k % 5 + v % 3 END AS total
        FROM ev""",
    # Turns to price: model names in mixed case, dates on both sides of price changes.
    "priced": """
        SELECT 'u' || CAST(user_id AS STRING) AS session_id,
               'g' || CAST(user_id % 3 AS STRING) AS source, event_id AS sequence,
               CASE WHEN event_id % 41 = 0 THEN NULL ELSE ts_us END AS ts_us,
               CASE k % 9 WHEN 0 THEN 'Alpha-Large' WHEN 1 THEN 'acme/alpha-large' WHEN 2 THEN 'ALPHA-mini'
                          WHEN 3 THEN 'beta' WHEN 4 THEN 'beta-2' WHEN 5 THEN 'zeta/unknown-1'
                          WHEN 6 THEN 'Unlisted' WHEN 7 THEN 'gamma' ELSE 'delta' END AS model,
               CASE WHEN event_id % 37 = 0 THEN NULL ELSE v * 997 END AS billable_input,
               CASE WHEN event_id % 37 = 0 THEN NULL ELSE 'measured' END AS billable_input_kind,
               CASE WHEN event_id % 53 = 0 THEN NULL WHEN event_id % 59 = 0 THEN v * 998 ELSE v * 101 END
                 AS billable_cache_read,
               CASE WHEN event_id % 53 = 0 THEN 'unknown' ELSE 'measured' END AS billable_cache_read_kind,
               CASE WHEN event_id % 3 = 0 THEN NULL ELSE v * 11 END AS billable_cache_write,
               CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'measured' END AS billable_cache_write_kind,
               CASE WHEN event_id % 43 = 0 THEN NULL ELSE k * 31 END AS billable_output,
               CASE WHEN event_id % 43 = 0 THEN NULL ELSE 'derived' END AS billable_output_kind
        FROM ev""",
    # Captured calls: a customer's orders continue each other by response id.
    "exchanges": """
        SELECT 'gw-' || CAST(100000000000 + o_orderkey AS STRING) AS id, o_orderkey AS num,
               'p' || CAST(o_custkey % 4 AS STRING) AS profile,
               CASE WHEN o_custkey % 4 = 3 THEN 'anthropic_messages'
                    WHEN o_orderkey % 101 = 0 THEN 'other' ELSE 'openai_responses' END AS protocol,
               o_custkey AS customer, @US[o_orderdate] AS started_us,
               CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE 'model-' || CAST(o_custkey % 3 AS STRING) END AS model,
               CASE WHEN o_orderkey % 17 = 0 THEN 'GET' ELSE 'POST' END AS method,
               CASE WHEN o_orderkey % 19 = 0 THEN '/v1/models'
                    WHEN o_orderkey % 23 = 0 THEN '/v1/messages/count_tokens'
                    WHEN o_custkey % 4 = 3 THEN '/v1/messages'
                    WHEN o_orderkey % 29 = 0 THEN '' ELSE '/v1/responses' END AS endpoint,
               CASE o_orderstatus WHEN 'F' THEN 200 WHEN 'O' THEN 429 ELSE 302 END AS status,
               CASE WHEN o_orderkey % 31 = 0 THEN 'stream_truncated'
                    WHEN o_orderkey % 47 = 0 THEN 'client_canceled'
                    WHEN o_orderkey % 61 = 0 THEN 'transport_failure'
                    WHEN o_orderkey % 67 = 0 THEN 'odd' ELSE NULL END AS event,
               CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 37 = 0 THEN 'custom'
                    WHEN o_custkey % 4 = 3 THEN 'anthropic_messages' ELSE 'openai_responses' END AS usage_source,
               CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey % 1000 END AS input_tokens,
               CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 70 END AS cache_creation_input_tokens,
               CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderkey % 1100 END AS cache_read_input_tokens,
               CASE WHEN o_orderkey % 43 = 0 THEN NULL ELSE o_orderkey % 90 END AS output_tokens,
               CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_orderkey % 20 END AS reasoning_output_tokens,
               CASE WHEN o_orderkey % 9 = 0 THEN o_orderkey % 2000 ELSE NULL END AS total_input_tokens,
               CASE WHEN o_orderkey % 8 = 0 THEN o_orderkey % 3000 ELSE NULL END AS total_tokens
        FROM orders""",
    # Components of captured requests, several per request, some repeated.
    "request_parts": """
        SELECT 'gw-' || CAST(100000000000 + l_orderkey AS STRING) AS exchange_id,
               'p' || CAST(l_partkey % 4 AS STRING) AS profile,
               CAST(l_linenumber AS BIGINT) * 1000 + l_suppkey AS position,
               CASE l_partkey % 9 WHEN 0 THEN 'instructions' WHEN 1 THEN 'user_prompt' WHEN 2 THEN 'history'
                    WHEN 3 THEN 'file' WHEN 4 THEN 'tool_result' WHEN 5 THEN 'tool_definition'
                    WHEN 6 THEN 'other' WHEN 7 THEN 'unknown' ELSE 'file' END AS kind,
               CASE l_partkey % 9 WHEN 3 THEN ' /src//f' || CAST(l_suppkey % 5 AS STRING) || '/./x '
                    WHEN 8 THEN 'a/../f' || CAST(l_suppkey % 5 AS STRING) ELSE '' END AS path,
               'h' || CAST(l_partkey % 7 AS STRING) AS content_hash,
               CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE CAST(floor(l_quantity) AS BIGINT) END AS tokens,
               CASE WHEN l_suppkey % 7 = 0 THEN 'unknown' WHEN l_suppkey % 7 = 1 THEN 'counted'
                    WHEN l_suppkey % 7 = 2 THEN 'derived' WHEN l_suppkey % 7 < 5 THEN 'measured'
                    ELSE 'estimated' END AS tokens_kind
        FROM lineitem""",
    # Calls of agents: 16 calls per lane, linked by response id, tool ids or
    # growing context, with breaks where the link is lost.
    "calls": """
        SELECT id, num, profile, protocol, started_us, model, start_shape,
               CASE WHEN variant = 0 THEN 'r' || c || CAST(j AS STRING) ELSE '' END AS response_id,
               CASE WHEN variant = 0 THEN 'r' || c || CAST(j - 1 AS STRING) ELSE '' END AS previous_response_id,
               CASE WHEN variant = 1 THEN @SPLIT[c || replace(substr(letters, 1, 2 * j + 1), ',', ',' || c)] END AS tool_offers,
               CASE WHEN variant = 1 AND j > 0
                    THEN @SPLIT[c || replace(substr(letters, 1, 2 * j - 1), ',', ',' || c)] END AS tool_asks,
               CASE WHEN variant = 2 THEN @SPLIT[c || replace(substr(letters, 1, 2 * j + 1), ',', ',' || c)] END AS lineage,
               variant, lane, island, j
        FROM (SELECT *, 'b' || CAST(block AS STRING) || '-' || CAST(lane AS STRING) || '-' || CAST(island AS STRING) || '-' AS c,
                     'a,b,c,d,e,f,g,h,i,j,k,l,m,n,o,p' AS letters
              FROM (SELECT 'gw-' || CAST(100000000000 + event_id AS STRING) AS id, event_id AS num,
                           'p' || CAST(event_id % 4 AS STRING) AS profile,
                           CASE WHEN (event_id @DIV@ 64) % 3 = 0 THEN 'openai_responses'
                                ELSE 'anthropic_messages' END AS protocol,
                           ts_us AS started_us,
                           CASE WHEN event_id % 11 = 0 THEN ''
                                ELSE 'model-' || CAST((event_id @DIV@ 64) % 4 AS STRING) END AS model,
                           event_id % 3 <> 0 AS start_shape, event_id @DIV@ 64 AS block, event_id % 4 AS lane,
                           CAST((event_id @DIV@ 4) % 16 AS INT) AS j, (event_id @DIV@ 64) % 3 AS variant,
                           CASE WHEN (event_id @DIV@ 64) % 2 = 0 AND (event_id @DIV@ 4) % 16 >= 5 THEN 1 ELSE 0 END +
                           CASE WHEN (event_id @DIV@ 64) % 5 = 0 AND (event_id @DIV@ 4) % 16 >= 9 THEN 1 ELSE 0 END AS island
                    FROM ev) a) b""",
    # What each call sent and used.
    "call_facts": """
        SELECT 'gw-' || CAST(100000000000 + event_id AS STRING) AS id,
               CASE WHEN event_id % 83 = 0 THEN NULL ELSE v * 10 + event_id % 50 END AS attributed,
               CASE WHEN event_id % 83 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 'estimated' ELSE 'measured' END
                 AS attributed_kind,
               CASE WHEN event_id % 12 = 0 THEN NULL ELSE v END AS tool_result,
               CASE WHEN event_id % 12 = 0 THEN NULL ELSE 'estimated' END AS tool_result_kind,
               v * 9 AS history, 'estimated' AS history_kind,
               CAST(NULL AS BIGINT) AS tool_definition, CAST(NULL AS STRING) AS tool_definition_kind,
               CASE WHEN event_id % 45 = 0 THEN NULL ELSE v * 12 END AS total_input,
               CASE WHEN event_id % 45 = 0 THEN NULL ELSE k END AS cached_input,
               CASE WHEN event_id % 45 = 0 OR event_id % 46 = 0 THEN NULL ELSE v END AS fresh_input,
               CAST(NULL AS BIGINT) AS cache_creation_input,
               CASE WHEN event_id % 45 = 0 THEN NULL ELSE k * 2 END AS output,
               CASE WHEN event_id % 45 = 0 OR event_id % 7 = 0 THEN NULL ELSE k END AS reasoning_output
        FROM ev""",
    # Stream events of a response: one exchange per user and day.
    "frames": """
        SELECT 'x' || CAST(user_id AS STRING) || '-' || CAST(ts_us @DIV@ 86400000000 AS STRING) AS exchange_id,
               event_id AS seq,
               CASE WHEN user_id % 2 = 0 THEN 'anthropic_messages' ELSE 'openai_responses' END AS protocol,
               CASE WHEN k % 10 = 9 THEN '[DONE]'
                    WHEN k % 10 = 8 THEN '{"type":"broken'
                    WHEN user_id % 2 = 0 THEN
                      CASE k % 10
                        WHEN 0 THEN '{"type":"message_start","message":{"id":"m' || CAST(k AS STRING) ||
                             '","usage":{"input_tokens":' || CAST(v AS STRING) || ',"cache_read_input_tokens":' ||
                             CAST(k AS STRING) || '}}}'
                        WHEN 1 THEN '{"type":"message_stop"}'
                        WHEN 2 THEN '{"type":"ping","usage":{"output_tokens":999999}}'
                        ELSE '{"type":"message_delta","usage":{"output_tokens":' || CAST(v AS STRING) || '}}' END
                    ELSE
                      CASE k % 10
                        WHEN 0 THEN '{"type":"response.created","response":{"id":"r' || CAST(k AS STRING) || '"}}'
                        WHEN 1 THEN '{"type":"response.completed"}'
                        WHEN 2 THEN '{"type":"response.usage","usage":{"total_tokens":' || CAST(v AS STRING) ||
                             ',"input_tokens_details":{"cached_tokens":' || CAST(k AS STRING) || '}}}'
                        ELSE '{"type":"delta","usage":{"input_tokens":' || CAST(k AS STRING) ||
                             ',"output_tokens":' || CAST(v AS STRING) || '}}' END END AS payload
        FROM ev""",
    # Recorder failures by profile, with lines of other profiles and bad lines.
    "failures": """
        SELECT event_type AS journal, event_id AS line,
               CASE WHEN event_id % 40 = 0 THEN 'not json'
                    ELSE '{"schemaVersion":1,"profile":"' ||
                         CASE WHEN event_id % 10 = 0 THEN '' WHEN event_id % 10 = 1 THEN 'elsewhere'
                              ELSE event_type END ||
                         '","operation":"record","exchangeId":"e' || CAST(event_id AS STRING) || '"}' END AS raw
        FROM ev""",
    # Shell commands that read files.
    "shell_commands": """
        SELECT 'p' || CAST(page_id AS STRING) AS record, page_id AS ord,
               CASE page_id % 4 WHEN 0 THEN 'exec_command' WHEN 1 THEN 'functions.exec_command'
                    WHEN 2 THEN 'exec_command' ELSE 'write_stdin' END AS tool_name,
               CASE page_id % 5 WHEN 0 THEN 'cat ' WHEN 1 THEN 'sed -n ' WHEN 2 THEN '  head   -5 '
                    WHEN 3 THEN 'tail ' ELSE 'ls ' END ||
               'src//mod' || CAST(page_id % 7 AS STRING) || '/./a.go ../x.txt plain key=/v ''q/q'' ' ||
               '/srv/' || CAST(page_id % 3 AS STRING) || '/../etc/' AS cmd
        FROM pages""",
}

# Which twin a twin reads, besides the shared tables.
DEPENDS = {
    "context": ("components",),
    "context_turns": ("context",),
    "context_sessions": ("context",),
    **{name: ("ev",) for name in (
        "counters", "messages", "tool_results", "tool_links", "usage_events", "observations",
        "priced", "frames", "failures", "calls", "call_facts")},
}

_SPARK = {"US": r"unix_micros(CAST(\1 AS TIMESTAMP))", "BYTES": r"octet_length(\1)", "SHA": r"sha2(\1, 256)", "SPLIT": r"split(\1, ',')", "DIV": "div"}
_DUCK = {"US": r"epoch_us(\1)", "BYTES": r"strlen(\1)", "SHA": r"sha256(\1)", "SPLIT": r"string_split(\1, ',')", "DIV": "//"}


def _dialect(sql: str, terms: dict[str, str]) -> str:
    for name in ("US", "BYTES", "SHA", "SPLIT"):
        sql = re.sub(rf"@{name}\[([^\]]*)\]", terms[name], sql)
    return sql.replace("@DIV@", terms["DIV"])


def _closure(names: tuple[str, ...]) -> list[str]:
    ordered: list[str] = []
    for name in names:
        for needed in (*_closure(DEPENDS.get(name, ())), name):
            if needed not in ordered:
                ordered.append(needed)
    return ordered


def ctes(*names: str) -> str:
    """The twins as DuckDB common table expressions (without WITH)."""
    return ",\n".join(f"{n} AS ({_dialect(TWINS[n], _DUCK)})" for n in _closure(names))


def duck(body: str) -> str:
    """The expression part of an oracle in DuckDB's terms."""
    return _dialect(body, _DUCK)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def twin(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived domain table as a lazy DataFrame."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    sql = _dialect(TWINS[name], _SPARK)
    sources = {}
    for base in (*BASE_TABLES, "lineitem"):
        if re.search(rf"FROM {base}\b", sql):
            sources[base] = table(spark, sf_dir, base)
    for needed in DEPENDS.get(name, ()):
        sources[needed] = twin(spark, sf_dir, needed)
    for key in sources:
        sql = re.sub(rf"FROM {key}\b", f"FROM __{key}__", sql)
    sql = sql.replace("{", "{{").replace("}", "}}")
    for key in sources:
        sql = sql.replace(f"__{key}__", f"{{{key}}}")
    return spark.sql(sql, **sources)
