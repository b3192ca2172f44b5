"""Registered queries: context attribution, coverage, rules, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from usagelake.functions import text
from usagelake.operators import context, coverage, rules
from usagelake.plans.registry import query
from usagelake.plans.twins import table, twin

TURN = ["source", "session_id", "turn_sequence"]


def _turns(spark, sf_dir):
    turns = twin(spark, sf_dir, "context_turns")
    rest = [c for c in turns.columns]
    return turns.select(*rest, *context.counter_fresh_input())


@query("p8_transcript_dedup", ("context",), """
SELECT session_id, turn_sequence, ord, kind, record, path FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id, turn_sequence, kind, source, record, path ORDER BY ord) AS rn
  FROM context) q WHERE rn = 1""")
def p8(spark, sf_dir):
    return context.dedup_components(twin(spark, sf_dir, "context")).select(
        "session_id", "turn_sequence", "ord", "kind", "record", "path")


@query("p9_turn_assignment", ("usage_events",), """
SELECT session_id, ord, CASE WHEN t <= n THEN t END AS turn_sequence FROM (
  SELECT session_id, ord,
         1 + count(*) FILTER (closes_turn) OVER (PARTITION BY session_id ORDER BY ord
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS t,
         count(*) FILTER (closes_turn) OVER (PARTITION BY session_id) AS n FROM usage_events) q""")
def p9(spark, sf_dir):
    return context.assign_turns(twin(spark, sf_dir, "usage_events")).select("session_id", "ord", "turn_sequence")


@query("w5_turn_islands", ("usage_events",), """
SELECT session_id, turn_sequence, count(*) AS records, min(ord) AS first_ord, max(ord) AS last_ord FROM (
  SELECT session_id, ord, CASE WHEN t <= n THEN t END AS turn_sequence FROM (
    SELECT session_id, ord,
           1 + count(*) FILTER (closes_turn) OVER (PARTITION BY session_id ORDER BY ord
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS t,
           count(*) FILTER (closes_turn) OVER (PARTITION BY session_id) AS n FROM usage_events) q) z
GROUP BY session_id, turn_sequence""")
def w5(spark, sf_dir):
    placed = context.assign_turns(twin(spark, sf_dir, "usage_events"))
    return placed.groupBy("session_id", "turn_sequence").agg(
        F.count("*").alias("records"), F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"))


@query("p6_tool_call_linking", ("tool_links",), """
SELECT r.session_id, r.ord, r.call_id, c.name AS tool_name, c.fingerprint AS tool_call_fingerprint
FROM tool_links r LEFT JOIN tool_links c
  ON r.call_id <> '' AND c.role = 'call' AND c.name <> '' AND c.session_id = r.session_id
     AND c.call_id = r.call_id AND c.ord < r.ord
WHERE r.role = 'result'
QUALIFY row_number() OVER (PARTITION BY r.session_id, r.ord ORDER BY c.ord DESC NULLS LAST) = 1""")
def p6(spark, sf_dir):
    return context.link_calls(twin(spark, sf_dir, "tool_links"))


@query("j1_calls_with_results", ("tool_links",), """
SELECT r.session_id, c.name AS tool_name, count(*) AS results
FROM tool_links r ASOF JOIN (SELECT * FROM tool_links WHERE role = 'call' AND name <> '' AND call_id <> '') c
  ON c.session_id = r.session_id AND c.call_id = r.call_id AND r.ord > c.ord
WHERE r.role = 'result' AND r.call_id <> '' GROUP BY r.session_id, c.name""")
def j1(spark, sf_dir):
    linked = context.link_calls(twin(spark, sf_dir, "tool_links")).where("tool_name IS NOT NULL")
    return linked.groupBy("session_id", "tool_name").agg(F.count("*").alias("results"))


ATTRIBUTED = """
a AS (SELECT source, session_id, turn_sequence,
             sum(tokens) FILTER (tokens_kind IN ('counted', 'estimated')) AS attributed,
             CASE WHEN count(*) FILTER (tokens_kind = 'estimated') > 0 THEN 'estimated'
                  WHEN count(*) FILTER (tokens_kind = 'counted') > 0 THEN 'counted' END AS attributed_kind
      FROM context GROUP BY source, session_id, turn_sequence)
"""


@query("a9_attribution_sum", ("context",), "WITH " + ATTRIBUTED + """
SELECT source, session_id, turn_sequence, CAST(attributed AS BIGINT) AS attributed, attributed_kind FROM a""")
def a9(spark, sf_dir):
    return context.attribution(twin(spark, sf_dir, "context"), TURN)


@query("a8_turn_categories", ("context",), """
SELECT source, session_id, turn_sequence, kind,
       CAST(sum(tokens) FILTER (tokens_kind IN ('counted', 'estimated')) AS BIGINT) AS attributed,
       CASE WHEN count(*) FILTER (tokens_kind = 'estimated') > 0 THEN 'estimated'
            WHEN count(*) FILTER (tokens_kind = 'counted') > 0 THEN 'counted' ELSE 'unknown' END AS attributed_kind
FROM context GROUP BY source, session_id, turn_sequence, kind""")
def a8_turn(spark, sf_dir):
    return context.category_breakdown(twin(spark, sf_dir, "context"), TURN)


FRESH = """
f AS (SELECT *, CASE WHEN input IS NOT NULL AND cached IS NOT NULL THEN input - cached
                     WHEN input IS NOT NULL AND cached IS NULL THEN input END AS fresh,
             CASE WHEN input IS NOT NULL AND cached IS NOT NULL THEN input_kind
                  WHEN cached IS NOT NULL THEN 'unknown' ELSE input_kind END AS fresh_kind FROM context_turns)
"""


@query("a10_fresh_coverage", ("context_turns",), "WITH " + ATTRIBUTED + "," + FRESH + """,
j AS (SELECT f.*, attributed, attributed_kind,
             fresh IS NOT NULL AND fresh_kind <> 'estimated' AND attributed IS NOT NULL AS ok
      FROM f LEFT JOIN a USING (source, session_id, turn_sequence))
SELECT source, session_id, turn_sequence, fresh, fresh_kind,
       CASE WHEN ok THEN CAST(attributed AS BIGINT) END AS attributed,
       CASE WHEN ok THEN attributed_kind ELSE 'unknown' END AS attributed_kind,
       CASE WHEN ok THEN CAST(greatest(fresh - attributed, 0) AS BIGINT) END AS unattributed,
       CASE WHEN ok THEN CASE WHEN fresh > 0 THEN CAST(attributed AS DOUBLE) / fresh ELSE 0 END END AS coverage,
       ok AND fresh < attributed AS conflict FROM j""")
def a10(spark, sf_dir):
    return context.fresh_coverage(_turns(spark, sf_dir), twin(spark, sf_dir, "context"), TURN)


@query("a11_file_attribution", ("context",), """
SELECT source, session_id, path, CAST(sum(tokens) AS BIGINT) AS tokens,
       CASE WHEN count(*) FILTER (tokens_kind = 'estimated') > 0 THEN 'estimated'
            WHEN count(*) FILTER (tokens_kind = 'counted') > 0 THEN 'counted' ELSE 'measured' END AS tokens_kind
FROM context WHERE kind = 'file' AND path <> '' AND tokens IS NOT NULL GROUP BY source, session_id, path""")
def a11(spark, sf_dir):
    return context.file_attribution(twin(spark, sf_dir, "context"), ["source", "session_id"])


@query("t4_top_files", ("context",), """
SELECT session_id, ord, path, tokens, position FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY coalesce(tokens, 0) DESC, path, ord) AS position
  FROM context WHERE kind = 'file' AND path <> '') q WHERE position <= 5""")
def t4(spark, sf_dir):
    return context.top_files(twin(spark, sf_dir, "context"), ["session_id"]).select(
        "session_id", "ord", "path", "tokens", "position")


@query("s8_redacted_components", ("context",), """
SELECT session_id, ord, kind, tokens, '' AS content_hash FROM context""")
def s8(spark, sf_dir):
    return context.redact(twin(spark, sf_dir, "context")).select("session_id", "ord", "kind", "tokens", "content_hash")


@query("p4_shell_file_reads", ("shell_commands",), """
WITH c AS (SELECT record, regexp_split_to_array(trim(cmd), '\\s+') AS words FROM shell_commands
           WHERE tool_name IN ('exec_command', 'functions.exec_command')),
w AS (SELECT record, unnest(list_filter(words[2:], lambda x: NOT starts_with(x, '-') AND NOT contains(x, '=')
             AND NOT regexp_matches(x, '[''"{}]') AND (contains(x, '/') OR contains(x, '.')))) AS word,
             generate_subscripts(list_filter(words[2:], lambda x: NOT starts_with(x, '-') AND NOT contains(x, '=')
             AND NOT regexp_matches(x, '[''"{}]') AND (contains(x, '/') OR contains(x, '.'))), 1) AS position
      FROM c WHERE words[1] IN ('cat', 'sed', 'nl', 'awk', 'head', 'tail'))
SELECT record || '#file:' || CAST(position AS VARCHAR) AS record, position,
       CASE WHEN word LIKE '/srv/%' THEN '/srv/etc' WHEN word LIKE 'src//%' THEN replace(replace(word, '//', '/'), '/./', '/')
            ELSE word END AS path, 'unknown' AS tokens_kind FROM w""")
def p4(spark, sf_dir):
    return context.read_files(twin(spark, sf_dir, "shell_commands")).select("record", "position", "path", "tokens_kind")


# ------------------------------------------------------------------ coverage

def _scope_sql(scope: str, where: str = "") -> str:
    keys = {"session": "source, session_id", "source": "source", "all": "scope"}[scope]
    extra = ", 'all' AS scope" if scope == "all" else ""
    return "WITH " + FRESH + f""",
l AS (SELECT source, session_id, turn_sequence, fresh IS NOT NULL AND fresh_kind <> 'estimated' AS linked FROM f),
c AS (SELECT c.*, coalesce(l.linked, false) AS linked, kind = 'tool_result' AS out,
             coalesce(completeness IN ('truncated', 'unavailable'), false) AS bad{extra}
      FROM context c LEFT JOIN l USING (source, session_id, turn_sequence)),
s AS (SELECT {keys}, count(*) AS sessions FROM (SELECT *{extra} FROM context_sessions) q GROUP BY {keys}),
t AS (SELECT {keys}, count(*) AS turns FROM (SELECT *{extra} FROM context_turns) q GROUP BY {keys}),
g AS (SELECT {keys}, count(*) FILTER (out) AS tool_outputs,
  count(content_bytes) FILTER (out) AS with_content_bytes,
  count(*) FILTER (out AND tokens IS NOT NULL AND tokens_kind = 'estimated') AS with_estimated_tokens,
  count(*) FILTER (out AND tool_call_id <> '') AS with_tool_call_id,
  count(*) FILTER (out AND tool_name <> '') AS with_tool_name,
  count(*) FILTER (out AND linked) AS with_fresh_input,
  count(*) FILTER (out AND completeness = 'complete') AS complete,
  count(*) FILTER (out AND completeness = 'truncated') AS truncated,
  count(*) FILTER (out AND completeness = 'unavailable') AS unavailable,
  count(*) FILTER (out AND completeness IS NULL) AS unknown,
  count(*) FILTER (out AND turn_sequence IS NULL) AS trailing,
  count(*) FILTER (bad) AS unreadable_records,
  count(DISTINCT session_id) FILTER (bad) AS unreadable_sessions,
  CAST(sum(tokens) FILTER (out AND tokens_kind = 'estimated') AS BIGINT) AS estimated_tokens,
  CAST(coalesce(sum(content_bytes) FILTER (out), 0) AS BIGINT) AS bytes_total,
  min(content_bytes) FILTER (out) AS bytes_min,
  quantile_disc(content_bytes, 0.5) FILTER (out) AS bytes_p50,
  quantile_disc(content_bytes, 0.9) FILTER (out) AS bytes_p90,
  quantile_disc(content_bytes, 0.95) FILTER (out) AS bytes_p95,
  max(content_bytes) FILTER (out) AS bytes_max
  FROM c GROUP BY {keys})
SELECT {keys}, sessions, coalesce(turns, 0) AS turns, g.* EXCLUDE ({keys}),
  CASE WHEN tool_outputs > 0 THEN CAST(with_content_bytes AS DOUBLE) / tool_outputs END AS content_bytes_ratio,
  CASE WHEN tool_outputs > 0 THEN CAST(with_estimated_tokens AS DOUBLE) / tool_outputs END AS estimated_tokens_ratio,
  CASE WHEN tool_outputs > 0 THEN CAST(with_tool_call_id AS DOUBLE) / tool_outputs END AS tool_call_id_ratio,
  CASE WHEN tool_outputs > 0 THEN CAST(with_tool_name AS DOUBLE) / tool_outputs END AS tool_name_ratio,
  CASE WHEN tool_outputs > 0 THEN CAST(with_fresh_input AS DOUBLE) / tool_outputs END AS fresh_input_ratio,
  CASE WHEN estimated_tokens IS NOT NULL THEN 'estimated' ELSE 'unknown' END AS estimated_tokens_kind,
  with_content_bytes AS bytes_samples
FROM s LEFT JOIN t USING ({keys}) LEFT JOIN g USING ({keys})"""


def _coverage(scope):
    def run(spark, sf_dir):
        return coverage.coverage(
            _turns(spark, sf_dir), twin(spark, sf_dir, "context"), twin(spark, sf_dir, "context_sessions"), scope)
    return run


for _scope in ("session", "source", "all"):
    query(f"a14_coverage_{_scope}", ("context_turns", "context_sessions"), _scope_sql(_scope))(_coverage(_scope))


@query("a15_nearest_rank", ("ev",), """
SELECT event_type, count(v) AS samples, CAST(sum(v) AS BIGINT) AS total, min(v) AS min,
       quantile_disc(v, 0.5) AS p50, quantile_disc(v, 0.9) AS p90, quantile_disc(v, 0.95) AS p95, max(v) AS max
FROM ev GROUP BY event_type""")
def a15(spark, sf_dir):
    return coverage.nearest_rank(twin(spark, sf_dir, "ev"), ["event_type"], "v")


@query("f5_unsupported_sources", ("messages",), """
SELECT DISTINCT lower(source) AS source,
       'tool output coverage not supported for ' || lower(source) || ': source does not report tool output' AS reason
FROM messages WHERE lower(source) NOT IN ('codex', 'claude')""")
def f5(spark, sf_dir):
    return coverage.unsupported_sources(twin(spark, sf_dir, "messages"))


# --------------------------------------------------------------------- rules

def _with_turns(components):
    """Components whose turns are named after their session."""
    return components.withColumn("turn_id", F.concat_ws("/", "session_id", "turn_sequence"))


@query("r1_oversized_output", ("context",), """
SELECT session_id, 'TOOL001' AS rule_id, CASE WHEN content_bytes >= 262144 THEN 'high' ELSE 'medium' END AS severity,
       CASE WHEN tool_name <> '' THEN tool_name ELSE 'Tool' END || ' returned an oversized output' AS title,
       'The transcript contains a complete tool output of ' || CAST(content_bytes AS VARCHAR) ||
       ' bytes. Its token contribution is ' || CASE WHEN tokens_kind = 'estimated'
       THEN 'estimated, not provider-reported.' ELSE 'unavailable.' END AS description,
       tokens AS estimated_tokens, session_id || '/' || CAST(turn_sequence AS VARCHAR) AS turn_id, turn_sequence, ord, content_bytes,
       'Limit the command scope, filter the result, or read the output in smaller relevant sections.' AS recommendation
FROM context WHERE kind = 'tool_result' AND completeness = 'complete' AND turn_sequence IS NOT NULL
  AND content_bytes > 4096""")
def r1(spark, sf_dir):
    # The shared texts stay below the default threshold, so a lower one is asked for.
    return rules.oversized_output(_with_turns(twin(spark, sf_dir, "context")), max_bytes=4096).select(
        "session_id", "rule_id", "severity", "title", "description", "estimated_tokens", "turn_id", "turn_sequence", "ord",
        "content_bytes", "recommendation")


REPEATS = """
o AS (SELECT * FROM tool_results WHERE kind = 'tool_result' AND completeness = 'complete' AND turn_sequence IS NOT NULL
        AND tool_call_id <> '' AND tool_name <> '' AND tool_call_fingerprint <> '' AND content_hash <> ''
      QUALIFY row_number() OVER (PARTITION BY session_id, tool_name, tool_call_fingerprint, content_hash, tool_call_id
                                 ORDER BY turn_sequence, ord) = 1),
p AS (SELECT *, row_number() OVER (PARTITION BY session_id, tool_name, tool_call_fingerprint, content_hash
                                   ORDER BY turn_sequence, ord) AS place FROM o),
g AS (SELECT session_id, tool_name, tool_call_fingerprint, content_hash, count(*) AS occurrences,
             CAST(sum(tokens) FILTER (place > 1) AS BIGINT) AS est, count(tokens) FILTER (place > 1) AS known,
             min_by(turn_sequence, place) AS turn_sequence, min_by(ord, place) AS ord
      FROM p GROUP BY ALL HAVING count(*) >= 2)
"""


@query("r2_repeated_calls", ("tool_results",), "WITH " + REPEATS + """
SELECT session_id, 'TOOL002' AS rule_id, occurrences, est AS estimated_tokens,
       CASE WHEN known > 0 THEN 'estimated' ELSE 'unknown' END AS estimated_tokens_kind,
       session_id || '/' || CAST(turn_sequence AS VARCHAR) AS turn_id, turn_sequence, ord,
       'Reuse the earlier result when it is still valid, or narrow later calls to request only new information.' AS recommendation,
       tool_name || ' appears to have been called ' || CAST(occurrences AS VARCHAR) ||
       ' times with the same arguments, and every complete result had the same content. The first occurrence is the baseline and the '
       || CAST(occurrences - 1 AS VARCHAR) || ' later ones are repeated calls. ' ||
       CASE WHEN known = 0 THEN 'Their repeated tool output could not be sized, so its token contribution is unavailable.'
            WHEN known = occurrences - 1 THEN 'Their estimated repeated tool output is ' || CAST(est AS VARCHAR) ||
                 ' tokens: a potential context contribution, not measured waste.'
            ELSE 'The observed portion of their repeated tool output is at least ' || CAST(est AS VARCHAR) ||
                 ' estimated tokens across ' || CAST(known AS VARCHAR) || ' of ' || CAST(occurrences - 1 AS VARCHAR) ||
                 ' repeated results; the remaining ' || CASE WHEN occurrences - 1 - known = 1 THEN 'result has'
                 ELSE CAST(occurrences - 1 - known AS VARCHAR) || ' results have' END || ' no token estimate.' END AS description
FROM g""")
def r2(spark, sf_dir):
    return rules.repeated_calls(_with_turns(twin(spark, sf_dir, "tool_results"))).select(
        "session_id", "rule_id", "occurrences", "estimated_tokens", "estimated_tokens_kind", "turn_id", "turn_sequence", "ord",
        "recommendation", "description")


@query("a24_repeated_call_evidence", ("tool_results",), "WITH " + REPEATS + """
SELECT p.session_id, p.tool_name, g.ord AS finding_ord, p.turn_sequence, p.ord, p.tool_call_id, p.content_bytes, p.tokens
FROM p JOIN g USING (session_id, tool_name, tool_call_fingerprint, content_hash)""")
def a24(spark, sf_dir):
    return rules.repeated_call_evidence(twin(spark, sf_dir, "tool_results")).select(
        "session_id", "tool_name", "finding_ord", "turn_sequence", "ord", "tool_call_id", "content_bytes", "tokens")


@query("r3_analysis", ("tool_results",), "WITH " + REPEATS + """,
r AS (SELECT session_id, count(*) AS n FROM (
        SELECT session_id FROM g UNION ALL
        SELECT session_id FROM tool_results WHERE kind = 'tool_result' AND completeness = 'complete'
           AND turn_sequence IS NOT NULL AND content_bytes > 65536) q GROUP BY session_id)
SELECT s.session_id, coalesce(n, 0) AS findings, CASE WHEN coalesce(n, 0) = 0 THEN 'healthy' ELSE 'findings' END AS status,
       CASE WHEN coalesce(n, 0) = 0 THEN 'No token-efficiency findings detected.'
            ELSE 'Found ' || CAST(n AS VARCHAR) || ' token-efficiency issue(s).' END AS message
FROM (SELECT DISTINCT session_id FROM tool_results) s LEFT JOIN r USING (session_id)""")
def r3(spark, sf_dir):
    results = twin(spark, sf_dir, "tool_results")
    return rules.analysis(results.select("session_id").distinct(), rules.findings(results))


# ---------------------------------------------------------- scalar functions

@query("x1_token_estimate", (), """
SELECT doc_id, CASE WHEN length(text) > 0 THEN (length(text) + 3) // 4 END AS tokens,
       CASE WHEN length(text) > 0 THEN 'estimated' ELSE 'unknown' END AS tokens_kind FROM documents""")
def x1(spark, sf_dir):
    body = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.token_estimate(body).alias("tokens"), text.token_estimate_kind(body).alias("tokens_kind"))


@query("x2_content_hash", (), """
SELECT doc_id, CASE WHEN length(text) > 0 THEN 'sha256:' || sha256(text) ELSE '' END AS content_hash FROM documents""")
def x2(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))


@query("x6_case_insensitive_models", ("priced",), """
SELECT lower(trim(model)) AS model, count(*) AS turns FROM priced GROUP BY 1""")
def x6(spark, sf_dir):
    return twin(spark, sf_dir, "priced").groupBy(text.fold(F.col("model")).alias("model")).agg(
        F.count("*").alias("turns"))


@query("x7_path_normalise", ("request_parts",), """
SELECT CASE WHEN path = '' THEN '' WHEN path LIKE ' /src%' THEN '/src/' || substr(path, 8, 2) || '/x'
            ELSE substr(path, 6) END AS path, count(*) AS parts FROM request_parts GROUP BY 1""")
def x7(spark, sf_dir):
    return twin(spark, sf_dir, "request_parts").groupBy(text.clean_path(F.col("path")).alias("path")).agg(
        F.count("*").alias("parts"))


@query("x9_provider_model_split", ("priced",), """
SELECT CASE WHEN model LIKE '%/%' THEN split_part(model, '/', 1) ELSE '' END AS provider,
       CASE WHEN model LIKE '%/%' THEN split_part(model, '/', 2) ELSE model END AS model, count(*) AS turns
FROM priced GROUP BY 1, 2""")
def x9(spark, sf_dir):
    model = F.col("model")
    return twin(spark, sf_dir, "priced").groupBy(
        text.provider_of(model).alias("provider"), text.model_of(model).alias("model")).agg(F.count("*").alias("turns"))
