"""Registered queries: captured calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from usagelake.operators import context, gateway, observations
from usagelake.plans.registry import query
from usagelake.plans.twins import twin

KIND = """
kinds AS (SELECT *, CASE
   WHEN protocol IN ('anthropic_messages', 'openai_responses') AND method = 'POST' AND (
        (protocol = 'anthropic_messages' AND endpoint = '/v1/messages')
     OR (protocol = 'openai_responses' AND endpoint IN ('/responses', '/v1/responses'))) THEN 'model'
   WHEN protocol NOT IN ('anthropic_messages', 'openai_responses') OR endpoint = '' THEN 'unclassified'
   WHEN (protocol = 'anthropic_messages' AND endpoint = '/v1/messages/count_tokens')
     OR (protocol = 'openai_responses' AND endpoint IN ('/models', '/v1/models')) THEN 'non_model'
   ELSE '' END AS kind,
   CASE WHEN event IN ('stream_truncated', 'client_canceled', 'transport_failure') THEN event
        WHEN status BETWEEN 200 AND 399 THEN 'upstream_ok' ELSE 'upstream_http_error' END AS outcome,
   coalesce(usage_source = 'anthropic_messages', false) AS am, coalesce(usage_source = 'openai_responses', false) AS or_,
   method IN ('', 'POST') AND ((protocol = 'anthropic_messages' AND endpoint = '/v1/messages')
     OR (protocol = 'openai_responses' AND endpoint IN ('/responses', '/v1/responses'))) AS call FROM (SELECT * REPLACE (CASE WHEN usage_source IS NOT NULL THEN input_tokens END AS input_tokens, CASE WHEN usage_source IS NOT NULL THEN cache_creation_input_tokens END AS cache_creation_input_tokens, CASE WHEN usage_source IS NOT NULL THEN cache_read_input_tokens END AS cache_read_input_tokens, CASE WHEN usage_source IS NOT NULL THEN output_tokens END AS output_tokens, CASE WHEN usage_source IS NOT NULL THEN reasoning_output_tokens END AS reasoning_output_tokens, CASE WHEN usage_source IS NOT NULL THEN total_input_tokens END AS total_input_tokens, CASE WHEN usage_source IS NOT NULL THEN total_tokens END AS total_tokens) FROM exchanges) x)
"""
NORM = """
n1 AS (SELECT *, CASE WHEN am OR or_ THEN coalesce(cache_read_input_tokens, 0) ELSE 0 END AS oc,
              CASE WHEN am THEN coalesce(cache_creation_input_tokens, 0) ELSE 0 END AS ow FROM kinds),
n2 AS (SELECT *, CASE WHEN am AND input_tokens IS NOT NULL THEN input_tokens + oc + ow
                      WHEN or_ THEN coalesce(total_input_tokens, input_tokens, 0)
                      ELSE coalesce(total_input_tokens, 0) END AS oti FROM n1),
norm AS (SELECT *, CASE WHEN am THEN coalesce(input_tokens, 0) WHEN or_ THEN greatest(0, oti - oc) ELSE 0 END AS fr,
                CASE WHEN am THEN oti + coalesce(output_tokens, 0)
                     WHEN or_ THEN coalesce(total_tokens, oti + coalesce(output_tokens, 0))
                     ELSE coalesce(total_tokens, 0) END AS ot,
                CASE WHEN or_ OR (am AND total_input_tokens IS NOT NULL) THEN 'measured' ELSE 'derived' END AS kti,
                CASE WHEN (am OR or_) AND total_tokens IS NOT NULL THEN 'measured' ELSE 'derived' END AS kt,
                CASE WHEN am OR or_ THEN 'measured' ELSE 'derived' END AS km FROM n2)
"""


def _exchanges(spark, sf_dir):
    return twin(spark, sf_dir, "exchanges").withColumns({
        "kind": gateway.request_kind(), "outcome": gateway.request_outcome()})


@query("p15_request_kind", ("exchanges",), "WITH " + KIND + "SELECT id, kind FROM kinds")
def p15(spark, sf_dir):
    return _exchanges(spark, sf_dir).select("id", "kind")


@query("p16_request_outcome", ("exchanges",), "WITH " + KIND + "SELECT id, outcome FROM kinds")
def p16(spark, sf_dir):
    return _exchanges(spark, sf_dir).select("id", "outcome")


@query("a22_usage_normalisation", ("exchanges",), "WITH " + KIND + "," + NORM + """
SELECT id, fr AS obs_fresh, oc AS obs_cached, ow AS obs_cache_creation, oti AS obs_total_input, ot AS obs_total,
       kti AS kind_total_input, kt AS kind_total, CASE WHEN am THEN 'measured' ELSE 'derived' END AS kind_fresh FROM norm""")
def a22(spark, sf_dir):
    return gateway.normalise_usage(_exchanges(spark, sf_dir)).select(
        "id", "obs_fresh", "obs_cached", "obs_cache_creation", "obs_total_input", "obs_total", "kind_total_input",
        "kind_total", "kind_fresh")


@query("p17_gateway_observations", ("exchanges",), "WITH " + KIND + "," + NORM + """
SELECT 'gateway:' || profile || ':' || id AS id, profile AS source, id AS exchange_id, started_us, model,
  CASE WHEN am THEN input_tokens WHEN or_ AND (input_tokens IS NOT NULL OR total_input_tokens IS NOT NULL)
       AND cache_read_input_tokens IS NOT NULL THEN fr END AS fresh_input,
  CASE WHEN am OR or_ THEN cache_read_input_tokens END AS cached_input,
  CASE WHEN am THEN cache_creation_input_tokens END AS cache_creation_input,
  CASE WHEN total_input_tokens IS NOT NULL THEN total_input_tokens WHEN am AND input_tokens IS NOT NULL THEN oti
       WHEN or_ THEN input_tokens END AS total_input,
  output_tokens AS output, reasoning_output_tokens AS reasoning_output,
  CASE WHEN total_tokens IS NOT NULL THEN total_tokens WHEN (am OR or_) AND output_tokens IS NOT NULL
       AND (input_tokens IS NOT NULL OR total_input_tokens IS NOT NULL) THEN ot END AS total,
  CASE outcome WHEN 'upstream_ok' THEN 'succeeded' WHEN 'upstream_http_error' THEN 'provider_error'
       WHEN 'transport_failure' THEN 'transport_failure' WHEN 'client_canceled' THEN 'canceled'
       WHEN 'stream_truncated' THEN 'truncated' ELSE 'unknown' END AS outcome,
  CASE WHEN outcome = 'stream_truncated' THEN 'partial' WHEN outcome <> 'upstream_ok' THEN 'complete'
       WHEN output_tokens IS NOT NULL AND ((am AND input_tokens IS NOT NULL)
         OR (or_ AND (input_tokens IS NOT NULL OR total_input_tokens IS NOT NULL))) THEN 'complete' ELSE 'partial' END
    AS completeness
FROM norm WHERE kind = 'model'""")
def p17_gateway(spark, sf_dir):
    calls = gateway.normalise_usage(_exchanges(spark, sf_dir))
    return observations.from_exchanges(calls).select(
        "id", "source", "exchange_id", "started_us", "model", "fresh_input", "cached_input", "cache_creation_input",
        "total_input", "output", "reasoning_output", "total", "outcome", "completeness")


@query("s9_capture_summary", ("exchanges",), """
SELECT profile, count(*) AS requests, max(started_us) AS last_request_us FROM exchanges GROUP BY profile""")
def s9(spark, sf_dir):
    return gateway.capture_summary(twin(spark, sf_dir, "exchanges"))


@query("s4_recorder_failures", ("failures",), """
SELECT journal AS profile, line, 'e' || CAST(line AS VARCHAR) AS exchange_id, position FROM (
  SELECT *, row_number() OVER (PARTITION BY journal ORDER BY line DESC) AS position FROM failures
  WHERE line % 40 <> 0 AND line % 10 <> 1) q WHERE position <= 1024""")
def s4(spark, sf_dir):
    newest, _ = gateway.read_failures(twin(spark, sf_dir, "failures"))
    return newest.select("profile", "line", "exchange_id", "position")


@query("s4_failure_counts", ("failures",), """
SELECT journal AS profile, count(*) AS recorder_failures, count(*) > 1024 AS truncated FROM failures
WHERE line % 40 <> 0 AND line % 10 <> 1 GROUP BY journal""")
def s4_counts(spark, sf_dir):
    return gateway.read_failures(twin(spark, sf_dir, "failures"))[1]


@query("f6_id_lookup", ("exchanges",), """
WITH w AS (SELECT DISTINCT substr(id, 1, CASE WHEN num % 3 = 0 THEN 15 WHEN num % 3 = 1 THEN 14 ELSE 12 END)
             || CASE WHEN num % 50 = 0 THEN 'x' ELSE '' END AS wanted FROM exchanges),
j AS (SELECT wanted, count(e.id) AS n, min(e.id) AS found, bool_or(e.id = wanted) AS exact
      FROM w LEFT JOIN exchanges e ON starts_with(e.id, wanted) GROUP BY wanted)
SELECT wanted, CASE WHEN exact OR n = 1 THEN 'found' WHEN n > 1 THEN 'ambiguous' ELSE 'not_found' END AS status,
       CASE WHEN exact THEN wanted WHEN n = 1 THEN found END AS found FROM j""")
def f6(spark, sf_dir):
    calls = twin(spark, sf_dir, "exchanges")
    n = F.col("num") % 3
    size = F.when(n == 0, 15).when(n == 1, 14).otherwise(12)
    wanted = calls.select(F.concat(F.substring(F.col("id"), F.lit(1), size),
                                   F.when(F.col("num") % 50 == 0, "x").otherwise("")).alias("wanted"))
    return gateway.find_by_id(calls, wanted)


@query("p12_request_dedup", ("request_parts",), """
SELECT exchange_id, position, kind, path, content_hash, tokens, tokens_kind FROM (
  SELECT *, row_number() OVER (PARTITION BY exchange_id, kind, path, content_hash
    ORDER BY position, tokens NULLS FIRST, tokens_kind) AS rn FROM request_parts) q WHERE rn = 1""")
def p12(spark, sf_dir):
    return _parts(spark, sf_dir).select(
        "exchange_id", "position", "kind", "path", "content_hash", "tokens", "tokens_kind")


def _parts(spark, sf_dir):
    return gateway.dedup_request_components(
        twin(spark, sf_dir, "request_parts"), order=["position", "tokens", "tokens_kind"])


PARTS = """
parts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY exchange_id, kind, path, content_hash
            ORDER BY position, tokens NULLS FIRST, tokens_kind) AS rn FROM request_parts) q WHERE rn = 1),
counted AS (SELECT *, tokens IS NOT NULL AND NOT (kind = 'tool_definition' AND tokens_kind = 'counted') AS ok,
             CASE tokens_kind WHEN 'measured' THEN 1 WHEN 'counted' THEN 2 WHEN 'derived' THEN 3 WHEN 'unknown' THEN 4
                  ELSE 5 END AS r FROM parts),
cats AS (SELECT exchange_id, kind, CAST(sum(tokens) FILTER (ok) AS BIGINT) AS tokens, max(r) FILTER (ok) AS r
         FROM counted GROUP BY ALL),
att AS (SELECT exchange_id, CAST(sum(tokens) AS BIGINT) AS attributed, max(r) AS r,
               max(tokens) FILTER (kind = 'file') AS file, max(tokens) FILTER (kind = 'tool_definition') AS tool_definition
        FROM cats GROUP BY exchange_id)
"""
_NAME = ("CASE {0} WHEN 1 THEN 'measured' WHEN 2 THEN 'counted' WHEN 3 THEN 'derived' WHEN 4 THEN 'unknown' "
         "WHEN 5 THEN 'estimated' END")


@query("a8_request_categories", ("request_parts",), "WITH " + PARTS + f"""
SELECT exchange_id, kind, tokens, {_NAME.format('r')} AS tokens_kind FROM cats""")
def a8_request(spark, sf_dir):
    return context.request_categories(_parts(spark, sf_dir), ["exchange_id"])


@query("a11_request_files", ("request_parts",), "WITH " + PARTS + f"""
SELECT exchange_id, CASE WHEN path LIKE ' /src%' THEN '/src/' || substr(path, 8, 2) || '/x' ELSE substr(path, 6) END AS path,
       CAST(sum(tokens) AS BIGINT) AS tokens, {_NAME.format('max(r)')} AS tokens_kind
FROM counted WHERE kind = 'file' AND tokens IS NOT NULL GROUP BY 1, 2""")
def a11_request(spark, sf_dir):
    return gateway.request_files(_parts(spark, sf_dir))


@query("g6_request_report", ("exchanges", "request_parts"), "WITH " + KIND + "," + NORM + "," + PARTS + f""",
c AS (SELECT norm.*, a.attributed, a.r, a.file, a.tool_definition,
        CASE WHEN usage_source IS NULL THEN NULL
             WHEN am AND (input_tokens IS NOT NULL OR total_input_tokens IS NOT NULL) THEN oti
             WHEN or_ AND input_tokens IS NOT NULL THEN oti
             WHEN NOT am AND NOT or_ AND total_input_tokens IS NOT NULL THEN oti END AS pti
      FROM norm LEFT JOIN att a ON a.exchange_id = norm.id)
SELECT id, attributed, {_NAME.format('r')} AS attributed_kind, file, tool_definition, pti AS call_total_input,
  CASE WHEN usage_source IS NULL THEN NULL WHEN output_tokens IS NOT NULL OR total_tokens IS NOT NULL THEN ot END AS call_total,
  CASE WHEN pti > 0 THEN pti - attributed END AS gap,
  CASE WHEN pti > 0 AND attributed IS NOT NULL THEN CAST(attributed AS DOUBLE) / pti * 100 END AS coverage_percent FROM c""")
def g6(spark, sf_dir):
    return gateway.request_report(_exchanges(spark, sf_dir), _parts(spark, sf_dir)).select(
        "id", "attributed", "attributed_kind", "file", "tool_definition", "call_total_input", "call_total", "gap",
        "coverage_percent")
