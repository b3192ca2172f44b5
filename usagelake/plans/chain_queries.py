"""Registered queries: request chains and profile accounts."""

from __future__ import annotations

from pyspark.sql import functions as F

from usagelake.functions.ordered import number
from usagelake.operators import chains, gateway
from usagelake.plans.gateway_queries import KIND, NORM, _exchanges
from usagelake.plans.registry import query
from usagelake.plans.twins import table, twin

_COMPATIBLE = "p.protocol = c.protocol AND p.profile = c.profile AND p.num < c.num AND (p.model = '' OR c.model = '' OR p.model = c.model)"


@query("j12_explicit_lineage", ("calls",), f"""
SELECT c.id, max(p.id) AS previous_id, CAST(1 AS BIGINT) AS shared FROM calls c JOIN calls p ON {_COMPATIBLE}
  AND c.previous_response_id <> '' AND p.response_id = c.previous_response_id GROUP BY c.id""")
def j12(spark, sf_dir):
    return chains.latest_predecessor(twin(spark, sf_dir, "calls"), "explicit_id")


@query("j13_tool_lineage", ("calls",), f"""
WITH a AS (SELECT *, unnest(tool_asks) AS t FROM calls), b AS (SELECT *, unnest(tool_offers) AS t FROM calls),
e AS (SELECT c.id, p.id AS previous_id, count(*) AS shared FROM a c JOIN b p ON c.t = p.t AND {_COMPATIBLE} GROUP BY ALL)
SELECT id, previous_id, shared FROM e QUALIFY row_number() OVER (PARTITION BY id ORDER BY previous_id DESC) = 1""")
def j13(spark, sf_dir):
    return chains.latest_predecessor(twin(spark, sf_dir, "calls"), "tool_lineage")


@query("j14_context_lineage", ("calls",), f"""
SELECT c.id, max(p.id) AS previous_id, CAST(1 AS BIGINT) AS shared FROM calls c JOIN calls p ON {_COMPATIBLE}
  AND p.lineage[1] = c.lineage[1] AND len(c.lineage) > len(p.lineage) AND list_has_all(c.lineage, p.lineage) GROUP BY c.id""")
def j14(spark, sf_dir):
    return chains.latest_predecessor(twin(spark, sf_dir, "calls"), "context_lineage")


# In the derived calls each island is a path, and calls of one island follow
# each other: the chain of an island begins at its first start-shaped call.
ISLANDS = """
i AS (SELECT *, num // 64 AS block, min(j) FILTER (start_shape) OVER (PARTITION BY num // 64, lane, island) AS root FROM calls),
r AS (SELECT *, min(id) FILTER (j = root) OVER (PARTITION BY block, lane, island) AS root_id FROM i),
m AS (SELECT *, 'gwc-' || substr(root_id, 4) AS chain_id,
             j - root + 1 AS call, lag(id) OVER (PARTITION BY block, lane, island ORDER BY j) AS before FROM r),
members AS (SELECT * FROM m WHERE call >= 1)
"""


@query("g1_chain_members", ("calls",), "WITH " + ISLANDS + """
SELECT root_id, chain_id, CAST(call AS BIGINT) AS call, id, profile, protocol, started_us, model FROM members""")
def g1(spark, sf_dir):
    return chains.build_chains(twin(spark, sf_dir, "calls")).members


@query("g1_uncorrelated", ("calls",), "WITH " + ISLANDS + """
SELECT id, profile, protocol, started_us, model FROM m WHERE call IS NULL OR call < 1""")
def g1_rest(spark, sf_dir):
    return chains.build_chains(twin(spark, sf_dir, "calls")).uncorrelated


@query("g3_chain_links", ("calls",), "WITH " + ISLANDS + """
SELECT root_id, chain_id, CAST(call AS BIGINT) AS call, id, CASE WHEN call > 1 THEN before END AS previous_id,
       CASE WHEN call > 1 THEN 'continue' ELSE 'start' END AS relation,
       CASE WHEN call = 1 THEN 'chain_start' WHEN variant = 0 THEN 'explicit_id' WHEN variant = 1 THEN 'tool_lineage'
            ELSE 'context_lineage' END AS method FROM members""")
def g3(spark, sf_dir):
    return chains.build_chains(twin(spark, sf_dir, "calls")).links


def _start_calls(spark, sf_dir):
    """Each turn as a captured request of either protocol, the rest of the conversation left out.

    Even turns are messages requests with a text block and, every third, only a tool result; odd ones are responses
    requests whose only item is a message, first or later, with and without an id.
    """
    def nested(sql: str):
        return F.expr(sql)

    turns = table(spark, sf_dir, "conversations")
    messages = nested("""CASE WHEN turn % 2 = 0 THEN named_struct('messages', array(named_struct('role', role, 'blocks',
        array(named_struct('type', IF(conv_id % 3 = 0, 'tool_result', 'text')))))) END""")
    items = nested("""CASE WHEN turn % 2 = 1 THEN named_struct('items', array(named_struct('type', IF(conv_id % 5 = 0, 'reasoning', 'message'),
        'itemId', IF(conv_id % 2 = 0, 'm1', NULL), 'index', CAST(turn % 4 - 1 AS INT)))) END""")
    request = F.struct(F.struct(messages.alias("anthropicMessages"), items.alias("openaiResponses")).alias("metadata"))
    protocol = F.when(F.col("turn") % 2 == 0, gateway.MESSAGES).otherwise(gateway.RESPONSES)
    return turns.select("conv_id", "turn", protocol.alias("protocol"), request.alias("request"))


@query("g2_start_shapes", (), """
SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'anthropic_messages' ELSE 'openai_responses' END AS protocol,
  CASE WHEN turn % 2 = 0 THEN role = 'user' AND conv_id % 3 <> 0
       ELSE conv_id % 5 <> 0 AND (conv_id % 2 = 0 OR turn % 4 - 1 = 0) END AS starts
FROM conversations""")
def g2(spark, sf_dir):
    shaped = chains.shaped_like_start(_start_calls(spark, sf_dir))
    return shaped.select("conv_id", "turn", "protocol", F.col("shape").alias("starts"))


@query("g4_chain_ids", ("exchanges",), """
SELECT id, 'gwc-' || right(replace(id, 'gw-', ''), 12) AS chain_id FROM exchanges""")
def g4(spark, sf_dir):
    return twin(spark, sf_dir, "exchanges").select("id", chains.chain_id(F.col("id")).alias("chain_id"))


FACTS = ISLANDS + """,
f AS (SELECT members.*, call_facts.* EXCLUDE (id) FROM members JOIN call_facts USING (id)),
d AS (SELECT *, CASE WHEN call > 1 THEN attributed - lag(attributed) OVER (PARTITION BY root_id ORDER BY call) END AS delta FROM f)
"""


def _chain_calls(spark, sf_dir):
    found = chains.build_chains(twin(spark, sf_dir, "calls"))
    return found.members.join(twin(spark, sf_dir, "call_facts"), "id"), found.longest


@query("w2_context_delta", ("calls", "call_facts"), "WITH " + FACTS + """
SELECT root_id, CAST(call AS BIGINT) AS call, delta AS context_delta FROM d""")
def w2(spark, sf_dir):
    calls, longest = _chain_calls(spark, sf_dir)
    return chains.context_deltas(calls, longest=longest).select("root_id", "call", "context_delta")


@query("w3_chain_metrics", ("calls", "call_facts"), "WITH " + FACTS + """,
g AS (SELECT root_id, count(*) AS n, count(attributed) AS ok, sum(attributed) AS s, max(attributed) AS p,
             min_by(attributed, call) FILTER (call = 1) AS a, max(delta) AS top,
             count(*) FILTER (call > 1 AND delta IS NULL) AS bad, count(*) FILTER (call > 1) AS later,
             max_by(history, call) - min_by(history, call) AS hg, max(call) AS z FROM d GROUP BY root_id)
SELECT g.root_id, n AS model_calls, a AS initial_context, l.attributed AS final_context,
  CASE WHEN ok = n THEN p END AS peak_context, CASE WHEN ok = n THEN CAST(s AS BIGINT) END AS total_context,
  l.attributed - a AS context_growth,
  CASE WHEN later = 0 OR bad > 0 THEN NULL WHEN top > 0 THEN top ELSE 0 END AS largest_growth,
  CAST(CASE WHEN bad = 0 AND top > 0 THEN (SELECT min(call) FROM d WHERE d.root_id = g.root_id AND d.delta = g.top) ELSE 0 END
    AS BIGINT) AS largest_growth_call, hg AS history_growth, l.tool_result - q.tool_result AS tool_result_growth
FROM g JOIN d l ON l.root_id = g.root_id AND l.call = g.z JOIN d q ON q.root_id = g.root_id AND q.call = 1""")
def w3(spark, sf_dir):
    calls, longest = _chain_calls(spark, sf_dir)
    return chains.chain_metrics(chains.context_deltas(calls, longest=longest)).select(
        "root_id", "model_calls", "initial_context", "final_context", "peak_context", "total_context", "context_growth",
        "largest_growth", "largest_growth_call", "history_growth", "tool_result_growth")


USAGE = """
u AS (SELECT root_id, count(*) AS usage_total_calls,
  count(*) FILTER (coalesce(total_input, cached_input, fresh_input, output, reasoning_output) IS NOT NULL) AS usage_observed_calls,
  CASE WHEN count(total_input) = count(*) THEN CAST(sum(total_input) AS BIGINT) END AS provider_total_input,
  CASE WHEN count(cached_input) = count(*) THEN CAST(sum(cached_input) AS BIGINT) END AS provider_cached_input,
  CASE WHEN count(output) = count(*) THEN CAST(sum(output) AS BIGINT) END AS provider_output,
  CASE WHEN count(fresh_input) = count(*) THEN CAST(sum(fresh_input) AS BIGINT) END AS provider_fresh_input,
  CASE WHEN count(reasoning_output) = count(*) THEN CAST(sum(reasoning_output) AS BIGINT) END AS provider_reasoning_output,
  CASE WHEN count(attributed) = count(*) THEN CAST(sum(attributed) AS BIGINT) END AS total_context
  FROM f GROUP BY root_id)
"""


@query("a23_chain_usage", ("calls", "call_facts"), "WITH " + FACTS + "," + USAGE + """
SELECT * EXCLUDE (total_context) FROM u""")
def a23(spark, sf_dir):
    return chains.chain_usage(_chain_calls(spark, sf_dir)[0]).select(
        "root_id", "usage_total_calls", "usage_observed_calls", "provider_total_input", "provider_cached_input", "provider_output",
        "provider_fresh_input", "provider_reasoning_output")


@query("g5_chain_report", ("calls", "call_facts"), "WITH " + FACTS + "," + USAGE + """,
g AS (SELECT root_id, any_value(chain_id) AS chain_id, min_by(profile, call) AS profile, min_by(protocol, call) AS protocol,
    min_by(model, call) AS model, min(started_us) AS started_us, count(*) AS n, count(attributed) AS ok,
    sum(attributed) AS s, max(attributed) AS p, max(CASE attributed_kind WHEN 'estimated' THEN 1 ELSE 0 END) AS est,
    max(delta) AS top, count(*) FILTER (call > 1 AND delta IS NULL) AS bad, count(*) FILTER (call > 1) AS later, max(call) AS z
  FROM d GROUP BY root_id)
SELECT g.root_id, g.chain_id, g.profile, g.protocol, g.model, g.started_us, n AS model_calls, q.attributed AS initial_context,
  l.attributed AS final_context, CASE WHEN ok = n THEN p END AS peak_context, u.total_context,
  CASE WHEN ok < n THEN 'unknown' WHEN est = 1 THEN 'estimated' ELSE 'measured' END AS total_context_kind,
  l.attributed - q.attributed AS context_growth,
  CASE WHEN later = 0 OR bad > 0 THEN NULL WHEN top > 0 THEN top ELSE 0 END AS largest_growth,
  CAST(CASE WHEN bad = 0 AND top > 0 THEN (SELECT min(call) FROM d WHERE d.root_id = g.root_id AND d.delta = g.top) ELSE 0 END
    AS BIGINT) AS largest_growth_call, l.tool_result - q.tool_result AS tool_result_growth,
  l.history - q.history AS history_growth, CAST(NULL AS BIGINT) AS tool_definition_growth,
  u.* EXCLUDE (root_id, total_context), CAST(NULL AS BIGINT) AS provider_cache_creation_input,
  provider_total_input - total_context AS attribution_gap,
  CASE WHEN provider_total_input <> 0 THEN CAST(total_context AS DOUBLE) / provider_total_input * 100 END AS coverage_percent
FROM g JOIN u USING (root_id) JOIN d l ON l.root_id = g.root_id AND l.call = g.z JOIN d q ON q.root_id = g.root_id AND q.call = 1""")
def g5(spark, sf_dir):
    calls, longest = _chain_calls(spark, sf_dir)
    return chains.chain_report(calls, longest=longest)


@query("g5_call_report", ("calls", "call_facts"), "WITH " + FACTS + """
SELECT root_id, CAST(call AS BIGINT) AS call, id, attributed, delta AS context_delta, total_input,
  total_input - attributed AS attribution_gap,
  CASE WHEN total_input <> 0 THEN CAST(attributed AS DOUBLE) / total_input * 100 END AS coverage_percent FROM d""")
def g5_calls(spark, sf_dir):
    calls, longest = _chain_calls(spark, sf_dir)
    return chains.call_report(calls, longest=longest).select(
        "root_id", "call", "id", "attributed", "context_delta", "total_input", "attribution_gap", "coverage_percent")


# Two chains whose first calls' ids end alike: every call again under another profile, with another head of its id.
@query("g1_roots_of_one_tail", ("calls",), "WITH " + ISLANDS + """
SELECT root_id, CAST(call AS BIGINT) AS call, id FROM members
UNION ALL SELECT 'other-chain-' || substr(root_id, 4), CAST(call AS BIGINT), 'other-chain-' || substr(id, 4) FROM members""")
def g1_one_tail(spark, sf_dir):
    calls = twin(spark, sf_dir, "calls")
    other = calls.withColumns({
        "id": F.concat(F.lit("other-chain-"), F.substr("id", F.lit(4))), "profile": F.concat(F.lit("other-"), F.col("profile"))})
    return chains.build_chains(calls.unionByName(other)).members.select("root_id", "call", "id")


@query("t6_newest_chains_first", ("calls",), "WITH " + ISLANDS + """
SELECT profile, root_id, chain_id, row_number() OVER (PARTITION BY profile ORDER BY min(started_us) DESC, chain_id, root_id) AS position
FROM members GROUP BY profile, root_id, chain_id""")
def t6(spark, sf_dir):
    members = chains.build_chains(twin(spark, sf_dir, "calls")).members
    heads = members.where("call = 1").select("profile", "root_id", "chain_id", (-F.col("started_us")).alias("_age"))
    # A profile may hold most chains: ranks come from a global order, less the profile's first rank.
    ranked = number(heads, ["profile", "_age", "chain_id", "root_id"], "_n")
    first = ranked.groupBy("profile").agg(F.min("_n").alias("_first"))
    return ranked.join(first, "profile").select(
        "profile", "root_id", "chain_id", (F.col("_n") - F.col("_first") + 1).alias("position"))


# -------------------------------------------------------------------- account

_FIELDS = {"fresh_input": "fi", "cached_input": "ci", "cache_creation_input": "wi", "total_input": "ti", "output": "oo",
           "reasoning_output": "ro", "total": "tt"}
# Where the kind of a field is not that of its protocol.
_KINDS = {"fresh_input": "(CASE WHEN am THEN 'measured' ELSE 'derived' END)", "total_input": "kti", "total": "kt"}
ACCOUNT = """
x AS (SELECT *, id IN (SELECT exchange_id FROM request_parts) AND kind = 'model' AS chained,
        call AND usage_source IS NOT NULL AS counted,
        call AND coalesce(input_tokens, cache_creation_input_tokens, cache_read_input_tokens, output_tokens,
          reasoning_output_tokens, total_input_tokens, total_tokens) IS NOT NULL AND usage_source IS NOT NULL AS obs,
        input_tokens IS NOT NULL OR total_input_tokens IS NOT NULL AS hi FROM norm),
y AS (SELECT *,
  CASE WHEN (am AND input_tokens IS NOT NULL) OR (or_ AND hi AND cache_read_input_tokens IS NOT NULL) THEN fr END AS fi,
  CASE WHEN (am OR (or_ AND hi)) AND cache_read_input_tokens IS NOT NULL THEN oc END AS ci,
  CASE WHEN am AND cache_creation_input_tokens IS NOT NULL THEN ow END AS wi,
  CASE WHEN ((am OR or_) AND hi) OR (NOT am AND NOT or_ AND total_input_tokens IS NOT NULL) THEN oti END AS ti,
  output_tokens AS oo, reasoning_output_tokens AS ro,
  CASE WHEN total_tokens IS NOT NULL THEN total_tokens
       WHEN (am OR or_) AND hi AND output_tokens IS NOT NULL THEN ot END AS tt FROM x),
fl AS (SELECT profile, count(*) AS recorder_failures FROM exchanges WHERE protocol = 'other' GROUP BY profile),
a AS (SELECT profile, count(*) AS http_requests, count(*) FILTER (kind = 'model') AS model_requests,
  count(*) FILTER (kind = 'model' AND chained) AS chained_requests,
  count(*) FILTER (kind = 'model' AND NOT chained) AS uncorrelated_requests,
  count(*) FILTER (kind = 'non_model') AS non_model_requests, count(*) FILTER (kind = '') AS unknown_requests,
  count(*) FILTER (kind = 'unclassified') AS unclassified_requests, count(*) FILTER (counted) AS usage_observed_requests,
""" + ",\n".join(f"  count(*) FILTER (outcome = '{o}') AS outcome_{o}" for o in gateway.OUTCOMES) + """,
  count(*) FILTER (outcome IS NULL OR outcome NOT IN (""" + ", ".join(f"'{o}'" for o in gateway.OUTCOMES) + """)) AS outcome_unknown,
  count(*) FILTER (obs) AS observed_calls, count(*) FILTER (obs AND chained) AS chained_calls,
""" + ",\n".join(
    f"count({c}) FILTER (obs{w}) AS {s}_{f}_count, CAST(coalesce(sum({c}) FILTER (obs{w}), 0) AS BIGINT) AS {s}_{f}_sum, "
    f"CASE max(CASE WHEN {_KINDS.get(f, 'km')} = 'derived' THEN 2 ELSE 1 END) FILTER (obs{w} AND {c} IS NOT NULL) "
    f"WHEN 1 THEN 'measured' WHEN 2 THEN 'derived' END AS {s}_{f}_kind"
    for s, w in (("observed", ""), ("chained", " AND chained"), ("uncorrelated", " AND NOT chained"))
    for f, c in _FIELDS.items()) + ", count(*) FILTER (obs AND NOT chained) AS uncorrelated_calls" + """
  FROM y GROUP BY profile)
"""


def _account(spark, sf_dir):
    """Calls that sent components stand for chained ones, calls of no known protocol for failures."""
    calls = _exchanges(spark, sf_dir)
    sent = twin(spark, sf_dir, "request_parts").select(F.col("exchange_id").alias("id")).distinct()
    chained = calls.where("kind = 'model'").select("id").join(sent, "id", "left_semi")
    failures = calls.where("protocol = 'other'").groupBy("profile").agg(F.count("*").alias("recorder_failures"))
    return gateway.profile_account(calls, chained, failures)


@query("a21_profile_account", ("exchanges", "request_parts"), "WITH " + KIND + "," + NORM + "," + ACCOUNT + """,
z AS (SELECT a.*, coalesce(recorder_failures, 0) AS recorder_failures, """ + ", ".join(
    f"({n} = 0 OR ({s}_calls >= {n} AND {s}_fresh_input_count >= {n} AND {s}_output_count >= {n})) AS {s}_complete"
    for s, n in (("observed", "model_requests"), ("chained", "chained_requests"), ("uncorrelated", "uncorrelated_requests"))) + """
  FROM a LEFT JOIN fl USING (profile))
SELECT *, CASE WHEN (model_requests > 0 AND NOT (observed_complete AND chained_complete AND uncorrelated_complete))
    OR recorder_failures > 0 OR outcome_stream_truncated > 0 THEN 'partial' ELSE 'complete' END AS completeness FROM z""")
def a21(spark, sf_dir):
    return _account(spark, sf_dir)


# From captured exchanges to chains, and from chains to the account: responses calls that name their predecessor.
PATH = """
e AS (SELECT *, CASE WHEN (method IS NULL OR method IN ('', 'POST')) AND (
        (protocol = 'anthropic_messages' AND endpoint = '/v1/messages')
        OR (protocol = 'openai_responses' AND endpoint IN ('/responses', '/v1/responses'))) THEN 1 ELSE 0 END AS call FROM exchanges)
"""


def _captured(spark, sf_dir):
    """The exchanges in the nested capture schema; each names itself as response and starts a conversation."""
    calls = _exchanges(spark, sf_dir)
    message = "array(named_struct('type', 'message', 'itemId', 'm', 'index', 0))"
    block = "array(named_struct('role', 'user', 'blocks', array(named_struct('type', 'text', 'toolUseId', '', 'toolResultToolUseId', ''))))"
    return calls.withColumns({
        "startedAt": F.timestamp_micros("started_us"),
        "request": F.expr(f"""named_struct('method', method, 'endpoint', endpoint, 'components', CAST(NULL AS array<struct<kind: string, contentHash: string>>),
            'metadata', named_struct(
              'openaiResponses', named_struct('items', {message}, 'previousResponseId', CAST(NULL AS string), 'functionCallOutputIds', CAST(NULL AS array<string>)),
              'anthropicMessages', named_struct('messages', {block})))"""),
        "response": F.expr("named_struct('openaiResponses', named_struct('responseId', id, 'outputItemCallIDs', CAST(NULL AS array<string>)))"),
    })


@query("chain_calls", ("exchanges",), "WITH " + PATH + """
SELECT id, profile, protocol, coalesce(model, '') AS model, true AS start_shape,
  CASE WHEN protocol <> 'anthropic_messages' THEN id END AS response_id FROM e WHERE call = 1""")
def chain_calls(spark, sf_dir):
    got = chains.calls_from_exchanges(_captured(spark, sf_dir))
    return got.select("id", "profile", "protocol", "model", "start_shape", "response_id")


@query("gateway_account", ("exchanges",), "WITH " + PATH + """
SELECT profile, count(*) AS http_requests, sum(call)::BIGINT AS chained_requests,
  (SELECT count(*) FROM e n WHERE n.profile = e.profile AND n.call = 0) AS other_requests FROM e GROUP BY profile""")
def gateway_account(spark, sf_dir):
    captured = _captured(spark, sf_dir)
    found = chains.build_chains(chains.calls_from_exchanges(captured), context=False)
    none = captured.where("false").groupBy("profile").agg(F.count("*").alias("recorder_failures"))
    # Calls of a chain, whatever the request's own kind says.
    chained = captured.join(found.members.select("id"), "id", "left_semi").groupBy("profile").agg(F.count("*").alias("n"))
    account = gateway.profile_account(captured, found.members, none)
    return account.join(chained, "profile", "left").select(
        "profile", "http_requests", F.coalesce("n", F.lit(0)).alias("chained_requests"),
        (F.col("http_requests") - F.coalesce("n", F.lit(0))).alias("other_requests"))
