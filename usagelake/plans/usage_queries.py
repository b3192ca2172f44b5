"""Registered queries: session and turn usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from usagelake.functions.measure import USAGE_METRICS
from usagelake.operators import usage
from usagelake.plans.registry import query
from usagelake.plans.twins import twin

DELTAS = """
WITH w AS (
  SELECT *, row_number() OVER s AS sequence,
         lag(input) OVER s AS pi, lag(cached) OVER s AS pc, lag(output) OVER s AS po,
         lag(reasoning) OVER s AS pr, lag(total) OVER s AS pt
  FROM counters WINDOW s AS (PARTITION BY session_id ORDER BY ord)),
r AS (
  SELECT *, (coalesce(input < coalesce(pi, 0), false) OR cached < coalesce(pc, 0)
             OR output < coalesce(po, 0) OR total < coalesce(pt, 0)
             OR coalesce(reasoning < pr, false)) AS reset FROM w),
turns AS (
  SELECT session_id, source, ord, ts_us, sequence, reset,
         CASE WHEN NOT reset THEN input - coalesce(pi, 0) END AS input,
         CASE WHEN NOT reset THEN cached - coalesce(pc, 0) END AS cached,
         CASE WHEN NOT reset THEN output - coalesce(po, 0) END AS output,
         CASE WHEN NOT reset THEN reasoning - coalesce(pr, 0) END AS reasoning,
         CASE WHEN NOT reset THEN total - coalesce(pt, 0) END AS total
  FROM r)
"""
BEST = """
best AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY total DESC, ord DESC) AS rn
  FROM counters WHERE total >= 0) q WHERE rn = 1)
"""


def _turns(spark, sf_dir):
    return usage.counter_deltas(twin(spark, sf_dir, "counters"))


@query("w1_counter_deltas", ("counters",), DELTAS + """
SELECT session_id, sequence, reset, input, cached, output, reasoning, total,
       CASE WHEN total IS NOT NULL THEN 'derived' END AS total_kind FROM turns""")
def w1(spark, sf_dir):
    return _turns(spark, sf_dir).select(
        "session_id", "sequence", "reset", "input", "cached", "output", "reasoning", "total", "total_kind")


@query("w4_turn_sequence", ("messages",), """
SELECT session_id, ord, row_number() OVER (PARTITION BY session_id ORDER BY ord) AS sequence FROM messages""")
def w4(spark, sf_dir):
    return usage.number_turns(twin(spark, sf_dir, "messages").select("session_id", "ord"))


@query("a1_turn_usage_sum", ("counters",), DELTAS + """
SELECT session_id, CAST(sum(input) AS BIGINT) AS input, CAST(sum(cached) AS BIGINT) AS cached,
       CAST(sum(output) AS BIGINT) AS output, CAST(sum(reasoning) AS BIGINT) AS reasoning,
       CAST(sum(total) AS BIGINT) AS total,
       CASE WHEN sum(total) IS NOT NULL THEN 'derived' END AS total_kind
FROM turns GROUP BY session_id""")
def a1(spark, sf_dir):
    return usage.sum_usage(_turns(spark, sf_dir), ["session_id"]).select(
        "session_id", *USAGE_METRICS, "total_kind")


@query("a2_counter_session_usage", ("counters",), "WITH " + BEST + """
SELECT session_id, ord AS snapshot_ord, input, cached, output, reasoning, total FROM best""")
def a2(spark, sf_dir):
    return usage.counter_session_usage(twin(spark, sf_dir, "counters")).select(
        "session_id", "snapshot_ord", *USAGE_METRICS)


@query("a5_counter_source_usage", ("counters",), "WITH " + BEST + """
SELECT source, CAST(sum(input) AS BIGINT) AS input, CAST(sum(cached) AS BIGINT) AS cached,
       CAST(sum(output) AS BIGINT) AS output, CAST(sum(reasoning) AS BIGINT) AS reasoning,
       CAST(sum(total) AS BIGINT) AS total
FROM best WHERE NOT (total = 0 AND input = 0 AND output = 0) GROUP BY source""")
def a5_counters(spark, sf_dir):
    sessions = usage.counter_session_usage(twin(spark, sf_dir, "counters"), ["source", "session_id"])
    return usage.counter_source_usage(sessions).select("source", *USAGE_METRICS)


@query("a12_turns_vs_session", ("counters",), DELTAS + "," + BEST + """,
s AS (SELECT session_id, sum(input) AS i, sum(cached) AS c, sum(output) AS o, sum(reasoning) AS r, sum(total) AS t
      FROM turns GROUP BY session_id),
d AS (SELECT b.session_id, CAST(coalesce(i, 0) - input AS BIGINT) AS input_delta,
             CAST(coalesce(c, 0) - cached AS BIGINT) AS cached_delta,
             CAST(coalesce(o, 0) - output AS BIGINT) AS output_delta,
             CAST(CASE WHEN b.reasoning IS NULL AND r IS NULL THEN NULL WHEN b.reasoning IS NULL THEN 0
                       ELSE coalesce(r, 0) - b.reasoning END AS BIGINT) AS reasoning_delta,
             CAST(coalesce(t, 0) - total AS BIGINT) AS total_delta
      FROM best b LEFT JOIN s USING (session_id))
SELECT *, input_delta = 0 AND cached_delta = 0 AND output_delta = 0 AND coalesce(reasoning_delta, 0) = 0
          AND total_delta = 0 AS matches FROM d""")
def a12(spark, sf_dir):
    sessions = usage.counter_session_usage(twin(spark, sf_dir, "counters"))
    return usage.compare_turns_to_session(_turns(spark, sf_dir), sessions)


@query("a7_session_span", ("messages",), """
WITH m AS (SELECT session_id, ord, CASE WHEN ord % 9 = 0 THEN NULL ELSE ts_us END AS ts FROM messages)
SELECT session_id, min_by(ts, ord) FILTER (ts IS NOT NULL) AS started,
       max_by(ts, ord) FILTER (ts IS NOT NULL) AS updated FROM m GROUP BY session_id""")
def a7(spark, sf_dir):
    records = twin(spark, sf_dir, "messages").withColumn("ts", F.when(F.col("ord") % 9 != 0, F.col("ts_us")))
    return usage.session_span(records)


@query("a6_session_model", ("messages",), """
SELECT session_id, CASE WHEN count(DISTINCT model) FILTER (model <> '' AND model <> '<synthetic>') = 1
       THEN max(model) FILTER (model <> '' AND model <> '<synthetic>') ELSE '' END AS model
FROM messages GROUP BY session_id""")
def a6(spark, sf_dir):
    return usage.session_model(twin(spark, sf_dir, "messages"))


@query("a6_last_model", ("messages",), """
SELECT session_id, coalesce(max_by(model, ord) FILTER (model <> ''), '') AS model FROM messages GROUP BY session_id""")
def a6_last(spark, sf_dir):
    return usage.last_model(twin(spark, sf_dir, "messages"))


BEARING = """
bearing AS (SELECT * FROM messages WHERE model <> '<synthetic>'
            AND (input IS NOT NULL OR cache_read IS NOT NULL OR cache_write IS NOT NULL OR output IS NOT NULL)),
marked AS (
  SELECT *, CASE WHEN message_id = '' THEN ord END AS own FROM bearing),
ranked AS (
  SELECT *, row_number() OVER g AS rn,
         first_value(input) OVER g AS fi, first_value(cache_read) OVER g AS fr,
         first_value(cache_write) OVER g AS fw, first_value(output) OVER g AS fo
  FROM marked WINDOW g AS (PARTITION BY session_id, message_id, own ORDER BY ord)),
flags AS (
  SELECT session_id, message_id, own, count(*) AS copies,
         bool_or(input IS DISTINCT FROM fi OR cache_read IS DISTINCT FROM fr
                 OR cache_write IS DISTINCT FROM fw OR output IS DISTINCT FROM fo) AS conflict
  FROM ranked GROUP BY ALL),
kept AS (
  SELECT r.session_id, r.source, r.ord, r.ts_us, r.message_id, r.model, r.input, r.cache_read, r.cache_write,
         r.output, f.conflict, f.copies
  FROM ranked r JOIN flags f ON r.session_id = f.session_id AND r.message_id = f.message_id
       AND r.own IS NOT DISTINCT FROM f.own
  WHERE rn = 1)
"""
TOTALS = """
t AS (
  SELECT session_id, min(source) AS source, count(*) FILTER (NOT conflict) AS n,
         count(*) FILTER (conflict) AS conflicts,
         sum(input) FILTER (NOT conflict AND input >= 0) AS si, count(*) FILTER (NOT conflict AND input >= 0) AS ci,
         count(input) FILTER (NOT conflict) AS ri,
         sum(cache_read) FILTER (NOT conflict AND cache_read >= 0) AS sr,
         count(*) FILTER (NOT conflict AND cache_read >= 0) AS cr, count(cache_read) FILTER (NOT conflict) AS rr,
         sum(cache_write) FILTER (NOT conflict AND cache_write >= 0) AS sw,
         count(*) FILTER (NOT conflict AND cache_write >= 0) AS cw, count(cache_write) FILTER (NOT conflict) AS rw,
         sum(output) FILTER (NOT conflict AND output >= 0) AS so,
         count(*) FILTER (NOT conflict AND output >= 0) AS co, count(output) FILTER (NOT conflict) AS ro
  FROM kept GROUP BY session_id)
"""


def _kept(spark, sf_dir, keys=("session_id",)):
    return usage.dedup_messages(usage.usage_bearing(twin(spark, sf_dir, "messages")), keys)


@query("f3_synthetic_filter", ("messages",), """
SELECT session_id, count(*) AS records FROM messages
WHERE model <> '<synthetic>'
  AND (input IS NOT NULL OR cache_read IS NOT NULL OR cache_write IS NOT NULL OR output IS NOT NULL)
GROUP BY session_id""")
def f3(spark, sf_dir):
    return usage.usage_bearing(twin(spark, sf_dir, "messages")).groupBy("session_id").agg(
        F.count("*").alias("records"))


@query("a4_message_dedup", ("messages",), "WITH " + BEARING + """
SELECT session_id, message_id, ord, conflict, copies, input, cache_read, cache_write, output FROM kept""")
def a4(spark, sf_dir):
    return _kept(spark, sf_dir).select(
        "session_id", "message_id", "ord", "conflict", "copies", "input", "cache_read", "cache_write", "output")


@query("a4_message_turns", ("messages",), "WITH " + BEARING + """,
n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ord) AS sequence,
             CASE WHEN NOT conflict AND input >= 0 THEN input END AS i,
             CASE WHEN NOT conflict AND cache_read >= 0 THEN cache_read END AS r,
             CASE WHEN NOT conflict AND cache_write >= 0 THEN cache_write END AS w,
             CASE WHEN NOT conflict AND output >= 0 THEN output END AS o FROM kept)
SELECT session_id, sequence,
       CASE WHEN message_id <> '' THEN message_id ELSE session_id || '#' || CAST(sequence AS VARCHAR) END AS turn_id,
       i AS input, CASE WHEN input IS NULL THEN NULL WHEN i IS NULL THEN 'unknown' ELSE 'measured' END AS input_kind,
       r + w AS cached, o AS output, i + r + w + o AS total, i + r + w AS billable_input,
       CASE WHEN cache_write IS NULL THEN NULL WHEN w IS NULL THEN 'unknown' ELSE 'measured' END
         AS billable_cache_write_kind FROM n""")
def a4_turns(spark, sf_dir):
    return usage.message_turns(_kept(spark, sf_dir)).select(
        "session_id", "sequence", "turn_id", "input", "input_kind", "cached", "output", "total",
        "billable_input", "billable_cache_write_kind")


@query("a3_message_session_usage", ("messages",), "WITH " + BEARING + "," + TOTALS + """,
v AS (SELECT *, CASE WHEN n > 0 AND ci = n THEN si END AS i, CASE WHEN n > 0 AND cr = n THEN sr END AS r,
             CASE WHEN n > 0 AND cw = n THEN sw END AS w, CASE WHEN n > 0 AND co = n THEN so END AS o FROM t)
SELECT session_id, n AS accepted, conflicts, ci + cr + cw + co > 0 AS has_reported_usage,
       CAST(i AS BIGINT) AS input, CASE WHEN i IS NOT NULL THEN 'derived' WHEN ri > 0 THEN 'unknown' END AS input_kind,
       CAST(r + w AS BIGINT) AS cached, CAST(o AS BIGINT) AS output,
       CASE WHEN o IS NOT NULL THEN 'derived' WHEN ro > 0 THEN 'unknown' END AS output_kind,
       CAST(i + r + w + o AS BIGINT) AS total FROM v""")
def a3(spark, sf_dir):
    return usage.message_session_usage(_kept(spark, sf_dir)).select(
        "session_id", "accepted", "conflicts", "has_reported_usage", "input", "input_kind", "cached",
        "output", "output_kind", "total")


@query("a5_message_source_usage", ("messages",), "WITH " + BEARING + "," + TOTALS + """,
p AS (SELECT source, CASE WHEN ri > 0 THEN coalesce(si, 0) END AS i, CASE WHEN rr > 0 THEN coalesce(sr, 0) END AS r,
             CASE WHEN rw > 0 THEN coalesce(sw, 0) END AS w, CASE WHEN ro > 0 THEN coalesce(so, 0) END AS o
      FROM t WHERE ci + cr + cw + co > 0),
g AS (SELECT source, count(*) AS sessions,
             CASE WHEN count(i) = count(*) THEN sum(i) END AS i, CASE WHEN count(r) = count(*) THEN sum(r) END AS r,
             CASE WHEN count(w) = count(*) THEN sum(w) END AS w, CASE WHEN count(o) = count(*) THEN sum(o) END AS o
      FROM p GROUP BY source)
SELECT source, sessions, CAST(i AS BIGINT) AS input, CAST(r + w AS BIGINT) AS cached, CAST(o AS BIGINT) AS output,
       CAST(i + r + w + o AS BIGINT) AS total FROM g""")
def a5_messages(spark, sf_dir):
    sessions = usage.message_session_usage(_kept(spark, sf_dir, ["source", "session_id"]), ["source", "session_id"])
    return usage.message_source_usage(sessions)


@query("f2_reported_usage_filter", ("messages",), "WITH " + BEARING + "," + TOTALS + """
SELECT session_id FROM t WHERE ci + cr + cw + co > 0""")
def f2(spark, sf_dir):
    return usage.message_session_usage(_kept(spark, sf_dir)).where("has_reported_usage").select("session_id")


@query("f1_authoritative_filter", ("messages",), "WITH " + BEARING + "," + TOTALS + """
SELECT session_id FROM t WHERE n > 0 AND (ci = n OR co = n OR (cr = n AND cw = n))""")
def f1(spark, sf_dir):
    return usage.with_authoritative_usage(usage.message_session_usage(_kept(spark, sf_dir))).select("session_id")


@query("t1_session_order", ("messages",), """
SELECT source, session_id, CASE WHEN max(ord) % 5 = 0 THEN NULL ELSE max(ts_us) END AS updated_us
FROM messages GROUP BY source, session_id ORDER BY updated_us DESC NULLS LAST, source, session_id""")
def t1(spark, sf_dir):
    sessions = twin(spark, sf_dir, "messages").groupBy("source", "session_id").agg(
        F.when(F.max("ord") % 5 != 0, F.max("ts_us")).alias("updated_us"))
    return usage.order_sessions(sessions)


@query("t2_top_expensive_turns", ("counters",), DELTAS + """,
k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY coalesce(total, 0) DESC, sequence) AS position FROM turns)
SELECT session_id, sequence, position, total FROM k WHERE position <= 5""")
def t2(spark, sf_dir):
    return usage.top_expensive(_turns(spark, sf_dir)).select("session_id", "sequence", "position", "total")


@query("t3_recent_turns", ("counters",), DELTAS + """,
k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY sequence DESC) AS position FROM turns)
SELECT session_id, sequence, position, total FROM k WHERE position <= 5""")
def t3(spark, sf_dir):
    return usage.recent_turns(_turns(spark, sf_dir)).select("session_id", "sequence", "position", "total")


@query("x8_turn_kinds", ("messages",), "WITH " + BEARING + """,
n AS (SELECT session_id,
             CASE WHEN NOT conflict AND input >= 0 THEN input END AS i,
             CASE WHEN NOT conflict AND cache_read >= 0 THEN cache_read END AS r,
             CASE WHEN NOT conflict AND cache_write >= 0 THEN cache_write END AS w,
             CASE WHEN NOT conflict AND output >= 0 THEN output END AS o FROM kept),
k AS (SELECT session_id, CASE WHEN (i IS NOT NULL OR o IS NOT NULL) AND r + w IS NULL THEN 'measured'
             WHEN i IS NULL AND o IS NULL AND r + w IS NOT NULL THEN 'derived' ELSE '' END AS kind FROM n)
SELECT session_id, count(*) AS turns, min(kind) AS first_kind, min(kind) <> max(kind) AS mixed
FROM k GROUP BY session_id""")
def x8(spark, sf_dir):
    return usage.session_mixed(usage.message_turns(_kept(spark, sf_dir)))


@query("u1_union_of_sources", ("counters", "messages"), "WITH " + BEARING + "," + TOTALS + "," + BEST + """
SELECT source, session_id, CAST(total AS BIGINT) AS total, 'measured' AS total_kind FROM best
UNION ALL
SELECT source, session_id, CASE WHEN n > 0 AND ci = n AND cr = n AND cw = n AND co = n THEN CAST(si + sr + sw + so AS BIGINT) END,
       CASE WHEN n > 0 AND ci = n AND cr = n AND cw = n AND co = n THEN 'derived' ELSE '' END FROM t""")
def u1(spark, sf_dir):
    keys = ["source", "session_id"]
    counted = usage.counter_session_usage(twin(spark, sf_dir, "counters"), keys)
    summed = usage.message_session_usage(_kept(spark, sf_dir, keys), keys)
    both = counted.unionByName(summed, allowMissingColumns=True)
    return both.select(*keys, "total", F.coalesce("total_kind", F.lit("")).alias("total_kind"))
