"""Registered queries: matching and reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from usagelake.operators import matching, observations, reconcile, usage
from usagelake.plans import usage_queries
from usagelake.plans.registry import query
from usagelake.plans.twins import twin

FIELDS = ("fresh_input", "cached_input", "cache_creation_input", "total_input", "output", "reasoning_output", "total")
_EQUAL = " + ".join(f"CASE WHEN g.{f} = t.{f} THEN 1 ELSE 0 END" for f in FIELDS)

MATCH = f"""
o AS (SELECT *, lower(trim(model)) AS m FROM observations),
gw AS (SELECT * FROM o WHERE channel = 'gateway'), tr AS (SELECT * FROM o WHERE channel = 'session_transcript'),
same AS (SELECT g.id AS gid, t.id AS tid FROM gw g JOIN tr t ON g.response_object_id = t.response_object_id
           AND g.response_object_id <> ''
         UNION SELECT g.id, t.id FROM gw g JOIN tr t ON g.turn_id = t.turn_id AND g.turn_id <> ''),
near AS (SELECT g.id AS gid, t.id AS tid, abs(g.started_us - t.started_us) AS delta, {_EQUAL} AS eq,
                g.m <> '' AND g.m = t.m AS sm
         FROM gw g JOIN tr t ON t.started_us BETWEEN g.started_us - 120000000 AND g.started_us + 120000000
         WHERE (g.m = '' OR t.m = '' OR g.m = t.m)),
pairs AS (SELECT gid, tid, true AS ident, NULL AS delta, NULL AS eq, NULL AS sm FROM same
          UNION ALL SELECT gid, tid, false, delta, eq, sm FROM near n WHERE (sm OR eq > 0)
            AND NOT EXISTS (SELECT 1 FROM same s WHERE s.gid = n.gid AND s.tid = n.tid)),
gr AS (SELECT *, rank() OVER (PARTITION BY gid ORDER BY ident DESC, delta, eq DESC, sm DESC) AS r FROM pairs),
tt AS (SELECT *, rank() OVER (PARTITION BY tid ORDER BY ident DESC, delta, eq DESC, sm DESC) AS r FROM pairs),
gp AS (SELECT gid, bool_or(ident) AS ident, count(*) AS n, min(tid) AS lo, max(tid) AS hi, max(eq) AS eq, bool_or(sm) AS sm
       FROM gr WHERE r = 1 GROUP BY gid),
tp AS (SELECT tid, bool_or(ident) AS ident, count(*) AS n, min(gid) AS lo FROM tt WHERE r = 1 GROUP BY tid),
res AS (SELECT gw.id AS gid, gp.*  EXCLUDE (gid), CASE WHEN gp.gid IS NULL THEN 'unmatched' WHEN gp.n > 1 THEN 'ambiguous'
               WHEN tp.ident IS DISTINCT FROM gp.ident THEN 'unmatched' WHEN tp.n > 1 THEN 'ambiguous'
               WHEN tp.lo = gw.id THEN 'matched' ELSE 'unmatched' END AS status
        FROM gw LEFT JOIN gp ON gw.id = gp.gid LEFT JOIN tp ON gp.n = 1 AND tp.tid = gp.lo),
used AS (SELECT lo AS tid FROM res WHERE status = 'matched' OR (status = 'ambiguous' AND n = 1)
         UNION SELECT gr.tid FROM gr JOIN res ON gr.gid = res.gid AND gr.r = 1 WHERE status = 'ambiguous'),
matches AS (
  SELECT CASE WHEN status = 'matched' THEN 'match:' || gid || '=' || lo ELSE 'match:gateway:' || gid END AS match_id,
         gid AS gateway_id, CASE WHEN status = 'matched' THEN lo END AS transcript_id, status,
         CASE WHEN status = 'matched' THEN CASE WHEN ident THEN 'high' ELSE 'medium' END END AS confidence,
         CASE WHEN status = 'matched' THEN CASE WHEN ident THEN 'shared_identity' ELSE 'time' ||
              CASE WHEN sm THEN ',model' ELSE '' END || CASE WHEN eq > 0 THEN ',usage' ELSE '' END END END AS reasons,
         CASE WHEN status <> 'matched' THEN 'gateway' END AS side,
         CASE WHEN status = 'ambiguous' THEN lo END AS first_candidate, CASE WHEN status = 'ambiguous' THEN hi END AS last_candidate
  FROM res
  UNION ALL
  SELECT 'match:transcript:' || id, NULL, id, 'unmatched', NULL, NULL, 'transcript', NULL, NULL
  FROM tr WHERE id NOT IN (SELECT tid FROM used))
"""


def _sides(spark, sf_dir):
    seen = twin(spark, sf_dir, "observations")
    return matching.gateway_requests(seen), matching.transcript_turns(seen)


@query("j2_identity_partners", ("observations",), "WITH " + MATCH + """
SELECT gid AS id, min(tid) AS lo, max(tid) AS hi FROM same GROUP BY gid""")
def j2(spark, sf_dir):
    gateways, transcripts = _sides(spark, sf_dir)
    return matching.identity_partners(gateways, transcripts)


@query("j3_nearest_candidates", ("observations",), "WITH " + MATCH + """
SELECT gid AS id, min(delta) AS delta FROM near WHERE sm OR eq > 0 GROUP BY gid""")
def j3(spark, sf_dir):
    gateways, transcripts = _sides(spark, sf_dir)
    side, other = matching.Side.of(gateways, True), matching.Side.of(transcripts, False)
    found, _ = matching.nearest(side, other, matching.DEFAULT_WINDOW_US)
    return side.rows.join(found, "sig").select("id", "delta")


@query("j4_mutual_best_match", ("observations",), "WITH " + MATCH + """
SELECT * FROM matches WHERE gateway_id IS NOT NULL""")
def j4(spark, sf_dir):
    return matching.match(twin(spark, sf_dir, "observations")).matches.where("gateway_id IS NOT NULL")


@query("j5_unmatched_transcripts", ("observations",), "WITH " + MATCH + """
SELECT match_id, transcript_id, status, side FROM matches WHERE side = 'transcript'""")
def j5(spark, sf_dir):
    return matching.match(twin(spark, sf_dir, "observations")).matches.where("side = 'transcript'").select(
        "match_id", "transcript_id", "status", "side")


FIELD_ROWS = "\n UNION ALL ".join(
    f"SELECT m.match_id, m.gateway_id, m.transcript_id, '{f}' AS field, g.{f} AS gateway_value, t.{f} AS transcript_value "
    f"FROM matches m JOIN gw g ON g.id = m.gateway_id JOIN tr t ON t.id = m.transcript_id WHERE m.status = 'matched'"
    for f in FIELDS)
COMPARED = MATCH + f""",
raw AS ({FIELD_ROWS}),
compared AS (SELECT *, transcript_value - gateway_value AS delta,
  CASE WHEN transcript_value - gateway_value IS NULL THEN 'unavailable' WHEN transcript_value = gateway_value THEN 'equal'
       ELSE 'different' END AS status FROM raw),
paired AS (SELECT match_id, gateway_id, transcript_id,
  CASE WHEN bool_or(status = 'different') THEN 'different' WHEN bool_or(status = 'equal') THEN 'equal'
       ELSE 'unavailable' END AS status FROM compared GROUP BY ALL)
"""


def _matched(spark, sf_dir):
    seen = twin(spark, sf_dir, "observations")
    return seen, matching.match(seen)


@query("j6_field_reconciliation", ("observations",), "WITH " + COMPARED + """
SELECT match_id, field, gateway_value, transcript_value, delta, status FROM compared""")
def j6(spark, sf_dir):
    seen, result = _matched(spark, sf_dir)
    return reconcile.field_comparisons(result.matches, seen).select(
        "match_id", "field", "gateway_value", "transcript_value", "delta", "status")


@query("j7_turn_reconciliation", ("observations",), "WITH " + COMPARED + """
SELECT tr.id, CASE WHEN p.status IS NOT NULL THEN 'matched' WHEN m.match_id IS NOT NULL THEN 'unmatched'
       ELSE 'ambiguous' END AS status, p.status AS result
FROM tr LEFT JOIN paired p ON p.transcript_id = tr.id
LEFT JOIN (SELECT * FROM matches WHERE side = 'transcript') m ON m.transcript_id = tr.id""")
def j7(spark, sf_dir):
    seen, result = _matched(spark, sf_dir)
    pairs = reconcile.pair_status(reconcile.field_comparisons(result.matches, seen))
    return reconcile.turn_status(result, pairs, matching.transcript_turns(seen))


@query("a13_reconciliation_summary", ("observations",), "WITH " + COMPARED + """
SELECT (SELECT count(*) FROM gw) AS gateway_requests, (SELECT count(*) FROM tr) AS transcript_turns,
  (SELECT count(*) FROM paired) AS matched, (SELECT count(*) FROM paired WHERE status = 'equal') AS equal,
  (SELECT count(*) FROM paired WHERE status = 'different') AS different,
  (SELECT count(*) FROM paired WHERE status = 'unavailable') AS unavailable,
  (SELECT count(*) FROM matches WHERE status = 'ambiguous') AS ambiguous_gateways,
  (SELECT count(*) FROM matches WHERE status = 'unmatched' AND side = 'gateway') AS unmatched_gateways,
  (SELECT count(*) FROM matches WHERE side = 'transcript') AS unmatched_transcripts""")
def a13(spark, sf_dir):
    seen, result = _matched(spark, sf_dir)
    pairs = reconcile.pair_status(reconcile.field_comparisons(result.matches, seen))
    return reconcile.summary(result.matches, pairs, seen)


# Sessions of two channels for the window filter: one per user and day.
WINDOW = """
t AS (SELECT 's' || CAST(user_id % 2 AS VARCHAR) AS source, CAST(user_id AS VARCHAR) || '-' || CAST(ts_us // 86400000000 AS VARCHAR)
        AS session_id, CASE WHEN user_id % 10 = 0 THEN NULL ELSE ts_us END AS ts_us FROM ev),
w AS (SELECT source, session_id, min(ts_us) - 120000000 AS lower_us, max(ts_us) + 120000000 AS upper_us,
             CASE WHEN count(ts_us) = 0 THEN 'session has no reliable timestamp for gateway reconciliation' END AS unavailable
      FROM t GROUP BY ALL),
g AS (SELECT id, source, event_ts AS started_us FROM (SELECT 'o' || CAST(event_id AS VARCHAR) AS id,
        's' || CAST(event_id % 2 AS VARCHAR) AS source, ts_us AS event_ts FROM ev) q)
"""


def _windows(spark, sf_dir):
    ev = twin(spark, sf_dir, "ev")
    day = F.expr("concat_ws('-', user_id, ts_us div 86400000000)")
    turns = ev.select(
        F.concat(F.lit("s"), (F.col("user_id") % 2).cast("string")).alias("source"), day.alias("session_id"),
        F.when(F.col("user_id") % 10 != 0, F.col("ts_us")).alias("ts_us"))
    sessions = turns.select("source", "session_id").distinct().withColumns(
        {"started_us": F.lit(None).cast("long"), "updated_us": F.lit(None).cast("long")})
    seen = ev.select(
        F.concat(F.lit("o"), F.col("event_id").cast("string")).alias("id"),
        F.concat(F.lit("s"), (F.col("event_id") % 2).cast("string")).alias("source"),
        F.col("ts_us").alias("started_us"))
    return reconcile.session_windows(sessions, turns), seen


@query("f4_session_windows", ("ev",), "WITH " + WINDOW + "SELECT * FROM w")
def f4_windows(spark, sf_dir):
    return _windows(spark, sf_dir)[0]


@query("f4_window_counts", ("ev",), "WITH " + WINDOW + """
SELECT w.source, w.session_id, count(g.id) AS observations FROM w LEFT JOIN g ON g.source = w.source
  AND g.started_us BETWEEN w.lower_us AND w.upper_us WHERE w.lower_us IS NOT NULL GROUP BY ALL""")
def f4_counts(spark, sf_dir):
    return reconcile.window_counts(*_windows(spark, sf_dir))


# Sessions of five sources, one each twenty minutes: the calls near a border are in two windows.  Turns without a
# time form a session without one; s2 is not supported, s3 has no capture, s4 one that cannot be read.
_FROM = "o AS (SELECT *, lower(trim(model)) AS m FROM observations),\ngw AS (SELECT * FROM o WHERE channel = 'gateway'), tr AS (SELECT * FROM o WHERE channel = 'session_transcript'),"
SESSIONS = MATCH.replace(_FROM, """
o AS (SELECT * EXCLUDE (source), lower(trim(model)) AS m, 's' || CAST(CAST(substr(id, 2) AS BIGINT) // 2 % 5 AS VARCHAR) AS source,
        coalesce(CAST(started_us // 1200000000 AS VARCHAR), 'none') AS session_id FROM observations),
w AS (SELECT source, session_id, source || '/' || session_id AS grp, min(started_us) - 120000000 AS lo, max(started_us) + 120000000 AS hi,
        CASE WHEN source = 's2' THEN 'reconciliation is not supported for source "s2"'
             WHEN count(started_us) = 0 THEN 'session has no reliable timestamp for gateway reconciliation'
             WHEN source = 's3' THEN 'gateway capture not available'
             WHEN source = 's4' THEN 'gateway capture could not be read: profile p: broken' END AS reason
      FROM o WHERE channel = 'session_transcript' GROUP BY source, session_id),
gw AS (SELECT o.* REPLACE (w.grp || '#' || o.id AS id), w.grp FROM o JOIN w ON o.source = w.source AND o.started_us BETWEEN w.lo AND w.hi
       WHERE channel = 'gateway' AND reason IS NULL),
tr AS (SELECT o.* REPLACE (w.grp || '#' || o.id AS id), w.grp FROM o JOIN w USING (source, session_id)
       WHERE channel = 'session_transcript' AND reason IS NULL),""").replace(
    "FROM gw g JOIN tr t ON ", "FROM gw g JOIN tr t ON g.grp = t.grp AND ")
INSPECTED = SESSIONS + COMPARED[len(MATCH):]


def _inspected(spark, sf_dir):
    seen = twin(spark, sf_dir, "observations").withColumn(
        "source", F.expr("concat('s', CAST(substr(id, 2) AS BIGINT) div 2 % 5)"))
    turns = matching.transcript_turns(seen).withColumn(
        "session_id", F.coalesce(F.expr("CAST(started_us div 1200000000 AS STRING)"), F.lit("none")))
    stamps = turns.select("source", "session_id", F.col("started_us").alias("ts_us"))
    none = F.lit(None).cast("long")
    sessions = turns.select("source", "session_id").distinct().withColumns({"started_us": none, "updated_us": none})
    captured = spark.createDataFrame(
        [("s0", None), ("s1", None), ("s2", None), ("s4", "profile p: broken")], "source string, unreadable string")
    return reconcile.inspect_sessions(
        reconcile.session_windows(sessions, stamps), turns, matching.gateway_requests(seen), captured,
        supported=("s0", "s1", "s3", "s4"))


@query("inspect_reconciliation", ("observations",), "WITH " + INSPECTED + """,
c AS (SELECT grp, count(*) AS n FROM gw GROUP BY grp), d AS (SELECT grp, count(*) AS n FROM tr GROUP BY grp),
e AS (SELECT split_part(gateway_id, '#', 1) AS grp, count(*) AS n, count(*) FILTER (status = 'equal') AS eq,
        count(*) FILTER (status = 'different') AS df, count(*) FILTER (status = 'unavailable') AS na FROM paired GROUP BY 1),
f AS (SELECT split_part(coalesce(gateway_id, transcript_id), '#', 1) AS grp, count(*) FILTER (status = 'ambiguous' AND side = 'gateway') AS a,
        count(*) FILTER (status = 'unmatched' AND side = 'gateway') AS u, count(*) FILTER (side = 'transcript') AS t FROM matches GROUP BY 1)
SELECT source, session_id, reason, """ + ", ".join(
    f"CASE WHEN reason IS NULL THEN coalesce({v}, 0) END AS {n}" for n, v in (
        ("gateway_requests", "c.n"), ("transcript_turns", "d.n"), ("matched", "e.n"), ("equal", "e.eq"), ("different", "e.df"),
        ("unavailable", "e.na"), ("ambiguous_gateways", "f.a"), ("unmatched_gateways", "f.u"), ("unmatched_transcripts", "f.t"))) + """
FROM w LEFT JOIN c USING (grp) LEFT JOIN d USING (grp) LEFT JOIN e USING (grp) LEFT JOIN f USING (grp)""")
def inspect_reconciliation(spark, sf_dir):
    return _inspected(spark, sf_dir)[0]


@query("inspect_turns", ("observations",), "WITH " + INSPECTED + """
SELECT split_part(tr.id, '#', 2) AS id, tr.source, tr.session_id,
  CASE WHEN p.status IS NOT NULL THEN 'matched' WHEN m.match_id IS NOT NULL THEN 'unmatched' ELSE 'ambiguous' END AS status,
  p.status AS result FROM tr LEFT JOIN paired p ON p.transcript_id = tr.id
LEFT JOIN (SELECT * FROM matches WHERE side = 'transcript') m ON m.transcript_id = tr.id""")
def inspect_turns(spark, sf_dir):
    return _inspected(spark, sf_dir)[1]


@query("inspect_matches", ("observations",), "WITH " + SESSIONS + """
SELECT split_part(coalesce(gateway_id, transcript_id), '/', 1) AS source,
  split_part(split_part(coalesce(gateway_id, transcript_id), '#', 1), '/', 2) AS session_id,
  split_part(gateway_id, '#', 2) AS gateway_id, split_part(transcript_id, '#', 2) AS transcript_id, status, confidence, reasons, side,
  split_part(first_candidate, '#', 2) AS first_candidate, split_part(last_candidate, '#', 2) AS last_candidate FROM matches""")
def inspect_matches(spark, sf_dir):
    return _inspected(spark, sf_dir)[2]


@query("f4_in_window", ("ev",), "WITH " + WINDOW + """
SELECT w.source, w.session_id, g.id, g.started_us FROM w JOIN g ON g.source = w.source AND g.started_us BETWEEN w.lower_us AND w.upper_us""")
def f4_in_window(spark, sf_dir):
    windows, seen = _windows(spark, sf_dir)
    return reconcile.in_session_window(windows, seen)


# ---------------------------------------------------------------- projection

@query("p17_counter_observations", ("counters",), usage_queries.DELTAS + """
SELECT 'codex:turn:' || session_id || '#' || CAST(sequence AS VARCHAR) AS id, session_id, ts_us AS started_us,
       CASE WHEN input - cached >= 0 THEN input - cached END AS fresh_input,
       CASE WHEN input - cached >= 0 THEN 'derived' WHEN input - cached < 0 THEN 'unknown' END AS fresh_input_kind,
       cached AS cached_input, input AS total_input, output, reasoning AS reasoning_output, total,
       CASE WHEN total IS NULL THEN 'unknown' ELSE 'complete' END AS completeness FROM turns""")
def p17_counters(spark, sf_dir):
    turns = usage.counter_deltas(twin(spark, sf_dir, "counters")).withColumns({
        "turn_id": F.concat_ws("#", "session_id", "sequence"), "model": F.lit("")})
    return observations.from_counter_usage(turns, "turn").select(
        "id", "session_id", "started_us", "fresh_input", "fresh_input_kind", "cached_input", "total_input", "output",
        "reasoning_output", "total", "completeness")


@query("p17_message_observations", ("messages",), "WITH " + usage_queries.BEARING + """,
n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ord) AS sequence,
             CASE WHEN NOT conflict AND input >= 0 THEN input END AS i,
             CASE WHEN NOT conflict AND cache_read >= 0 THEN cache_read END AS r,
             CASE WHEN NOT conflict AND cache_write >= 0 THEN cache_write END AS w,
             CASE WHEN NOT conflict AND output >= 0 THEN output END AS o FROM kept)
SELECT 'claude:turn:' || CASE WHEN message_id <> '' THEN message_id ELSE session_id || '#' || CAST(sequence AS VARCHAR) END AS id,
       session_id, model, i AS fresh_input, r AS cached_input, w AS cache_creation_input, i + r + w AS total_input,
       o AS output, i + r + w + o AS total, CASE WHEN i + r + w + o IS NOT NULL THEN 'complete' ELSE 'partial' END AS completeness
FROM n""")
def p17_messages(spark, sf_dir):
    kept = usage.dedup_messages(usage.usage_bearing(twin(spark, sf_dir, "messages")))
    return observations.from_message_usage(usage.message_turns(kept), "turn").select(
        "id", "session_id", "model", "fresh_input", "cached_input", "cache_creation_input", "total_input", "output",
        "total", "completeness")


@query("p17_counter_session_observations", ("counters",), "WITH " + usage_queries.BEST + """
SELECT 'codex:session:' || session_id AS id, session_id, CAST(NULL AS VARCHAR) AS turn_id, CAST(NULL AS BIGINT) AS started_us,
       CASE WHEN input - cached >= 0 THEN input - cached END AS fresh_input, cached AS cached_input, input AS total_input, output,
       reasoning AS reasoning_output, total,
       CASE WHEN input IS NOT NULL AND output IS NOT NULL THEN 'complete' ELSE 'partial' END AS completeness FROM best""")
def p17_counter_sessions(spark, sf_dir):
    sessions = usage.counter_session_usage(twin(spark, sf_dir, "counters")).withColumns({
        "model": F.lit(""), "started_us": F.lit(None).cast("long")})
    return observations.from_counter_usage(sessions, "session").select(
        "id", "session_id", "turn_id", "started_us", "fresh_input", "cached_input", "total_input", "output", "reasoning_output",
        "total", "completeness")


@query("p17_message_session_observations", ("messages",), "WITH " + usage_queries.BEARING + "," + usage_queries.TOTALS + """,
v AS (SELECT *, CASE WHEN n > 0 AND ci = n THEN si END AS i, CASE WHEN n > 0 AND cr = n THEN sr END AS r,
             CASE WHEN n > 0 AND cw = n THEN sw END AS w, CASE WHEN n > 0 AND co = n THEN so END AS o FROM t)
SELECT 'claude:session:' || session_id AS id, session_id, CAST(i AS BIGINT) AS fresh_input, CAST(r AS BIGINT) AS cached_input,
       CAST(w AS BIGINT) AS cache_creation_input, CAST(i + r + w AS BIGINT) AS total_input, CAST(o AS BIGINT) AS output,
       CAST(i + r + w + o AS BIGINT) AS total,
       CASE WHEN i + r + w + o IS NOT NULL THEN 'derived' END AS total_kind FROM v""")
def p17_message_sessions(spark, sf_dir):
    kept = usage.dedup_messages(usage.usage_bearing(twin(spark, sf_dir, "messages")))
    sessions = usage.message_session_usage(kept).withColumns({
        "model": F.lit(""), "started_us": F.lit(None).cast("long")})
    return observations.from_message_usage(sessions, "session").select(
        "id", "session_id", "fresh_input", "cached_input", "cache_creation_input", "total_input", "output", "total", "total_kind")


@query("p18_observation_problems", ("ev",), """
WITH o AS (SELECT 'o' || CAST(event_id - event_id % 400 % 2 AS VARCHAR) AS id, event_id AS e FROM ev)
SELECT id, p AS problem FROM (
  SELECT id, unnest([CASE WHEN e % 50 = 0 THEN 'invalid channel' END, CASE WHEN e % 70 = 0 THEN 'source is required' END,
    CASE WHEN e % 90 = 0 THEN 'finishedAt precedes startedAt' END, CASE WHEN e % 30 = 0 THEN 'output: kind requires a value' END,
    CASE WHEN e % 110 = 0 THEN 'total: value requires a usable kind' END]) AS p FROM o) q WHERE p IS NOT NULL
UNION ALL SELECT id, 'duplicate observation id' FROM o GROUP BY id HAVING count(*) > 1""")
def p18(spark, sf_dir):
    e = F.col("event_id")
    none, text = F.lit(None).cast("long"), F.lit(None).cast("string")
    rows = twin(spark, sf_dir, "ev").select(
        F.lit(1).alias("schema_version"),
        F.concat(F.lit("o"), (e - e % 400 % 2).cast("string")).alias("id"),
        F.when(e % 50 == 0, "mail").otherwise("gateway").alias("channel"), F.lit("request").alias("scope"),
        F.when(e % 70 == 0, "").otherwise("s").alias("source"), F.col("ts_us").alias("started_us"),
        F.when(e % 90 == 0, F.col("ts_us") - 1).alias("finished_us"),
        F.lit("unknown").alias("outcome"), F.lit("unknown").alias("completeness"),
        *[c for f in FIELDS if f not in ("output", "total") for c in (none.alias(f), text.alias(f"{f}_kind"))],
        none.alias("output"), F.when(e % 30 == 0, "measured").alias("output_kind"),
        F.when(e % 110 == 0, F.col("v")).alias("total"), F.when(e % 110 == 0, "unknown").alias("total_kind"))
    return observations.problems(rows)
