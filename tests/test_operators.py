"""Edge cases of usage, pricing, coverage and rules."""

import json
import random

import pytest
from pyspark.sql import functions as F

from usagelake.functions.text import clean_path, model_of, parse_time, provider_of, token_estimate
from usagelake.operators import coverage, gateway, pricing, rules, usage
from usagelake.sources import catalog

COUNTERS = "session_id string, ord bigint, input bigint, cached bigint, output bigint, reasoning bigint, total bigint"


def test_counter_deltas_and_resets(spark):
    df = spark.createDataFrame([
        ("a", 1, 10, 1, 5, None, 15), ("a", 5, 20, 1, 6, 4, 26), ("a", 6, 25, 1, 6, 3, 31), ("a", 7, 26, 2, 7, None, 33),
        ("a", 9, 3, 0, 0, None, 3), ("b", 1, 0, 0, 0, 0, 0)], COUNTERS)
    rows = {(r.session_id, r.sequence): r for r in usage.counter_deltas(df, block=3).collect()}
    assert [rows["a", i].total for i in range(1, 6)] == [15, 11, None, 2, None]
    assert [rows["a", i].reasoning for i in (1, 2, 4)] == [None, 4, None]
    assert rows["b", 1].total == 0 and rows["b", 1].total_kind == "derived"
    sessions = {r.session_id: r for r in usage.counter_session_usage(df).collect()}
    assert sessions["a"].total == 33 and sessions["b"].total == 0 and sessions["b"].total_kind == "measured"


def test_negative_totals_never_win(spark):
    df = spark.createDataFrame([("a", 1, -1, 0, 0, None, -1)], COUNTERS)
    (row,) = usage.counter_session_usage(df).collect()
    assert row.total is None and row.total_kind is None


MESSAGES = "session_id string, ord bigint, message_id string, model string, ts_us bigint, input bigint, cache_read bigint, cache_write bigint, output bigint"


def test_message_usage_is_all_or_nothing(spark):
    df = spark.createDataFrame([
        ("a", 1, "m1", "x", 1, 1, 2, 3, 4), ("a", 2, "m1", "x", 1, 1, 2, 3, 4), ("a", 3, "m2", "x", 1, 5, None, 1, 1),
        ("a", 4, "m3", "x", 1, 9, 9, 9, 9), ("a", 5, "m3", "x", 1, 9, 9, 9, 8), ("a", 6, "", "<synthetic>", 1, 7, 7, 7, 7),
        ("b", 1, "", "x", 1, -1, None, None, None)], MESSAGES)
    kept = usage.dedup_messages(usage.usage_bearing(df))
    rows = {r.session_id: r for r in usage.message_session_usage(kept).collect()}
    a, b = rows["a"], rows["b"]
    assert (a.accepted, a.conflicts, a.input, a.output, a.cached, a.total) == (2, 1, 6, 5, None, None)
    assert (a.cache_read, a.cache_read_kind, a.cache_write) == (None, "unknown", 4)
    assert (b.input, b.input_kind, b.cached_kind, b.has_reported_usage) == (None, "unknown", None, False)


def test_dedup_equals_a_walk_in_order(spark):
    draw = random.Random(5)
    some = lambda: draw.choice([None, 0, 1, 1, 1])
    rows = [(draw.choice("ab"), i, draw.choice([None, "", "m1", "m2", "m3", "m4", "m5"]), draw.choice([None, "x", "y"]),
             draw.choice([None, i]), some(), 1, some() if i % 2 else None, 3) for i in draw.sample(range(200), 60)]
    want = {}
    for session, at, message, model, ts, *fields in sorted(rows, key=lambda r: r[1]):
        first = want.setdefault((session, message or "", None if message else at), [at, model, ts, fields, False, 0])
        first[4] |= fields != first[3]
        first[5] += 1
    kept = usage.dedup_messages(spark.createDataFrame(rows, MESSAGES))
    got = sorted((r.session_id, r.message_id, r.ord, r.model, r.ts_us, r.input, r.cache_read, r.cache_write, r.output,
                  r.conflict, r.copies) for r in kept.collect())
    assert got == sorted((s, m, at, model, ts, *fields, conflict, copies)
                         for (s, m, _), (at, model, ts, fields, conflict, copies) in want.items())
    assert {r[9] for r in got} == {True, False}
    plan = kept.drop("model")._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "Sort" not in plan


def test_percentiles(spark):
    df = spark.createDataFrame([("x", i) for i in range(1, 11)] + [("one", 7), ("none", None)], "k string, v bigint")
    rows = {r.k: r for r in coverage.nearest_rank(df, ["k"], "v", block=2).collect()}
    assert (rows["x"].p50, rows["x"].p90, rows["x"].p95, rows["x"].total) == (5, 9, 10, 55)
    assert (rows["one"].p50, rows["one"].p95, rows["one"].samples) == (7, 7, 1)
    assert "none" not in rows


RATES = {"input_micros_per_million": 300000, "cache_read_micros_per_million": 60000, "output_micros_per_million": 1200000}


def make_catalog(tmp_path, **changes):
    profile = {
        "provider": "acme", "sku": "M3", "model": "M3", "aliases": ["acme/M3"], "currency": "USD", "rates": {},
        "tiers": [{"name": "base", "up_to_input_tokens": 512000, "rates": RATES},
                  {"name": "long", "rates": {k: 2 * v for k, v in RATES.items()}}],
        "sources": [{"url": "https://example.com/prices"}], **changes}
    path = tmp_path / "catalog.json"
    path.write_text(json.dumps({"version": "v1", "profiles": [profile]}, indent=1))
    return str(path)


def turns(spark, *rows):
    data = [("s", "src", i + 1, 1, model, inp, "measured", read, "measured", None, None, out, "measured")
            for i, (model, inp, read, out) in enumerate(rows)]
    return spark.createDataFrame(data, (
        "session_id string, source string, sequence bigint, ts_us bigint, model string, billable_input bigint, "
        "billable_input_kind string, billable_cache_read bigint, billable_cache_read_kind string, billable_cache_write bigint, "
        "billable_cache_write_kind string, billable_output bigint, billable_output_kind string"))


def test_tiers_and_truncation(spark, tmp_path):
    profiles = catalog.read_catalog(spark, make_catalog(tmp_path))
    assert catalog.catalog_errors(profiles).count() == 0
    costs = pricing.turn_cost(
        turns(spark, ("m3", 512000, 0, 0), ("ACME/M3", 512001, 0, 0), ("M3", 3, 0, 1), ("other", 1, 0, 0), ("M3", 1, 2, 0)),
        profiles)
    got = {r.sequence: r for r in costs.collect()}
    assert (got[1].total_micros, got[1].tier) == (153600, "base")
    assert (got[2].total_micros, got[2].tier) == (307200, "long")
    assert (got[3].fresh_input_micros, got[3].output_micros, got[3].total_micros) == (0, 1, 1)
    assert got[4].unavailable == 'pricing profile unavailable for model "other"'
    assert got[5].unavailable == "billable cache tokens exceed input"
    (session,) = pricing.session_cost(costs).collect()
    assert session.status == "unavailable" and session.unpriced_turns == 2
    reasons = {r.reason for r in pricing.cost_reasons(costs).collect()}
    assert reasons == {"turn 5: billable cache tokens exceed input", "pricing unavailable for other (1 turns)"}


def test_sessions_without_turns_are_priced_once(spark, tmp_path):
    profiles = catalog.read_catalog(spark, make_catalog(tmp_path))
    some = turns(spark, ("", 1000, 0, 1000))
    names = [c for c in some.columns if c.startswith("billable")]
    sessions = some.select("session_id", "source", F.lit("M3").alias("model"), F.lit(9).cast("long").alias("updated_us"), *names)
    sessions = sessions.unionByName(sessions.withColumn("session_id", F.lit("alone")))
    rows = {r.session_id: r for r in pricing.turn_cost(pricing.turns_for_cost(some, sessions), profiles).collect()}
    assert {r.status for r in rows.values()} == {"available"} and rows["alone"].sequence == 1 and rows["alone"].ts_us == 9


@pytest.mark.parametrize("changes,problem", [
    ({"currency": ""}, "currency is required"), ({"rates": {"input_micros_per_million": -1}}, "rates must be non-negative"),
    ({"sources": [{"url": "ftp://x"}]}, "source url is invalid"), ({"tiers": [{"rates": {}}]}, "tier name is required"),
])
def test_catalog_errors(spark, tmp_path, changes, problem):
    found = catalog.catalog_errors(catalog.read_catalog(spark, make_catalog(tmp_path, **changes)))
    assert problem in {r.problem for r in found.collect()}


def test_oversized_thresholds(spark):
    sizes = [65536, 65537, 262143, 262144]
    rows = [("s", i, "tool_result", "complete", n, "", "", None, None) for i, n in enumerate(sizes)]
    rows += [("s", None, "tool_result", "complete", 10**6, "", "", None, None), ("s", 9, "tool_result", "truncated", 10**6, "", "", None, None)]
    df = spark.createDataFrame(rows, (
        "session_id string, turn_sequence bigint, kind string, completeness string, content_bytes bigint, tool_name string, "
        "tool_call_id string, tokens bigint, tokens_kind string")).withColumn("ord", F.monotonically_increasing_id())
    for limit in (rules.MAX_OUTPUT_BYTES, 0, -5):
        got = rules.oversized_output(df, max_bytes=limit).collect()
        assert sorted((r.content_bytes, r.severity) for r in got) == [(65537, "medium"), (262143, "medium"), (262144, "high")]
    assert got[0].title == "Tool returned an oversized output"


def test_text_functions(spark):
    paths = {
        "": "", "  ": "", "a//b/./c": "a/b/c", "/a/../../b": "/b", "../x/..": "..", "a/..": ".", " /x/ ": "/x", "//": "/",
        "../../a": "../../a", "a/b/../../..": ".."}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r[0]: r[1] for r in df.select("p", clean_path(F.col("p"))).collect()} == paths
    names = spark.createDataFrame([("a/b",), ("/b",), ("a/",), ("x",), ("a/b/c",)], "m string")
    got = [tuple(r) for r in names.select(provider_of(F.col("m")), model_of(F.col("m"))).collect()]
    assert got == [("a", "b"), ("", "/b"), ("", "a/"), ("", "x"), ("a", "b/c")]
    times = spark.createDataFrame([("2026-01-01",), ("2026-01-01T00:00:00.123456789+01:00",), ("bad",), ("",)], "t string")
    got = [r[0] for r in times.select(F.unix_micros(parse_time(F.col("t")))).collect()]
    assert got == [None, 1767222000123456, None, None]
    texts = spark.createDataFrame([("",), ("é",), ("abcd",), ("abcde",)], "t string")
    assert [r[0] for r in texts.select(token_estimate(F.col("t"))).collect()] == [None, 1, 1, 2]


def test_find_by_id(spark):
    rows = spark.createDataFrame([("abc",), ("abcd",), ("xyz",)], "id string")
    wanted = spark.createDataFrame([("abc",), ("ab",), ("x",), ("q",), ("abcde",)], "wanted string")
    got = {r.wanted: (r.status, r.found) for r in gateway.find_by_id(rows, wanted).collect()}
    assert got == {"abc": ("found", "abc"), "ab": ("ambiguous", None), "x": ("found", "xyz"), "q": ("not_found", None),
                   "abcde": ("not_found", None)}
