"""Registered queries: price resolution and cost."""

from __future__ import annotations

from pyspark.sql import functions as F

from usagelake.operators import pricing
from usagelake.plans.registry import query
from usagelake.plans.twins import table, twin
from usagelake.sources import catalog

# A small price list for the turns derived from the shared tables: provider,
# sku, model, aliases, currency, effective_us, catalog source, base rates,
# tiers (name, up_to, rates).  Rates: input, cached_input, cache_read,
# cache_write, output.
PRICES = [
    ("acme", "alpha-large", "alpha-large", ["acme/alpha-large"], "USD", None, "embedded", (0, 0, 0, 0, 0),
     [("base", 200000, (300000, 0, 60000, 0, 1200000)), ("long", None, (600000, 0, 120000, 0, 2400000))]),
    ("acme", "alpha-large", "alpha-large", [], "USD", 1704844800000000, "embedded", (250000, 50000, 0, 0, 900000), []),
    ("acme", "alpha-mini", "alpha-mini", [], "USD", 1704412800000000, "embedded", (7, 3, 0, 0, 11), []),
    ("beta-co", "beta", "beta", ["Beta-2"], "EUR", None, "embedded", (5000000, 500000, 0, 0, 30000000), []),
    ("beta-co", "beta-2x", "beta-2", [], "USD", None, "override", (4000000, 400000, 0, 0, 20000000), []),
    ("gam", "gamma", "gamma", [], "USD", None, "cache", (0, 0, 0, 0, 0),
     [("only", 100000, (1, 1, 1, 0, 1999999))]),
    ("del", "delta", "delta", [], "USD", None, "cache", (10000000, 1000000, 0, 12500000, 50000000), []),
]
_RATES = "struct<input: bigint, cached_input: bigint, cache_read: bigint, cache_write: bigint, output: bigint>"
_SCHEMA = (
    "provider string, sku string, model string, aliases array<string>, currency string, effective_us bigint, "
    f"catalog_source string, rates {_RATES}, tiers array<struct<name: string, up_to: bigint, rates: {_RATES}>>"
)
_RANK = {"embedded": 1, "cache": 2, "override": 3}


def profiles(spark):
    return spark.createDataFrame(PRICES, _SCHEMA)


def _null(value):
    return "NULL" if value is None else str(value)


def _price_rows() -> str:
    rows = []
    for number, (prov, sku, model, names, cur, eff, src, rates, tiers) in enumerate(PRICES):
        for name in dict.fromkeys(n.lower() for n in (model, sku, *names)):
            for place, (tier, up_to, r) in enumerate(tiers or [(None, None, rates)]):
                label = "NULL" if tier is None else f"'{tier}'"
                rows.append(
                    f"({number}, '{name}', '{prov}', '{sku}', '{cur}', CAST({_null(eff)} AS BIGINT), {_RANK[src]}, {place}, "
                    f"{label}, CAST({_null(up_to)} AS BIGINT), {', '.join(map(str, r))})")
    return ",\n".join(rows)


COST = f"""
prices(pid, alias, provider, sku, currency, eff, source_rank, place, tier, up_to, r_in, r_cached, r_read, r_write, r_out) AS (
  SELECT * FROM (VALUES {_price_rows()}) v),
heads AS (SELECT DISTINCT pid, alias, provider, sku, currency, eff, source_rank FROM prices),
res AS (
  SELECT t.*, h.pid, h.provider AS prov, h.sku AS psku, h.currency AS cur
  FROM priced t LEFT JOIN heads h ON lower(t.model) = h.alias AND (h.eff IS NULL OR t.ts_us IS NULL OR h.eff <= t.ts_us)
  QUALIFY row_number() OVER (PARTITION BY t.sequence ORDER BY source_rank DESC, eff IS NULL, eff DESC, h.sku) = 1),
split AS (
  SELECT *, CASE WHEN billable_cache_read_kind = 'measured' THEN billable_cache_read END AS rd,
         billable_input - CASE WHEN billable_cache_read_kind = 'measured' THEN billable_cache_read END
           - coalesce(billable_cache_write, 0) AS fresh FROM res),
tiered AS (
  SELECT s.*, p.tier, r_in, r_cached, r_read, r_write, r_out, p.alias IS NULL AS no_tier
  FROM split s LEFT JOIN (SELECT DISTINCT pid, place, tier, up_to, r_in, r_cached, r_read, r_write, r_out, 'x' AS alias FROM prices) p
    ON s.pid = p.pid AND (p.up_to IS NULL OR fresh + rd + coalesce(billable_cache_write, 0) <= p.up_to)
  QUALIFY row_number() OVER (PARTITION BY sequence ORDER BY place) = 1),
judged AS (
  SELECT *, CASE
    WHEN pid IS NULL THEN 'pricing profile unavailable for model "' || model || '"'
    WHEN billable_input IS NULL AND billable_cache_write IS NULL AND billable_output IS NULL
         AND billable_cache_read_kind IS NULL THEN 'billable usage unavailable'
    WHEN billable_input IS NULL THEN 'billable input unavailable'
    WHEN rd IS NULL THEN 'billable cache read unavailable'
    WHEN billable_output IS NULL THEN 'billable output unavailable'
    WHEN fresh < 0 THEN 'billable cache tokens exceed input'
    WHEN no_tier THEN 'pricing tier unavailable for turn input'
    WHEN r_write > 0 AND billable_cache_write IS NULL THEN 'billable cache write unavailable' END AS unavailable FROM tiered),
costs AS (
  SELECT *, unavailable IS NULL AS ok,
    CASE WHEN unavailable IS NULL THEN fresh * r_in // 1000000 END AS m_fresh,
    CASE WHEN unavailable IS NULL THEN rd * (CASE WHEN r_read <> 0 THEN r_read ELSE r_cached END) // 1000000 END AS m_read,
    CASE WHEN unavailable IS NULL THEN coalesce(billable_cache_write, 0) * r_write // 1000000 END AS m_write,
    CASE WHEN unavailable IS NULL THEN billable_output * r_out // 1000000 END AS m_out FROM judged)
"""


def _costs(spark, sf_dir):
    return pricing.turn_cost(twin(spark, sf_dir, "priced"), profiles(spark))


@query("j8_price_resolution", ("priced",), "WITH " + COST + """
SELECT sequence, model, prov AS provider, psku AS sku, cur AS currency FROM res""")
def j8(spark, sf_dir):
    return pricing.resolve_prices(twin(spark, sf_dir, "priced"), profiles(spark)).select(
        "sequence", "model", F.col("profile.provider").alias("provider"), F.col("profile.sku").alias("sku"),
        F.col("profile.currency").alias("currency"))


@query("j9_tier_selection", ("priced",), "WITH " + COST + """
SELECT sequence, psku AS sku, tier FROM costs WHERE ok""")
def j9(spark, sf_dir):
    return _costs(spark, sf_dir).where("status = 'available'").select("sequence", "sku", "tier")


@query("a16_turn_cost", ("priced",), "WITH " + COST + """
SELECT session_id, sequence, CASE WHEN ok THEN 'available' ELSE 'unavailable' END AS status, unavailable,
       m_fresh AS fresh_input_micros, m_read AS cache_read_micros, m_write AS cache_write_micros,
       m_out AS output_micros, m_fresh + m_read + m_write + m_out AS total_micros FROM costs""")
def a16(spark, sf_dir):
    return _costs(spark, sf_dir).select(
        "session_id", "sequence", "status", "unavailable", "fresh_input_micros", "cache_read_micros",
        "cache_write_micros", "output_micros", "total_micros")


# A user here rarely prices in full, so a user's turns are taken as several sessions.
@query("a17_session_cost", ("priced",), "WITH " + COST + """,
s AS (SELECT source, session_id || '-' || CAST(sequence % 500 AS VARCHAR) AS session_id, count(*) AS turns,
             count(*) FILTER (NOT ok) AS unpriced_turns,
             count(*) FILTER (pid IS NULL) AS missing_profile_turns, min(cur) FILTER (ok) AS lo, max(cur) FILTER (ok) AS hi,
             sum(fresh) FILTER (ok) AS f, sum(rd) FILTER (ok) AS r, sum(coalesce(billable_cache_write, 0)) FILTER (ok) AS w,
             sum(m_fresh + m_read + m_write + m_out) AS m
      FROM costs GROUP BY 1, 2),
g AS (SELECT *, unpriced_turns = 0 AND lo = hi AS good FROM s)
SELECT source, session_id, turns, unpriced_turns, missing_profile_turns,
       CASE WHEN good THEN 'available' ELSE 'unavailable' END AS status, CASE WHEN good THEN lo END AS currency,
       CASE WHEN good THEN CAST(m AS BIGINT) END AS total_micros,
       CASE WHEN good AND f + r + w <> 0 THEN CAST((r + w) * 10000 // (f + r + w) AS BIGINT) END AS cache_hit_basis_points
FROM g""")
def a17(spark, sf_dir):
    finer = F.concat_ws("-", "session_id", (F.col("sequence") % 500).cast("string"))
    costs = _costs(spark, sf_dir).withColumn("session_id", finer)
    return pricing.session_cost(costs).select(
        "source", "session_id", "turns", "unpriced_turns", "missing_profile_turns", "status", "currency",
        "total_micros", "cache_hit_basis_points")


@query("a17_cost_reasons", ("priced",), "WITH " + COST + """,
c AS (SELECT source, session_id, min_by(cur, sequence) AS first_cur FROM costs WHERE ok GROUP BY ALL)
SELECT source, session_id, sequence, 'turn ' || CAST(sequence AS VARCHAR) || ': ' || unavailable AS reason
FROM costs WHERE NOT ok AND pid IS NOT NULL
UNION ALL
SELECT source, session_id, NULL, 'pricing unavailable for ' || max(model) || ' (' || CAST(count(*) AS VARCHAR) || ' turns)'
FROM costs WHERE pid IS NULL GROUP BY source, session_id, lower(model)
UNION ALL
SELECT costs.source, costs.session_id, sequence, 'turn ' || CAST(sequence AS VARCHAR) || ' has currency ' || cur
FROM costs JOIN c USING (source, session_id) WHERE ok AND cur <> first_cur""")
def a17_reasons(spark, sf_dir):
    return pricing.cost_reasons(_costs(spark, sf_dir))


ROLLUP = """
  count(DISTINCT session_id) AS sessions, count(*) AS model_calls, max(cur) AS currency,
  CAST(sum(fresh) AS BIGINT) AS fresh_input, CAST(sum(rd) AS BIGINT) AS cache_read,
  CAST(sum(billable_output) AS BIGINT) AS output, CAST(sum(m_fresh + m_read + m_write + m_out) AS BIGINT) AS total_micros
"""


@query("a18_cost_rollup", ("priced",), "WITH " + COST + f"""
SELECT CASE WHEN grouping(psku) = 1 THEN 'source' ELSE 'model' END AS level, prov AS provider, source, psku AS sku, model,
{ROLLUP} FROM costs WHERE ok GROUP BY GROUPING SETS ((prov, source, cur), (prov, source, psku, model, cur))""")
def a18(spark, sf_dir):
    return pricing.cost_rollup(_costs(spark, sf_dir)).select(
        "level", "provider", "source", "sku", "model", "sessions", "model_calls", "currency", "fresh_input",
        "cache_read", "output", "total_micros")


@query("f5_provider_filter", ("priced",), "WITH " + COST + """
SELECT source, count(*) AS model_calls FROM costs WHERE ok AND lower(prov) = 'acme' GROUP BY source""")
def f5_provider(spark, sf_dir):
    return pricing.filter_provider(_costs(spark, sf_dir), "ACME").groupBy("source").agg(
        F.count("*").alias("model_calls"))


@query("a20_cache_hit_basis_points", ("priced",), "WITH " + COST + """
SELECT sequence, CASE WHEN fresh + rd + coalesce(billable_cache_write, 0) <> 0 THEN
       CAST((rd + coalesce(billable_cache_write, 0)) * 10000 // (fresh + rd + coalesce(billable_cache_write, 0)) AS BIGINT)
       END AS basis_points FROM costs WHERE ok""")
def a20(spark, sf_dir):
    return _costs(spark, sf_dir).where("status = 'available'").select(
        "sequence", pricing.cache_hit_basis_points().alias("basis_points"))


@query("j11_missing_prices", ("priced",), "WITH " + COST + """
SELECT CASE WHEN min(model) LIKE '%/%' THEN split_part(min(model), '/', 1) ELSE '' END AS provider,
       CASE WHEN min(model) LIKE '%/%' THEN split_part(min(model), '/', 2) ELSE min(model) END AS model,
       count(*) AS turns, count(DISTINCT session_id) AS sessions
FROM costs WHERE pid IS NULL GROUP BY lower(model)""")
def j11(spark, sf_dir):
    return pricing.missing_prices(twin(spark, sf_dir, "priced"), profiles(spark))


@query("a19_missing_price_providers", ("priced",), "WITH " + COST + """
SELECT CASE WHEN model LIKE '%/%' THEN split_part(model, '/', 1) ELSE '' END AS provider, count(*) AS turns
FROM costs WHERE pid IS NULL GROUP BY 1""")
def a19(spark, sf_dir):
    missing = pricing.missing_prices(twin(spark, sf_dir, "priced"), profiles(spark))
    return missing.groupBy("provider").agg(F.sum("turns").alias("turns"))


def _listed(spark, sf_dir):
    base = table(spark, sf_dir, "part").select(
        F.concat(F.lit("pr"), (F.col("p_partkey") % 5).cast("string")).alias("provider"),
        F.concat(F.lit("sku-"), F.col("p_partkey").cast("string")).alias("sku"),
        F.concat(F.lit("AL-"), (F.col("p_partkey") % 100).cast("string")).alias("model"))
    higher = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("PR"), (F.col("s_suppkey") % 5).cast("string")).alias("provider"),
        F.concat(F.lit("al-"), (F.col("s_suppkey") % 40).cast("string")).alias("sku"),
        F.concat(F.lit("m"), F.col("s_suppkey").cast("string")).alias("model"))
    extra = {"aliases": F.array().cast("array<string>"), "effective_us": F.lit(None).cast("long")}
    return base.withColumns(extra), higher.withColumns(extra)


@query("j10_catalog_overlay", (), """
WITH b AS (SELECT 'pr' || CAST(p_partkey % 5 AS VARCHAR) AS provider, 'sku-' || CAST(p_partkey AS VARCHAR) AS sku,
                  'AL-' || CAST(p_partkey % 100 AS VARCHAR) AS model FROM part),
h AS (SELECT 'PR' || CAST(s_suppkey % 5 AS VARCHAR) AS provider, 'al-' || CAST(s_suppkey % 40 AS VARCHAR) AS sku,
             'm' || CAST(s_suppkey AS VARCHAR) AS model FROM supplier)
SELECT * FROM h
UNION ALL
SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM h WHERE lower(h.provider) = lower(b.provider)
  AND (lower(h.sku) IN (lower(b.sku), lower(b.model)) OR lower(h.model) IN (lower(b.sku), lower(b.model))))""")
def j10(spark, sf_dir):
    base, higher = _listed(spark, sf_dir)
    return catalog.overlay(base, higher).select("provider", "sku", "model")


@query("u3_except_by_anti_join", ("priced",), "WITH " + COST + """
SELECT source, session_id, count(*) AS unpriced_turns FROM costs WHERE NOT ok GROUP BY source, session_id""")
def u3(spark, sf_dir):
    turns = twin(spark, sf_dir, "priced")
    priced = _costs(spark, sf_dir).where("status = 'available'").select("sequence")
    return turns.join(priced, "sequence", "left_anti").groupBy("source", "session_id").agg(
        F.count("*").alias("unpriced_turns"))
