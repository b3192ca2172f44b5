"""Tool-output coverage: counts, ratios, exact percentiles, three scopes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelake.functions.measure import authoritative, ratio
from usagelake.functions.ordered import carry, running_sum, lookup_join
from usagelake.operators.context import turn_fresh_input

# Sources whose tool output is captured, and the percentiles shown.
CAPTURING_SOURCES = ("codex", "claude")
PERCENTILES = (50, 90, 95)


def nearest_rank(values: DataFrame, keys: Sequence[str], value: str,
                 percentiles: Sequence[int] = PERCENTILES, block: int = 1 << 16) -> DataFrame:
    """Exact nearest-rank percentiles, sum, extremes and count per key.

    Values are counted first, so repeats collapse before anything is ordered;
    ranks come from a block scan over the counts.  No task holds a whole group.
    """
    keys = list(keys)
    counts = values.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    ranked = carry(counts, keys, value, {"_before": running_sum(F.col("_n"))}, block)
    totals = counts.groupBy(*keys).agg(
        F.sum("_n").alias("samples"),
        F.sum(F.col(value) * F.col("_n")).alias("total"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    low = F.coalesce("_before", F.lit(0))
    # The totals are one row per key; the distinct values of a key are spread.
    placed = lookup_join(ranked, totals, keys)
    picks = []
    for p in percentiles:
        rank = F.greatest(F.expr(f"(samples * {p} + 99) div 100"), F.lit(1))
        picks.append(F.max(F.when((low < rank) & (rank <= low + F.col("_n")), F.col(value))).alias(f"p{p}"))
    return placed.groupBy(*keys).agg(
        F.max("samples").alias("samples"), F.max("total").alias("total"),
        F.max("min").alias("min"), *picks, F.max("max").alias("max"),
    )


def scan_rows(turns: DataFrame, components: DataFrame) -> DataFrame:
    """Components with the fact whether their turn has trusted fresh input."""
    keys = ["source", "session_id", "turn_sequence"]
    linked = turn_fresh_input(turns).select(*keys, authoritative("fresh").alias("linked"))
    return lookup_join(components, linked, keys).withColumn("linked", F.coalesce("linked", F.lit(False)))


def coverage(turns: DataFrame, components: DataFrame, sessions: DataFrame, scope: str) -> DataFrame:
    """Tool-output coverage for one scope: session, source or all."""
    keys = {"session": ["source", "session_id"], "source": ["source"], "all": ["scope"]}[scope]
    if scope == "all":
        turns, components, sessions = (
            df.where(F.col("source").isin(*CAPTURING_SOURCES)).withColumn("scope", F.lit("all"))
            for df in (turns, components, sessions)
        )
    rows = scan_rows(turns.drop("scope"), components)
    output = F.col("kind") == "tool_result"
    unreadable = F.coalesce(F.col("completeness").isin("truncated", "unavailable"), F.lit(False))
    estimated = output & F.col("tokens").isNotNull() & (F.col("tokens_kind") == "estimated")

    def count(condition: Column, name: str) -> Column:
        return F.count_if(condition).alias(name)

    # Partial sums per session first: one pass gives the session facts too.
    per_session = rows.groupBy(*dict.fromkeys([*keys, "source", "session_id"])).agg(
        count(output, "tool_outputs"),
        count(output & F.col("content_bytes").isNotNull(), "_bytes"),
        count(estimated, "_estimated"),
        count(output & (F.coalesce("tool_call_id", F.lit("")) != ""), "_call_id"),
        count(output & (F.coalesce("tool_name", F.lit("")) != ""), "_name"),
        count(output & F.col("linked"), "_fresh"),
        count(output & (F.col("completeness") == "complete"), "complete"),
        count(output & (F.col("completeness") == "truncated"), "truncated"),
        count(output & (F.col("completeness") == "unavailable"), "unavailable"),
        count(output & ~F.coalesce(F.col("completeness").isin("complete", "truncated", "unavailable"), F.lit(False)),
              "unknown"),
        count(output & F.col("turn_sequence").isNull(), "trailing"),
        count(unreadable, "unreadable_records"),
        F.bool_or(unreadable).cast("long").alias("unreadable_sessions"),
        F.sum(F.when(estimated, F.col("tokens"))).alias("estimated_tokens"),
    )
    summed = per_session.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in per_session.columns if c not in (*keys, "source", "session_id")]
    )
    sizes = nearest_rank(rows.where(output), keys, "content_bytes")
    base = sessions.groupBy(*keys).agg(F.count("*").alias("sessions"))
    turn_counts = turns.groupBy(*keys).agg(F.count("*").alias("turns"))
    joined = base.join(turn_counts, keys, "left").join(summed, keys, "left").join(sizes, keys, "left")
    counts = ["turns", "tool_outputs", "complete", "truncated", "unavailable", "unknown", "trailing",
              "unreadable_records", "unreadable_sessions", "_bytes", "_estimated", "_call_id", "_name", "_fresh",
              "samples", "total"]
    filled = joined.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in counts})
    whole = F.col("tool_outputs")
    return filled.select(
        *keys, "sessions", "turns", "tool_outputs",
        F.col("_bytes").alias("with_content_bytes"), ratio(F.col("_bytes"), whole).alias("content_bytes_ratio"),
        F.col("_estimated").alias("with_estimated_tokens"),
        ratio(F.col("_estimated"), whole).alias("estimated_tokens_ratio"),
        F.col("_call_id").alias("with_tool_call_id"), ratio(F.col("_call_id"), whole).alias("tool_call_id_ratio"),
        F.col("_name").alias("with_tool_name"), ratio(F.col("_name"), whole).alias("tool_name_ratio"),
        F.col("_fresh").alias("with_fresh_input"), ratio(F.col("_fresh"), whole).alias("fresh_input_ratio"),
        "complete", "truncated", "unavailable", "unknown", "trailing", "unreadable_records", "unreadable_sessions",
        "estimated_tokens",
        F.when(F.col("estimated_tokens").isNotNull(), "estimated").otherwise("unknown").alias("estimated_tokens_kind"),
        F.col("total").alias("bytes_total"), F.col("samples").alias("bytes_samples"),
        F.col("min").alias("bytes_min"), F.col("p50").alias("bytes_p50"), F.col("p90").alias("bytes_p90"),
        F.col("p95").alias("bytes_p95"), F.col("max").alias("bytes_max"),
    )


def unsupported_sources(sessions: DataFrame) -> DataFrame:
    """Sources without captured tool output, listed with a reason instead of a zero."""
    names = sessions.select(F.lower("source").alias("source")).distinct()
    return names.where(~F.col("source").isin(*CAPTURING_SOURCES)).select(
        "source", F.concat(F.lit("tool output coverage not supported for "), F.col("source"), F.lit(": source does not report tool output")).alias("reason")
    )
