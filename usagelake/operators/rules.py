"""Diagnostic rules over context components.

A rule is a function from components to findings; ``RULES`` lists them in order.
Findings are one row each; what they rest on is a child table, so a group with
endless repeats never becomes one cell.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelake.functions.measure import available, kind_of
from usagelake.functions.ordered import first_per_key, lookup_join

# Thresholds in bytes and the least number of repeats.
MAX_OUTPUT_BYTES = 64 * 1024
HIGH_SEVERITY_BYTES = 256 * 1024
MIN_OCCURRENCES = 2

# Rule ids and names.
OVERSIZED = ("TOOL001", "oversized-tool-output")
REPEATED = ("TOOL002", "repeated-tool-call")

# What is advised, by rule.  The titles and descriptions below are fixed values as well.
RECOMMENDATIONS = {
    "TOOL001": "Limit the command scope, filter the result, or read the output in smaller relevant sections.",
    "TOOL002": "Reuse the earlier result when it is still valid, or narrow later calls to request only new information.",
}


def _finding(rule: tuple[str, str]) -> list[Column]:
    return [F.lit(rule[0]).alias("rule_id"), F.lit(rule[1]).alias("rule_name"),
            F.lit(RECOMMENDATIONS[rule[0]]).alias("recommendation")]


def _turn_id(components: DataFrame) -> DataFrame:
    """Components with the id of their turn; '' where the source has none."""
    if "turn_id" in components.columns:
        return components.withColumn("turn_id", F.coalesce("turn_id", F.lit("")))
    return components.withColumn("turn_id", F.lit(""))


def oversized_output(components: DataFrame, keys: Sequence[str] = ("session_id",),
                     max_bytes: int = MAX_OUTPUT_BYTES) -> DataFrame:
    """Complete tool results of turns that are larger than the threshold."""
    limit = max_bytes if max_bytes > 0 else MAX_OUTPUT_BYTES
    found = _turn_id(components).where(
        (F.col("kind") == "tool_result") & (F.col("completeness") == "complete")
        & F.col("turn_sequence").isNotNull() & (F.col("content_bytes") > limit)
    )
    size = F.concat(F.lit("The transcript contains a complete tool output of "), F.col("content_bytes").cast("string"),
                    F.lit(" bytes. Its token contribution is "))
    estimated = available("tokens") & (kind_of("tokens") == "estimated")
    return found.select(
        *keys, *_finding(OVERSIZED),
        F.when(F.col("content_bytes") >= HIGH_SEVERITY_BYTES, "high").otherwise("medium").alias("severity"),
        F.lit("high").alias("confidence"),
        F.concat(F.when(F.col("tool_name") != "", F.col("tool_name")).otherwise("Tool"),
                 F.lit(" returned an oversized output")).alias("title"),
        F.concat(size, F.when(estimated, "estimated, not provider-reported.").otherwise("unavailable."))
        .alias("description"),
        F.col("tokens").alias("estimated_tokens"), F.col("tokens_kind").alias("estimated_tokens_kind"),
        F.lit(1).cast("long").alias("occurrences"),
        "turn_id", F.col("turn_sequence"), F.col("ord"), F.col("tool_call_id"), F.col("content_bytes"),
    )


def _occurrences(components: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First result of each call id within (session, tool, arguments, output)."""
    group = [*keys, "tool_name", "tool_call_fingerprint", "content_hash"]
    filled = (F.col("kind") == "tool_result") & (F.col("completeness") == "complete") \
        & F.col("turn_sequence").isNotNull()
    for name in ("tool_call_id", "tool_name", "tool_call_fingerprint", "content_hash"):
        filled = filled & (F.coalesce(F.col(name), F.lit("")) != "")
    return first_per_key(_turn_id(components).where(filled), [*group, "tool_call_id"], ["turn_sequence", "ord"])


def repeated_calls(components: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """The same tool with the same arguments and the same complete output, at least twice.

    The first occurrence is the baseline.  Its share is taken off the group sums,
    so a group is only ever summed, never collected.
    """
    group = [*keys, "tool_name", "tool_call_fingerprint", "content_hash"]
    place = F.struct("turn_sequence", "ord")
    tokens = F.when(available("tokens"), F.col("tokens"))
    summed = _occurrences(components, keys).groupBy(*group).agg(
        F.count("*").alias("occurrences"),
        F.sum(tokens).alias("_sum"), F.count(tokens).alias("_known"),
        F.min_by(F.struct(tokens.alias("tokens"), "turn_id", "turn_sequence", "ord", "tool_call_id"), place).alias("_first"),
    ).where(F.col("occurrences") >= MIN_OCCURRENCES)
    baseline = F.col("_first.tokens")
    known = F.col("_known") - F.when(baseline.isNotNull(), 1).otherwise(0)
    later = F.when(known > 0, F.col("_sum") - F.coalesce(baseline, F.lit(0)))
    total = F.col("occurrences") - 1
    missing = total - known

    def text(value: Column) -> Column:
        return value.cast("string")

    described = F.concat(
        F.col("tool_name"), F.lit(" appears to have been called "), text(F.col("occurrences")),
        F.lit(" times with the same arguments, and every complete result had the same content. "
              "The first occurrence is the baseline and the "), text(total),
        F.lit(" later ones are repeated calls. "),
        F.when(known == 0, "Their repeated tool output could not be sized, so its token contribution is unavailable.")
        .when(known == total, F.concat(
            F.lit("Their estimated repeated tool output is "), text(later),
            F.lit(" tokens: a potential context contribution, not measured waste.")))
        .otherwise(F.concat(
            F.lit("The observed portion of their repeated tool output is at least "), text(later),
            F.lit(" estimated tokens across "), text(known), F.lit(" of "), text(total),
            F.lit(" repeated results; the remaining "),
            F.when(missing == 1, F.lit("result has")).otherwise(F.concat(text(missing), F.lit(" results have"))),
            F.lit(" no token estimate."))),
    )
    return summed.select(
        *keys, *_finding(REPEATED), F.lit("medium").alias("severity"), F.lit("high").alias("confidence"),
        F.concat(F.col("tool_name"), F.lit(" repeated the same tool call")).alias("title"),
        described.alias("description"),
        later.alias("estimated_tokens"), F.when(known > 0, "estimated").otherwise("unknown").alias("estimated_tokens_kind"),
        "occurrences", F.col("_first.turn_id").alias("turn_id"), F.col("_first.turn_sequence").alias("turn_sequence"), F.col("_first.ord").alias("ord"),
        F.col("_first.tool_call_id").alias("tool_call_id"), F.lit(None).cast("long").alias("content_bytes"),
    )


def repeated_call_evidence(components: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """The occurrences behind each repeated-call finding, one row each."""
    group = [*keys, "tool_name", "tool_call_fingerprint", "content_hash"]
    seen = _occurrences(components, keys)
    groups = seen.groupBy(*group).agg(F.count("*").alias("_n"), F.min("ord").alias("finding_ord")).where(
        F.col("_n") >= MIN_OCCURRENCES)
    return lookup_join(seen, groups, group, "inner").select(
        *keys, F.lit(REPEATED[0]).alias("rule_id"), "tool_name", "finding_ord", "turn_id", "turn_sequence", "ord", "tool_call_id",
        "content_bytes", "tokens", "tokens_kind", "completeness",
    )


RULES: list[Callable[..., DataFrame]] = [oversized_output, repeated_calls]


def findings(components: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """All rules' findings, in rule order."""
    result = None
    for position, rule in enumerate(RULES, start=1):
        found = rule(components, keys).withColumn("rule_order", F.lit(position))
        result = found if result is None else result.unionByName(found)
    return result


def analysis(sessions: DataFrame, found: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Status and message per session, also for sessions without findings."""
    counts = found.groupBy(*keys).agg(F.count("*").alias("findings"))
    n = F.coalesce("findings", F.lit(0))
    return sessions.join(counts, list(keys), "left").select(
        *keys, n.alias("findings"),
        F.when(n == 0, "healthy").otherwise("findings").alias("status"),
        F.when(n == 0, F.lit("No token-efficiency findings detected."))
        .otherwise(F.concat(F.lit("Found "), n.cast("string"), F.lit(" token-efficiency issue(s)."))).alias("message"),
    )
