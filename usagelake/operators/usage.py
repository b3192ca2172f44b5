"""Session and turn usage: counter deltas, message dedup, null-aware totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelake.functions.measure import (
    USAGE_METRICS,
    any_authoritative,
    available,
    kind_of,
    sum_available,
    usable,
)
from usagelake.functions.ordered import BLOCK, carry, previous_row, running_count, top_per_key

# Fixed value: model name of records an agent writes itself.
SYNTHETIC_MODEL = "<synthetic>"
MESSAGE_FIELDS = ("input", "cache_read", "cache_write", "output")
COUNTERS = ("input", "cached", "output", "reasoning", "total")


# ---------------------------------------------------------------- numbering

def number_turns(df: DataFrame, keys: Sequence[str] = ("session_id",), order: str = "ord",
                 block: int = BLOCK) -> DataFrame:
    """1-based sequence of each row within its session."""
    numbered = carry(df, keys, order, {"_before": running_count(F.lit(True))}, block)
    return numbered.withColumn("sequence", F.coalesce("_before", F.lit(0)) + 1).drop("_before")


# ------------------------------------------------- cumulative counter source

def counter_deltas(df: DataFrame, keys: Sequence[str] = ("session_id",), order: str = "ord",
                   block: int = BLOCK) -> DataFrame:
    """Turn usage from cumulative counters.

    The first row counts from zero.  A counter that falls is a reset: the whole
    turn has no usage, it is not clamped.  Reasoning is optional: absent now is
    absent, absent before counts from zero.
    """
    with_previous = carry(
        df, keys, order,
        {**{f"_prev_{c}": previous_row(F.col(c)) for c in COUNTERS}, "_before": running_count(F.lit(True))},
        block,
    )

    def before(name: str) -> Column:
        return F.coalesce(F.col(f"_prev_{name}"), F.lit(0))

    reset = F.lit(False)
    for name in ("input", "cached", "output", "total"):
        reset = reset | (F.col(name) < before(name))
    reset = reset | F.coalesce(F.col("reasoning") < F.col("_prev_reasoning"), F.lit(False))
    base = with_previous.withColumn("reset", reset)
    deltas = []
    for name in COUNTERS:
        delta = F.when(~F.col("reset"), F.col(name) - before(name))
        deltas += [delta.alias(name), F.when(delta.isNotNull(), "derived").alias(f"{name}_kind")]
    rest = [c for c in df.columns if c not in COUNTERS]
    return base.select(*rest, (F.coalesce("_before", F.lit(0)) + 1).alias("sequence"), "reset", *deltas)


def counter_session_usage(df: DataFrame, keys: Sequence[str] = ("session_id",), order: str = "ord") -> DataFrame:
    """The snapshot with the largest total, the latest of equals; totals below zero never count."""
    best = F.max_by(
        F.struct(*COUNTERS, F.col(order).alias("at")),
        F.when(F.col("total") >= 0, F.struct("total", order)),
    )
    grouped = df.groupBy(*keys).agg(best.alias("_best"))
    columns = []
    for name in COUNTERS:
        value = F.col(f"_best.{name}")
        columns += [value.alias(name), F.when(value.isNotNull(), "measured").alias(f"{name}_kind")]
    return grouped.select(*keys, F.col("_best.at").alias("snapshot_ord"), *columns)


def counter_source_usage(sessions: DataFrame, keys: Sequence[str] = ("source",)) -> DataFrame:
    """Sum of session usage per source, leaving out all-zero snapshots."""
    kept = sessions.where(
        F.col("total").isNotNull() & ~((F.col("total") == 0) & (F.col("input") == 0) & (F.col("output") == 0))
    )
    return sum_usage(kept, keys)


# ------------------------------------------------------------ usage algebra

def sum_usage(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum of the available values per key; none available stays missing."""
    columns = []
    for name in USAGE_METRICS:
        columns.append(sum_available(name).alias(name))
    summed = df.groupBy(*keys).agg(*columns)
    return summed.select(
        *keys,
        *[c for name in USAGE_METRICS
          for c in (F.col(name), F.when(F.col(name).isNotNull(), "derived").alias(f"{name}_kind"))],
    )


def compare_turns_to_session(turns: DataFrame, sessions: DataFrame,
                             keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Turn sums against the session's own usage; missing counts as 0, except reasoning."""
    sums = sum_usage(turns, keys).select(*keys, *[F.col(n).alias(f"_sum_{n}") for n in USAGE_METRICS])
    joined = sessions.join(sums, list(keys), "left")
    own = {name: usable(name) for name in USAGE_METRICS}

    def zero(value: Column) -> Column:
        return F.coalesce(value, F.lit(0))

    deltas = {n: zero(F.col(f"_sum_{n}")) - zero(own[n]) for n in ("input", "cached", "output", "total")}
    reasoning = (
        F.when(own["reasoning"].isNull() & F.col("_sum_reasoning").isNull(), F.lit(None).cast("long"))
        .when(own["reasoning"].isNull(), F.lit(0).cast("long"))
        .otherwise(zero(F.col("_sum_reasoning")) - own["reasoning"])
    )
    matches = F.coalesce(reasoning, F.lit(0)) == 0
    for delta in deltas.values():
        matches = matches & (delta == 0)
    return joined.select(
        *keys,
        deltas["input"].alias("input_delta"),
        deltas["cached"].alias("cached_delta"),
        deltas["output"].alias("output_delta"),
        reasoning.alias("reasoning_delta"),
        deltas["total"].alias("total_delta"),
        matches.alias("matches"),
    )


def turn_kind() -> Column:
    """The one kind shared by a turn's available metrics, else ''."""
    kinds = F.array_distinct(F.filter(
        F.array(*[F.when(available(n), kind_of(n)) for n in USAGE_METRICS]), lambda k: k.isNotNull()
    ))
    return F.when(F.size(kinds) == 1, F.element_at(kinds, 1)).otherwise("")


def session_mixed(turns: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Whether the turns of a session are of different kinds."""
    kinds = turns.select(*keys, turn_kind().alias("kind"))
    return kinds.groupBy(*keys).agg(
        F.count("*").alias("turns"),
        F.min("kind").alias("first_kind"),
        (F.min("kind") != F.max("kind")).alias("mixed"),
    )


# -------------------------------------------------------- per-message source

def usage_bearing(messages: DataFrame) -> DataFrame:
    """Records that count for usage: not synthetic, at least one field reported."""
    reported = F.lit(False)
    for name in MESSAGE_FIELDS:
        reported = reported | F.col(name).isNotNull()
    synthetic = F.coalesce(F.col("model") == SYNTHETIC_MODEL, F.lit(False))
    return messages.where(~synthetic & reported)


def dedup_messages(messages: DataFrame, keys: Sequence[str] = ("session_id",), order: str = "ord",
                   passthrough: Sequence[str] = ("model", "ts_us")) -> DataFrame:
    """One row per message: the first of each id, marked when a repeat differs.

    A record without an id is never a repeat.  All facts are plain aggregates, so a message id that is repeated
    without end is combined before the shuffle.  The usage fields travel as numbers, not as a struct: where no
    passthrough string is read either, Spark combines them in a hash table and sorts nothing.
    """
    keyed = messages.withColumn(
        "_own", F.when(F.coalesce(F.col("message_id"), F.lit("")) == "", F.col(order))
    ).withColumn("message_id", F.coalesce("message_id", F.lit("")))
    copies = F.count("*")
    differs = F.lit(False)
    for name in MESSAGE_FIELDS:
        reported = F.count(name)
        differs = differs | F.coalesce(F.min(name) != F.max(name), F.lit(False)) | ((reported > 0) & (reported < copies))
    firsts = [n for n in dict.fromkeys([*passthrough, *MESSAGE_FIELDS]) if n != order]
    grouped = keyed.groupBy(*keys, "message_id", "_own").agg(
        F.min(order).alias(order), differs.alias("conflict"), copies.alias("copies"),
        *[F.min_by(name, order).alias(name) for name in firsts])
    return grouped.select(*keys, "message_id", "conflict", "copies", order, *firsts)


def message_turns(kept: DataFrame, keys: Sequence[str] = ("session_id",), order: str = "ord",
                  block: int = BLOCK) -> DataFrame:
    """Turn usage of deduplicated messages, with provenance per field."""
    turns = number_turns(kept, keys, order, block)
    conflict = F.col("conflict")

    def value(name: str) -> Column:
        return F.when(~conflict & (F.col(name) >= 0), F.col(name))

    def kind(name: str) -> Column:
        return F.when(F.col(name).isNull(), None).when(~conflict & (F.col(name) >= 0), "measured").otherwise("unknown")

    cached = value("cache_read") + value("cache_write")
    total = value("input") + cached + value("output")
    billable = value("input") + cached

    def derived(column: Column) -> Column:
        return F.when(column.isNotNull(), "derived")

    rest = [c for c in turns.columns if c not in MESSAGE_FIELDS]
    return turns.select(
        *rest,
        value("input").alias("input"), kind("input").alias("input_kind"),
        cached.alias("cached"), derived(cached).alias("cached_kind"),
        value("output").alias("output"), kind("output").alias("output_kind"),
        F.lit(None).cast("long").alias("reasoning"), F.lit(None).cast("string").alias("reasoning_kind"),
        total.alias("total"), derived(total).alias("total_kind"),
        billable.alias("billable_input"), derived(billable).alias("billable_input_kind"),
        value("cache_read").alias("billable_cache_read"), kind("cache_read").alias("billable_cache_read_kind"),
        value("cache_write").alias("billable_cache_write"), kind("cache_write").alias("billable_cache_write_kind"),
        value("output").alias("billable_output"), kind("output").alias("billable_output_kind"),
    ).withColumn(
        "turn_id",
        F.when(F.col("message_id") != "", F.col("message_id"))
        .otherwise(F.concat_ws("#", F.col(keys[-1]), F.col("sequence"))),
    )


def message_session_usage(kept: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """All-or-nothing totals: a field counts only when every accepted message reported it."""
    accepted = ~F.col("conflict")
    aggregates = [F.count_if(accepted).alias("accepted"), F.count_if(F.col("conflict")).alias("conflicts")]
    for name in MESSAGE_FIELDS:
        good = accepted & (F.col(name) >= 0)
        aggregates += [
            F.sum(F.when(good, F.col(name))).alias(f"_sum_{name}"),
            F.count_if(good).alias(f"_count_{name}"),
            F.count_if(accepted & F.col(name).isNotNull()).alias(f"_reported_{name}"),
        ]
    grouped = kept.groupBy(*keys).agg(*aggregates)

    def value(name: str) -> Column:
        complete = (F.col("accepted") > 0) & (F.col(f"_count_{name}") == F.col("accepted"))
        return F.when(complete, F.col(f"_sum_{name}"))

    def kind(name: str) -> Column:
        return F.when(value(name).isNotNull(), "derived").when(F.col(f"_reported_{name}") > 0, "unknown")

    cached = value("cache_read") + value("cache_write")
    total = value("input") + cached + value("output")
    has_reported = F.lit(False)
    for name in MESSAGE_FIELDS:
        has_reported = has_reported | (F.col(f"_count_{name}") > 0)
    partial = [
        F.when(F.col(f"_reported_{name}") > 0, F.coalesce(f"_sum_{name}", F.lit(0))).alias(f"partial_{name}")
        for name in MESSAGE_FIELDS
    ]
    return grouped.select(
        *keys, "accepted", "conflicts", has_reported.alias("has_reported_usage"),
        value("input").alias("input"), kind("input").alias("input_kind"),
        cached.alias("cached"), F.when(cached.isNotNull(), "derived").alias("cached_kind"),
        value("output").alias("output"), kind("output").alias("output_kind"),
        F.lit(None).cast("long").alias("reasoning"), F.lit(None).cast("string").alias("reasoning_kind"),
        total.alias("total"), F.when(total.isNotNull(), "derived").alias("total_kind"),
        value("cache_read").alias("cache_read"), kind("cache_read").alias("cache_read_kind"),
        value("cache_write").alias("cache_write"), kind("cache_write").alias("cache_write_kind"),
        *partial,
    )


def message_source_usage(sessions: DataFrame, keys: Sequence[str] = ("source",)) -> DataFrame:
    """Source totals: each session with reported usage enters as one snapshot.

    A field counts when every included session reported it at all, so a session
    that shows a field as unknown still adds what it did report.
    """
    kept = sessions.where("has_reported_usage")
    aggregates = [F.count("*").alias("sessions")]
    for name in MESSAGE_FIELDS:
        part = F.col(f"partial_{name}")
        aggregates += [F.sum(part).alias(f"_sum_{name}"), F.count(part).alias(f"_count_{name}")]
    grouped = kept.groupBy(*keys).agg(*aggregates)

    def value(name: str) -> Column:
        return F.when(F.col(f"_count_{name}") == F.col("sessions"), F.col(f"_sum_{name}"))

    cached = value("cache_read") + value("cache_write")
    return grouped.select(
        *keys, "sessions",
        value("input").alias("input"), cached.alias("cached"), value("output").alias("output"),
        (value("input") + cached + value("output")).alias("total"),
    )


def session_model(messages: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """The session's model when it used exactly one real model, else ''."""
    real = F.when((F.col("model") != "") & (F.col("model") != SYNTHETIC_MODEL), F.col("model"))
    # Equal extremes mean one model; no distinct set is kept per session.
    return messages.groupBy(*keys).agg(
        F.when(F.min(real) == F.max(real), F.max(real)).otherwise("").alias("model")
    )


def last_model(records: DataFrame, keys: Sequence[str] = ("session_id",), order: str = "ord") -> DataFrame:
    """The last model named in file order."""
    named = F.when(F.col("model") != "", F.col(order))
    return records.groupBy(*keys).agg(F.coalesce(F.max_by("model", named), F.lit("")).alias("model"))


def session_span(records: DataFrame, keys: Sequence[str] = ("session_id",), order: str = "ord",
                 ts: str = "ts") -> DataFrame:
    """First and last non-empty time stamp in file order (not the extremes)."""
    present = F.when(F.coalesce(F.col(ts).cast("string"), F.lit("")) != "", F.col(order))
    return records.groupBy(*keys).agg(
        F.min_by(ts, present).alias("started"), F.max_by(ts, present).alias("updated")
    )


# ------------------------------------------------------------ filters, order

def with_authoritative_usage(sessions: DataFrame) -> DataFrame:
    """Sessions with at least one trusted number; a trusted zero passes."""
    return sessions.where(any_authoritative())


def order_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.orderBy(F.col("updated_us").desc_nulls_last(), "source", "session_id")


def top_expensive(turns: DataFrame, keys: Sequence[str] = ("session_id",), n: int = 5) -> DataFrame:
    """The ``n`` turns with the largest total per session; missing counts as 0."""
    total = F.coalesce(usable("total"), F.lit(0))
    return top_per_key(turns, keys, [total.desc(), F.col("sequence").asc()], n, "position")


def recent_turns(turns: DataFrame, keys: Sequence[str] = ("session_id",), n: int = 5) -> DataFrame:
    return top_per_key(turns, keys, [F.col("sequence").desc()], n, "position")


