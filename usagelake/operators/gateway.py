"""Captured calls: classification, usage normalisation, request and profile reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelake.functions.measure import available, kind_from_rank, kind_of, rank_of, subtract
from usagelake.functions.ordered import first_per_key, top_per_key
from usagelake.operators.context import COMPONENT_KINDS, file_attribution, request_categories

# Protocols and the endpoints that carry model calls.
MESSAGES = "anthropic_messages"
RESPONSES = "openai_responses"
PROTOCOLS = (MESSAGES, RESPONSES)
ENDPOINTS = {
    (MESSAGES, "/v1/messages"): True,
    (MESSAGES, "/v1/messages/count_tokens"): False,
    (RESPONSES, "/responses"): True,
    (RESPONSES, "/v1/responses"): True,
    (RESPONSES, "/models"): False,
    (RESPONSES, "/v1/models"): False,
}
OUTCOMES = ("upstream_ok", "upstream_http_error", "transport_failure", "client_canceled", "stream_truncated")

USAGE_COLUMNS = (
    "input_tokens",
    "cache_creation_input_tokens",
    "cache_read_input_tokens",
    "output_tokens",
    "reasoning_output_tokens",
    "total_input_tokens",
    "total_tokens",
)
# The normalised fields, and the name their kind goes by.
FIELDS = {
    "fresh_input": "kind_fresh",
    "cached_input": "kind_cached",
    "cache_creation_input": "kind_cache_creation",
    "total_input": "kind_total_input",
    "output": "kind_output",
    "reasoning_output": "kind_reasoning",
    "total": "kind_total",
}


# ------------------------------------------------------------ classification

def _listed(eligible: bool, path: str = "endpoint") -> Column:
    hit = F.lit(False)
    for (protocol, endpoint), carries in ENDPOINTS.items():
        if carries == eligible:
            hit = hit | ((F.col("protocol") == protocol) & (F.col(path) == endpoint))
    return hit


def request_kind() -> Column:
    """model, non_model, unclassified or '' (unknown)."""
    return (
        F.when(F.col("protocol").isin(*PROTOCOLS) & (F.col("method") == "POST") & _listed(True), "model")
        .when(~F.col("protocol").isin(*PROTOCOLS) | (F.col("endpoint") == ""), "unclassified")
        .when(_listed(False), "non_model")
        .otherwise(""))


def request_outcome() -> Column:
    """Outcome from what happened on the way, else from the HTTP status."""
    return F.when(F.col("event").isin(*OUTCOMES), F.col("event")).when(
        (F.col("status") >= 200) & (F.col("status") < 400), "upstream_ok").otherwise("upstream_http_error")


def is_model_call(method: str = "method", endpoint: str = "endpoint") -> Column:
    """Calls that can be part of a chain; a method that was not recorded passes."""
    return F.coalesce((F.coalesce(method, F.lit("")).isin("", "POST")) & _listed(True, endpoint), F.lit(False))


# -------------------------------------------------------- usage normalisation

def clear_absent_usage(exchanges: DataFrame) -> DataFrame:
    """No usage report means no usage fields, whatever else the row holds."""
    present = F.col("usage_source").isNotNull()
    return exchanges.withColumns({name: F.when(present, F.col(name)) for name in USAGE_COLUMNS})


def normalise_usage(exchanges: DataFrame) -> DataFrame:
    """Provider usage in one shape, zero-filled (``obs_*``), with the kind of each field.

    The messages protocol reports fresh, read and created input apart; the
    responses protocol reports input that includes cached input.  A usage report
    of an unknown shape keeps only what it states as totals.
    """
    exchanges = clear_absent_usage(exchanges)

    def n(name: str) -> Column:
        return F.coalesce(name, F.lit(0).cast("long"))

    messages = F.coalesce(F.col("usage_source") == MESSAGES, F.lit(False))
    responses = F.coalesce(F.col("usage_source") == RESPONSES, F.lit(False))
    known = messages | responses
    zero = F.lit(0).cast("long")
    created = F.when(messages, n("cache_creation_input_tokens")).otherwise(zero)
    cached = F.when(known, n("cache_read_input_tokens")).otherwise(zero)
    total_input = (
        F.when(messages & F.col("input_tokens").isNotNull(), F.col("input_tokens") + cached + created)
        .when(responses, F.coalesce("total_input_tokens", "input_tokens", zero))
        .otherwise(n("total_input_tokens")))
    fresh = F.when(messages, n("input_tokens")).when(responses, F.greatest(zero, total_input - cached)).otherwise(zero)
    total = (
        F.when(messages, total_input + n("output_tokens"))
        .when(responses, F.coalesce(F.col("total_tokens"), total_input + n("output_tokens")))
        .otherwise(n("total_tokens")))
    measured = F.when(known, "measured").otherwise("derived")
    reported = F.lit(0)
    for name in USAGE_COLUMNS:
        reported = reported + F.col(name).isNotNull().cast("int")
    return exchanges.withColumns({
        "reported_fields": reported,
        "obs_fresh": fresh, "obs_cached": cached, "obs_cache_creation": created, "obs_total_input": total_input,
        "obs_output": n("output_tokens"), "obs_reasoning": n("reasoning_output_tokens"), "obs_total": total,
        "kind_fresh": F.when(messages, "measured").otherwise("derived"),
        "kind_cached": measured, "kind_cache_creation": measured,
        "kind_total_input": F.when(responses | (messages & F.col("total_input_tokens").isNotNull()), "measured")
        .otherwise("derived"),
        "kind_output": measured, "kind_reasoning": measured,
        "kind_total": F.when(known & F.col("total_tokens").isNotNull(), "measured").otherwise("derived"),
    })


def call_usage(normalised: DataFrame) -> DataFrame:
    """The usage fields a single call can show; NULL where the provider did not say."""
    messages = F.coalesce(F.col("usage_source") == MESSAGES, F.lit(False))
    responses = F.coalesce(F.col("usage_source") == RESPONSES, F.lit(False))
    has = {name: F.col(name).isNotNull() for name in USAGE_COLUMNS}
    shown = {
        "fresh_input": F.when((messages & has["input_tokens"])
                              | (responses & has["cache_read_input_tokens"] & has["input_tokens"]), F.col("obs_fresh")),
        "cached_input": F.when((messages | responses) & has["cache_read_input_tokens"], F.col("obs_cached")),
        "cache_creation_input": F.when(messages & has["cache_creation_input_tokens"], F.col("obs_cache_creation")),
        "total_input": (
            F.when(messages & (has["input_tokens"] | has["total_input_tokens"]), F.col("obs_total_input"))
            .when(responses & has["input_tokens"], F.col("obs_total_input"))
            .when(~messages & ~responses & has["total_input_tokens"], F.col("obs_total_input"))),
        "output": F.when(has["output_tokens"], F.col("obs_output")),
        "reasoning_output": F.when(has["reasoning_output_tokens"], F.col("obs_reasoning")),
        "total": F.when(has["output_tokens"] | has["total_tokens"], F.col("obs_total")),
    }
    present = F.col("usage_source").isNotNull()
    shown = {name: F.when(present, value) for name, value in shown.items()}
    any_field = F.lit(False)
    for value in shown.values():
        any_field = any_field | value.isNotNull()
    return normalised.withColumns({
        **{f"call_{name}": value for name, value in shown.items()},
        "has_usage": any_field,
        "usage_kind": F.when(present & any_field, F.when(messages | responses, "measured").otherwise("derived")),
    })


# --------------------------------------------------------------- components

def dedup_request_components(components: DataFrame, keys: Sequence[str] = ("exchange_id",),
                             order: Sequence[str | Column] = ("position",)) -> DataFrame:
    """First component per kind, path and content of a request, in position order."""
    return first_per_key(components, [*keys, "kind", "path", "content_hash"], order)


def request_attribution(components: DataFrame, keys: Sequence[str] = ("exchange_id",)) -> DataFrame:
    """Per request: tokens by category (wide) and in total, kinds weakening."""
    by_kind = request_categories(components, keys)
    columns = []
    for kind in COMPONENT_KINDS:
        here = F.col("kind") == kind
        columns += [F.max(F.when(here, F.col("tokens"))).alias(kind),
                    F.max(F.when(here, F.col("tokens_kind"))).alias(f"{kind}_kind")]
    known = F.col("tokens").isNotNull()
    return by_kind.groupBy(*keys).agg(
        *columns, F.sum("tokens").alias("attributed"),
        kind_from_rank(F.max(F.when(known, rank_of(F.col("tokens_kind"))))).alias("attributed_kind"))


def coverage_percent(attributed: Column, whole: Column) -> Column:
    return F.when(whole != 0, attributed.cast("double") / whole.cast("double") * 100)


def request_report(exchanges: DataFrame, components: DataFrame) -> DataFrame:
    """One row per captured request: categories, provider usage, gap and coverage."""
    calls = call_usage(normalise_usage(exchanges))
    attributed = request_attribution(components).withColumnRenamed("exchange_id", "id")
    joined = calls.join(attributed, "id", "left").withColumns(
        {"provider_input": F.col("call_total_input"),
         "provider_input_kind": F.when(F.col("call_total_input").isNotNull(), F.col("kind_total_input"))})
    comparable = available("attributed") & F.coalesce(F.col("provider_input") > 0, F.lit(False)) \
        & F.col("has_usage")
    gap, gap_kind = subtract("provider_input", "attributed", "gap")
    return joined.select(
        *[c for c in joined.columns],
        F.when(comparable, gap).alias("gap"), F.when(comparable, gap_kind).alias("gap_kind"),
        F.when(comparable, coverage_percent(F.col("attributed"), F.col("provider_input"))).alias("coverage_percent"),
        F.when(comparable, F.when(kind_of("attributed") == "measured", "measured").otherwise("estimated"))
        .alias("coverage_kind"))


def request_files(components: DataFrame) -> DataFrame:
    return file_attribution(components, ["exchange_id"])


# --------------------------------------------------------------- profile view

def _account_values(row_usage: DataFrame) -> dict[str, Column]:
    """What one call adds to each accounting field; NULL where it adds nothing."""
    messages = F.col("usage_source") == MESSAGES
    responses = F.col("usage_source") == RESPONSES
    known = messages | responses
    has = {name: F.col(name).isNotNull() for name in USAGE_COLUMNS}
    has_input = has["input_tokens"] | has["total_input_tokens"]
    return {
        "fresh_input": F.when((messages & has["input_tokens"])
                              | (responses & has_input & has["cache_read_input_tokens"]), F.col("obs_fresh")),
        "cached_input": F.when((messages | (responses & has_input)) & has["cache_read_input_tokens"], F.col("obs_cached")),
        "cache_creation_input": F.when(messages & has["cache_creation_input_tokens"], F.col("obs_cache_creation")),
        "total_input": F.when((known & has_input) | (~known & has["total_input_tokens"]), F.col("obs_total_input")),
        "output": F.when(has["output_tokens"], F.col("obs_output")),
        "reasoning_output": F.when(has["reasoning_output_tokens"], F.col("obs_reasoning")),
        "total": F.when(has["total_tokens"], F.col("total_tokens")).when(
            known & has_input & has["output_tokens"], F.col("obs_total")),
    }


def profile_account(exchanges: DataFrame, chained: DataFrame, failures: DataFrame) -> DataFrame:
    """Counts, outcomes and three usage aggregates per profile, in one pass.

    ``chained`` lists the ids of calls in chains, ``failures`` counts recorder
    failures per profile.
    """
    marked = normalise_usage(exchanges).join(
        chained.select(F.col("id"), F.lit(True).alias("chained")), "id", "left"
    ).withColumn("chained", F.coalesce("chained", F.lit(False)))
    model = F.col("kind") == "model"
    counted = is_model_call() & F.col("usage_source").isNotNull()
    observed = counted & (F.col("reported_fields") > 0)
    values = _account_values(marked)
    aggregates = [
        F.count("*").alias("http_requests"), F.count_if(model).alias("model_requests"),
        F.count_if(model & F.col("chained")).alias("chained_requests"),
        F.count_if(model & ~F.col("chained")).alias("uncorrelated_requests"),
        F.count_if(F.col("kind") == "non_model").alias("non_model_requests"),
        F.count_if(F.coalesce("kind", F.lit("")) == "").alias("unknown_requests"),
        F.count_if(F.col("kind") == "unclassified").alias("unclassified_requests"),
        F.count_if(counted).alias("usage_observed_requests"),
        *[F.count_if(F.col("outcome") == o).alias(f"outcome_{o}") for o in OUTCOMES],
        F.count_if(~F.coalesce(F.col("outcome").isin(*OUTCOMES), F.lit(False))).alias("outcome_unknown"),
    ]
    segments = {"observed": observed, "chained": observed & F.col("chained"), "uncorrelated": observed & ~F.col("chained")}
    for segment, here in segments.items():
        aggregates.append(F.count_if(here).alias(f"{segment}_calls"))
        for field, value in values.items():
            present = here & value.isNotNull()
            kind = F.col(FIELDS[field])
            aggregates += [
                F.count_if(present).alias(f"{segment}_{field}_count"),
                F.coalesce(F.sum(F.when(present, value)), F.lit(0)).alias(f"{segment}_{field}_sum"),
                kind_from_rank(F.max(F.when(present, rank_of(kind)))).alias(f"{segment}_{field}_kind"),
            ]
    account = marked.groupBy("profile").agg(*aggregates).join(
        failures.select("profile", "recorder_failures"), "profile", "left"
    ).withColumn("recorder_failures", F.coalesce("recorder_failures", F.lit(0).cast("long")))

    def complete(segment: str, requests: str) -> Column:
        whole = F.col(requests)
        full = (F.col(f"{segment}_calls") >= whole) & (F.col(f"{segment}_fresh_input_count") >= whole) \
            & (F.col(f"{segment}_output_count") >= whole)
        return (whole == 0) | full

    account = account.withColumns({
        "observed_complete": complete("observed", "model_requests"),
        "chained_complete": complete("chained", "chained_requests"),
        "uncorrelated_complete": complete("uncorrelated", "uncorrelated_requests"),
    })
    partial = (
        ((F.col("model_requests") > 0)
         & ~(F.col("observed_complete") & F.col("chained_complete") & F.col("uncorrelated_complete")))
        | (F.col("recorder_failures") > 0) | (F.col("outcome_stream_truncated") > 0))
    return account.withColumn("completeness", F.when(partial, "partial").otherwise("complete"))


def capture_summary(exchanges: DataFrame) -> DataFrame:
    """Requests and last time per profile."""
    return exchanges.groupBy("profile").agg(
        F.count("*").alias("requests"), F.max("started_us").alias("last_request_us"))


# Fixed value: newest journal entries shown per profile.
FAILURE_LIMIT = 1024
FAILURE_SCHEMA = "schemaVersion int, profile string, operation string, exchangeId string, occurredAt string"


def read_failures(lines: DataFrame, journal: str = "journal", order: str = "line", raw: str = "raw",
                  limit: int = FAILURE_LIMIT) -> tuple[DataFrame, DataFrame]:
    """Entries of failure journals: the newest per profile, and the counts of all.

    Lines that are not JSON and entries of another profile are skipped.
    """
    parsed = lines.withColumn("e", F.expr(f"from_json({raw}, '{FAILURE_SCHEMA}, _bad string', "
                                          "map('columnNameOfCorruptRecord', '_bad'))"))
    mine = (F.coalesce("e.profile", F.lit("")) == "") | (F.col("e.profile") == F.col(journal))
    good = parsed.where(F.col("e").isNotNull() & F.col("e._bad").isNull() & mine).select(
        F.col(journal).alias("profile"), F.col(order).alias("line"), F.col("e.operation").alias("operation"),
        F.col("e.exchangeId").alias("exchange_id"), F.col("e.occurredAt").alias("occurred_at"))
    newest = top_per_key(good, ["profile"], [F.col("line").desc()], limit, "position")
    totals = good.groupBy("profile").agg(F.count("*").alias("recorder_failures")).withColumn(
        "truncated", F.col("recorder_failures") > limit)
    return newest, totals


# ------------------------------------------------------------------- look-up

#: Ids asked for that are still sent to every task.
BROADCAST_WANTED = 10_000


def find_by_id(rows: DataFrame, wanted: DataFrame, column: str = "id", shortest: int = 1) -> DataFrame:
    """Exact id, else the only id with that prefix, else ambiguous or not found.

    ``wanted`` is the user's list of ids.  Prefixes of the lengths asked for are
    joined by equality, not by comparing everything with everything.
    """
    ids = rows.select(F.col(column).alias("found"))
    asked = wanted.select("wanted").where(F.length("wanted") >= shortest).distinct()
    exact = asked.join(ids, F.col("wanted") == F.col("found"), "left_semi").select("wanted", F.col("wanted").alias("found"))
    # Distinct lengths of the ids asked for: at most the longest id.
    lengths = [r[0] for r in asked.select(F.length("wanted").alias("n")).distinct().collect()]
    sizes = F.array(*[F.lit(n) for n in sorted(lengths)]).cast("array<int>")
    prefixes = ids.withColumn("_size", F.explode(sizes)).where(F.length("found") >= F.col("_size")).select(
        F.substr("found", F.lit(1), F.col("_size")).alias("wanted"), "found")
    # Only prefixes asked for go on; a short list, its size checked, goes to every task.
    few = asked.limit(BROADCAST_WANTED + 1).count() <= BROADCAST_WANTED
    met = prefixes.join(F.broadcast(asked) if few else asked, "wanted", "left_semi")
    counts = met.groupBy("wanted").agg(F.count("*").alias("n"), F.min("found").alias("found"))
    joined = asked.join(exact.withColumnRenamed("found", "_exact"), "wanted", "left").join(counts, "wanted", "left")
    status = (
        F.when(F.col("_exact").isNotNull() | (F.col("n") == 1), "found")
        .when(F.col("n") > 1, "ambiguous").otherwise("not_found"))
    return joined.select(
        "wanted", status.alias("status"),
        F.coalesce("_exact", F.when(F.col("n") == 1, F.col("found"))).alias("found"))
