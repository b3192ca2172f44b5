"""Cost of turns, sessions and whole collections in integer micros."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelake.functions.measure import available
from usagelake.functions.ordered import lookup_join
from usagelake.functions.text import model_of, provider_of
from usagelake.sources.catalog import price_index

# Fixed value: rates are per million tokens.
MILLION = 1_000_000
# Names in a price index that may be broadcast; a catalog file is at most
# 2 MiB, a few ten thousand names.  Beyond it Spark picks the join itself.
BROADCAST_NAMES = 50_000

PARTS = ("fresh_input", "cache_read", "cache_write", "output")


def turns_for_cost(turns: DataFrame, sessions: DataFrame, keys: Sequence[str] = ("source", "session_id")) -> DataFrame:
    """Turns, plus one stand-in turn for each session that has none."""
    named = turns.join(
        sessions.select(*keys, F.col("model").alias("_session_model")), list(keys), "left"
    ).withColumn("model", F.when(F.coalesce("model", F.lit("")) != "", F.col("model")).otherwise(F.col("_session_model")))
    alone = sessions.join(turns.select(*keys).distinct(), list(keys), "left_anti").withColumns(
        {"sequence": F.lit(1).cast("long"), "ts_us": F.col("updated_us")})
    return named.drop("_session_model").unionByName(
        alone.select(*[F.col(c) if c in alone.columns else F.lit(None).alias(c) for c in turns.columns]))


def resolve_prices(turns: DataFrame, profiles: DataFrame) -> DataFrame:
    """The price profile in force for each turn; NULL where there is none.

    A model name meets one row of the index, so this is one hash join on the
    name; with a catalog of checked size it is a broadcast and turns do not move.
    """
    index = price_index(profiles)
    named = turns.withColumn("alias", F.lower("model"))
    if index.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES:
        found = named.join(F.broadcast(index), "alias", "left")
    else:
        # A model everyone uses would be one key: spread its turns.
        found = lookup_join(named, index, ["alias"])
    in_force = F.filter(
        "candidates",
        lambda c: c.getField("effective_us").isNull() | F.col("ts_us").isNull()
        | (c.getField("effective_us") <= F.col("ts_us")),
    )
    return found.withColumn("profile", F.get(in_force, F.lit(0))).drop("alias", "candidates")


def turn_cost(turns: DataFrame, profiles: DataFrame) -> DataFrame:
    """Cost of each turn, or the reason it cannot be priced.

    Each part is cut to whole micros before the parts are added.
    """
    priced = resolve_prices(turns, profiles)
    value = {n: F.when(available(f"billable_{n}"), F.col(f"billable_{n}"))
             for n in ("input", "cache_read", "cache_write", "output")}
    nothing = F.lit(True)
    for name in value:
        nothing = nothing & F.col(f"billable_{name}").isNull() & F.col(f"billable_{name}_kind").isNull()
    # A write that is present but of unknown kind still counts in the split.
    write = F.coalesce(F.col("billable_cache_write"), F.lit(0))
    fresh = value["input"] - value["cache_read"] - write
    tier = F.get(F.filter("profile.tiers", lambda t: t.getField("up_to").isNull()
                          | (F.col("_total_input") <= t.getField("up_to"))), F.lit(0))
    split = priced.withColumns({
        "_nothing": nothing, "_fresh": fresh, "_write": write,
        "_total_input": fresh + value["cache_read"] + write,
    }).withColumn("_tier", tier)
    tiered = F.size("profile.tiers") > 0
    rates = F.when(tiered, F.col("_tier.rates")).otherwise(F.col("profile.rates"))
    split = split.withColumn("_rates", rates)
    reason = (
        F.when(F.col("profile").isNull(), F.concat(
            F.lit('pricing profile unavailable for model "'), F.coalesce("model", F.lit("")), F.lit('"')))
        .when(F.col("_nothing"), "billable usage unavailable")
        .when(value["input"].isNull(), "billable input unavailable")
        .when(value["cache_read"].isNull(), "billable cache read unavailable")
        .when(value["output"].isNull(), "billable output unavailable")
        .when(F.col("_fresh") < 0, "billable cache tokens exceed input")
        .when(tiered & F.col("_tier").isNull(), "pricing tier unavailable for turn input")
        .when((F.col("_rates.cache_write") > 0) & value["cache_write"].isNull(), "billable cache write unavailable")
    )
    read_rate = F.when(F.col("_rates.cache_read") != 0, F.col("_rates.cache_read")).otherwise(
        F.col("_rates.cached_input"))
    tokens = {"fresh_input": F.col("_fresh"), "cache_read": value["cache_read"], "cache_write": F.col("_write"),
              "output": value["output"]}
    rate = {"fresh_input": F.col("_rates.input"), "cache_read": read_rate, "cache_write": F.col("_rates.cache_write"),
            "output": F.col("_rates.output")}
    judged = split.withColumn("unavailable", reason)
    ok = F.col("unavailable").isNull()

    def micros(part: str) -> Column:
        return whole_division(F.when(ok, tokens[part] * rate[part]), F.lit(MILLION))

    out = judged.withColumns({
        **{part: F.when(ok, tokens[part]) for part in PARTS},
        **{f"{part}_micros": micros(part) for part in PARTS},
    })
    total = sum((F.col(f"{part}_micros") for part in PARTS[1:]), F.col("fresh_input_micros"))
    return out.select(
        *[c for c in turns.columns],
        F.when(ok, "available").otherwise("unavailable").alias("status"),
        F.when(ok, "estimated_api").otherwise("unknown").alias("provenance"),
        "unavailable", F.col("profile").isNull().alias("profile_missing"),
        F.when(ok, F.col("profile.currency")).alias("currency"),
        F.when(ok, F.col("profile.provider")).alias("provider"),
        F.when(ok, F.col("profile.sku")).alias("sku"),
        F.when(ok, F.col("_tier.name")).alias("tier"),
        *PARTS, *[f"{part}_micros" for part in PARTS], total.alias("total_micros"),
    )


def whole_division(value: Column, by: Column) -> Column:
    """Integer division that drops the fraction and never goes through a double."""
    return F.call_function("div", value, by)


def _sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in (*PARTS, *[f"{p}_micros" for p in PARTS], "total_micros")]


def cache_hit_basis_points() -> Column:
    """Cached share of the input in hundredths of a percent, cut to a whole number."""
    cached = F.col("cache_read") + F.col("cache_write")
    whole = F.col("fresh_input") + cached
    return whole_division(cached * 10_000, F.when(whole != 0, whole))


def session_cost(costs: DataFrame, keys: Sequence[str] = ("source", "session_id")) -> DataFrame:
    """All or nothing: one turn without a price, or a second currency, leaves the session unpriced."""
    ok = F.col("status") == "available"
    grouped = costs.groupBy(*keys).agg(
        F.count("*").alias("turns"),
        F.count_if(~ok).alias("unpriced_turns"),
        F.count_if(F.col("profile_missing")).alias("missing_profile_turns"),
        F.min("currency").alias("_low"), F.max("currency").alias("_high"),
        *_sums(),
    )
    good = (F.col("unpriced_turns") == 0) & (F.col("_low") == F.col("_high"))
    columns = [c for c in (*PARTS, *[f"{p}_micros" for p in PARTS], "total_micros")]
    return grouped.select(
        *keys, "turns", "unpriced_turns", "missing_profile_turns",
        F.when(good, "available").otherwise("unavailable").alias("status"),
        F.when(good, F.col("_low")).alias("currency"),
        *[F.when(good, F.col(c)).alias(c) for c in columns],
        F.when(good, cache_hit_basis_points()).alias("cache_hit_basis_points"),
    )


def cost_reasons(costs: DataFrame, keys: Sequence[str] = ("source", "session_id")) -> DataFrame:
    """Why sessions are unpriced: one row per turn, and one per model without a profile."""
    per_turn = costs.where("status = 'unavailable' AND NOT profile_missing").select(
        *keys, "sequence", F.concat(F.lit("turn "), F.col("sequence").cast("string"), F.lit(": "), F.col("unavailable"))
        .alias("reason"))
    named = F.when(F.coalesce("model", F.lit("")) == "", "unknown model").otherwise(F.col("model"))
    per_model = costs.where("profile_missing").withColumn("model", named).groupBy(*keys, F.lower("model").alias("_m")).agg(
        F.max("model").alias("model"), F.count("*").alias("n")
    ).select(
        *keys, F.lit(None).cast("long").alias("sequence"),
        F.concat(F.lit("pricing unavailable for "), F.col("model"), F.lit(" ("), F.col("n").cast("string"), F.lit(" turns)"))
        .alias("reason"))
    first = costs.where("status = 'available'").groupBy(*keys).agg(
        F.min_by("currency", "sequence").alias("_first"), F.max("currency").alias("_high"), F.min("currency").alias("_low")
    ).where("_low <> _high").select(*keys, "_first")
    odd = costs.where("status = 'available'").join(first, list(keys)).where("currency <> _first").select(
        *keys, "sequence", F.concat(F.lit("turn "), F.col("sequence").cast("string"), F.lit(" has currency "),
                                    F.col("currency")).alias("reason"))
    return per_turn.unionByName(per_model).unionByName(odd)


def cost_rollup(costs: DataFrame) -> DataFrame:
    """Cost by provider, source and currency, and within it by SKU and model.

    Amounts of different currencies are never added.  No grand total: sources may have seen the same calls.
    """
    group, model = ["provider", "source", "currency"], ["sku", "model"]
    per_session = costs.where("status = 'available'").groupBy(*group, *model, "session_id").agg(
        F.count("*").alias("model_calls"), *_sums())
    by_model = per_session.groupBy(*group, *model).agg(
        F.count("*").alias("sessions"), F.sum("model_calls").alias("model_calls"), *_sums()).withColumn("level", F.lit("model"))
    # Sessions are distinct after the first grouping but for their models.
    per_group = per_session.groupBy(*group, "session_id").agg(F.sum("model_calls").alias("model_calls"), *_sums())
    by_source = per_group.groupBy(*group).agg(
        F.count("*").alias("sessions"), F.sum("model_calls").alias("model_calls"), *_sums()).withColumn("level", F.lit("source"))
    return by_source.unionByName(by_model, allowMissingColumns=True)


def filter_provider(costs: DataFrame, provider: str) -> DataFrame:
    return costs.where(F.lower("provider") == provider.lower())


def missing_prices(turns: DataFrame, profiles: DataFrame) -> DataFrame:
    """Models without a price profile: turns and sessions affected."""
    lost = resolve_prices(turns, profiles).where("profile IS NULL")
    model = F.coalesce("model", F.lit(""))
    named = lost.select("source", "session_id", provider_of(model).alias("provider"), model_of(model).alias("model"))
    per_session = named.groupBy(
        F.lower("provider").alias("_p"), F.lower("model").alias("_m"), "session_id"
    ).agg(F.min("provider").alias("provider"), F.min("model").alias("model"), F.count("*").alias("turns"))
    return per_session.groupBy("_p", "_m").agg(
        F.min("provider").alias("provider"), F.min("model").alias("model"),
        F.sum("turns").alias("turns"), F.count("*").alias("sessions"),
    ).drop("_p", "_m")

