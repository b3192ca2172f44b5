"""Context attribution: components of turns, dedup, coverage of fresh input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelake.functions.measure import (
    authoritative,
    available,
    kind_from_rank,
    kind_of,
    rank_of,
    ratio,
    subtract,
)
from usagelake.functions.ordered import (
    BLOCK,
    carry,
    first_per_key,
    last_value,
    running_count,
    lookup_join,
    top_per_key,
)
from usagelake.functions.text import clean_path

# Component kinds in report order.
COMPONENT_KINDS = (
    "instructions",
    "user_prompt",
    "history",
    "file",
    "tool_result",
    "tool_definition",
    "other",
    "unknown",
)


def assign_turns(records: DataFrame, keys: Sequence[str] = ("session_id",), order: str = "ord",
                 closes: str = "closes_turn", block: int = BLOCK) -> DataFrame:
    """Give each record the turn closed by the next usage event.

    Records after the last usage event are trailing: their turn is NULL.
    """
    counted = carry(records, keys, order, {"_closed": running_count(F.col(closes))}, block)
    totals = records.groupBy(*keys).agg(F.count_if(F.col(closes)).alias("_turns"))
    placed = lookup_join(counted, totals, keys)
    turn = F.coalesce("_closed", F.lit(0)) + 1
    return placed.withColumn("turn_sequence", F.when(turn <= F.col("_turns"), turn)).drop("_closed", "_turns")


def dedup_components(components: DataFrame, keys: Sequence[str] = ("session_id", "turn_sequence"),
                     order: str = "ord") -> DataFrame:
    """First component per kind, source, record and path of a turn's pending list."""
    return first_per_key(components, [*keys, "kind", "source", "record", "path"], [order])


def link_calls(events: DataFrame, keys: Sequence[str] = ("session_id",), order: str = "ord",
               block: int = BLOCK) -> DataFrame:
    """Give each result the name and fingerprint of the latest earlier call with its id.

    ``events`` has ``role`` (call or result), ``call_id``, ``name`` and
    ``fingerprint``.  A call without a name registers nothing.  Both facts come
    from the same call.
    """
    registers = (F.col("role") == "call") & (F.coalesce("name", F.lit("")) != "")
    declared = F.when(registers, F.struct(F.col("name").alias("name"), F.col("fingerprint").alias("fingerprint")))
    linked = carry(
        events.where("call_id <> ''"), [*keys, "call_id"], order, {"_call": last_value(declared)}, block,
        keep=F.col("role") == "result",
    )
    with_id = linked.select(
        *[c for c in events.columns if c not in ("role", "name", "fingerprint")],
        F.col("_call.name").alias("tool_name"), F.col("_call.fingerprint").alias("tool_call_fingerprint"),
    )
    without = events.where("role = 'result' AND coalesce(call_id, '') = ''").select(
        *[c for c in events.columns if c not in ("role", "name", "fingerprint")],
        F.lit(None).cast("string").alias("tool_name"), F.lit(None).cast("string").alias("tool_call_fingerprint"),
    )
    return with_id.unionByName(without)


def attribution(components: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum of what is attributed: estimates and counts, not provider numbers."""
    counts = available("tokens") & ~kind_of("tokens").isin("measured", "derived")
    estimated = F.bool_or(counts & (kind_of("tokens") == "estimated"))
    return components.groupBy(*keys).agg(
        F.sum(F.when(counts, F.col("tokens"))).alias("attributed"),
        F.when(F.count_if(counts) > 0, F.when(estimated, "estimated").otherwise("counted")).alias("attributed_kind"),
    )


def category_breakdown(components: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tokens per component kind of a turn, in attribution terms."""
    summed = attribution(components, [*keys, "kind"])
    return summed.withColumn("attributed_kind", F.coalesce("attributed_kind", F.lit("unknown")))


def request_categories(components: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tokens per component kind of a request, kinds weakening as they add up.

    Counted tool definitions are sizes of a schema, not tokens sent, and stay out.
    """
    usable = available("tokens") & ~((F.col("kind") == "tool_definition") & (kind_of("tokens") == "counted"))
    return components.groupBy(*keys, "kind").agg(
        F.sum(F.when(usable, F.col("tokens"))).alias("tokens"),
        kind_from_rank(F.max(F.when(usable, rank_of(kind_of("tokens"))))).alias("tokens_kind"),
    )


def counter_fresh_input() -> list[Column]:
    """Fresh input where input includes cached input."""
    return subtract("input", "cached", "fresh")


def reported_fresh_input() -> list[Column]:
    """Fresh input where the source reports it apart from cached input."""
    return [F.col("input").alias("fresh"), F.col("input_kind").alias("fresh_kind")]


def turn_fresh_input(turns: DataFrame) -> DataFrame:
    """Resolve ``fresh``: the accounting of the turn, else its plain input."""
    missing = ~available("fresh") & ~available("cached")
    return turns.withColumns({
        "fresh": F.when(missing, F.col("input")).otherwise(F.col("fresh")),
        "fresh_kind": F.when(missing, F.col("input_kind")).otherwise(F.col("fresh_kind")),
    })


def fresh_coverage(turns: DataFrame, components: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How much of a turn's fresh input its components account for."""
    known = turn_fresh_input(turns).join(attribution(components, keys), list(keys), "left")
    usable = authoritative("fresh") & F.col("attributed").isNotNull()
    rest = F.col("fresh") - F.col("attributed")
    return known.select(
        *keys,
        F.col("fresh"), F.col("fresh_kind"),
        F.when(usable, F.col("attributed")).alias("attributed"),
        F.when(usable, F.col("attributed_kind")).otherwise("unknown").alias("attributed_kind"),
        F.when(usable, F.greatest(rest, F.lit(0).cast("long"))).alias("unattributed"),
        F.when(usable & (F.col("fresh") > 0), ratio(F.col("attributed"), F.col("fresh")))
        .when(usable, F.lit(0.0)).alias("coverage"),
        F.coalesce(usable & (rest < 0), F.lit(False)).alias("conflict"),
    )


def file_attribution(components: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tokens per normalised file path, available measurements only."""
    files = components.where((F.col("kind") == "file") & available("tokens")).withColumn("path", clean_path(F.col("path")))
    return files.where("path <> ''").groupBy(*keys, "path").agg(
        F.sum("tokens").alias("tokens"), kind_from_rank(F.max(rank_of(kind_of("tokens")))).alias("tokens_kind")
    )


def top_files(components: DataFrame, keys: Sequence[str], n: int = 5) -> DataFrame:
    """The largest file components of a turn."""
    files = components.where("kind = 'file' AND path <> ''")
    order = [F.coalesce("tokens", F.lit(0)).desc(), F.col("path").asc(), F.col("ord").asc()]
    return top_per_key(files, keys, order, n, "position")


def redact(components: DataFrame) -> DataFrame:
    """Components without the digests that must not leave the job."""
    blank = {c: F.lit("") for c in ("content_hash", "tool_call_fingerprint") if c in components.columns}
    return components.withColumns(blank)


# Programs whose arguments are files they read, tools that run
# them, and characters that rule an argument out.
READ_PROGRAMS = ("cat", "sed", "nl", "awk", "head", "tail")
SHELL_TOOLS = ("exec_command", "functions.exec_command")


def read_files(calls: DataFrame) -> DataFrame:
    """File components of shell commands that read files; one row per path."""
    words = F.filter(F.split("cmd", r"\s+"), lambda w: w != "")
    arguments = F.filter(
        F.slice("_words", 2, F.greatest(F.size("_words") - 1, F.lit(1))),
        lambda w: ~w.startswith("-") & ~w.contains("=") & ~w.rlike("['\"{}]") & (w.contains("/") | w.contains(".")),
    )
    chosen = (
        calls.where(F.col("tool_name").isin(*SHELL_TOOLS))
        .withColumn("_words", words)
        .where((F.size("_words") > 1) & F.col("_words")[0].isin(*READ_PROGRAMS))
    )
    rest = [c for c in calls.columns if c not in ("cmd", "tool_name", "record")]
    return chosen.select(
        *rest, "record", F.posexplode(arguments).alias("_i", "_path")
    ).select(
        *rest,
        F.lit("file").alias("kind"),
        F.concat(F.col("record"), F.lit("#file:"), (F.col("_i") + 1).cast("string")).alias("record"),
        (F.col("_i") + 1).cast("long").alias("position"),
        clean_path(F.col("_path")).alias("path"),
        F.lit(None).cast("long").alias("tokens"),
        F.lit("unknown").alias("tokens_kind"),
    )


