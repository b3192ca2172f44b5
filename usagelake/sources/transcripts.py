"""What the two transcript readers share: component columns, turns, links."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelake.functions.ordered import BLOCK
from usagelake.functions.text import content_hash, token_estimate, token_estimate_kind
from usagelake.operators import context
from usagelake.session import cut

# Place of a component within its line: positions per line.  A record of 64 MiB, the largest that is read, has
# fewer blocks than this, as each takes three bytes or more.
SLOTS = 1 << 25


def _line_block(block: int) -> int:
    """Order range of a block of lines; a line holds a few components."""
    return max(block // 16, 1) * SLOTS

COMPONENT_COLUMNS = (
    "file", "line", "ord", "kind", "source", "record", "path", "tokens", "tokens_kind", "content_hash",
    "completeness", "tool_call_id", "content_bytes",
)


@dataclass
class Transcripts:
    """Tables of a transcript source, keyed by file."""

    sessions: DataFrame
    turns: DataFrame
    components: DataFrame


def place(line: Column, slot: Column) -> Column:
    return line * SLOTS + slot


def text_facts(body: Column) -> list[Column]:
    """What is kept of a text: estimate, its kind, digest.  The text itself goes no further."""
    return [token_estimate(body).alias("tokens"), token_estimate_kind(body).alias("tokens_kind"),
            content_hash(body).alias("content_hash")]


def component(kind: Column, source: str, record: Column, ordinal: Column, measured: bool = True,
              completeness: Column | None = None, path: Column | None = None, call_id: Column | None = None,
              size: Column | None = None) -> list[Column]:
    none = F.lit(None)
    facts = (
        [F.col("tokens"), F.col("tokens_kind"), F.col("content_hash")] if measured
        else [none.cast("long").alias("tokens"), F.lit("unknown").alias("tokens_kind"), F.lit("").alias("content_hash")])
    return [
        F.col("file"), F.col("line"), ordinal.alias("ord"), kind.alias("kind"), F.lit(source).alias("source"),
        record.alias("record"), (path if path is not None else F.lit("")).alias("path"), *facts,
        (completeness if completeness is not None else none.cast("string")).alias("completeness"),
        (call_id if call_id is not None else F.lit("")).alias("tool_call_id"),
        (size if size is not None else none.cast("long")).alias("content_bytes"),
    ]


def unreadable(records: DataFrame, source: str) -> DataFrame:
    """A component for each record that could not be read, so its loss stays visible."""
    return records.where("NOT readable").select(*component(
        F.lit("unknown"), source, F.concat(F.lit(f"{source}#line:"), F.col("line").cast("string")),
        place(F.col("line"), F.lit(1)), measured=False,
        completeness=F.when(F.col("oversized"), "truncated").otherwise("unavailable")))


def finish_components(components: DataFrame, closes: DataFrame, calls: DataFrame, block: int = BLOCK) -> DataFrame:
    """Put components into turns, drop repeats, and name the tools of results.

    ``closes`` has file and ord of usage events, ``calls`` file, ord, call_id,
    name and fingerprint of declared calls.
    """
    shaped = cut(components.withColumn("closes_turn", F.lit(False)).unionByName(
        closes.select("file", "ord", F.lit(True).alias("closes_turn")), allowMissingColumns=True))
    placed = context.assign_turns(shaped, ["file"], "ord", block=_line_block(block)).where("NOT closes_turn").drop("closes_turn")
    unique = cut(context.dedup_components(placed, ["file", "turn_sequence"]))
    results = unique.where("kind = 'tool_result'").select(
        "file", "ord", F.lit("result").alias("role"), F.col("tool_call_id").alias("call_id"),
        F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("fingerprint"))
    events = cut(results.unionByName(calls.select("file", "ord", F.lit("call").alias("role"), "call_id", "name", "fingerprint")))
    linked = context.link_calls(events, ["file"], "ord", _line_block(block)).select(
        "file", "ord", "tool_name", "tool_call_fingerprint")
    return unique.join(linked, ["file", "ord"], "left").withColumns({
        "tool_name": F.coalesce("tool_name", F.lit("")),
        "tool_call_fingerprint": F.coalesce("tool_call_fingerprint", F.lit(""))})
