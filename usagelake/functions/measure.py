"""Measurement algebra: a number, the kind of knowledge behind it, and NULL.

A measurement is two columns, ``name`` (bigint) and ``name_kind`` (string).
``kind`` is NULL when the source never reported the field and ``'unknown'``
when it was reported but cannot be used.  Missing is never zero.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Measurement kinds, strongest first.
KINDS = ("measured", "counted", "derived", "unknown", "estimated")
AUTHORITATIVE = ("measured", "derived", "counted")

# The five totals a session or turn reports.
USAGE_METRICS = ("input", "cached", "output", "reasoning", "total")

# The seven usage fields of an observation.
OBSERVATION_FIELDS = (
    "fresh_input",
    "cached_input",
    "cache_creation_input",
    "total_input",
    "output",
    "reasoning_output",
    "total",
)


def col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def kind_of(name: str) -> Column:
    return F.col(f"{name}_kind")


def available_pair(value: Column, kind: Column) -> Column:
    """True when the number can be used; never NULL."""
    return value.isNotNull() & F.coalesce(~kind.isin("", "unknown"), F.lit(False))


def available(name: str) -> Column:
    return available_pair(F.col(name), kind_of(name))


def authoritative(name: str) -> Column:
    return F.col(name).isNotNull() & F.coalesce(kind_of(name).isin(*AUTHORITATIVE), F.lit(False))


def any_authoritative(names: Sequence[str] = USAGE_METRICS) -> Column:
    result = F.lit(False)
    for name in names:
        result = result | authoritative(name)
    return result


def usable(name: str) -> Column:
    """The value where it is available, else NULL."""
    return F.when(available(name), F.col(name))


def rank_of(kind: Column) -> Column:
    """Weakness of a kind; combining measurements keeps the weakest."""
    rank = F.when(kind == KINDS[0], 1)
    for position, name in enumerate(KINDS[1:], start=2):
        rank = rank.when(kind == name, position)
    return rank


def kind_from_rank(rank: Column) -> Column:
    kind = F.when(rank == 1, KINDS[0])
    for position, name in enumerate(KINDS[1:], start=2):
        kind = kind.when(rank == position, name)
    return kind


def sum_available(name: str) -> Column:
    """Aggregate: sum of the available values, NULL when there are none."""
    return F.sum(usable(name))


def weakest_available(name: str) -> Column:
    """Aggregate: weakest kind among the available values."""
    return kind_from_rank(F.max(F.when(available(name), rank_of(kind_of(name)))))


def subtract(left: str, right: str, out: str) -> list[Column]:
    """``left - right`` as a measurement; unknown unless both are available."""
    both = available(left) & available(right)
    weaker = kind_from_rank(F.greatest(rank_of(kind_of(left)), rank_of(kind_of(right))))
    return [
        F.when(both, F.col(left) - F.col(right)).alias(out),
        F.when(both, weaker).otherwise("unknown").alias(f"{out}_kind"),
    ]


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, part.cast("double") / whole.cast("double"))
