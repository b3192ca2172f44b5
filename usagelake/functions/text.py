"""Scalar text functions: token estimates, hashes, time stamps, names, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# RFC 3339 time stamps with an optional fraction.
RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([.,]\d+)?(Z|[+-]\d{2}:\d{2})$"


# The blanks that trimming removes.
BLANKS = " \t\n\v\f\r"


def strip(value: Column) -> Column:
    return F.trim(value, F.lit(BLANKS))


def none_if_empty(value: Column) -> Column:
    return F.when(value != "", value)


def token_estimate(text: Column) -> Column:
    """A quarter of the code points, rounded up; NULL for no text."""
    return F.when(F.length(text) > 0, F.floor((F.length(text) + 3) / 4).cast("long"))


def token_estimate_kind(text: Column) -> Column:
    return F.when(F.length(text) > 0, "estimated").otherwise("unknown")


def content_hash(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.concat(F.lit("sha256:"), F.sha2(text, 256))).otherwise("")


def parse_time(value: Column) -> Column:
    """Time stamp of an RFC 3339 string, NULL for anything else."""
    return F.when(value.rlike(RFC3339), F.try_to_timestamp(F.regexp_replace(value, ",", ".")))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def fold(value: Column) -> Column:
    """Key for comparing names without regard to case or outer blanks."""
    return F.lower(strip(F.coalesce(value, F.lit(""))))


def provider_of(model: Column) -> Column:
    """Text before the first slash, when both parts are there, else ''."""
    at = F.instr(model, "/")
    return F.when((at > 1) & (at < F.length(model)), F.substring_index(model, "/", 1)).otherwise("")


def model_of(model: Column) -> Column:
    """What follows the provider, or the whole name when there is none."""
    at = F.instr(model, "/")
    return F.when((at > 1) & (at < F.length(model)), F.substr(model, at + 1)).otherwise(model)


def clean_path(path: Column) -> Column:
    """Lexically normal form of a slash path, with built-ins only.

    Blank stays blank, repeated slashes and ``.`` go, ``..`` takes the element
    before it away (and is dropped at the root), nothing left is ``.``.
    """
    text = strip(path)
    rooted = text.startswith("/")
    parts = F.filter(F.split(text, "/+"), lambda p: (p != "") & (p != "."))

    def step(kept: Column, part: Column) -> Column:
        can_pop = (F.size(kept) > 0) & (F.element_at(kept, -1) != "..")
        popped = F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))
        return (
            F.when(part != "..", F.concat(kept, F.array(part)))
            .when((F.size(kept) > 0) & can_pop, popped)
            .when(rooted, kept)
            .otherwise(F.concat(kept, F.array(part)))
        )

    joined = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    full = F.when(rooted, F.concat(F.lit("/"), joined)).otherwise(joined)
    return F.when(text == "", "").when(full == "", ".").otherwise(full)
