"""Order-dependent operators that never put one group into one task.

A plain window ``partitionBy(session)`` gives a session that holds a third of
all rows to a single task.  ``carry`` computes the same running values in
blocks: rows are spread by (keys, order div block), each block is summarised,
the short list of block summaries is scanned per key, and what came before a
block is joined back onto its rows.  The order column must be an integer that
is unique within the keys (a line number, an event id, a rank), so a block can
never hold more than ``block`` rows, however large the group is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagelake.session import cut

BLOCK = 1 << 20


def block_of(order: str | Column, block: int = BLOCK) -> Column:
    order = F.col(order) if isinstance(order, str) else order
    return F.call_function("div", order, F.lit(block))


class Running:
    """One running value over the rows strictly before the current one."""

    def __init__(self, kind: str, value: Column) -> None:
        if kind not in ("sum", "max", "min", "xor", "last", "row"):
            raise ValueError(kind)
        self.kind = kind
        self.value = value

    def in_block(self, window) -> Column:
        if self.kind == "sum":
            return F.sum(self.value).over(window)
        if self.kind == "max":
            return F.max(self.value).over(window)
        if self.kind == "min":
            return F.min(self.value).over(window)
        if self.kind == "xor":
            return F.bit_xor(self.value).over(window)
        return F.last(self.value, ignorenulls=self.kind == "last").over(window)

    def of_block(self, order: Column) -> Column:
        if self.kind == "sum":
            return F.sum(self.value)
        if self.kind == "max":
            return F.max(self.value)
        if self.kind == "min":
            return F.min(self.value)
        if self.kind == "xor":
            return F.bit_xor(self.value)
        if self.kind == "row":
            return F.max_by(self.value, order)
        return F.max_by(self.value, F.when(self.value.isNotNull(), order))

    def over_blocks(self, name: str, window) -> Column:
        return Running(self.kind, F.col(name)).in_block(window)

    def combine(self, before: Column, inside: Column) -> Column:
        if self.kind == "row":
            return F.when(F.col("_i__any"), inside).otherwise(before)
        if self.kind == "sum":
            return F.when(before.isNotNull() | inside.isNotNull(),
                          F.coalesce(before, F.lit(0)) + F.coalesce(inside, F.lit(0)))
        if self.kind == "max":
            return F.greatest(before, inside)
        if self.kind == "min":
            return F.least(before, inside)
        if self.kind == "xor":
            return F.coalesce(before, F.lit(0)).bitwiseXOR(F.coalesce(inside, F.lit(0)))
        return F.coalesce(inside, before)


def running_sum(value: Column) -> Running:
    return Running("sum", value)


def running_count(condition: Column) -> Running:
    return Running("sum", F.when(condition, 1).otherwise(0).cast("long"))


def running_max(value: Column) -> Running:
    return Running("max", value)


def running_xor(value: Column) -> Running:
    return Running("xor", value)


def last_value(value: Column) -> Running:
    """Last non-NULL value before this row (a struct is NULL only as a whole)."""
    return Running("last", value)


def previous_row(value: Column) -> Running:
    """The value of the row just before this one, NULL included.

    On fixed-width columns the block summaries stay hash aggregates.
    """
    return Running("row", value)


def carry(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    values: dict[str, Running],
    block: int = BLOCK,
    keep: Column | None = None,
    top: int | None = None,
) -> DataFrame:
    """Add running values over the earlier rows of the same keys.

    ``keys`` must not be NULL.  ``keep`` drops rows after the scan (for rows
    that only feed it).  ``top`` is the greatest order value, where it is known:
    if that leaves a single block (and no order is negative), nothing has to be
    brought across blocks and one window does it.
    """
    keys = list(keys)
    if top is not None and top < block:
        inside = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        scanned = df.select(
            "*", *[value.in_block(inside).alias(f"_i_{name}") for name, value in values.items()],
            (F.count(F.lit(1)).over(inside) > 0).alias("_i__any"),
        )
        if keep is not None:
            scanned = scanned.where(keep)
        return scanned.select(
            *[F.col(name) for name in df.columns],
            *[value.combine(F.lit(None), F.col(f"_i_{name}")).alias(name) for name, value in values.items()],
        )
    rows = df.withColumn("_blk", block_of(order, block))
    summary = rows.groupBy(*keys, "_blk").agg(
        *[value.of_block(F.col(order)).alias(f"_c_{name}") for name, value in values.items()]
    )
    across = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    before = summary.select(
        *keys,
        "_blk",
        *[value.over_blocks(f"_c_{name}", across).alias(f"_b_{name}") for name, value in values.items()],
    )
    inside = (
        Window.partitionBy(*keys, "_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    )
    # The explicit repartition keeps an upstream partitioning on the keys alone
    # from being reused for the window, which would bring the hot group back.
    scanned = rows.repartition(*keys, "_blk").select(
        "*", *[value.in_block(inside).alias(f"_i_{name}") for name, value in values.items()],
        (F.count(F.lit(1)).over(inside) > 0).alias("_i__any"),
    )
    if keep is not None:
        scanned = scanned.where(keep)
    out = scanned.join(before, [*keys, "_blk"], "left")
    return out.select(
        *[F.col(name) for name in df.columns],
        *[
            value.combine(F.col(f"_b_{name}"), F.col(f"_i_{name}")).alias(name)
            for name, value in values.items()
        ],
    )


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in the given order.

    Catalyst turns the rank filter into a group limit that runs before the
    shuffle, so a hot key sends one row per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).where("_rn = 1").drop("_rn")


#: Spark limits groups before the shuffle up to this rank, its default.
GROUP_LIMIT = 1000


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "_rn") -> DataFrame:
    """The first ``n`` rows of each key.

    Up to ``GROUP_LIMIT`` the limit runs before the shuffle.  Beyond it each key is first limited in 64 parts, so
    that at most 64 ``n`` rows of a key come together.
    """
    if n > GROUP_LIMIT:
        part = Window.partitionBy(*keys, "_part").orderBy(*order)
        # By the row's own values: a task that runs again deals its rows alike.
        plain = [F.col(f.name) for f in df.schema if f.dataType.typeName() not in ("map", "variant")]
        dealt = df.withColumn("_part", F.pmod(F.xxhash64(*plain), F.lit(64)))
        df = dealt.withColumn("_rp", F.row_number().over(part)).where(F.col("_rp") <= n).drop("_rp", "_part")
    window = Window.partitionBy(*keys).orderBy(*order)
    limited = df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)
    return limited.withColumn(rank, F.col(rank).cast("long"))


def lookup_join(rows: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join many rows to one lookup row per key when a key may be hot.

    A small lookup is broadcast after a look at its size.  Else both sides meet by key, and adaptive execution splits
    the partitions that turn out too large by the tasks that wrote them, repeating only their lookup rows:
    ``build_session`` lets it do so even where that costs another shuffle.  Nothing is copied for keys that are not hot.
    """
    return rows.join(lookup, list(on), how)


#: Lookups of at most so many rows are broadcast.
SMALL = 200_000


def small(lookup: DataFrame, rows: int = SMALL) -> DataFrame:
    """The lookup (a materialised one), marked for broadcast where it has few rows."""
    return F.broadcast(lookup) if lookup.limit(rows + 1).count() <= rows else lookup


def number(df: DataFrame, order: Sequence[str], name: str = "n") -> DataFrame:
    """Dense global rank from 0 in the given total order, without a global window.

    Rows are range-partitioned and sorted, so a row's rank is the size of the
    partitions before it plus its place in its own.  The partition sizes are
    one row per task.  The range-partitioned rows are materialised first: both
    passes must see the same ranges, also after an executor is lost.
    """
    placed = cut(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_pos", F.monotonically_increasing_id())
    )
    part = F.shiftright("_pos", 33)
    local = F.col("_pos").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    # One row per range partition, so its size is bounded by the task count; kept, or each reader would count all rows again.
    offsets = cut(sizes.select(
        "_part",
        F.coalesce(
            F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("_offset"),
    ))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + local)
        .drop("_part", "_pos", "_offset")
    )
