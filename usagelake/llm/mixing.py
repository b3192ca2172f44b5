"""Mixing sources to target weights by entropy balancing.

Every document i of source s gets a rate r_i >= 0.  Among all rates that meet the token constraints
``sum of size_i r_i over source s = target_s`` the one of least relative entropy to "take everything once",
counted over tokens, is ``r_i = exp(lambda_s)``: the exponential tilt of the dual's solution.  The dual is
``sum_s (S_s exp(lambda_s) - target_s lambda_s)`` with S_s the source's tokens.  It is convex and separates by
source, so Newton's steps run where the source's row is, in parallel over sources, with no job per step.

Rates become whole copies through the histogram of (source, size).  Going from large documents to small ones,
each cell takes the number of copies that brings the source's running total next to its running target, and that
leaves to the smaller documents what they can give, so the final gap is that of the smallest documents.  Documents of one cell differ by one copy at most.

Shuffles carry (source, size) counts and (doc_id, source, size) rows; text never moves.  A hot source is
pre-aggregated, a hot cell is dealt to buckets (:func:`common.dealt_rank`).  Only built-in functions are used.

Defined cases: a null text has size 0 and is never taken; a null source is a source of its own, sorted last;
a source of size 0 has target 0; repeated rows are rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelake.functions.ordered import number
from usagelake.llm.common import WORD, dealt_rank, keep, table

WEIGHTS = (5.0, 2.0, 1.0)
#: No document is taken more often, and so no target exceeds this times its source's size.
MOST_COPIES = 3
#: Newton's steps from lambda = 0.  A step moves at least 1 towards a far solution and converges
#: quadratically near it, so 64 steps reach any rate down to exp(-50).
NEWTON_STEPS = 64


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target, rate) from rows of (source, source_size), one a source.

    Weights go round the sources in code point order, null last.  The sum of all sizes is shared by weight;
    a share stops at ``most`` times the source's size and the excess is shared again among the others.
    """
    ranked = number(sizes.withColumn("_null", F.col("source").isNull().cast("int")), ["_null", "source"], "_k")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_k") % len(weights) + 1).cast("int"))
    src = keep(ranked.select("source", "source_size", weight.alias("weight")))
    cap = F.col("source_size") * float(most)
    total, heft = src.agg(F.sum("source_size"), F.sum("weight")).head()
    level, above = (float(total) / heft if heft else 0.0), -1
    while True:  # each round caps at least one source more, or ends
        over = F.col("weight") * level > cap
        fixed, free, count = src.agg(
            F.sum(F.when(over, cap).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))),
            F.sum(over.cast("long")),
        ).head()
        if count == above or not free:
            break
        above, level = count, (float(total) - fixed) / free
    target = F.least(F.col("weight") * level, cap)
    step = lambda at, _: at + F.col("target") / (F.col("source_size") * F.exp(at)) - 1.0
    dual = F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), F.lit(0.0), step)
    rate = F.when(F.col("source_size") > 0, F.exp(dual)).otherwise(0.0)
    return src.select("source", "source_size", target.alias("target")).withColumn("rate", rate)


def _copies(cells: DataFrame, most: int) -> DataFrame:
    """(source, size, n, copies of the whole cell), cells being (source, size, n, source_size, target, rate)."""
    per_source = cells.groupBy("source", "source_size", "target", "rate").agg(
        F.sort_array(F.collect_list(F.struct("size", "n")), asc=False).alias("cells")
    )
    start = F.struct(
        F.lit(0.0).alias("gap"), F.col("target").alias("left"), F.col("source_size").cast("double").alias("rest"),
        F.array().cast("array<bigint>").alias("out"),
    )

    def step(state, cell):
        wanted = state["gap"] + cell["size"] * cell["n"] * F.col("rate")
        rest = state["rest"] - cell["size"] * cell["n"]
        # What is left for smaller documents must be something that they can give.
        low = F.greatest(F.ceil((state["left"] - float(most) * rest) / cell["size"]), F.lit(0))
        high = F.least(F.floor(state["left"] / cell["size"]), cell["n"] * most)
        over = (high + 1) * cell["size"] - state["left"]
        short = state["left"] - high * cell["size"] - float(most) * rest
        near = F.greatest(low, F.least(high, F.round(wanted / cell["size"])))
        taken = F.when(low <= high, near).otherwise(F.when(over < short, high + 1).otherwise(high))
        taken = F.greatest(F.least(taken, cell["n"] * most), F.lit(0)).cast("bigint")
        return F.struct(
            (wanted - taken * cell["size"]).alias("gap"), (state["left"] - taken * cell["size"]).alias("left"),
            rest.alias("rest"), F.concat(state["out"], F.array(taken)).alias("out"),
        )

    # Sizes differ within a source, so its list is no longer than its longest document has words.
    out = F.aggregate("cells", start, step, lambda s: s["out"])
    return (
        per_source.withColumn("out", out)
        .select("source", "source_size", "target", "rate", F.explode(F.arrays_zip("cells", "out")).alias("c"))
        .select("source", "source_size", "target", "rate", "c.cells.size", "c.cells.n", F.col("c.out").alias("taken"))
    )


def mix(
    docs: DataFrame, keys: Sequence[str] = ("doc_id",), weights: Sequence[float] = WEIGHTS, most: int = MOST_COPIES
) -> DataFrame:
    """One row a document: ``keys``, size, source, source_size, target, rate, copies, taken."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = keep(docs.select(*keys, F.col("source"), size.alias("size")))
    cells = keep(sized.groupBy("source", "size").agg(F.count("*").alias("n")))
    sizes = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goal = targets(sizes, weights, most)
    held = cells.where("size > 0").alias("c").join(goal.alias("g"), F.expr("c.source <=> g.source"))
    dealt = _copies(held.select("c.source", "c.size", "c.n", "source_size", "target", "rate"), most)
    plan = dealt.select(
        F.col("source").alias("_source"), F.col("size").alias("_size"),
        F.expr("taken div n").alias("_each"), F.expr("taken % n").alias("_extra"),
    )
    ranked = dealt_rank(sized.where("size > 0"), ["source", "size"], list(keys), "_rank")
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size"))
    copies = F.col("_each") + (F.col("_rank") < F.col("_extra")).cast("long")
    taken = ranked.join(plan, same).select(*keys, "source", "size", copies.alias("copies"))
    empty = sized.where("size = 0").select(*keys, "source", "size", F.lit(0).cast("long").alias("copies"))
    rows = taken.unionByName(empty).alias("r")
    return rows.join(goal.alias("g"), F.expr("r.source <=> g.source")).select(
        *(f"r.{k}" for k in keys), "r.size", "r.source", "source_size", "target", "rate", "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def op8_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "rate", "copies"
    )
