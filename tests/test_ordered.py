"""Ordered scans against plain windows, with tiny blocks and one hot key."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from usagelake.functions import ordered
from usagelake.functions.ordered import Running, carry, first_per_key, last_value, number, previous_row, running_count, running_xor


def _rows(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", i * rng.choice([1, 1, 1]) + 0,
             rng.choice([None, rng.randrange(50)]), rng.random() < 0.3) for i in range(n)]
    return spark.createDataFrame(rows, "key string, ord bigint, v bigint, flag boolean").repartition(5)


def test_carry_equals_window(spark):
    df = _rows(spark)
    got = carry(df, ["key"], "ord", {
        "s": Running("sum", F.col("v")), "mx": Running("max", F.col("v")), "mn": Running("min", F.col("v")),
        "x": running_xor(F.coalesce("v", F.lit(0))), "l": last_value(F.col("v")),
        "st": last_value(F.struct("v", "ord")), "c": running_count(F.col("flag")),
        "p": previous_row(F.col("v"))}, block=7)
    w = Window.partitionBy("key").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    want = df.select(
        "*", F.sum("v").over(w).alias("s"), F.max("v").over(w).alias("mx"), F.min("v").over(w).alias("mn"),
        F.coalesce(F.bit_xor(F.coalesce("v", F.lit(0))).over(w), F.lit(0)).alias("x"),
        F.last("v", True).over(w).alias("l"), F.last(F.struct("v", "ord"), True).over(w).alias("st"),
        F.sum(F.when(F.col("flag"), 1).otherwise(0).cast("long")).over(w).alias("c"),
        F.lag("v").over(Window.partitionBy("key").orderBy("ord")).alias("p"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_carry_runs_backwards_too(spark):
    df = _rows(spark).withColumn("back", -F.col("ord"))
    got = carry(df, ["key"], "back", {"c": running_count(F.lit(True))}, block=3)
    w = Window.partitionBy("key").orderBy(F.col("ord").desc())
    want = df.select("key", "ord", (F.row_number().over(w) - 1).alias("c"))
    assert {(r.key, r.ord): r.c or 0 for r in got.collect()} == {(r.key, r.ord): r.c for r in want.collect()}


def test_hot_key_is_spread(spark):
    plan = carry(_rows(spark), ["key"], "ord", {"c": running_count(F.lit(True))}, block=7)._jdf.queryExecution().toString()
    assert "hashpartitioning(key" in plan and "_blk" in plan


def test_number_is_dense_and_ordered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("a"), (F.col("id") % 3).alias("b")).repartition(7)
    rows = number(df, ["b", "a"]).collect()
    assert [r.n for r in sorted(rows, key=lambda r: (r.b, r.a))] == list(range(1000))


def test_first_per_key_limits_before_the_shuffle(spark):
    df = _rows(spark)
    first = first_per_key(df, ["key"], ["ord"])
    plan = first._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    want = {}
    for r in df.collect():
        want[r.key] = min(want.get(r.key, r.ord), r.ord)
    assert {r.key: r.ord for r in first.collect()} == want


def test_lookup_is_a_left_join(spark):
    df = _rows(spark)
    names = spark.createDataFrame([("hot", "H"), ("k1", "one")], "key string, name string")
    got = ordered.lookup_join(df, names, ["key"])
    want = df.join(names, "key", "left").select("key", "ord", "v", "flag", "name")
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_one_block_in_all_needs_no_blocks(spark):
    df = _rows(spark)
    values = {"s": Running("sum", F.col("v")), "p": previous_row(F.col("v")), "x": running_xor(F.coalesce("v", F.lit(0)))}
    known = carry(df, ["key"], "ord", values, top=400)
    assert sorted(map(str, known.collect())) == sorted(map(str, carry(df, ["key"], "ord", values, block=7).collect()))
    assert "_blk" not in known._jdf.queryExecution().toString()


def test_top_of_many_is_the_same_however_often_dealt(spark):
    df = spark.range(9000).select((F.col("id") % 2).alias("k"), (F.col("id") * 7919 % 9001).alias("v"))
    got = ordered.top_per_key(df, ["k"], [F.col("v").desc()], 1500)
    want = [sorted((i * 7919 % 9001 for i in range(k, 9000, 2)), reverse=True)[:1500] for k in (0, 1)]
    assert [[r.v for r in got.where(F.col("k") == k).orderBy("_rn").collect()] for k in (0, 1)] == want
