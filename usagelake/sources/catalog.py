"""Price catalogs: read, validate, overlay, and index by model name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from usagelake.functions.text import parse_time

# Fixed value: a catalog file is at most this large, so it can be broadcast.
MAX_CATALOG_BYTES = 2 * 1024 * 1024

# Where a profile came from, weakest first.
SOURCE_RANK = {"embedded": 1, "cache": 2, "override": 3}

RATES = ("input", "cached_input", "cache_read", "cache_write", "output")
_FILE_RATES = T.StructType([T.StructField(f"{r}_micros_per_million", T.LongType()) for r in RATES])
FILE_SCHEMA = T.StructType([
    T.StructField("version", T.StringType()),
    T.StructField("generated_at", T.StringType()),
    T.StructField("profiles", T.ArrayType(T.StructType([
        T.StructField("provider", T.StringType()),
        T.StructField("sku", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("aliases", T.ArrayType(T.StringType())),
        T.StructField("currency", T.StringType()),
        T.StructField("effective_from", T.StringType()),
        T.StructField("rates", _FILE_RATES),
        T.StructField("tiers", T.ArrayType(T.StructType([
            T.StructField("name", T.StringType()),
            T.StructField("up_to_input_tokens", T.LongType()),
            T.StructField("rates", _FILE_RATES),
        ]))),
        T.StructField("sources", T.ArrayType(T.StructType([
            T.StructField("url", T.StringType()),
            T.StructField("verified_at", T.StringType()),
            T.StructField("note", T.StringType()),
        ]))),
    ]))),
])


def _rates(column: Column) -> Column:
    return F.struct(*[
        F.coalesce(column.getField(f"{r}_micros_per_million"), F.lit(0).cast("long")).alias(r) for r in RATES
    ])


def read_catalog(spark: SparkSession, path: str, catalog_source: str = "embedded") -> DataFrame:
    """Profiles of one catalog file; refuses a file above the size limit."""
    sizes = spark.read.format("binaryFile").load(path).select("length")
    largest = sizes.agg(F.max("length")).first()[0]
    if largest is None or largest > MAX_CATALOG_BYTES:
        raise ValueError(f"price catalog {path} is missing or above {MAX_CATALOG_BYTES} bytes")
    rows = spark.read.schema(FILE_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)
    profile = F.col("p")
    return rows.select("version", F.explode("profiles").alias("p")).select(
        "version", *[profile.getField(f).alias(f) for f in ("provider", "sku", "model")],
        F.coalesce(profile.getField("aliases"), F.array().cast("array<string>")).alias("aliases"),
        profile.getField("currency").alias("currency"),
        F.unix_micros(parse_time(profile.getField("effective_from"))).alias("effective_us"),
        _rates(profile.getField("rates")).alias("rates"),
        F.transform(
            F.coalesce(profile.getField("tiers"), F.array()),
            lambda t: F.struct(t.getField("name").alias("name"), t.getField("up_to_input_tokens").alias("up_to"),
                               _rates(t.getField("rates")).alias("rates")),
        ).alias("tiers"),
        profile.getField("sources").alias("sources"),
        F.lit(catalog_source).alias("catalog_source"),
    )


def aliases(profiles: DataFrame) -> DataFrame:
    """One row per profile and distinct lower-case name it answers to."""
    names = F.array_distinct(F.transform(
        F.filter(F.concat(F.array("model", "sku"), F.coalesce("aliases", F.array().cast("array<string>"))),
                 lambda a: a.isNotNull() & (a != "")),
        lambda a: F.lower(a),
    ))
    return profiles.select("*", F.explode(names).alias("alias"))


def catalog_errors(profiles: DataFrame) -> DataFrame:
    """Everything wrong with a catalog, one row per problem."""

    def negative(rates: Column) -> Column:
        bad = F.lit(False)
        for rate in RATES:
            bad = bad | (F.coalesce(rates.getField(rate), F.lit(0)) < 0)
        return bad

    def blank(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) == ""

    problems = F.array(
        F.when(blank("version"), "pricing catalog version is required"),
        F.when(blank("provider"), "provider is required"),
        F.when(blank("sku"), "sku is required"),
        F.when(blank("currency"), "currency is required"),
        F.when(negative(F.col("rates")), "rates must be non-negative"),
        F.when(F.exists("tiers", lambda t: F.coalesce(t.getField("name"), F.lit("")) == ""), "tier name is required"),
        F.when(F.exists("tiers", lambda t: F.coalesce(t.getField("up_to"), F.lit(0)) < 0),
               "up_to_input_tokens must be non-negative"),
        F.when(F.exists("tiers", lambda t: negative(t.getField("rates"))), "tier rates must be non-negative"),
        F.when(F.exists(F.coalesce("sources", F.array()),
                        lambda s: ~F.coalesce(s.getField("url"), F.lit("")).rlike("^https?://[^/?#]+")),
               "source url is invalid"),
    )
    single = profiles.select("provider", "sku", F.explode(F.filter(problems, lambda p: p.isNotNull())).alias("problem"))
    # One name of a provider belongs to one SKU, once per effective date.
    shared = aliases(profiles).groupBy(F.lower("provider").alias("provider"), "alias").agg(
        F.min("sku").alias("sku"), F.max("sku").alias("_other"),
        (F.count("*") - F.count_distinct(F.coalesce("effective_us", F.lit(-(1 << 62))))).alias("_repeats"),
    ).where("sku <> _other OR _repeats > 0").select("provider", "sku", F.lit("duplicate pricing alias").alias("problem"))
    return single.unionByName(shared)


def overlay(base: DataFrame, higher: DataFrame) -> DataFrame:
    """The higher catalog plus the base profiles that share no name with it."""
    taken = aliases(higher).select(F.lower("provider").alias("_p"), "alias").distinct()
    named = aliases(base).select("provider", "sku", "effective_us", F.lower("provider").alias("_p"), "alias")
    replaced = named.join(taken, ["_p", "alias"], "left_semi").select("provider", "sku", "effective_us").distinct()
    same = (
        (F.col("b.provider") == F.col("r.provider")) & (F.col("b.sku") == F.col("r.sku"))
        & F.col("b.effective_us").eqNullSafe(F.col("r.effective_us"))
    )
    kept = base.alias("b").join(replaced.alias("r"), same, "left_anti")
    return higher.unionByName(kept, allowMissingColumns=True)


def order_catalog(profiles: DataFrame) -> DataFrame:
    return profiles.orderBy(F.lower("provider"), F.lower("sku"))


def price_index(profiles: DataFrame) -> DataFrame:
    """Per name, its profiles in the order they are preferred.

    Preference does not depend on the turn (catalog source, dated before
    undated, newest, SKU), only the date filter does.  So the order is fixed
    here once and a turn takes the first entry that is in force.
    """
    rank = F.lit(0)
    for name, value in SOURCE_RANK.items():
        rank = F.when(F.col("catalog_source") == name, value).otherwise(rank)
    entry = F.struct(
        (-rank).alias("by_source"),
        F.col("effective_us").isNull().alias("undated"),
        (-F.col("effective_us")).alias("by_date"),
        "sku", "provider", "currency", "effective_us", "rates", "tiers",
    )
    return aliases(profiles).groupBy("alias").agg(F.array_sort(F.collect_list(entry)).alias("candidates"))
