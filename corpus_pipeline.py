"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

quality rules -> n-gram Jaccard join -> substring dedup -> mixing -> packing.  A stage judges all rows that its
predecessor kept.  All but the last return the columns of ``documents``, in their order:

* ``quality``: documents that the rules reject go; from the texts of the others the lines above the limits go, and
  ``n_chars`` follows.
* ``near_duplicates``: of each class of near copies the document of least id stays, once.
* ``substrings``: windows of 13 words that a document of smaller id has go out of the text; ``n_chars`` follows.
  A document may become empty; it stays.
* ``mixing``: a document comes as often as its source's rate says, 0 to 3 times.
* ``packing``: one row a piece of a training sequence.

Rows are told apart by doc_id and the text's hash; a null doc_id is an id like others.  Further columns are carried
along, whatever their names.  An empty table gives an empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelake.llm import automata, jaccard, mixing, packing, quality
from usagelake.llm.common import keep, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.cleaned(docs).withColumn("n_chars", F.length("text").cast("long")).select(*[f"`{c}`" for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    first = jaccard.representatives(docs)
    low = F.lit(-(2**63)).cast("long")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = docs.select(F.coalesce("doc_id", low).alias("_d"), F.xxhash64("text").alias("_t"), whole.alias("row"))
    kept = first.select(F.coalesce("doc_id", low).alias("_d"), F.col("text_hash").alias("_t"))
    # Repeated rows of a representative: one stays.
    return rows.join(kept, ["_d", "_t"], "left_semi").dropDuplicates(["_d", "_t"]).select("row.*")


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    got = automata.dedup(docs, texts=True)
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return got.select(*(new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    low = F.lit(-(2**63)).cast("long")
    keys = [F.coalesce("doc_id", low).alias("_d"), F.xxhash64("text").alias("_t")]
    dealt = mixing.mix(docs.select(*keys, "source", "text"), ["_d", "_t"])
    copies = dealt.groupBy("_d", "_t").agg(F.sum("copies").alias("copies")).where("copies > 0")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(*keys, whole).join(copies, ["_d", "_t"]).dropDuplicates(["_d", "_t"])
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality", quality_rules),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: Word shingles, MinHash and copies by a fold are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir))
    return docs
