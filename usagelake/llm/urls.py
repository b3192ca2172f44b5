"""URL filters: rules for hosts and paths, and a tree of path templates judged by labelled purity.

Every host has a tree of path segments.  Segments of digits, hexadecimal or mixed marks are variable from the
start; of the others a child of a node stays a name if enough of the node's pages have it, else it becomes a
wildcard.  A template is a path through that tree.

A template's purity is its share of good pages among its labelled ones, smoothed towards its parent's estimate,
down from the corpus over the host to the template.  A branch whose share does not differ from its parent's
beyond chance (``Z`` standard errors) is merged with it: it takes the parent's estimate, as all such siblings do.
Templates below ``PURITY`` are rejected.

Pages are first counted by (host, segments), so a hot host costs its distinct paths; all counting is partial
aggregation, level by level, and no host's pages meet in one task.  Levels beyond ``DEPTH`` share one node.

Defined cases: a null url, or one without ``://``, has empty host and path and is judged as the empty host's
root; without labels every estimate is ``PRIOR`` and nothing is rejected; several labels of a page count each;
repeated rows get equal verdicts; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelake.llm.common import keep, table

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
DEPTH = 6
#: A name has at least so many pages and this share of its parent's pages.
NAME_PAGES, NAME_SHARE = 5, 0.01
Z = 2.0
#: Labelled pages that a parent's estimate counts for.
SMOOTH = 10.0
PRIOR = 0.5
PURITY = 0.5


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), upper, upper.lower())
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule in sorted(rules, key=lambda r: (len(r[1]), r[1].find("/"))):
        rule_host, rule_path = rule[: rule.find("/")], rule[rule.find("/") :]
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        name = F.when(fits, F.lit(rule)).otherwise(name)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def segments(path: Column) -> Column:
    """The path's segments, variable ones as marks."""
    def kind(s):
        ext = F.regexp_extract(s, r"(\.[A-Za-z]{1,5})$", 1)
        return (
            F.when(F.regexp_like(s, F.lit(r"^\d+(\.[A-Za-z]{1,5})?$")), F.concat(F.lit("<n>"), ext))
            .when(F.regexp_like(s, F.lit(r"^[0-9a-fA-F-]{8,}(\.[A-Za-z]{1,5})?$")), F.concat(F.lit("<h>"), ext))
            .when(F.regexp_like(s, F.lit(r"\d.*\d.*\d")), F.concat(F.lit("<x>"), ext))
            .otherwise(s)
        )

    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), kind)


def estimates(shapes: DataFrame) -> DataFrame:
    """(host, segs, purity) for rows of (host, segs, pages, labelled, good)."""
    total = shapes.agg(F.sum("labelled"), F.sum("good"), F.max(F.size("segs"))).head()
    if total[0] is None:
        return shapes.select("host", "segs", F.lit(PRIOR).alias("purity"))
    prior = float((total[1] + 2 * PRIOR) / (total[0] + 2))
    depth = min(DEPTH, total[2])

    def judged(nodes: DataFrame) -> DataFrame:
        """Nodes (..., labelled, good, above) with their estimate."""
        p = F.col("above")
        own = (F.col("good") + SMOOTH * p) / (F.col("labelled") + SMOOTH)
        gap = F.abs(F.col("good") - p * F.col("labelled"))
        alike = gap <= Z * F.sqrt(p * (1 - p) * F.col("labelled"))
        return nodes.withColumn("purity", F.when(alike, p).otherwise(own)).drop("labelled", "good", "above")

    sums = [F.sum(c).alias(c) for c in ("labelled", "good")]
    hosts = judged(shapes.groupBy("host").agg(*sums).withColumn("above", F.lit(prior)))
    now = keep(shapes.join(hosts, "host").withColumn("template", F.lit("")))
    for level in range(depth):
        deep = F.size("segs") > level
        seg = F.when(deep, F.lit("**") if level == DEPTH - 1 else F.col("segs")[level])
        rows = now.withColumn("seg", seg)
        # Pages of each name below a node, and of the node.
        names = rows.where(deep).groupBy("host", "template", "seg").agg(F.sum("pages").alias("n"))
        nodes = names.groupBy("host", "template").agg(F.sum("n").alias("of"))
        named = names.join(nodes, ["host", "template"]).select(
            "host", "template", "seg",
            F.when((F.col("n") >= NAME_PAGES) & (F.col("n") >= NAME_SHARE * F.col("of")), F.col("seg"))
            .when(F.startswith("seg", F.lit("<")), F.col("seg")).otherwise("*").alias("child"),
        )
        rows = rows.join(named, ["host", "template", "seg"], "left").withColumn(
            "next", F.when(F.col("child").isNotNull(), F.concat("template", F.lit("/"), F.col("child"))).otherwise(F.col("template"))
        )
        branches = rows.where("child is not null").groupBy("host", "next").agg(*sums, F.max("purity").alias("above"))
        branches = judged(branches).withColumnRenamed("purity", "below")
        now = keep(
            rows.join(branches, ["host", "next"], "left")
            .withColumn("purity", F.when(F.col("child").isNotNull(), F.col("below")).otherwise(F.col("purity")))
            .select("host", "segs", "pages", "labelled", "good", "purity", F.col("next").alias("template"))
        )
    return now.select("host", "segs", "template", "purity")


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]] = RULES, id_column: str = "page_id") -> DataFrame:
    """One row a page: its id, host, path, rule, verdict, template, purity; ``labels`` has (page_url, good)."""
    host, path = split_url(F.col("url"))
    parts = pages.select(F.col(id_column), "url", host.alias("host"), path.alias("path"))
    rows = parts.withColumn("segs", segments(F.col("path")))
    known = labels.groupBy("page_url").agg(F.count("good").alias("labelled"), F.sum("good").alias("good"))
    urls = rows.groupBy("url", "host", "segs").agg(F.count("*").alias("pages"))
    told = urls.join(known, urls["url"] == known["page_url"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)) * F.col("pages")
    shapes = keep(told.groupBy("host", "segs").agg(
        F.sum("pages").alias("pages"), F.sum(zero("labelled")).alias("labelled"), F.sum(zero("good")).alias("good")
    ))
    purity = estimates(shapes)
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    learnt = F.when(F.col("purity") < PURITY, F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(purity, ["host", "segs"]).select(
        id_column, "host", "path", rule.alias("rule"), F.coalesce(verdict, learnt).alias("verdict"),
        *(c for c in ("template", "purity") if c in purity.columns),
    )


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_url, good): the labels of the document whose number ends a page's path; good is fine and not toxic."""
    _, path = split_url(F.col("url"))
    number = F.regexp_extract(path, r"(\d{1,18})(?:\.[A-Za-z]+)?/?$", 1)
    of = pages.select(F.col("url").alias("page_url"), F.when(number != "", number.cast("long")).alias("_doc")).where("_doc is not null").distinct()
    good = ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")
    return of.join(labels.select(F.col("doc_id").alias("_doc"), good.alias("good")), "_doc").select("page_url", "good")


def op6_path_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    got = judge(pages, page_labels(pages, table(spark, sf_dir, "labels")))
    return got.select("page_id", "host", "path", "rule", "verdict")
