"""Document fingerprints: a Merkle tree over paragraphs and sections.

A text is cut, without loss, after every line end and every mark that ends sentences; these paragraphs are the leaves.
A section is a run of paragraphs that ends where a paragraph's own hash says so, about every eighth time, so an
edit moves no section border beyond its neighbourhood.  A paragraph of more than ``LONG`` characters is cut on where a hash
of ``SEEN`` neighbouring characters says so, about every ``PIECE``, and after ``LONG`` characters at the latest.  A section's hash covers its paragraphs' hashes, the root
covers the sections' hashes.  Equal roots mean equal texts; below unequal roots the unequal sections, and in them
the unequal paragraphs, locate the edits (:func:`differing`).

The fingerprint is one string, ``root|sections|paragraphs``: the root's SHA-256 in hex, eight hex digits for each
section, and ``hash.length`` for each paragraph.  Two fingerprints give a likeness without their texts: twice the
characters in shared paragraphs over all characters of both, paragraphs counted with repeats.

Only built-in functions are used.  :func:`edited_pairs` brings each document together with its successor in
doc_id order: documents are dealt to blocks of neighbouring ids at approximate quantiles, the first documents of a
block also go to the block before it, so texts move once and no task holds more than some thousand documents.

Defined cases: a null text is an empty one, whose fingerprint has no section; rows of equal doc_id follow each
other in the order of their texts' hashes; a null doc_id sorts first; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from usagelake.llm.common import table

#: A paragraph: up to a line end or a mark that ends sentences, with the few blanks and marks behind it.
PARAGRAPH = r"[^.!?\n]*+[.!?\n][^\p{L}\p{N}\n]{0,4}\n?|[^.!?\n]++"
#: Characters of a paragraph at most.
LONG = 512
#: A longer one is cut behind characters whose hash, with those before them, is 0 modulo PIECE.
SEEN, PIECE = 6, 64
#: Hex digits of a paragraph's hash in the tree.
DIGITS = 24
#: A section ends after a paragraph whose hash is 0 modulo this.
SECTION = 8
#: Documents of a block of neighbours.
BLOCK = 512
#: Blocks at most; beyond that blocks grow.
MOST_BLOCKS = 10_000


def _hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _let(value: Column, then) -> Column:
    """``then(value)``, the value being worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _cut(paragraph: Column) -> Column:
    """The pieces of an overlong paragraph."""
    def pieces(chars):
        seen = lambda i: F.xxhash64(*[F.get(chars, i - k - 1) for k in range(SEEN)])
        last = F.size(chars)
        borders = F.filter(F.sequence(F.lit(1), last), lambda i: (i == last) | (F.pmod(seen(i), F.lit(PIECE)) == 0))
        before = lambda at, k: F.coalesce(F.get(at, k - 1), F.lit(0))
        return _let(borders, lambda at: F.transform(
            at, lambda end, k: F.array_join(F.slice(chars, before(at, k) + 1, end - before(at, k)), "")
        ))

    whole = _let(F.regexp_extract_all(paragraph, F.lit("(?s)."), F.lit(0)), pieces)
    return F.flatten(F.transform(whole, lambda p: F.regexp_extract_all(p, F.lit(f"(?s).{{1,{LONG}}}"), F.lit(0))))


def _paragraph_texts(text: Column) -> Column:
    def bounded(found):
        cut = F.transform(found, lambda p: F.when(F.length(p) > LONG, _cut(p)).otherwise(F.array(p)))
        return F.when(F.exists(found, lambda p: F.length(p) > LONG), F.flatten(cut)).otherwise(found)

    return _let(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), bounded)


def paragraphs(text: Column) -> Column:
    """``hash.length`` of a text's paragraphs in order; none for an empty text."""
    return F.transform(
        _paragraph_texts(text),
        lambda p: F.concat(F.substring(_hash(p), 1, DIGITS), F.lit("."), F.length(p)),
    )


def sections(leaves: Column) -> Column:
    """array<string> of the sections' hashes.

    The paragraphs are written one after the other, a border after each that ends a section.
    """
    # So many of the sixteen digits that one of SECTION hashes begins with one of them.
    last = F.lit("0123456789abcdef"[: 16 // SECTION])
    marked = F.transform(leaves, lambda x: F.when(F.contains(last, F.substring(x, 1, 1)), F.concat(x, F.lit("/"))).otherwise(x))
    runs = F.filter(F.split(F.array_join(marked, ","), "/,?"), lambda s: s != "")
    return F.transform(runs, _hash)


def fingerprint(leaves: Column, nodes: Column, size: Column) -> Column:
    """The fingerprint of a text from its paragraphs, sections and length."""
    root = _hash(F.concat(size.cast("string"), F.lit("|"), F.array_join(nodes, "")))
    short = F.array_join(F.transform(nodes, lambda n: F.substring(n, 1, 8)), "")
    below = F.transform(leaves, lambda x: F.concat(F.substring(x, 1, 8), F.substring(x, DIGITS + 1, 20)))
    return F.concat_ws("|", root, short, F.array_join(below, ","))


def parsed(print_: Column) -> Column:
    """The paragraphs of a fingerprint, with hashes of eight digits."""
    return F.filter(F.split(F.substring_index(print_, "|", -1), ","), lambda p: p != "")


def length(leaves: Column) -> Column:
    """Characters of paragraphs."""
    return F.aggregate(leaves, F.lit(0).cast("long"), lambda s, x: s + F.substring_index(x, ".", -1).cast("long"))


def numbered(leaves: Column) -> Column:
    """The paragraphs as a set: the second ``x`` of a list is ``2:x``, the third ``3:x``."""
    def runs(ordered):
        n = F.size(ordered)
        firsts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))
        number = lambda x, k: F.when(k == 1, x).otherwise(F.concat(k.cast("string"), F.lit(":"), x))
        return _let(firsts, lambda at: F.flatten(F.transform(at, lambda i, j: F.transform(
            F.sequence(F.lit(1), F.coalesce(F.get(at, j + 1), n) - i), lambda k: number(F.get(ordered, i), k)
        ))))

    return F.when(F.size(F.array_distinct(leaves)) == F.size(leaves), leaves).otherwise(_let(F.sort_array(leaves), runs))


def alike(a: Column, b: Column) -> Column:
    """``likeness`` of numbered lists."""
    both = length(a) + length(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * length(F.array_intersect(a, b)) / both)


def likeness(a: Column, b: Column) -> Column:
    """From 0 to 1: the share of characters that two lists of paragraphs have in common, repeats counted; 1 for two empty ones."""
    return alike(numbered(a), numbered(b))


def _branches(leaves: Column) -> Column:
    """array<struct<hash, section, first, leaves>> of the tree's sections, ``first`` the number of its first paragraph."""
    def cut(hashes):
        n = F.size(leaves)
        last = F.lit("0123456789abcdef"[: 16 // SECTION])
        ends = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | F.contains(last, F.substring(F.get(leaves, i - 1), 1, 1)))
        first = lambda at, j: F.coalesce(F.get(at, j - 1), F.lit(0))
        return _let(ends, lambda at: F.transform(at, lambda end, j: F.struct(
            F.get(hashes, j).alias("hash"), j.alias("section"), first(at, j).alias("first"),
            F.slice(leaves, first(at, j) + 1, end - first(at, j)).alias("leaves"),
        )))

    return F.when(F.size(leaves) > 0, _let(sections(leaves), cut)).otherwise(
        F.array().cast("array<struct<hash: string, section: int, first: int, leaves: array<string>>>")
    )


def _unmatched(a: Column, b: Column) -> Column:
    """Positions in ``a`` of the entries beyond those of ``b``; of equal ones the last.  One sort of both lists."""
    side = lambda x, which: F.transform(x, lambda h, i: F.struct(h.alias("h"), F.lit(which).alias("s"), i.alias("i")))

    def runs(both):
        n = F.size(both)
        changes = lambda i: (i == 0) | (F.get(both, i)["h"] != F.get(both, i - 1)["h"])
        firsts = F.filter(F.sequence(F.lit(0), n - 1), changes)

        def rest(run):
            others = F.size(F.filter(run, lambda x: x["s"] == 1))
            return F.slice(run, others + 1, F.greatest(F.size(run) - 2 * others, F.lit(0)))

        return _let(firsts, lambda at: F.flatten(F.transform(
            at, lambda i, j: _let(F.slice(both, i + 1, F.coalesce(F.get(at, j + 1), n) - i), rest)
        )))

    both = F.sort_array(F.concat(side(a, 0), side(b, 1)))
    return F.when(F.size(a) > 0, F.sort_array(F.transform(_let(both, runs), lambda x: x["i"]))).otherwise(F.array().cast("array<int>"))


def differing(a: Column, b: Column) -> Column:
    """Where the tree over paragraphs ``a`` departs from ``b``'s: array<struct<section, paragraph, leaf>>, numbered from 0.

    From the root down: equal section lists settle all; a section that ``b`` has too, as often, settles its paragraphs;
    only the other sections' paragraphs are compared.  What ``b`` has and ``a`` has not is ``differing(b, a)``.
    A section or paragraph that only moved is no difference.
    """
    def below(here, there):
        odd = lambda x, y: F.transform(_unmatched(x["hash"], y["hash"]), lambda i: F.get(x, i))
        spread = lambda found: F.flatten(F.transform(found, lambda s: F.transform(s["leaves"], lambda leaf, k: F.struct(
            s["section"].alias("section"), (s["first"] + k).alias("paragraph"), leaf.alias("leaf")
        ))))
        mine, other = spread(odd(here, there)), spread(odd(there, here))
        return _let(mine, lambda m: F.transform(_unmatched(m["leaf"], other["leaf"]), lambda i: F.get(m, i)))

    none = F.array().cast("array<struct<section: int, paragraph: int, leaf: string>>")
    return F.when(a == b, none).otherwise(_let(_branches(a), lambda x: _let(_branches(b), lambda y: below(x, y))))


def paragraph_texts(text: Column, found: Column) -> Column:
    """The texts of the paragraphs that :func:`differing` names."""
    return _let(_paragraph_texts(text), lambda all_: F.transform(found, lambda x: F.get(all_, x["paragraph"])))


def edited_pairs(docs: DataFrame) -> DataFrame:
    """(doc_id, text, leaves, next_text, next_leaves): each document with its successor; the last one's is the first."""
    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = docs.select(F.col("doc_id").cast("double").alias("_id"))
    count = docs.count()
    blocks = max(1, min(MOST_BLOCKS, count // BLOCK))
    cuts = sorted(set(ids.approxQuantile("_id", [i / blocks for i in range(1, blocks)], 0.2 / blocks))) if blocks > 1 else []
    edges = [-float("inf"), *cuts, float("inf")]

    def block(df: DataFrame) -> DataFrame:
        df = df.withColumn("_id", F.col("doc_id").cast("double")).withColumn("_block", F.lit(0.0))
        if cuts:
            deal = Bucketizer(splits=edges, inputCol="_id", outputCol="_block", handleInvalid="keep")
            df = deal.transform(df.drop("_block"))
        # A null sorts first: it goes to a block before all others.
        return df.withColumn("_block", F.when(F.col("_id").isNull(), -1).otherwise(F.col("_block").cast("int"))).drop("_id")

    lowest = block(docs.select("doc_id")).groupBy("_block").agg(F.min("doc_id").alias("first"))
    firsts = {r["_block"]: r["first"] for r in lowest.collect()}  # no more than MOST_BLOCKS + 1
    there = sorted(firsts)
    back = {b: there[i - 1] for i, b in enumerate(there)}  # the first block's goes after the last
    dealt = block(slim)
    home = dealt.withColumn("_guest", F.lit(0))
    lead = slim.sparkSession.createDataFrame(
        [(firsts[b], back[b]) for b in there], "_first long, _before int"
    )
    guests = (
        slim.join(F.broadcast(lead), F.col("doc_id").eqNullSafe(F.col("_first")))
        .select("doc_id", "text", F.col("_before").alias("_block"), F.lit(1).alias("_guest"))
    )
    order = Window.partitionBy("_block").orderBy("_guest", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    near = home.unionByName(guests).repartition("_block").withColumn("leaves", paragraphs(F.col("text")))
    after = F.lead(F.struct("text", "leaves")).over(order)
    together = near.withColumn("_next", after).where("_guest = 0")
    return together.select("doc_id", "text", "leaves", F.col("_next.text").alias("next_text"), F.col("_next.leaves").alias("next_leaves"))


def op2_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (n - half).cast("int")), F.substring(F.col("next_text"), F.lit(1), half))
    # Step by step, so that nothing is worked out twice.
    pairs = edited_pairs(table(spark, sf_dir, "documents")).withColumn("edited", edited)
    leaves = pairs.select(
        "doc_id", n.cast("long").alias("n_chars"), F.length("edited").alias("m"), _hash(F.col("edited")).alias("edited_sha256"),
        F.col("leaves").alias("a"), paragraphs(F.col("edited")).alias("b"), F.col("next_leaves").alias("c"),
    )
    nodes = leaves.withColumns({
        "na": sections(F.col("a")), "nb": sections(F.col("b")),
        "da": numbered(F.col("a")), "db": numbered(F.col("b")), "dc": numbered(F.col("c")),
    })
    return nodes.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("a"), F.col("na"), F.col("n_chars")).alias("fingerprint"),
        fingerprint(F.col("b"), F.col("nb"), F.col("m")).alias("edited_fingerprint"),
        alike(F.col("da"), F.col("db")).alias("near_edited"), alike(F.col("da"), F.col("dc")).alias("near_next"),
    )
