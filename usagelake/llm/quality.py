"""Quality rules with cross-document line frequency.

Base rules look at one document: too few words, or too many words in repeated eight-word windows.  The method
looks across documents: lines are normalised and hashed, and each line's distinct documents are counted per
host.  Lines above the limits are boilerplate of that host; a document that they deplete is rejected.

The limits of a line of a host: more than ``min_documents`` distinct documents, and more than ``share`` of the
host's distinct documents.  Exact copies of a text are one document (told apart by a 64-bit hash); documents of one
template each count, however little of their own they have.

One Python pass turns texts into counts and line hashes, written once.  Counting goes by (host, line, document)
and then (host, line), both with partial aggregation, so neither a hot host nor a hot line meets in one task.

Defined cases: a null or empty text has no words and fails the base rules; a null host is a host of its own;
repeated rows get equal verdicts; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelake.llm.common import keep, table
from usagelake.llm.hashing import WordHashes, windows

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MIN_WORDS = 20
WINDOW = 8
REPEATED_PERCENT = 30
#: A line is boilerplate of a host above both limits.
MIN_DOCUMENTS = 10
SHARE = 0.05
#: A document is depleted if boilerplate lines hold more than this share of its words, or leave fewer than MIN_WORDS.
DEPLETED = 0.5

SYMBOLS = "#*$%&|<>"
MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "lines array<long>, line_words array<int>"
)
_NUMBER = re.compile(rb"[0-9]+")


def normal(words: list[bytes]) -> bytes:
    """A line's words in small letters, one blank between them, every number as 0."""
    return _NUMBER.sub(b"0", b" ".join(words).lower())


def repeated_words(hashes: np.ndarray, n: int = WINDOW) -> int:
    """Words in windows of ``n`` words that occur twice or more."""
    found = windows(hashes, n)
    if len(found) < 2:
        return 0
    ordered = np.sort(found)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(found, twice))
    edges = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + n, -1)
    return int(np.count_nonzero(np.cumsum(edges)[:-1]))


def measured(text: str, known: WordHashes) -> tuple:
    import xxhash

    raw = text.encode()
    words: list[bytes] = []
    seen: set[bytes] = set()
    lines, line_words, repeats = [], [], 0
    for line in raw.split(b"\n"):
        own = line.split()
        if own:
            repeats += line in seen
            seen.add(line)
            words += own
            lines.append(xxhash.xxh3_64_intdigest(normal(own)) - 2**63)
            line_words.append(len(own))
    hashes = known.of(words)
    spaces = len(raw) - sum(map(len, words))
    return (
        len(words), len(text) - spaces, sum(map(text.count, SYMBOLS)), repeats, repeated_words(hashes), lines, line_words,
    )


def _measure(batches: Iterable) -> Iterator:
    import pyarrow as pa

    known = WordHashes()
    types = [pa.int64()] * 5 + [pa.list_(pa.int64()), pa.list_(pa.int32())]
    names = [part.split()[0] for part in MEASURES.split(", ")]
    for batch in batches:
        rows = [measured(t or "", known) for t in batch.column("text").to_pylist()]
        others = [n for n in batch.schema.names if n != "text"]
        columns = zip(*rows) if rows else [[]] * len(names)
        arrays = [batch.column(n) for n in others] + [pa.array(c, t) for c, t in zip(columns, types)]
        yield pa.RecordBatch.from_arrays(arrays, names=others + names)


def measure(docs: DataFrame, keys: Sequence[str], host: str) -> DataFrame:
    """``keys``, ``_host``, ``_text``, the base counts, and the lines' hashes and words."""
    slim = docs.select(*keys, F.col(host).alias("_host"), F.xxhash64("text").alias("_text"), "text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name != "text")
    return slim.mapInArrow(_measure, f"{fields}, {MEASURES}")


def boilerplate(rows: DataFrame, min_documents: int = MIN_DOCUMENTS, share: float = SHARE) -> DataFrame:
    """(_host, _line, documents) of the lines above the limits, from rows of ``measure``."""
    texts = rows.where("n_words > 0").groupBy("_host", "_text").agg(F.lit(1).alias("one"))
    hosts = texts.groupBy("_host").agg(F.count("*").alias("of"))
    seen = rows.select("_host", "_text", F.explode(F.array_distinct("lines")).alias("_line"))
    per_text = seen.groupBy("_host", "_line", "_text").agg(F.lit(1).alias("one"))
    counts = per_text.groupBy("_host", "_line").agg(F.count("*").alias("documents"))
    many = counts.where(F.col("documents") > min_documents).alias("c")
    return many.join(hosts.alias("h"), F.expr("c._host <=> h._host")).where(
        F.col("documents") > share * F.col("of")
    ).select("c._host", "_line", "documents")


def judge(
    docs: DataFrame, keys: Sequence[str] = ("doc_id",), host: str = "source",
    min_documents: int = MIN_DOCUMENTS, share: float = SHARE, lines: bool = False,
) -> DataFrame:
    """One row a document: ``keys``, the counts, n_boilerplate_words, base_failed, kept.

    With ``lines`` also ``boilerplate``, the hashes of its own lines that are above the limits (null if none).
    """
    rows = keep(measure(docs, keys, host).withColumn("_row", F.monotonically_increasing_id()))
    bad = keep(boilerplate(rows, min_documents, share)).alias("b")
    each = rows.select("_row", "_host", F.explode(F.arrays_zip("lines", "line_words")).alias("l"))
    each = each.select("_row", "_host", F.col("l.lines").alias("_line"), F.col("l.line_words").alias("_n")).alias("l")
    hit = each.join(bad, F.expr("l._host <=> b._host and l._line = b._line"), "left_semi")
    # A document's own flagged lines are no more than its lines.
    own = [F.collect_set("_line").alias("boilerplate")] if lines else []
    lost = hit.groupBy("_row").agg(F.sum("_n").alias("n_boilerplate_words"), *own)
    lost_words = F.coalesce("n_boilerplate_words", F.lit(0)).cast("long")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    left = F.col("n_words") - F.col("n_boilerplate_words")
    depleted = (left < MIN_WORDS) | (F.col("n_boilerplate_words") > DEPLETED * F.col("n_words"))
    return (
        rows.drop("lines", "line_words", "_text", "_host")
        .join(lost, "_row", "left")
        .withColumn("n_boilerplate_words", lost_words)
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & ~depleted)
        .drop("_row")
    )


def _without(batches: Iterable) -> Iterator:
    import pyarrow as pa
    import xxhash

    def one(text: str | None, lines: list[int] | None) -> str | None:
        if text is None or not lines:
            return text
        gone = set(lines)
        kept = (x for x in text.split("\n") if not (own := x.encode().split()) or xxhash.xxh3_64_intdigest(normal(own)) - 2**63 not in gone)
        return "\n".join(kept)

    for batch in batches:
        names = [n for n in batch.schema.names if n != "_boilerplate"]
        pairs = zip(batch.column("text").to_pylist(), batch.column("_boilerplate").to_pylist())
        new = pa.array([one(*x) for x in pairs], batch.schema.field("text").type)
        yield pa.RecordBatch.from_arrays([new if n == "text" else batch.column(n) for n in names], names=names)


def without_lines(docs: DataFrame, column: str) -> DataFrame:
    """``docs`` less ``column``, the lines whose hashes it lists taken out of ``text``; nothing else changes."""
    rest = docs.drop(column)
    return docs.withColumnRenamed(column, "_boilerplate").select(*[f"`{c}`" for c in rest.columns], "_boilerplate").mapInArrow(_without, rest.schema)


def _same(left: str, right: str, *columns: str) -> Column:
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"{left}.`{c}`").eqNullSafe(F.col(f"{right}.`_k_{c}`"))
    return same


def cleaned(
    docs: DataFrame, keys: Sequence[str] = ("doc_id",), host: str = "source",
    min_documents: int = MIN_DOCUMENTS, share: float = SHARE,
) -> DataFrame:
    """The rows of ``docs`` that are kept, without the lines above the limits in their texts; other columns as they are.

    Rows are told apart by ``keys``, ``host`` and the text's hash; rows alike in these get one verdict.
    """
    by = list(dict.fromkeys([*keys, host]))
    slim = docs.select(*by, "text", F.xxhash64("text").alias("_t"))
    judged = judge(slim, [*by, "_t"], host, min_documents, share, lines=True).where("kept")
    verdict = judged.groupBy(*[F.col(c).alias(f"_k_{c}") for c in [*by, "_t"]]).agg(F.first("boilerplate").alias("_gone")).alias("k")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *by, F.xxhash64("text").alias("_t")).alias("d")
    kept = own.join(verdict, _same("d", "k", *by, "_t")).select("row.*", F.col("_gone").alias("_boilerplate"))
    return without_lines(kept, "_boilerplate")


def op5_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_boilerplate_words",
    )
