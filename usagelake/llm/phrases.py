"""Phrase collocations by vertical partitioning of the suffixes of all texts.

Texts are cut into pieces and words; a suffix starts at a word and is read to depth 3 or to the end of its piece.
The suffix tree of a whole corpus fits nowhere, so it is built in parts, as ERA does:

1. Words are counted (the tree's first level).  A word that occurs more often than a task may hold suffixes (BUDGET)
   is a prefix too large for one subtree: its prefixes are extended by a word and counted in another pass, and where
   that is still too large, by the third word, which makes it a leaf.
2. Prefixes are filed by hash in buckets, and neighbouring buckets are put together into groups of at most BUDGET
   occurrences (one bucket may be more, where a prefix alone is).
3. Every task sends its suffixes to their prefix's group, equal ones of a stretch of texts together with their count:
   one row for a stretch and group, its words once and the suffixes as word numbers.
4. Each group's subtree is built on its own, from the sorted suffixes; a leaf's total is its occurrences, a node's
   total those of the leaves below.  Nodes with too few occurrences go no further.
5. The totals of parts of phrases are joined back to the phrases; all arithmetic is exact.

A phrase that occurs ``least`` times has words that do.  Words below that end a suffix; a table of bits, whose size
is fixed, says which words may be kept.  It never drops a frequent one, and rare ones that it keeps fall out later.

Heavy prefixes are at most all words / BUDGET, buckets at most 2**MOST_BITS: only these reach the driver, besides the bits.

Defined cases: a null text has no words; a null lang is ``und``; repeated rows count each; a text without words adds
nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from usagelake.llm.common import keep, table
from usagelake.llm.hashing import BASE, WordHashes, mixed

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Occurrences of suffixes that one task holds at a time, and the part of all words that it does at most: no task
#: gets more than its share of the work, however small the corpus.
BUDGET = 500_000
SHARES = 200
#: Bytes of text that are counted together before they are sent.
STRETCH = 8_000_000
LEAST_BITS, MOST_BITS = 10, 20
#: The table of frequent words has 2**FILTER_BITS bits.
FILTER_BITS = 25
#: Bits of a row of the table while it is gathered.
PAGE = 32_768

LEAST = 10
INSIDE_PERCENT = 50
TOP = 2000
UNIT = 1_000_000
#: Parts in which a language is ranked first.
PARTS = 64

_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_CODES = bytes(10 if b in _ENDS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))

COUNTS = "lang string, word string, h long, n long"
PAIRS = "lang string, first string, second string, h long, n long"
#: Suffixes of a row, so that 16 bits number their words; words stand one on a line.
ROW = 10_000
SUFFIXES = "grp int, split boolean, lang string, words string, a array<smallint>, b array<smallint>, c array<smallint>, n array<int>"
NODES = "lang string, w1 string, w2 string, w3 string, n long"


@dataclass
class Stretch:
    """Words of some texts of one language in order, as numbers of ``words``; ``piece`` tells pieces apart."""

    words: object
    hashes: np.ndarray
    at: np.ndarray
    piece: np.ndarray


def words_of(raw: bytes, lang: str, known: WordHashes) -> Stretch:
    """``raw`` is texts with a line end between them."""
    import pyarrow as pa

    codes = np.frombuffer(raw.translate(_CODES), np.uint8)
    inside = (codes != 10) & (codes != 32)
    turns = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    starts, ends = turns[::2], turns[1::2]
    breaks = np.flatnonzero(codes == 10)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    array = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(codes[inside])])
    coded = array.dictionary_encode()
    words = coded.dictionary
    hashes = mixed(known.of(words.to_pylist()) ^ np.uint64(known[b"\n" + lang.encode()]))
    return Stretch(words.cast(pa.large_string()), hashes, coded.indices.to_numpy().astype(np.int64), np.searchsorted(breaks, starts))


def _stretches(batches: Iterable) -> Iterator[tuple[str, Stretch]]:
    """(lang, words) of stretches of about STRETCH bytes of whole texts."""
    known = WordHashes()
    held: dict[str, list[bytes]] = {}
    size = 0

    def drained():
        for lang, texts in held.items():
            yield lang, words_of(b"\n".join(texts), lang, known)
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            if text.is_valid:
                raw = text.as_buffer().to_pybytes()
                held.setdefault(lang, []).append(raw)
                size += len(raw) + 1
                if size > STRETCH:
                    yield from drained()
                    size = 0
    yield from drained()


def _longs(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _count(batches: Iterable) -> Iterator:
    import pyarrow as pa

    for lang, got in _stretches(batches):
        if len(got.at):
            n = np.bincount(got.at, minlength=len(got.words))
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(n)), got.words.cast(pa.string()), pa.array(_longs(got.hashes)), pa.array(n)],
                names=["lang", "word", "h", "n"])


@dataclass
class Plan:
    """What tasks know of the prefixes: bits of frequent words, heavy prefixes' hashes, and buckets' groups."""

    bits: np.ndarray
    heavy: np.ndarray
    heavy_pairs: np.ndarray
    groups: np.ndarray

    def frequent(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & np.uint64(2**FILTER_BITS - 1)
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0

    def group(self, hashes: np.ndarray) -> np.ndarray:
        return self.groups[hashes & np.uint64(len(self.groups) - 1)]


def _pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(first * np.uint64(BASE) + second)


def _next(got: Stretch, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers (first, second, third or -1) of the suffixes whose first two words may be frequent."""
    at, piece = got.at, got.piece
    fine = ok[at]
    start = np.flatnonzero((piece[:-1] == piece[1:]) & fine[:-1] & fine[1:]) if len(at) > 1 else np.empty(0, np.int64)
    third = np.full(len(start), -1, np.int64)
    more = np.flatnonzero(start + 2 < len(at))
    more = more[(piece[start[more] + 2] == piece[start[more]]) & fine[start[more] + 2]]
    third[more] = at[start[more] + 2]
    return at[start], at[start + 1], third


def _count_pairs(batches: Iterable, plan: Plan) -> Iterator:
    """Prefixes of two words whose first is heavy."""
    import pyarrow as pa

    for lang, got in _stretches(batches):
        a, b, _ = _next(got, plan.frequent(got.hashes))
        own = np.isin(got.hashes, plan.heavy)[a]
        key, n = np.unique(a[own] * len(got.words) + b[own], return_counts=True)
        if len(key):
            a, b = np.divmod(key, len(got.words))
            words = got.words.cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(n)), words.take(pa.array(a)), words.take(pa.array(b)),
                 pa.array(_longs(_pair_hash(got.hashes[a], got.hashes[b]))), pa.array(n)],
                names=["lang", "first", "second", "h", "n"])


def _suffixes(batches: Iterable, plan: Plan) -> Iterator:
    """One row for each stretch and group: the distinct suffixes and how often each occurs."""
    import pyarrow as pa

    for lang, got in _stretches(batches):
        a, b, c = _next(got, plan.frequent(got.hashes))
        if not len(a):
            continue
        size = len(got.words)
        pairs, of = np.unique(a * size + b, return_inverse=True)
        leaves, n = np.unique(of * (size + 1) + c + 1, return_counts=True)
        of, c = np.divmod(leaves, size + 1)
        c -= 1
        first, second = np.divmod(pairs, size)
        h = _pair_hash(got.hashes[first], got.hashes[second])
        group = plan.group(np.where(np.isin(got.hashes, plan.heavy)[first], h, got.hashes[first]))[of]
        split = np.isin(h, plan.heavy_pairs)[of]
        if split.any():
            third = np.where(c[split] >= 0, got.hashes[c[split]], np.uint64(0))
            group[split] = plan.group(_pair_hash(h[of[split]], third))
        a, b = first[of], second[of]
        # The suffixes are in order; sorting by group keeps it inside a group.
        order = np.argsort(group * 2 + split, kind="stable")
        a, b, c, n, group, split = (x[order] for x in (a, b, c, n, group, split))
        edges = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (split[1:] != split[:-1])]))
        edges = [y for x, z in zip(edges, [*edges[1:], len(a)]) for y in range(x, z, ROW)]
        spelled = np.array(got.words.to_pylist(), object)
        rows: list[tuple] = []
        for x, y in zip(edges, [*edges[1:], len(a)]):
            used, number = np.unique(np.concatenate([a[x:y], b[x:y], c[x:y]]), return_inverse=True)
            none = int(used[0] == -1)
            number = (number - none).astype(np.int16).reshape(3, -1)
            rows.append((group[x], split[x], "\n".join(spelled[used[none:]]), *number, n[x:y]))
        kinds = [pa.int32(), pa.bool_(), pa.string(), *[pa.list_(pa.int16())] * 3, pa.list_(pa.int32())]
        arrays = [pa.array(list(x), k) for x, k in zip(zip(*rows), kinds)]
        arrays.insert(2, pa.array([lang] * len(rows)))
        yield pa.RecordBatch.from_arrays(arrays, names=["grp", "split", "lang", "words", "a", "b", "c", "n"])


class Subtree:
    """The suffixes of one group and language, to depth 3: sorted leaves with totals."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = self.kept = 0

    def add(self, words: list[str], suffixes: np.ndarray, n: np.ndarray) -> None:
        """``suffixes`` has lines a, b, c: numbers of ``words``, c may be -1."""
        number = self.number
        to = np.array([number.setdefault(w, len(number)) for w in words] + [-1], np.int32)
        self.parts.append((*to[suffixes], n))
        self.held += len(n)

    def leaves(self) -> tuple[np.ndarray, ...]:
        """a, b, c, total of the leaves in order; equal suffixes become one leaf."""
        a, b, c, n = map(np.concatenate, zip(*self.parts))
        self.parts.clear()
        order = np.lexsort((c, b, a))
        a, b, c, n = a[order], b[order], c[order], n[order]
        new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])]))
        self.parts.append((a[new], b[new], c[new], np.add.reduceat(n, new)))
        self.held = self.kept = len(new)
        return self.parts[0]

    def nodes(self, least: int, partial: bool) -> Iterator[tuple[np.ndarray, ...]]:
        """(a, b, c or -1, total) of the nodes of two and three words; ``partial`` totals of two words go on whatever they are."""
        a, b, c, n = self.leaves()
        new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        total = np.add.reduceat(n, new)
        some = (total >= least) | partial
        yield a[new][some], b[new][some], np.full(some.sum(), -1), total[some]
        some = (c >= 0) & (n >= least)
        yield a[some], b[some], c[some], n[some]


def _built(batches: Iterable, least: int) -> Iterator:
    """A partition sorted by group: each group's subtrees one after the other."""
    import pyarrow as pa

    now, held = None, {}

    def drained():
        for (lang, split), tree in held.items():
            words = pa.array(list(tree.number), pa.string())
            for a, b, c, n in tree.nodes(least, split):
                if len(a):
                    w3 = words.take(pa.array(np.where(c < 0, None, c), pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(a)), words.take(pa.array(a)), words.take(pa.array(b)), w3, pa.array(n)],
                        names=["lang", "w1", "w2", "w3", "n"])
        held.clear()

    for batch in batches:
        columns = {n: batch.column(n) for n in batch.schema.names}
        for k in range(batch.num_rows):
            group = columns["grp"][k].as_py()
            if group != now:
                yield from drained()
                now = group
            tree = held.setdefault((columns["lang"][k].as_py(), columns["split"][k].as_py()), Subtree())
            *lines, n = (columns[x][k].values.to_numpy() for x in "abcn")
            tree.add(columns["words"][k].as_py().split("\n"), np.vstack(lines), n.astype(np.int64))
            if tree.held > BUDGET + tree.kept:
                tree.leaves()
    yield from drained()


# -------------------------------------------------------------------------- the prefixes

def _bits(counts: DataFrame) -> np.ndarray:
    """Bits of the words of ``counts``: at most 2**FILTER_BITS / PAGE rows come to the driver."""
    at = F.pmod("h", F.lit(2**FILTER_BITS))
    pages = counts.groupBy(F.call_function("div", at, F.lit(PAGE)).alias("page")).agg(
        F.bitmap_construct_agg(F.pmod(at, F.lit(PAGE))).alias("bits"))
    out = np.zeros(2**FILTER_BITS // 8, np.uint8)
    for r in pages.toLocalIterator():
        out[r["page"] * PAGE // 8 :][: PAGE // 8] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def _hashes(rows: DataFrame) -> np.ndarray:
    return np.sort(np.array([r[0] for r in rows.select("h").collect()], np.int64).view(np.uint64))


def _grouped(prefixes: DataFrame, buckets: int, budget: int) -> np.ndarray:
    """The group of each bucket: neighbours are put together while they fit."""
    sizes = prefixes.groupBy(F.pmod("h", F.lit(buckets)).alias("k")).agg(F.sum("n").alias("n")).collect()
    weight = np.zeros(buckets, np.int64)
    for r in sizes:
        weight[r["k"]] = r["n"]
    group, now, room = np.zeros(buckets, np.int32), 0, budget
    for k, w in enumerate(weight.tolist()):
        if w > room and room < budget:
            now, room = now + 1, budget
        group[k] = now
        room -= w
    return group


def counted(docs: DataFrame, least: int = LEAST, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """((lang, word, n) of all words, (lang, w1, w2, w3, n) of the phrases of two or three words found ``least`` times)."""
    slim = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    words = keep(slim.mapInArrow(_count, COUNTS).groupBy("lang", "word").agg(F.first("h").alias("h"), F.sum("n").alias("n")))
    frequent = words.where(F.col("n") >= least)
    budget = max(1, min(budget, (frequent.agg(F.sum("n")).head()[0] or 0) // SHARES))
    none = np.empty(0, np.uint64)
    plan = Plan(_bits(frequent), _hashes(frequent.where(F.col("n") > budget)), none, none)
    prefixes = frequent.where(F.col("n") <= budget).select("h", "n")
    if len(plan.heavy):
        pairs = keep(slim.mapInArrow(lambda b: _count_pairs(b, plan), PAIRS).groupBy("lang", "first", "second").agg(
            F.first("h").alias("h"), F.sum("n").alias("n")))
        plan.heavy_pairs = _hashes(pairs.where(F.col("n") > budget))
        prefixes = prefixes.unionByName(pairs.select("h", "n"))
    total = prefixes.agg(F.sum("n")).head()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * total // budget).bit_length()))
    plan.groups = _grouped(prefixes, 1 << bits, budget)
    suffixes = slim.mapInArrow(lambda b: _suffixes(b, plan), SUFFIXES)
    nodes = suffixes.repartition("grp").sortWithinPartitions("grp").mapInArrow(lambda b: _built(b, least), NODES)
    found = nodes.groupBy("lang", "w1", "w2", "w3").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return words.select("lang", "word", "n"), keep(found)


# --------------------------------------------------------------------------- the scores

def _score(a: Column, left: Column, right: Column) -> Column:
    wide = [x.cast("decimal(19,0)") for x in (a, left, right)]
    return F.call_function("div", wide[0] * wide[0] * F.lit(UNIT), wide[1] * wide[2])


def collocations(
    docs: DataFrame, least: int = LEAST, inside_percent: int = INSIDE_PERCENT, top: int = TOP, budget: int = BUDGET
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first ``top`` phrases."""
    words, phrases = counted(docs, least, budget)
    known = words.where(F.col("n") >= least)

    def single(word: str, name: str) -> DataFrame:
        return known.select("lang", F.col("word").alias(word), F.col("n").alias(name))

    pairs = phrases.where("w3 IS NULL").select("lang", "w1", "w2", F.col("n").alias("a"))
    triples = phrases.where("w3 IS NOT NULL").select("lang", "w1", "w2", "w3", F.col("n").alias("a"))
    ends = triples.select("lang", "w1", "w2", "a").unionByName(
        triples.select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
    longer = ends.groupBy("lang", "w1", "w2").agg(F.max("a").alias("_longer"))
    two = pairs.join(longer, ["lang", "w1", "w2"], "left").where(
        F.col("_longer").isNull() | (100 * F.col("_longer") < inside_percent * F.col("a"))
    ).join(single("w1", "l"), ["lang", "w1"]).join(single("w2", "r"), ["lang", "w2"]).select(
        "lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", _score(F.col("a"), F.col("l"), F.col("r")).alias("score"))
    head = pairs.withColumnRenamed("a", "_l2")
    tail = pairs.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("_r1"))
    cut = triples.join(head, ["lang", "w1", "w2"]).join(tail, ["lang", "w2", "w3"]).join(
        single("w1", "_l1"), ["lang", "w1"]).join(single("w3", "_r2"), ["lang", "w3"])
    cut = cut.withColumns({"_s1": _score(F.col("a"), F.col("_l1"), F.col("_r1")), "_s2": _score(F.col("a"), F.col("_l2"), F.col("_r2"))})
    later = F.col("_s2") < F.col("_s1")
    three = cut.select(
        "lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.when(later, F.col("_l2")).otherwise(F.col("_l1")).alias("l"),
        F.when(later, F.col("_r2")).otherwise(F.col("_r1")).alias("r"), F.least("_s1", "_s2").alias("score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = two.unionByName(three).withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    some = part.withColumn("_k", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_k") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_suffix_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), listed AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), placed AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM listed
), counts AS (
  SELECT lang, w[i] AS w1, NULL AS w2, NULL AS w3, count(*) AS f FROM placed GROUP BY ALL
  UNION ALL
  SELECT lang, w[i], w[i + 1], NULL, count(*) FROM placed WHERE i < len(w) GROUP BY ALL
  UNION ALL
  SELECT lang, w[i], w[i + 1], w[i + 2], count(*) FROM placed WHERE i + 1 < len(w) GROUP BY ALL
), one AS (SELECT lang, w1, f FROM counts WHERE w2 IS NULL),
two AS (SELECT lang, w1, w2, f FROM counts WHERE w2 IS NOT NULL AND w3 IS NULL AND f >= 10),
three AS (SELECT lang, w1, w2, w3, f FROM counts WHERE w3 IS NOT NULL AND f >= 10),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM one GROUP BY lang),
cuts AS (
  SELECT t.lang, t.w1 || ' ' || t.w2 AS phrase, t.f AS a, x.f AS l, y.f AS r, 1 AS k
  FROM two t JOIN one x ON x.lang = t.lang AND x.w1 = t.w1 JOIN one y ON y.lang = t.lang AND y.w1 = t.w2
  WHERE NOT EXISTS (SELECT 1 FROM three h WHERE h.lang = t.lang AND 100 * h.f >= 50 * t.f
    AND h.w1 = t.w1 AND h.w2 = t.w2)
  AND NOT EXISTS (SELECT 1 FROM three h WHERE h.lang = t.lang AND 100 * h.f >= 50 * t.f
    AND h.w2 = t.w1 AND h.w3 = t.w2)
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, x.f, y.f, 1
  FROM three t JOIN one x ON x.lang = t.lang AND x.w1 = t.w1 JOIN two y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, x.f, y.f, 2
  FROM three t JOIN two x ON x.lang = t.lang AND x.w1 = t.w1 AND x.w2 = t.w2 JOIN one y ON y.lang = t.lang AND y.w1 = t.w3
), scored AS (
  SELECT *, (1000000::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM cuts
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM scored s JOIN totals USING (lang)
QUALIFY rank <= 2000
"""
