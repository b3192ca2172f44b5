"""Scores of a class-based bigram model in the manner of Brown, with classes by exchange clustering.

    log10 P(text) = sum over tokens of log10 P(class | class before) + log10 P(token | its class)

1. Words of the training documents are counted in tasks and then by hash over the corpus; all words count.
2. Every word has a symbol: the ``CLUSTERED`` most frequent words have their own, the others share one with all words
   of a like ending.  Classes are learnt for symbols, so each word, also one never seen, has a class.
3. Exchange clustering: a pass over the corpus sums, for each symbol, how often each class stands before and
   after it; then each symbol in turn is taken out of its class and put where the likelihood of the class bigrams
   is greatest.  Passes see the classes of the pass before, so they run over any number of tasks.  What a pass
   sends to the driver has a fixed size: symbols times classes.
4. Transitions are smoothed towards the classes' own probabilities, emissions by ``DELTA`` for each word of a class
   and one unknown.

Counts of the ``LOOKED_UP`` most frequent words are broadcast; those of the others are joined, by (document, word).

Defined cases: a null or empty text is its end token alone; a null doc_id counts as empty text in the choice of
training documents; repeated rows get equal scores; without training documents all counts are 0; an empty table
gives an empty result.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelake.llm.common import keep, table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CLASSES = 64
PASSES = 6
CLUSTERED = 8192
ENDINGS = 1024
LOOKED_UP = 1 << 18
#: Symbols: clustered words, endings, and the end of a text, which also stands before each text.
END = CLUSTERED + ENDINGS
SYMBOLS = END + 1
BLOCK = 64
DELTA = 0.5
#: Weight of a class's own probability among its transitions.
BACKOFF = 16.0
#: Words that a task holds at a time.
HELD = 500_000


def ending(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % ENDINGS


def _count(batches: Iterable) -> Iterator:
    import pyarrow as pa
    import xxhash
    from collections import Counter

    counts: Counter = Counter()

    def made():
        words = list(counts)
        out = pa.RecordBatch.from_arrays(
            [pa.array([xxhash.xxh3_64_intdigest(w) - 2**63 for w in words], pa.int64()),
             pa.array([ending(w) for w in words], pa.int32()), pa.array(list(counts.values()), pa.int64())],
            names=["h", "ending", "n"],
        )
        counts.clear()
        return out

    for batch in batches:
        for text in batch.column("text").to_pylist():
            counts.update((text or "").encode().lower().split())
            if len(counts) > HELD:
                yield made()
    yield made()


class _Seen(dict):
    """Numbers of the words that a task has met, with what it needs to know of each."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, symbols: np.ndarray):
        self.hashes, self.known, self.symbols = hashes, counts, symbols
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.columns = np.empty((1024, 3), np.int64)  # hash, symbol, count or -1; grows in place

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word) - 2**63
        at = int(np.searchsorted(self.hashes, h)) if len(self.hashes) else 0
        symbol, count = -1, -1
        if at < len(self.hashes) and self.hashes[at] == h:
            symbol, count = int(self.symbols[at]), int(self.known[at])
        got = len(self)
        if got == len(self.columns):
            self.columns = np.concatenate([self.columns, np.empty_like(self.columns)])
        self.columns[got] = h, symbol if symbol >= 0 else CLUSTERED + ending(word), count
        self[word] = got
        return got

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > HELD:
            self.reset()
        ids = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.columns[ids]


def _symbols(batches: Iterable, lookup) -> Iterator:
    """Per text: its symbols, sums over looked-up words, and the other words with their numbers."""
    import pyarrow as pa

    seen = None
    for batch in batches:
        seen = seen or _Seen(*lookup.value)
        texts = batch.column("text").to_pylist()
        packed, sizes, base, own, known, rare, number, counts = [], [], [], [], [], [], [], []
        for text in texts:
            got = seen.of((text or "").encode().lower().split())
            packed.append(zlib.compress(got[:, 1].astype("<u2").tobytes(), 1))
            sizes.append(len(got))
            there = got[:, 2] >= 0
            c = got[there, 2]
            base.append(float(np.log10(c + 1.0).sum()))
            own.append(float(np.log10(c + DELTA).sum()))
            known.append(int(np.count_nonzero(c)))
            h, n = np.unique(got[~there, 0], return_counts=True)
            rare.append(h)
            number.append(n)
            counts.append(len(h))
        inner = pa.StructArray.from_arrays(
            [pa.array(np.concatenate(rare or [[]]).astype(np.int64)), pa.array(np.concatenate(number or [[]]).astype(np.int64))],
            names=["h", "n"],
        )
        offsets = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays(
            [batch.column(n) for n in names]
            + [pa.array(packed, pa.binary()), pa.array(sizes, pa.int64()), pa.array(base, pa.float64()),
               pa.array(own, pa.float64()), pa.array(known, pa.int64()), pa.ListArray.from_arrays(offsets, inner)],
            names=[*names, "symbols", "n", "base", "own", "known", "rare"],
        )


def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), "<u2").astype(np.int64)


def _contexts(batches: Iterable, classes) -> Iterator:
    """For each symbol the numbers of each class before and after it, in blocks of symbols."""
    import pyarrow as pa

    kind = classes.value
    size = -(-SYMBOLS // BLOCK) * BLOCK
    total = np.zeros((2, size * CLASSES), np.int64)
    for batch in batches:
        parts = [np.array([END])]
        for packed in batch.column("symbols").to_pylist():
            parts += [_unpacked(packed), [END]]
        line = np.concatenate(parts).astype(np.int64)
        before, after = line[:-1], line[1:]
        total[0] += np.bincount(after * CLASSES + kind[before], minlength=size * CLASSES)
        total[1] += np.bincount(before * CLASSES + kind[after], minlength=size * CLASSES)
    blocks = total.reshape(2, size // BLOCK, BLOCK * CLASSES).transpose(1, 0, 2)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.arange(len(blocks), dtype=np.int32)),
         pa.array([zlib.compress(b.astype("<i8").tobytes(), 1) for b in blocks], pa.binary())], names=["block", "counts"],
    )


def _summed(batches: Iterable) -> Iterator:
    import pyarrow as pa

    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
            got = np.frombuffer(zlib.decompress(counts), "<i8")
            total[block] = total[block] + got if block in total else got.copy()
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int32()), pa.array([zlib.compress(t.tobytes(), 1) for t in total.values()], pa.binary())],
        names=["block", "counts"],
    )


def contexts(texts: DataFrame, kind: np.ndarray) -> np.ndarray:
    """(2, symbols, classes): the classes before and after each symbol, over all rows of ``texts``."""
    sent = texts.sparkSession.sparkContext.broadcast(kind)
    shape = "block int, counts binary"
    parts = texts.select("symbols").mapInArrow(lambda b: _contexts(b, sent), shape)
    rows = parts.repartition("block").mapInArrow(_summed, shape).collect()  # symbols times classes, always
    out = np.zeros((-(-SYMBOLS // BLOCK), 2, BLOCK, CLASSES), np.int64)
    for r in rows:
        out[r["block"]] = np.frombuffer(zlib.decompress(r["counts"]), "<i8").reshape(2, BLOCK, CLASSES)
    return out.transpose(1, 0, 2, 3).reshape(2, -1, CLASSES)[:, :SYMBOLS]


def exchange(kind: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """One turn of exchanges: each symbol goes to the class where sum N log N - 2 sum N(class) log N(class) is greatest."""
    def f(x):
        return x * np.log(np.maximum(x, 1.0))

    left, right = seen[0].astype(float), seen[1].astype(float)
    pairs = np.zeros((CLASSES, CLASSES))  # [before, after]
    np.add.at(pairs.T, kind, left)
    sizes = pairs.sum(axis=0)
    mass = left.sum(axis=1)
    kind = kind.copy()
    for s in np.argsort(-mass, kind="stable"):
        if s == END or not mass[s]:
            continue
        a, n = kind[s], mass[s]
        pairs[:, a] -= left[s]
        pairs[a, :] -= right[s]
        np.maximum(pairs, 0.0, out=pairs)
        sizes[a] -= n
        gain = (f(pairs + left[s][:, None]) - f(pairs)).sum(axis=0) + (f(pairs + right[s][None, :]) - f(pairs)).sum(axis=1)
        own = np.diag(pairs)  # a class's own cell gets both sides at once
        gain += f(own + left[s] + right[s]) - f(own + left[s]) - f(own + right[s]) + f(own)
        gain -= 2 * (f(sizes + n) - f(sizes))
        gain[kind[END]] = -np.inf  # the end keeps a class of its own
        b = int(np.argmax(gain))
        kind[s] = b
        pairs[:, b] += left[s]
        pairs[b, :] += right[s]
        sizes[b] += n
    return kind


def _scored(batches: Iterable, model) -> Iterator:
    import pyarrow as pa

    kind, step, weight = model.value
    for batch in batches:
        out = []
        for packed in batch.column("symbols").to_pylist():
            line = kind[np.r_[END, _unpacked(packed), END]]
            out.append(float(step[line[:-1], line[1:]].sum() + weight[line[1:-1]].sum()))
        names = [n for n in batch.schema.names if n != "symbols"]
        yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(out, pa.float64())], names=[*names, "path"])


def most_frequent(counts: DataFrame, most: int = LOOKED_UP):
    """The most frequent words (h, c) in order, as pandas: down to a count above which there are at most ``most``.

    The count is found in a histogram over logarithms, so no task sees the words of all others.
    """
    bucket = F.floor(F.log2("c") * 32)
    histogram = sorted(counts.groupBy(bucket.alias("b")).count().collect(), reverse=True)  # at most 2016 rows
    least, total = None, 0
    for b, n in histogram:
        total += n
        if total > most:
            break
        least = b
    rows = counts.where(bucket >= least) if least is not None else counts.where("false")
    return rows.select("h", "c").toPandas().sort_values(["c", "h"], ascending=[False, True], ignore_index=True)


def score(docs: DataFrame, id_column: str = "doc_id", passes: int = PASSES) -> DataFrame:
    """One row a document: its id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    out = F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2
    slim = docs.select(F.col(id_column).alias("_id"), out.alias("held_out"), "text")
    kind_of_id = slim.schema["_id"].dataType.simpleString()
    counted = slim.where(~F.col("held_out")).select("text").mapInArrow(_count, "h long, ending int, n long")
    counts = keep(counted.groupBy("h").agg(F.sum("n").alias("c"), F.first("ending").alias("ending")))
    ends = slim.where(~F.col("held_out")).count()
    words, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).head()
    tokens, types = words + ends, types + (ends > 0)
    top = most_frequent(counts)
    symbols = np.where(np.arange(len(top)) < CLUSTERED, np.arange(len(top)), -1)
    order = np.argsort(top["h"].to_numpy(np.int64), kind="stable")
    lookup = tuple(x[order] for x in (top["h"].to_numpy(np.int64), top["c"].to_numpy(np.int64), symbols))
    sent = spark.sparkContext.broadcast(lookup)
    rows = keep(
        slim.mapInArrow(
            lambda b: _symbols(b, sent),
            f"_id {kind_of_id}, held_out boolean, symbols binary, n long, base double, own double, known long, "
            "rare array<struct<h: long, n: long>>",
        ).withColumn("_row", F.monotonically_increasing_id())
    )
    training = rows.where(~F.col("held_out"))
    kind = np.arange(SYMBOLS) % (CLASSES - 1)
    kind[END] = CLASSES - 1
    for _ in range(passes):
        kind = exchange(kind, contexts(training, kind))
    seen = contexts(training, kind)
    pairs = np.zeros((CLASSES, CLASSES))
    np.add.at(pairs.T, kind, seen[0].astype(float))
    sizes = pairs.sum(axis=0)
    prior = (sizes + 1.0) / (sizes.sum() + CLASSES)
    step = np.log10((pairs + BACKOFF * prior) / (pairs.sum(axis=1, keepdims=True) + BACKOFF))
    # Distinct words of each class: a clustered word is one, an ending has those that are not clustered.
    others = counts
    if len(top):
        last = top.iloc[min(len(top), CLUSTERED) - 1]
        c, h = F.lit(int(last["c"])), F.lit(int(last["h"]))
        others = counts.where((F.col("c") < c) | ((F.col("c") == c) & (F.col("h") > h)))
    distinct = np.zeros(CLASSES)
    np.add.at(distinct, kind[: min(len(top), CLUSTERED)], 1)
    for r in others.groupBy("ending").count().collect():  # one row an ending
        distinct[kind[CLUSTERED + r["ending"]]] += r["count"]
    weight = -np.log10(sizes + DELTA * (distinct + 1))
    model = spark.sparkContext.broadcast((kind, step, weight))
    paths = rows.select("_row", "_id", "held_out", "n", "base", "own", "known", "symbols").mapInArrow(
        lambda b: _scored(b, model),
        f"_row long, _id {kind_of_id}, held_out boolean, n long, base double, own double, known long, path double",
    )
    rare = rows.select("_row", F.explode("rare").alias("r")).select("_row", "r.h", "r.n").join(counts.select("h", "c"), "h", "left")
    count = F.coalesce("c", F.lit(0))
    rare = rare.groupBy("_row").agg(
        F.sum(F.col("n") * F.log10(count + 1.0)).alias("_base"), F.sum(F.col("n") * F.log10(count + DELTA)).alias("_own"),
        F.sum(F.when(count > 0, F.col("n")).otherwise(0)).alias("_known"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    base = F.col("base") + zero("_base") + F.log10(F.lit(ends + 1.0)) - (F.col("n") + 1) * F.log10(F.lit(float(tokens + types + 1)))
    return paths.join(rare, "_row", "left").select(
        F.col("_id").alias(id_column), "held_out", (F.col("n") + 1).alias("n_tokens"),
        (F.col("known") + zero("_known") + F.lit(int(ends > 0))).cast("long").alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"), base.alias("base_score"),
        (F.col("path") + F.col("own") + zero("_own")).alias("score"),
    )


def op10_brown_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
