"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

1. One Python pass turns every whole text into ``STATISTICS``: shares, lengths and entropies of words, lines and
   characters, as integers of 1/1024.  Texts go no further.
2. Standardised statistics are mapped to ``FEATURES`` random Fourier features ``cos(w.x + b)``, whose inner product
   approximates a Gaussian kernel; ``w`` and ``b`` are drawn from a fixed seed.
3. Each partition of the labelled rows sums its normal equations, one set for each kernel width and fold.  Features
   are integers of 1/4096, so the sums are exact: they come out the same however rows are dealt and added.
   Sums meet by row of the matrix, and the driver gets matrices whose size depends on ``FEATURES`` alone.
4. The driver solves ridge regressions on those matrices.  The width and the penalty are those of least squared error
   on left-out folds, which the left-out fold's own sums give without another pass.
5. Each labelled row is scored by the model of the other folds; scores are counted in ``BINS`` bins and calibrated by
   isotonic regression (adjacent violators pooled), straight lines between the pools.
6. Every row's statistics are scored with the model of all folds.

All labelled rows that are not held out are used; nothing is sampled.

Defined cases: a null or empty text has statistics 0 but is scored like others; a null doc_id takes part in no
training and is held out or not by the empty text's remainder; a document whose labels differ, or whose label is
null, has none; repeated rows each count in training and get equal scores; without any label all scores are 0.5,
and with labels of one kind all scores are that label; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelake.llm.common import keep, table
from usagelake.llm.hashing import WordHashes, windows

cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATISTICS = (
    "words", "characters", "word_length", "word_spread", "longest_word", "letters", "digits", "capitals", "symbols",
    "marks", "exclaims", "bars", "distinct", "commonest", "stutter", "repeated_three", "repeated_eight", "lines",
    "words_a_line", "repeated_lines", "short_lines", "open_lines", "wordless", "marked_words", "shouted_words",
    "character_entropy", "word_entropy", "worst_symbols", "worst_shouted", "worst_bars", "worst_stutter",
)
#: Statistics are whole numbers of 1 / UNIT, features of 1 / GRAIN.
UNIT, GRAIN = 1024, 4096
FEATURES = 192
FOLDS = 4
#: Kernel widths, times the root of the number of statistics, and penalties, times the number of rows.
WIDTHS = (0.5, 1.0, 2.0)
PENALTIES = (1e-6, 1e-5, 1e-4, 1e-3)
SEED = 11
#: Scores from -1 to 2 are calibrated in so many steps.
BINS = 6144
THRESHOLD = 0.7
#: Words of the stretches of which the worst one counts: a text may be junk in part.
STRETCH = 64

_LETTER, _CAPITAL, _DIGIT, _SYMBOL, _MARK, _EXCLAIM, _BAR = 1, 2, 3, 4, 5, 6, 7
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(ord("a"), ord("z") + 1), *range(128, 256)]] = _LETTER
_KIND[ord("A") : ord("Z") + 1] = _CAPITAL
_KIND[ord("0") : ord("9") + 1] = _DIGIT
_KIND[list(b"#*$%&<>=~^_\\{}[]@+/")] = _SYMBOL
_KIND[list(b".,;:?")] = _MARK
_KIND[ord("!")] = _EXCLAIM
_KIND[ord("|")] = _BAR

_BLANK = np.zeros(256, bool)
_BLANK[[*range(9, 14), 32]] = True
_END = re.compile(rb"[.!?:;\"')\]]\s*$")


def _entropy(counts: np.ndarray) -> float:
    """Bits a unit."""
    p = counts[counts > 0] / counts.sum()
    return float(-(p * np.log2(p)).sum())


def _repeated(hashes: np.ndarray, n: int) -> float:
    """Share of the windows of ``n`` words that occur before."""
    found = windows(hashes, n)
    return 1 - len(np.unique(found)) / len(found) if len(found) else 0.0


def _worst(flags: np.ndarray) -> float:
    """The largest share of flagged words in any stretch of STRETCH words (of all words, if fewer)."""
    n = min(STRETCH, len(flags))
    ends = np.concatenate([[0], np.cumsum(flags)])
    return float((ends[n:] - ends[:-n]).max() / n)


def statistics(text: str, known: WordHashes) -> np.ndarray:
    """STATISTICS of a whole text as integers of 1 / UNIT."""
    raw = text.encode()
    words = raw.split()
    out = dict.fromkeys(STATISTICS, 0.0)
    if words:
        codes = np.frombuffer(raw, np.uint8)
        own = codes[~_BLANK[codes]]
        kinds = np.bincount(_KIND[own], minlength=8)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        kind = _KIND[own]
        letters = np.add.reduceat((kind == _LETTER) | (kind == _CAPITAL), starts, dtype=np.int64)
        capitals = np.add.reduceat(kind == _CAPITAL, starts, dtype=np.int64)
        small = np.add.reduceat((kind == _LETTER) & (own < 128), starts, dtype=np.int64)
        marks = np.add.reduceat((kind == _SYMBOL) | (kind == _EXCLAIM), starts, dtype=np.int64)
        hashes = known.of(words)
        same = np.concatenate([[False], hashes[1:] == hashes[:-1]])
        shouted, bars = (capitals > 1) & (small == 0), (lengths == 1) & (own[starts] == ord("|"))
        times = np.array(list(Counter(words).values()))
        lines = [x for x in raw.split(b"\n") if x.strip()]
        sizes = np.array([len(x.split()) for x in lines])
        n, chars = len(words), len(own)
        out = {
            "words": np.log1p(n), "characters": np.log1p(chars), "word_length": lengths.mean(),
            "word_spread": lengths.std(), "longest_word": np.log1p(lengths.max()),
            "letters": (kinds[_LETTER] + kinds[_CAPITAL]) / chars, "digits": kinds[_DIGIT] / chars,
            "capitals": kinds[_CAPITAL] / chars, "symbols": kinds[_SYMBOL] / chars, "marks": kinds[_MARK] / n,
            "exclaims": kinds[_EXCLAIM] / n, "bars": kinds[_BAR] / n, "distinct": len(times) / n,
            "commonest": times.max() / n, "stutter": same.mean(), "repeated_three": _repeated(hashes, 3),
            "repeated_eight": _repeated(hashes, 8), "lines": np.log1p(len(lines)), "words_a_line": np.log1p(n / len(lines)),
            "repeated_lines": 1 - len(set(lines)) / len(lines), "short_lines": (sizes < 4).mean(),
            "open_lines": sum(not _END.search(x) for x in lines) / len(lines), "wordless": (letters == 0).mean(),
            "marked_words": (marks > 1).mean(), "shouted_words": shouted.mean(),
            "character_entropy": _entropy(np.bincount(own)), "word_entropy": _entropy(times) / np.log2(n + 1),
            "worst_symbols": _worst(marks > 1), "worst_shouted": _worst(shouted), "worst_bars": _worst(bars),
            "worst_stutter": _worst(same),
        }
    return np.rint(np.array([out[name] for name in STATISTICS]) * UNIT).astype(np.int64)


def _measure(batches: Iterable) -> Iterator:
    import pyarrow as pa

    known = WordHashes()
    for batch in batches:
        rows = [statistics(t or "", known) for t in batch.column("text").to_pylist()]
        others = [n for n in batch.schema.names if n != "text"]
        flat = np.concatenate(rows) if rows else np.empty(0, np.int64)
        at = np.arange(len(rows) + 1, dtype=np.int32) * len(STATISTICS)
        lists = pa.ListArray.from_arrays(pa.array(at), pa.array(flat.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([*map(batch.column, others), lists], names=[*others, "stats"])


def measure(docs: DataFrame, fold: Column) -> DataFrame:
    """(_id, _row, fold, stats) of every row: one pass over the texts.  ``fold`` is null where a row may not train."""
    slim = docs.select(F.col("doc_id").alias("_id"), fold.alias("fold"), "text")
    kind = slim.schema["_id"].dataType.simpleString()
    return slim.mapInArrow(_measure, f"_id {kind}, fold int, stats array<int>")


# ------------------------------------------------------------------ features and sums

@dataclass
class Scale:
    """Mean and inverse spread of each statistic; a statistic that never varies counts nothing."""

    mean: np.ndarray
    inverse: np.ndarray


def directions(width: float, features: int = FEATURES) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    w = rng.standard_normal((len(STATISTICS), features)) / (width * np.sqrt(len(STATISTICS)))
    return w, rng.uniform(0, 2 * np.pi, features)


def features(stats: np.ndarray, scale: Scale, width: float, count: int = FEATURES) -> np.ndarray:
    """One row of whole numbers of 1 / GRAIN each, the last one a constant."""
    # Far outliers would turn the cosines at random.
    x = np.clip((stats - scale.mean) * scale.inverse, -8, 8)
    w, b = directions(width, count)
    out = np.empty((len(stats), count + 1))
    out[:, :-1] = np.rint(np.cos(x @ w + b) * GRAIN)
    out[:, -1] = GRAIN
    return out


def _matrix(batch) -> np.ndarray:
    lists = batch.column("stats")
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), len(STATISTICS)).astype(float)


def _sums(batches: Iterable, scale: Scale, count: int) -> Iterator:
    """(slot, line, values): a line of the normal equations of one width and fold, its label sum last."""
    import pyarrow as pa

    size = count + 1
    held = np.zeros((len(WIDTHS) * FOLDS, size, size + 1), np.int64)
    for batch in batches:
        stats, fold = _matrix(batch), batch.column("fold").to_numpy()
        y = batch.column("label").to_numpy()
        for k, width in enumerate(WIDTHS):
            # At most 10,000 rows of whole numbers below 2**13: products and their sums are exact in doubles.
            z = features(stats, scale, width, count)
            for f in range(FOLDS):
                own = z[fold == f]
                held[k * FOLDS + f] += np.rint(own.T @ np.column_stack([own, y[fold == f] * GRAIN])).astype(np.int64)
    for slot in np.flatnonzero(held.any((1, 2))):
        values = pa.ListArray.from_arrays(pa.array(np.arange(size + 1, dtype=np.int32) * (size + 1)), pa.array(held[slot].ravel()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(size, slot, np.int32)), pa.array(np.arange(size, dtype=np.int32)), values],
            names=["slot", "line", "sums"],
        )


def _added(batches: Iterable) -> Iterator:
    """Lines of equal (slot, line) added: at most all lines of all matrices are held."""
    import pyarrow as pa

    held: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        lists = batch.column("sums")
        values = lists.flatten().to_numpy().reshape(len(lists), -1) if len(lists) else ()
        for slot, line, row in zip(batch.column("slot").to_pylist(), batch.column("line").to_pylist(), values):
            key = slot, line
            held[key] = held[key] + row if key in held else row.copy()
    if held:
        keys = list(held)
        arrays = [pa.array([k[i] for k in keys], pa.int32()) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array([held[k].tolist() for k in keys])], names=["slot", "line", "sums"])


def normal_equations(rows: DataFrame, scale: Scale, count: int = FEATURES) -> np.ndarray:
    """Sums by [width, fold, line, column], the label's in the last column; whole numbers in units of GRAIN squared."""
    fields = "slot int, line int, sums array<long>"
    parts = rows.select("fold", "label", "stats").mapInArrow(lambda b: _sums(b, scale, count), fields)
    added = parts.repartition("slot", "line").mapInArrow(_added, fields)
    out = np.zeros((len(WIDTHS) * FOLDS, count + 1, count + 2))
    for r in added.collect():  # as many rows as all matrices have lines
        out[r["slot"], r["line"]] = r["sums"]
    return out.reshape(len(WIDTHS), FOLDS, count + 1, count + 2) / GRAIN**2


# ------------------------------------------------------------------------------- model

@dataclass
class Model:
    """``fold_weights`` have a row for each fold: the model of the other folds.  ``edges``, ``values``: calibration."""

    scale: Scale
    width: float
    weights: np.ndarray
    fold_weights: np.ndarray
    edges: np.ndarray
    values: np.ndarray

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return features(stats, self.scale, self.width, len(self.weights) - 1) @ self.weights / GRAIN

    def scores(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.edges, self.values), 0, 1)


def _solved(sums: np.ndarray, penalty: float) -> np.ndarray:
    """Ridge weights; the constant is not shrunk.  The last diagonal element is the number of rows."""
    a, b = sums[:, :-1], sums[:, -1]
    shrink = np.full(len(b), penalty * max(a[-1, -1], 1.0))
    shrink[-1] = 1e-9
    return np.linalg.solve(a + np.diag(shrink), b)


def _error(sums: np.ndarray, w: np.ndarray) -> float:
    """Sum of squared errors, less what does not depend on the weights."""
    return float(w @ sums[:, :-1] @ w - 2 * w @ sums[:, -1])


def fitted(sums: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Width, weights of all rows, and the weights without each fold: the best by left-out error."""
    best = None
    for width, by_fold in zip(WIDTHS, sums):
        whole = by_fold.sum(0)
        for penalty in PENALTIES:
            without = np.array([_solved(whole - own, penalty) for own in by_fold])
            error = sum(map(_error, by_fold, without))
            if best is None or error < best[0]:
                best = error, width, _solved(whole, penalty), without
    return best[1:]


def pooled(bins: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of (bin, rows, ones): places and values of the pools, for straight lines between them."""
    pools: list[list[float]] = []  # first bin, last bin, rows, ones
    for at, rows, ones in sorted(bins):
        pools.append([at, at, rows, ones])
        while len(pools) > 1 and pools[-2][3] * pools[-1][2] >= pools[-1][3] * pools[-2][2]:
            _, last, rows_, ones_ = pools.pop()
            pools[-1][1], pools[-1][2], pools[-1][3] = last, pools[-1][2] + rows_, pools[-1][3] + ones_
    edges, values = [], []
    for first, last, rows, ones in pools:
        # A pool is flat between its own first and last bin.
        for at in dict.fromkeys((first, last)):
            edges.append((at + 0.5) * 3 / BINS - 1)
            values.append(ones / rows)
    return np.array(edges), np.array(values)


def bin_of(raw: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((raw + 1) * BINS / 3), 0, BINS - 1).astype(np.int32)


def _left_out(batches: Iterable, scale: Scale, width: float, weights: np.ndarray) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        z = features(_matrix(batch), scale, width, weights.shape[1] - 1)
        raw = (z * weights[batch.column("fold").to_numpy()]).sum(1) / GRAIN
        yield pa.RecordBatch.from_arrays([pa.array(bin_of(raw)), batch.column("label")], names=["bin", "label"])


def scaled(rows: DataFrame) -> Scale | None:
    """Mean and spread from exact sums of whole numbers; None without rows."""
    each = [F.col("stats")[i].cast("long") for i in range(len(STATISTICS))]
    got = rows.agg(F.count("*"), *[F.sum(x) for x in each], *[F.sum(x * x) for x in each]).head()
    if not got[0]:
        return None
    one, two = (np.array(got[1 + k : 1 + k + len(each)], float) / got[0] for k in (0, len(each)))
    spread = np.sqrt(np.maximum(two - one * one, 0))
    return Scale(one, np.where(spread > 0.5, 1 / np.maximum(spread, 0.5), 0.0))


def train(rows: DataFrame, count: int = FEATURES) -> Model | None:
    """A model of rows with stats, label (0 or 1) and fold; None without rows."""
    scale = scaled(rows)
    if scale is None:
        return None
    width, weights, without = fitted(normal_equations(rows, scale, count))
    # At most BINS rows come to the driver.
    bins = rows.select("fold", "label", "stats").mapInArrow(
        lambda b: _left_out(b, scale, width, without), "bin int, label int"
    ).groupBy("bin").agg(F.count("*"), F.sum("label")).collect()
    edges, values = pooled([tuple(r) for r in bins])
    return Model(scale, width, weights, without, edges, values)


def _score(batches: Iterable, model: Model | None) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        got = model.scores(_matrix(batch)) if model is not None else np.full(batch.num_rows, 0.5)
        yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(got)], names=["_id", "score"])


def agreed(labels: DataFrame, label: str) -> DataFrame:
    """(_id, label), one row for each id whose labels are all the same 0 or 1."""
    ok = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(
        F.min(label).alias("label"), F.max(label).alias("_most"), F.count_if(F.col(label).isNull()).alias("_none"))
    return ok.where((F.col("label") == F.col("_most")) & (F.col("_none") == 0) & F.col("label").isin(0, 1)).select(
        "_id", F.col("label").cast("int").alias("label"))


def classify(docs: DataFrame, labels: DataFrame, label: str, trains: Column, count: int = FEATURES) -> DataFrame:
    """(doc_id, score) of every row of ``docs``; only rows for which ``trains`` holds lend their labels."""
    fold = F.when(trains & F.col("doc_id").isNotNull(), F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(FOLDS)).cast("int"))
    rows = keep(measure(docs, fold))
    known = keep(rows.where("fold IS NOT NULL").join(agreed(labels, label), "_id").select("fold", "label", "stats"))
    model = train(known, count)
    kind = rows.schema["_id"].dataType.simpleString()
    scored = rows.select("_id", "stats").mapInArrow(lambda b: _score(b, model), f"_id {kind}, score double")
    return scored.withColumnRenamed("_id", "doc_id")


def held_out(id_column: str = "doc_id") -> Column:
    text = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(4)) == 2


def op11_fourier_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality", ~held_out())
    return got.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
