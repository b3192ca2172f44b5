"""Hard negatives for contrastive training: angular triangle filtering before integer scores.

Vectors are whole numbers; the score of two rows is their inner product.  An anchor's positives are its best other
rows of the same label; a positive's negatives are the best rows of other labels whose score lies in a window given
by the positive's.  Anchors are a stated set, searched against all rows, in blocks.

1. Rows get the angle to each of ``REFERENCES`` reference directions (rows of least id hash) and are ordered by
   their nearest one and the angle to it.  Range partitions of that order become blocks: one record of arrays each,
   with the least and largest angle to every reference.  A common vector fills blocks of its own.
2. A block's anchors go out in groups, with what their own block says of the last of their best positives: a floor.
3. For an anchor at angle a and rows at angles t1 to t2 to the same reference, the triangle inequality bounds the
   angle between anchor and rows; the cosines of the bounds, over all references, times the norms and widened by
   more than any rounding, bound the scores.  A group goes only to runs of blocks whose bounds overlap what it needs.
4. Blocks meet their groups in a sorted partition: one block is held while its groups stream by.  Inside, tiles of
   rows are bounded in the same way, and only the anchors whose window overlaps a tile's get integer scores there.
5. The best of the blocks' best are taken with a rank filter.  Positives come first; their windows are the second
   pass, which finds the negatives.

Bounds only skip rows that cannot be in a result, so results are exact.  Block and group sizes change the split only.
A task holds one block (BLOCK rows at most), one group and one tile of scores.

Defined cases: rows with a null label or a null, infinite or not-a-number component, or a null vector take no part;
a null id is no anchor and comes last among ties; repeated rows are rows of their own, so one may be its copy's
positive; vectors of different length have no score; an empty vector scores 0; an empty table gives an empty result.
Scores past 64 bits raise.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from usagelake.llm.common import keep, table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

REFERENCES = 16
#: Rows of a block: the 64th part of all rows, between these.
SMALL_BLOCK, BLOCK = 4096, 262_144
GROUP = 1024
TILE = 512
#: Runs of blocks whose bounds are sent to all tasks.
RUNS = 4096
#: Rows of a block are known by block number and place.
PLACES = 1 << 20
PENDING = 200_000
#: More than any rounding error of angles, cosines and norms, as a share of the product of norms.
SLACK = 1e-5

POSITIVES, NEGATIVES, ANCHOR_STEP = 5, 10, 100
SCALE = 256
#: A negative's score in percent of the positive's.
LEAST, MOST = 30, 90

ROW = "id long, unnamed boolean, label long, vec array<long>"
ARRAYS = "ids array<long>, unnamed array<boolean>, labels array<long>, dim int, vectors array<long>, angles array<double>, norms array<double>"
SIDE = f"block long, grp long, {ARRAYS}, places array<long>, floors array<long>, windows array<long>, positives array<long>, unnamed_positives array<boolean>"
NONE = -(2**63)


def rows_of(frame: DataFrame, vec_id: str, label: Column, vector: Column) -> DataFrame:
    """Rows that take part, as ROW; ``vector`` is an array of whole doubles or null."""
    got = frame.select(F.col(vec_id).cast("long").alias("id"), F.col(vec_id).isNull().alias("unnamed"),
                       label.cast("long").alias("label"), vector.alias("vec"))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return got.where(F.col("label").isNotNull() & F.col("vec").isNotNull() & fine).select(
        F.coalesce("id", F.lit(2**63 - 1)).alias("id"), "unnamed", "label", F.col("vec").cast("array<long>").alias("vec"))


# ------------------------------------------------------------------------------ blocks

def _angles(vectors: np.ndarray, norms: np.ndarray, references: np.ndarray | None) -> np.ndarray:
    """Angle of each row to each reference; without references or norm a right angle, which bounds nothing wrongly."""
    out = np.full((len(vectors), REFERENCES), np.pi / 2)
    if references is not None and len(references):
        dots = vectors.astype(float) @ references.T
        cosines = np.clip(dots / np.maximum(norms, 1)[:, None], -1, 1)
        out[:, : len(references)] = np.where(norms[:, None] > 0, np.arccos(cosines), np.pi / 2)
    return out


def _matrix(vectors: list, dim: int) -> np.ndarray:
    return np.array(vectors, np.int64).reshape(len(vectors), dim)


def _placed(batches: Iterable, references: dict[int, np.ndarray]) -> Iterator:
    """Rows with their nearest reference and the angle to it."""
    import pyarrow as pa

    for batch in batches:
        vectors = batch.column("vec").to_pylist()
        cell, near = np.zeros(len(vectors), np.int32), np.zeros(len(vectors))
        sizes = np.array([len(v) for v in vectors])
        for dim in np.unique(sizes):
            own = np.flatnonzero(sizes == dim)
            m = _matrix([vectors[i] for i in own], dim)
            angles = _angles(m, np.sqrt((m.astype(float) ** 2).sum(1)), references.get(int(dim)))
            cell[own], near[own] = angles.argmin(1), angles.min(1)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(sizes.astype(np.int32)), pa.array(cell), pa.array(near)],
            names=[*batch.schema.names, "dim", "cell", "near"],
        )


@dataclass
class Rows:
    """Rows of one block or group as arrays; ``floors`` and later belong to anchors only."""

    ids: np.ndarray
    unnamed: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    angles: np.ndarray
    norms: np.ndarray
    places: np.ndarray

    @staticmethod
    def of(columns: dict) -> Rows:
        n = len(columns["ids"])
        return Rows(
            np.array(columns["ids"], np.int64), np.array(columns["unnamed"], bool), np.array(columns["labels"], np.int64),
            np.array(columns["vectors"], np.int64).reshape(n, columns["dim"]),
            np.array(columns["angles"], float).reshape(n, REFERENCES), np.array(columns["norms"], float),
            np.array(columns["places"], np.int64),
        )

    def take(self, which) -> Rows:
        return Rows(*(getattr(self, f)[which] for f in ("ids", "unnamed", "labels", "vectors", "angles", "norms", "places")))

    def record(self, block: int, group: int | None, **more) -> dict:
        return {
            "block": block, "grp": group, "ids": self.ids, "unnamed": self.unnamed, "labels": self.labels,
            "dim": self.vectors.shape[1], "vectors": self.vectors.ravel(), "angles": self.angles.ravel(),
            "norms": self.norms, "places": self.places, "floors": None, "windows": None, "positives": None,
            "unnamed_positives": None,
        } | more


def _batch(records: list[dict]):
    import pyarrow as pa

    kinds = {"boolean": pa.bool_(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    arrays, names = [], []
    for field in SIDE.split(", "):
        name, kind = field.split()
        of = pa.list_(kinds[kind[6:-1]]) if kind.startswith("array") else kinds[kind]
        arrays.append(pa.array([r[name] for r in records], of))
        names.append(name)
    return pa.RecordBatch.from_arrays(arrays, names=names)


def _blocked(batches: Iterable, references: dict[int, np.ndarray], size: int) -> Iterator:
    """A sorted partition as block records of at most ``size`` rows of one length of vector."""
    from pyspark import TaskContext

    part, made = TaskContext.get().partitionId(), 0
    held: dict[str, list] = {"ids": [], "unnamed": [], "labels": [], "vectors": []}
    dim = None

    def record():
        m = _matrix(held["vectors"], dim)
        norms = np.sqrt((m.astype(float) ** 2).sum(1))
        block = part * 4096 + made
        rows = Rows(np.array(held["ids"]), np.array(held["unnamed"]), np.array(held["labels"]), m,
                    _angles(m, norms, references.get(dim)), norms, block * PLACES + np.arange(len(m)))
        return _batch([rows.record(block, None)])

    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("id", "unnamed", "label", "vec", "dim")]
        for i, u, l, v, d in zip(*columns):
            if dim is not None and (d != dim or len(held["ids"]) >= size):
                yield record()
                made += 1
                held = {k: [] for k in held}
            dim = d
            for k, x in zip(held, (i, u, l, v)):
                held[k].append(x)
    if held["ids"]:
        yield record()


def _records(batches: Iterable) -> Iterator[dict]:
    """One record at a time, lists as numpy arrays."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield {
                n: (None if not batch.column(n)[k].is_valid else batch.column(n)[k].values.to_numpy(zero_copy_only=False))
                if n not in ("block", "grp", "dim") else batch.column(n)[k].as_py()
                for n in batch.schema.names
            }


# ------------------------------------------------------------------------------ bounds

def bounds(a_angles, a_norms, low, high, least_norm, most_norm) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the scores of anchors (lines) with rows at angles low..high to each reference, of such norms."""
    near = np.maximum(0, np.maximum(low - a_angles, a_angles - high)).max(1)
    far = np.minimum(np.pi, np.minimum(a_angles + high, 2 * np.pi - a_angles - low)).min(1)
    best, worst = np.cos(np.minimum(near, np.pi)), np.cos(np.maximum(far, 0))
    up = a_norms * np.where(best >= 0, most_norm, least_norm) * best
    down = a_norms * np.where(worst >= 0, least_norm, most_norm) * worst
    slack = a_norms * most_norm * SLACK + 1
    return down - slack, up + slack


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where no sum can pass 2**53, else in Python's whole numbers."""
    most = (int(np.abs(a).max(initial=0)) + 1) * (int(np.abs(b).max(initial=0)) + 1) * max(a.shape[1], 1)
    if most < 2**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return (a.astype(object) @ b.astype(object).T).astype(np.int64)


class Best:
    """The first ``n`` (score, id) of each key among those offered so far."""

    def __init__(self, keys: int, n: int) -> None:
        self.n, self.floor = n, np.full(keys, NONE, np.int64)
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def offer(self, key, score, ids, unnamed, place) -> None:
        self.parts.append((key, score, ids, unnamed, place))
        self.waiting += len(key)
        if self.waiting > PENDING or len(self.parts) == 1:
            self.settle()

    def settle(self) -> tuple[np.ndarray, ...]:
        empty = np.empty(0, np.int64)
        if not self.parts:
            return empty, empty, empty, np.empty(0, bool), empty
        key, score, ids, unnamed, place = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((place, ids, unnamed, -score, key))
        key = key[order]
        first = np.searchsorted(key, key)
        rank = np.arange(len(key)) - first
        chosen = order[rank < self.n]
        last = rank == self.n - 1
        self.floor[key[last]] = score[order[last]]
        self.parts = [(key[rank < self.n], score[chosen], ids[chosen], unnamed[chosen], place[chosen])]
        self.waiting = 0
        return self.parts[0]


def _tiles(rows: Rows) -> Iterator[tuple[Rows, tuple]]:
    for at in range(0, len(rows.ids), TILE):
        tile = rows.take(slice(at, at + TILE))
        yield tile, (tile.angles.min(0), tile.angles.max(0), tile.norms.min(), tile.norms.max())


def best_positives(anchors: Rows, floors: np.ndarray, rows: Rows, n: int, tiles: list | None = None) -> Best:
    """The first ``n`` other rows of the same label, at least as good as ``floors``."""
    best = Best(len(anchors.ids), n)
    for tile, edge in tiles or _tiles(rows):
        need = np.maximum(floors, best.floor)
        _, up = bounds(anchors.angles, anchors.norms, *edge)
        open_ = np.flatnonzero(up >= need)
        if not len(open_):
            continue
        same = anchors.labels[open_, None] == tile.labels[None, :]
        if not same.any():
            continue
        scores = _product(anchors.vectors[open_], tile.vectors)
        fit = same & (scores >= need[open_, None]) & (anchors.places[open_, None] != tile.places[None, :])
        a, r = np.nonzero(fit)
        if len(a):
            best.offer(open_[a], scores[a, r], tile.ids[r], tile.unnamed[r], tile.places[r])
    best.settle()
    return best


def best_negatives(anchors: Rows, windows: np.ndarray, rows: Rows, n: int, tiles: list | None = None) -> Best:
    """For each anchor and slot of ``windows`` (anchors, slots, 2) the first ``n`` rows of other labels inside."""
    slots = windows.shape[1]
    best = Best(len(anchors.ids) * slots, n)
    for tile, edge in tiles or _tiles(rows):
        least = np.maximum(windows[:, :, 0], best.floor.reshape(-1, slots))
        down, up = bounds(anchors.angles, anchors.norms, *edge)
        meets = (least <= windows[:, :, 1]) & (up[:, None] >= least) & (down[:, None] <= windows[:, :, 1])
        open_ = np.flatnonzero(meets.any(1))
        if not len(open_):
            continue
        scores = _product(anchors.vectors[open_], tile.vectors)
        differs = anchors.labels[open_, None] != tile.labels[None, :]
        for s in range(slots):
            fit = differs & (scores >= least[open_, s, None]) & (scores <= windows[open_, s, 1, None])
            a, r = np.nonzero(fit)
            if len(a):
                best.offer(open_[a] * slots + s, scores[a, r], tile.ids[r], tile.unnamed[r], tile.places[r])
    best.settle()
    return best


# -------------------------------------------------------------------------- the passes

def _groups(batches: Iterable, step: int, positives: int) -> Iterator:
    """The anchors of each block, in groups, with floors for their positives from their own block."""
    for record in _records(batches):
        rows = Rows.of(record)
        chosen = np.flatnonzero((rows.ids % step == 0) & ~rows.unnamed)
        for k, at in enumerate(range(0, len(chosen), GROUP)):
            own = rows.take(chosen[at : at + GROUP])
            floors = best_positives(own, np.full(len(own.ids), NONE, np.int64), rows, positives).floor
            yield _batch([own.record(record["block"], record["block"] * PLACES + k, floors=floors)])


def _sent(batches: Iterable, runs: list[tuple], windows: bool) -> Iterator:
    """Each group once for every run of blocks that it may find something in: (block, group) for each block."""
    import pyarrow as pa

    for record in _records(batches):
        rows = Rows.of(record)
        need = record["floors"]
        if windows:
            w = record["windows"].reshape(len(rows.ids), -1, 2)
        to: list[int] = []
        for blocks, dim, *edge in runs:
            if dim != record["dim"]:
                continue
            down, up = bounds(rows.angles, rows.norms, *edge)
            if windows:
                meets = ((w[:, :, 0] <= w[:, :, 1]) & (up[:, None] >= w[:, :, 0]) & (down[:, None] <= w[:, :, 1])).any()
            else:
                meets = (up >= need).any()
            if meets:
                to += blocks
        if to:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(to), record["grp"], np.int64)), pa.array(to, pa.int64())], names=["grp", "block"])


FOUND = "grp long, anchor int, slot int, score long, id long, unnamed boolean, place long"


def _met(batches: Iterable, n: int, windows: bool) -> Iterator:
    """A partition sorted by block, each block before its groups: what each group finds there."""
    import pyarrow as pa

    rows, at, tiles = None, None, []
    for record in _records(batches):
        if record["grp"] is None:
            rows, at = Rows.of(record), record["block"]
            tiles = list(_tiles(rows))
            continue
        if record["block"] != at:
            raise ValueError("a group came without its block")
        anchors, slots = Rows.of(record), 1
        if windows:
            w = record["windows"].reshape(len(anchors.ids), -1, 2)
            slots = w.shape[1]
            key, score, ids, unnamed, place = best_negatives(anchors, w, rows, n, tiles).settle()
        else:
            key, score, ids, unnamed, place = best_positives(anchors, record["floors"], rows, n, tiles).settle()
        if len(key):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(key), record["grp"], np.int64)), pa.array((key // slots).astype(np.int32)),
                 pa.array((key % slots).astype(np.int32)), *map(pa.array, (score, ids, unnamed, place))],
                names=[f.split()[0] for f in FOUND.split(", ")])


def _runs(blocks: DataFrame) -> list[tuple]:
    """Bounds of runs of neighbouring blocks, RUNS in all at most but for lengths of vectors; blocks as lists."""
    known = blocks.select("block").agg(F.max("block")).head()[0] or 0
    wide = (known // 4096) // RUNS + 1  # partitions a run
    angles = F.posexplode("angles")
    slim = blocks.select(F.call_function("div", F.col("block"), F.lit(4096 * wide)).alias("run"), "dim", "block", "norms", "angles")
    norms = slim.groupBy("run", "dim").agg(
        F.collect_list("block").alias("blocks"), F.min(F.array_min("norms")).alias("least"), F.max(F.array_max("norms")).alias("most"))
    edges = slim.select("run", "dim", angles.alias("i", "angle")).groupBy("run", "dim", (F.col("i") % REFERENCES).alias("r")).agg(
        F.min("angle").alias("low"), F.max("angle").alias("high")).groupBy("run", "dim").agg(
        F.array_sort(F.collect_list(F.struct("r", "low", "high"))).alias("edges"))
    out = []
    for r in norms.join(edges, ["run", "dim"]).collect():
        low, high = (np.array([e[k] for e in r["edges"]]) for k in ("low", "high"))
        out.append((list(r["blocks"]), r["dim"], low, high, r["least"], r["most"]))
    return out


def _searched(blocks: DataFrame, groups: DataFrame, runs: list[tuple], n: int, windows: bool) -> DataFrame:
    pairs = groups.mapInArrow(lambda b: _sent(b, runs, windows), "grp long, block long")
    asks = groups.drop("block").join(pairs, "grp").select(*blocks.columns)
    both = blocks.unionByName(asks).repartition("block").sortWithinPartitions("block", F.col("grp").asc_nulls_first())
    return both.mapInArrow(lambda b: _met(b, n, windows), FOUND)


def _first(found: DataFrame, n: int) -> DataFrame:
    """The rank filter runs before the shuffle as well."""
    order = Window.partitionBy("grp", "anchor", "slot").orderBy(F.col("score").desc(), "unnamed", "id", "place")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def mine(
    rows: DataFrame, window: Callable[[Column], tuple[Column, Column]], anchor_step: int = ANCHOR_STEP,
    positives: int = POSITIVES, negatives: int = NEGATIVES, block: int | None = None,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score from ``rows`` (as ``rows_of``).

    ``window`` gives the least and largest score of a negative from the positive's score; both are whole numbers.
    """
    spark = rows.sparkSession
    rows = keep(rows)
    total = rows.count()
    size = block or min(BLOCK, max(SMALL_BLOCK, total // 64))
    # REFERENCES rows of each of the eight most common lengths of vectors; other lengths have no bounds but norms.
    common = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.col("count").desc(), "dim").limit(8)
    some = Window.partitionBy("dim").orderBy(F.xxhash64("id", "vec"), "id")
    picked = rows.withColumn("dim", F.size("vec")).where(F.exists("vec", lambda x: x != 0)).join(
        F.broadcast(common), "dim", "left_semi").withColumn("k", F.row_number().over(some)).where(F.col("k") <= REFERENCES)
    references: dict[int, np.ndarray] = {}
    for r in picked.orderBy("dim", "k").collect():
        v = np.array(r["vec"], float)
        references.setdefault(r["dim"], []).append(v / np.sqrt(v @ v))
    references = {d: np.array(v) for d, v in references.items()}

    placed = rows.mapInArrow(lambda b: _placed(b, references), f"{ROW}, dim int, cell int, near double")
    order = ["dim", "cell", "near", "id", F.monotonically_increasing_id()]
    spread = placed.withColumn("_k", order.pop()).repartitionByRange(max(1, -(-total // size)), *order, "_k")
    blocks = keep(spread.sortWithinPartitions(*order, "_k").mapInArrow(lambda b: _blocked(b, references, size), SIDE))
    groups = keep(blocks.mapInArrow(lambda b: _groups(b, anchor_step, positives), SIDE))
    runs = _runs(blocks)

    near = keep(_first(_searched(blocks, groups, runs, positives, False), positives).withColumn("slot", F.col("rank") - 1))
    low, high = window(F.col("score"))
    # Windows of a group: one line for each anchor and slot, empty where it has no such positive.
    slots = groups.select("grp", F.posexplode("ids").alias("anchor", "_id")).select(
        "grp", "anchor", F.explode(F.sequence(F.lit(0), F.lit(positives - 1))).alias("slot"))
    lines = slots.join(near.select("grp", "anchor", "slot", low.cast("long").alias("lo"), high.cast("long").alias("hi")),
                       ["grp", "anchor", "slot"], "left")
    packed = lines.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct(
        "anchor", "slot", F.coalesce("lo", F.lit(1)).alias("lo"), F.coalesce("hi", F.lit(0)).alias("hi")))).alias("w"))
    windows = packed.select("grp", F.flatten(F.transform("w", lambda x: F.array(x["lo"], x["hi"]))).alias("_windows"))
    asking = keep(groups.join(windows, "grp").withColumn("windows", F.col("_windows")).select(*groups.columns))
    far = _first(_searched(blocks, asking, runs, negatives, True), negatives)

    names = groups.select("grp", F.posexplode("ids").alias("anchor", "anchor_id"))
    known = near.select("grp", "anchor", "slot", F.when(~F.col("unnamed"), F.col("id")).alias("positive_id"),
                        F.col("score").alias("positive_score"))
    return far.join(known, ["grp", "anchor", "slot"]).join(names, ["grp", "anchor"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"),
        F.when(~F.col("unnamed"), F.col("id")).alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def percent_window(score: Column) -> tuple[Column, Column]:
    """Scores s with LEAST * score <= 100 * s <= MOST * score."""
    wide = score.cast("decimal(20,0)")
    # Rounded down, also below zero; the least one up.
    down = lambda x: F.call_function("div", x - F.pmod(x, F.lit(100)), F.lit(100))
    return -down(-wide * F.lit(LEAST)), down(wide * F.lit(MOST))


def op12_angular_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = table(spark, sf_dir, "embeddings")
    vec_id = F.col("vec_id")
    label = F.when(vec_id % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vector = F.transform("embedding", lambda x: F.floor(SCALE * x.cast("double")).cast("double"))
    return mine(rows_of(frame, "vec_id", label, vector), percent_window)


ORACLE = """
WITH picked AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
    list_inner_product(a.v, b.v)::BIGINT AS score
  FROM picked a JOIN picked b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
  row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id)::INT AS rank,
  s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
WHERE 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) <= 10
"""
