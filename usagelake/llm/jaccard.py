"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of five-word shingles; two of them are linked if their Jaccard similarity is 0.8 or more.

1. One Python pass gives each document 72 MinHash values and a 128-bit key of its set.  Documents of equal sets
   are one set from here on, so copies cost nothing more and are never paired.
2. Sets that agree in one of 24 bands of three values are candidates: a pair at 0.8 is missed with probability
   (1 - 0.8**3) ** 24 < 4e-8.  Buckets of equal membership are looked at once.
3. Inside a bucket pairs are compared by eight MinHash values after eight.  A pair is dropped as soon as the
   posterior probability that its similarity reaches the threshold is below ``TOLERANCE``.  Only a spanning
   forest of the pairs left goes on, so a bucket of n sets gives n - 1 rows at most.
4. Components of the forests gather the sets that may be linked.  Their shingles are read again from their texts,
   surviving pairs are verified exactly, and each set gets its number of links and a spanning forest of its links.
5. Components of the verified forests are the classes.

Large buckets and components are cut into blocks of bounded size; each pair of blocks is a task's unit of work, so
no group meets in one task.  Pairs are never rows: a task gives counts and forests.

Defined cases: texts with fewer than five words are one shingle of all their words; texts without a word (null
and empty ones) form one class without links; a document's number of links counts the other different texts at 0.8
or more, texts of equal sets included; repeated rows are copies; a null doc_id is kept and never names a class
that has another member; an empty table gives an empty result.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelake.llm.common import keep, table
from usagelake.llm.graph import components
from usagelake.llm.hashing import WordHashes, groups, shingles

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 3
HASHES = BANDS * ROWS
#: MinHash values compared at a time.
STEP = 8
#: A pair goes when its chance of reaching the threshold is below this.
TOLERANCE = 1e-7
#: Sets of a block of a bucket, and of a component; shingles of a block of a component.
BUCKET_BLOCK = 1024
BLOCK, BLOCK_SHINGLES = 512, 2_000_000


def _family() -> tuple[np.ndarray, np.ndarray]:
    values = np.random.RandomState(5).randint(0, 2**32, size=(4, HASHES), dtype=np.uint64)
    return (values[0] << np.uint64(32) | values[1]) | np.uint64(1), values[2] << np.uint64(32) | values[3]


def signature(grams: np.ndarray) -> np.ndarray:
    """The MinHash values (32 bits each) of a set that is not empty."""
    scale, shift = _family()
    best = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 2048):
        part = grams[at : at + 2048, None] * scale
        part += shift
        np.minimum(best, part.min(axis=0), out=best)
    return (best >> np.uint64(32)).astype(np.uint32)


def _sketch(batches: Iterable) -> Iterator:
    import pyarrow as pa
    import xxhash

    known = WordHashes()
    for batch in batches:
        keys, sizes, signatures = [], [], []
        for text in batch.column("text").to_pylist():
            grams = shingles(known.of((text or "").encode().split()), SHINGLE)
            keys.append(xxhash.xxh3_128_digest(grams.tobytes()))
            sizes.append(len(grams))
            signatures.append(signature(grams).tobytes() if len(grams) else None)
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays(
            [batch.column(n) for n in names]
            + [pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(signatures, pa.binary())],
            names=[*names, "sid", "size", "signature"],
        )


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """The matches a pair needs after 8, 16, ... values.

    The last eight bits of a MinHash value agree with probability c = s + (1 - s) / 256 at similarity s.  With a
    uniform prior on c, the posterior after m of n matches is Beta(m + 1, n - m + 1), and
    P(c >= x) = P(Binomial(n + 1, x) <= m).
    """
    from math import comb

    x, out = threshold + (1 - threshold) / 256, []
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += comb(n + 1, m) * x**m * (1 - x) ** (n + 1 - m)
        out.append(m)
    return out


def surviving(a: np.ndarray, b: np.ndarray | None, need: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows of two matrices of MinHash bytes that no step drops; i < j within one matrix."""
    other = a if b is None else b
    same = np.zeros((len(a), len(other)), np.uint8)
    for k in range(STEP):
        same += a[:, k, None] == other[None, :, k]
    alive = same >= need[0]
    if b is None:
        alive = np.triu(alive, 1)
    i, j = np.nonzero(alive)
    count = same[i, j].astype(np.int64)
    for at, least in zip(range(STEP, HASHES, STEP), need[1:]):
        if not len(i):
            break
        count += (a[i, at : at + STEP] == other[j, at : at + STEP]).sum(axis=1)
        left = count >= least
        i, j, count = i[left], j[left], count[left]
    return i, j


def forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """At most n - 1 pairs that connect what the given pairs connect."""
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(i.tolist(), j.tolist()):
        p, q = root(x), root(y)
        if p != q:
            parent[q] = p
            out.append((x, y))
    return out


def _sides(group: dict[str, list]) -> tuple[np.ndarray, np.ndarray | None]:
    """Row numbers of a group's two blocks; the second is None for a block with itself."""
    if group["_p"][0] == group["_q"][0]:
        return np.arange(len(group["_p"])), None
    mine = np.array(group["_block"])
    return np.flatnonzero(mine == group["_p"][0]), np.flatnonzero(mine == group["_q"][0])


def _pairs(group: dict[str, list], need: list[int]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(group["short"]), np.uint8).reshape(-1, HASHES)
    left, right = _sides(group)
    i, j = surviving(data[left], None if right is None else data[right], need)
    return left[i], (left if right is None else right)[j]


def _candidates(batches: Iterable, threshold: float) -> Iterator:
    import pyarrow as pa

    need, a, b = least_matches(threshold), [], []
    made = lambda: pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])
    for group in groups(batches, ["band", "_p", "_q"]):
        sids = group["sid"]
        for x, y in forest(len(sids), *_pairs(group, need)):
            a.append(sids[x])
            b.append(sids[y])
        if len(a) >= 10_000:
            yield made()
            a.clear()
            b.clear()
    yield made()


def _shingled(batches: Iterable) -> Iterator:
    import pyarrow as pa

    known = WordHashes()
    for batch in batches:
        grams = [shingles(known.of(t.encode().split()), SHINGLE).tobytes() for t in batch.column("text").to_pylist()]
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays(
            [batch.column(n) for n in names] + [pa.array(grams, pa.binary())], names=[*names, "grams"]
        )


def verified(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose exact similarity reaches the threshold."""
    sizes = np.array([len(s) for s in sets])
    near = np.minimum(sizes[i], sizes[j]) >= threshold * np.maximum(sizes[i], sizes[j])
    i, j = i[near], j[near]
    if len(i) < 4:
        shared = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i, j)], np.int64)
    else:
        names, columns = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum(sizes)
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        shared = np.empty(len(i), np.int64)
        mark = np.zeros(len(names), bool)
        firsts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        for first, last in zip(firsts, np.r_[firsts[1:], len(i)]):
            mine = columns[ends[i[first]] - sizes[i[first]] : ends[i[first]]]
            mark[mine] = True
            for at in range(first, last, 256):
                js = j[at : min(at + 256, last)]
                flat = np.concatenate([mark[columns[ends[x] - sizes[x] : ends[x]]] for x in js])
                shared[at : at + len(js)] = np.add.reduceat(flat, np.r_[0, np.cumsum(sizes[js])[:-1]], dtype=np.int64)
            mark[mine] = False
    linked = shared >= threshold * (sizes[i] + sizes[j] - shared) - 1e-9
    return i[linked], j[linked]


def _links(batches: Iterable, threshold: float) -> Iterator:
    import pyarrow as pa

    need, rows = least_matches(threshold), []

    def made():
        columns = zip(*rows) if rows else [[]] * 3
        types = [pa.binary(), pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["sid", "other", "links"])

    for group in groups(batches, ["comp", "_p", "_q"]):
        sids, n = group["sid"], len(group["sid"])
        i, j = _pairs(group, need)
        i, j = verified([np.frombuffer(g, np.uint64) for g in group["grams"]], i, j, threshold)
        texts = np.array(group["texts"], np.int64)
        links = np.bincount(i, texts[j], n) + np.bincount(j, texts[i], n)
        rows += [(sids[x], None, int(links[x])) for x in np.flatnonzero(links)]
        rows += [(sids[x], sids[y], 0) for x, y in forest(n, i, j)]
        if len(rows) >= 10_000:
            yield made()
            rows.clear()
    yield made()


def _blocked(rows: DataFrame, key: str) -> DataFrame:
    """Repeat each row of a group of ``_blocks`` blocks for each pair of blocks that its own is in."""
    own = F.pmod(F.xxhash64("sid"), F.col("_blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), (F.col("_blocks") - 1).cast("int")))
    spread = rows.withColumn("_block", own).withColumn("_other", every)
    spread = spread.withColumn("_p", F.least("_block", "_other")).withColumn("_q", F.greatest("_block", "_other"))
    return spread.drop("_other", "_blocks").repartition(key, "_p", "_q").sortWithinPartitions(key, "_p", "_q")


def _placed(docs: DataFrame, id_column: str) -> tuple[DataFrame, DataFrame]:
    """Documents (_id, _text, sid), and sets (sid, root, first, _id, texts, copies, size, links)."""
    slim = docs.select(F.col(id_column).alias("_id"), F.xxhash64("text").alias("_text"), "text")
    kind = slim.schema["_id"].dataType.simpleString()
    rows = keep(slim.mapInArrow(_sketch, f"_id {kind}, _text long, sid binary, size long, signature binary"))
    return rows, placed(slim, rows)


def placed(slim: DataFrame, rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Sets with their classes at ``threshold``, from (_id, _text, text) and the sketches of these rows."""
    first = F.struct(F.col("_id").isNull().cast("int").alias("_null"), "_id", "_text")
    texts = rows.groupBy("sid", "_text").agg(
        F.count("*").alias("n"), F.min(first).alias("first"),
        F.first("signature").alias("signature"), F.first("size").alias("size"),
    )
    sets = keep(texts.groupBy("sid").agg(
        F.sum("n").alias("copies"), F.count("*").alias("texts"), F.min("first").alias("first"),
        F.first("signature").alias("signature"), F.first("size").alias("size"),
    ).withColumn("_id", F.col("first._id")))
    # Buckets: the sets of each band, those of equal membership once.
    word = lambda k: F.substring(F.col("signature"), (k * (4 * ROWS) + 1).cast("int"), F.lit(4 * ROWS))
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, word(k)))
    banded = sets.where("size > 0").select("sid", F.explode(bands).alias("band"))
    mark = F.xxhash64("sid")
    buckets = banded.groupBy("band").agg(
        F.count("*").alias("_n"), F.bit_xor(mark).alias("_x"), F.bit_xor(F.xxhash64(mark, F.lit(1))).alias("_y")
    ).where("_n > 1").groupBy("_n", "_x", "_y").agg(F.min("band").alias("band"))
    buckets = buckets.select("band", F.ceil(F.col("_n") / BUCKET_BLOCK).alias("_blocks"))
    chosen = keep(banded.join(buckets, "band"))
    short = sets.where("size > 0").select("sid", F.concat(*[F.substring("signature", 4 * k + 1, 1) for k in range(HASHES)]).alias("short"))
    members = _blocked(chosen.join(short, "sid"), "band")
    comps = components(members.mapInArrow(lambda b: _candidates(b, threshold), "a binary, b binary"))
    # Exact links inside the components.
    held = comps.select(F.col("node").alias("sid"), F.col("root").alias("comp"))
    spread = held.join(sets.select("sid", "size"), "sid").groupBy("comp").agg(
        F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_SHINGLES)).alias("_blocks")
    )
    asked = keep(
        held.join(spread, "comp").join(sets.select("sid", "first", "texts"), "sid").join(short, "sid")
        .select("sid", "comp", "_blocks", "texts", "short", F.col("first._id").alias("_i"), F.col("first._text").alias("_t"))
    )
    same = slim["_id"].eqNullSafe(asked["_i"]) & (slim["_text"] == asked["_t"])
    # Repeated rows of one id and text would give a set twice.
    whole = slim.join(asked, same).select("sid", "comp", "_blocks", "texts", "short", "text").dropDuplicates(["sid"])
    fields = "sid binary, comp binary, _blocks long, texts long, short binary, grams binary"
    pairs = _blocked(whole.mapInArrow(_shingled, fields), "comp")
    links = keep(pairs.mapInArrow(lambda b: _links(b, threshold), "sid binary, other binary, links long"))
    classes = components(links.where("other is not null").select(F.col("sid").alias("a"), F.col("other").alias("b")))
    counted = links.where("other is null").groupBy("sid").agg(F.sum("links").alias("links"))
    named = classes.select(F.col("node").alias("sid"), "root")
    all_ = sets.select("sid", "first", "_id", "texts", "copies", "size").join(named, "sid", "left").join(counted, "sid", "left")
    return keep(all_.withColumn("root", F.coalesce("root", "sid")))


def join(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """One row a document: its id, class_id (the least id of its class), n_links and n_copies."""
    rows, sets = _placed(docs, id_column)
    least = sets.groupBy("root").agg(F.min("_id").alias("class_id"))
    own = F.when(F.col("size") > 0, F.col("texts") - 1).otherwise(0)
    out = sets.join(least, "root").select(
        "sid", "class_id", (F.coalesce("links", F.lit(0)) + own).cast("long").alias("n_links"),
        F.col("copies").alias("n_copies"),
    )
    return rows.select("_id", "sid").join(out, "sid").select(
        F.col("_id").alias(id_column), "class_id", "n_links", "n_copies"
    )


def representatives(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(id, text's xxhash64) of one document a class: that of the least id, then of the least hash."""
    _, sets = _placed(docs, id_column)
    first = sets.groupBy("root").agg(F.min("first").alias("f"))
    return first.select(F.col("f._id").alias(id_column), F.col("f._text").alias("text_hash"))


def op3_bayesian_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
