"""Repeated windows of a corpus: the frame that substring dedup over words and over bytes share.

A window is ``length`` units (words or bytes) of one document.  Two windows are compared only where they can be
equal, and every pair of equal windows is compared:

1. Anchors.  Of any ``run`` neighbouring ``gram``-unit hashes of a document the least one is its anchor, so equal
   windows have equal anchors inside.  A document's anchors are about 2 / (run + 1) of its units.
2. An anchor value that occurs once marks a stretch that no repeated window touches.  What is left are candidate
   windows: all their inner runs have repeated anchors.
3. A candidate window belongs to the group of its first run's anchor: to the least document that has that anchor.
   Equal windows have equal first anchors, so they meet in one group.  Neighbouring windows of a document and a
   group are one piece; pieces of equal content are one, whatever the number of copies.
4. Groups are the work of an engine (suffix automata, merged Burrows-Wheeler transforms), which compares
   content, not hashes.  A group above ``block`` units is dealt to blocks; what an engine leaves open there is
   settled across blocks by counting 128-bit hashes of the windows.

Anchors of a value that fills a large part of the rows form groups of their own and are spread over tasks; a
sample of documents tells which ones, and an error there costs balance, not results.  Texts move twice, packed,
the second time only those with candidates.  All intermediate tables are written to the shared folder.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from usagelake.llm.common import keep
from usagelake.llm.hashing import BASE, WordHashes, groups, mixed, windows

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Runs that are searched at a time.
CHUNK = 1 << 20
_LOW = np.uint64((1 << 22) - 1)
#: One of so many documents is looked at to find anchors that are everywhere.
LOOK = 16
#: An anchor value with more than this part of all anchors is spread over tasks.
HOT = 1 / 4000


@dataclass(frozen=True)
class Rule:
    words: bool  # units: words, else bytes
    length: int  # units of a window
    gram: int  # units of an anchor
    run: int  # anchors are the least of so many grams
    earlier: bool  # a window is removed if a document of smaller id has it, else if it starts anywhere else
    block: int  # units of content that an engine takes at a time

    @property
    def need(self) -> int:
        """Runs inside a window."""
        return self.length - self.gram - self.run + 2


#: Hash of each byte value.
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


def units(raw: bytes, rule: Rule, known: WordHashes) -> tuple[np.ndarray, list[bytes] | None]:
    if rule.words:
        words = raw.split()
        return known.of(words), words
    return _BYTES[np.frombuffer(raw, np.uint8)], None


def anchors(hashes: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, first run, end run) of each anchor; consecutive anchors share a border."""
    empty = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    if len(hashes) < rule.length:
        return empty
    runs = len(hashes) - rule.gram - rule.run + 2
    values, places = [], []
    for at in range(0, runs, CHUNK):
        end = min(at + CHUNK, runs)
        grams = windows(hashes[at : end + rule.run + rule.gram - 2], rule.gram)
        least = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)  # the leftmost of equals
        step = 1
        while 2 * step <= rule.run:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if step < rule.run:
            least = np.minimum(least[: step - rule.run], least[rule.run - step :])
        inner = (least & _LOW).astype(np.int64)
        new = np.flatnonzero(np.r_[True, inner[1:] != inner[:-1]])
        values.append(np.c_[new + at, inner[new] + at])
        places.append(grams[inner[new]])
    found, value = np.concatenate(values), np.concatenate(places)
    fresh = np.r_[True, found[1:, 1] != found[:-1, 1]]
    first = found[fresh, 0]
    return value[fresh], first, np.r_[first[1:], runs]


def small(batches: Iterable, rows: int = 1000) -> Iterator:
    """Batches of so many rows at most, which bounds what Python holds at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _anchored(batches: Iterable, rule: Rule) -> Iterator:
    import pyarrow as pa

    known = WordHashes()
    for batch in small(batches):
        found = [anchors(units((t or "").encode(), rule, known)[0], rule) for t in batch.column("text").to_pylist()]
        counts = [len(f[0]) for f in found]
        row = pa.array(np.repeat(np.arange(len(found)), counts))
        value, first, end = (np.concatenate([f[k] for f in found]) if found else np.empty(0) for k in range(3))
        yield pa.RecordBatch.from_arrays(
            [batch.column("_d").take(row), batch.column("_t").take(row), pa.array(value.astype(np.uint64).view(np.int64)),
             pa.array(first.astype(np.int32)), pa.array(end.astype(np.int32))],
            names=["_d", "_t", "value", "first", "end"],
        )


def _packed(batches: Iterable) -> Iterator:
    import pyarrow as pa
    import zstandard

    press = zstandard.ZstdCompressor(level=3).compress
    for batch in small(batches):
        texts = [press((t or "").encode()) for t in batch.column("text").to_pylist()]
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(texts, pa.binary())], names=[*names, "packed"])


def pieces(firsts: list[int], ends: list[int], groups: list[int], need: int) -> list[tuple[int, int, int]]:
    """(group, first window, end window) from a document's repeated anchors in order."""
    out: list[tuple[int, int, int]] = []
    at, n = 0, len(firsts)
    while at < n:
        last = at
        while last + 1 < n and firsts[last + 1] == ends[last]:
            last += 1
        limit = ends[last] - need + 1
        for k in range(at, last + 1):
            a, b = firsts[k], min(ends[k], limit)
            if a >= b:
                break
            if out and out[-1][0] == groups[k] and out[-1][2] == a:
                out[-1] = (groups[k], out[-1][1], b)
            else:
                out.append((groups[k], a, b))
        at = last + 1
    return out


def _sha(raw: bytes) -> str:
    import hashlib

    return hashlib.sha256(raw).hexdigest()


def _cut(batches: Iterable, rule: Rule, texts: bool) -> Iterator:
    """Candidate pieces of each document; of a document without any the result."""
    import pyarrow as pa
    import xxhash
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for batch in small(batches):
        sizes, shas, packed, counts = [], [], [], []
        group, start, number, mark, content = [], [], [], [], []
        for raw, found in zip(batch.column("packed").to_pylist(), batch.column("found").to_pylist()):
            found = sorted({(f["first"], f["end"], f["g"]) for f in found or []})  # repeated rows give each twice
            got = pieces(*(list(x) for x in zip(*found)), rule.need) if found else []
            text = unpack(raw)
            words = text.split() if rule.words else text
            for g, a, b in got:
                part = words[a : b - 1 + rule.length]
                part = b" ".join(part) if rule.words else part
                group.append(g)
                start.append(a)
                number.append(b - a)
                mark.append(xxhash.xxh3_128_digest(part))
                content.append(part)
            counts.append(len(got))
            sizes.append(len(words))
            shas.append(None if got else _sha(b" ".join(words) if rule.words else text))
            packed.append(raw if got or texts else None)
        inner = pa.StructArray.from_arrays(
            [pa.array(group, pa.int64()), pa.array(start, pa.int32()), pa.array(number, pa.int32()),
             pa.array(mark, pa.binary()), pa.array(content, pa.binary())],
            names=["g", "start", "windows", "mark", "content"],
        )
        offsets = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
        names = [n for n in batch.schema.names if n not in ("packed", "found")]
        yield pa.RecordBatch.from_arrays(
            [batch.column(n) for n in names]
            + [pa.array(sizes, pa.int64()), pa.array(shas, pa.string()), pa.array(packed, pa.binary()),
               pa.ListArray.from_arrays(offsets, inner)],
            names=[*names, "size", "sha", "packed", "pieces"],
        )


def runs_of(flags: np.ndarray) -> list[int]:
    """first, end, first, end, ... of the runs of True."""
    return np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0])).tolist()


def double_hash(content: bytes, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each window of a piece."""
    values, _ = units(content, rule, WordHashes())
    return windows(values, rule.length), windows(mixed(values ^ np.uint64(BASE)), rule.length)


#: An engine takes the pieces of whole blocks, each (d, content, windows, copies) in order of d, and gives for
#: each piece which of its windows are removed, and which of its windows stand for one in other blocks.
Engine = Callable[[list[list[tuple]]], list[list[tuple[np.ndarray, np.ndarray]]]]


def _worked(batches: Iterable, rule: Rule, engine: Engine) -> Iterator:
    import pyarrow as pa

    def made(blocks):
        rows = []
        for group, done in zip(blocks, engine([list(zip(*(g[c] for c in ("d", "content", "windows", "copies")))) for g in blocks])):
            for k, (gone, stands) in enumerate(done):
                a, b, at = [], [], []
                if group["blocks"][k] > 1:
                    h1, h2 = double_hash(group["content"][k], rule)
                    at = np.flatnonzero(stands)
                    a, b = h1[at].view(np.int64).tolist(), h2[at].view(np.int64).tolist()
                    at = at.tolist()
                rows.append((group["g"][k], group["mark"][k], group["d"][k], group["copies"][k], runs_of(gone), a, b, at))
        types = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]
        columns = zip(*rows) if rows else [[]] * len(types)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types)],
            names=["g", "mark", "d", "copies", "spans", "h1", "h2", "at"],
        )

    held, size = [], 0
    for group in groups(batches, ["g", "block"]):
        held.append(group)
        size += sum(map(len, group["content"]))
        if size >= 2_000_000:
            yield made(held)
            held, size = [], 0
    yield made(held)


def covered(windows_: list[tuple[int, int]], size: int, length: int) -> np.ndarray:
    """Units in windows that start in one of the intervals."""
    edges = np.zeros(size + 1, np.int64)
    for a, b in windows_:
        if a < b:
            edges[a] += 1
            edges[b - 1 + length] -= 1
    return np.cumsum(edges)[:-1] > 0


def without(raw: bytes, gone: np.ndarray, words: bool) -> bytes:
    """The text without the units gone; white space after a word goes with it."""
    if not words:
        return np.frombuffer(raw, np.uint8)[~gone].tobytes()
    import re

    starts = [m.start() for m in re.finditer(rb"[^\x20\x09-\x0d]+", raw)] + [len(raw)]
    kept, at = [raw[: starts[0]]], runs_of(~gone)
    kept += [raw[starts[a] : starts[b]] for a, b in zip(at[::2], at[1::2])]
    return b"".join(kept)


def _final(batches: Iterable, rule: Rule, texts: bool) -> Iterator:
    import pyarrow as pa
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for batch in small(batches):
        removed, spans, shas, kept = [], [], [], []
        for raw, size, sha, got in zip(*(batch.column(n).to_pylist() for n in ("packed", "size", "sha", "got"))):
            if sha is not None:  # nothing was a candidate
                removed.append(0)
                spans.append(0)
                shas.append(sha)
                kept.append(unpack(raw).decode() if texts else None)
                continue
            text = unpack(raw)
            found = [(p["start"] + a, p["start"] + b) for p in got or [] for a, b in zip(p["spans"][::2], p["spans"][1::2])]
            gone = covered(found, size, rule.length)
            removed.append(int(gone.sum()))
            spans.append(len(runs_of(gone)) // 2)
            if rule.words:
                shas.append(_sha(b" ".join(w for w, g in zip(text.split(), gone.tolist()) if not g)))
            else:
                shas.append(_sha(without(text, gone, False)))
            kept.append(without(text, gone, rule.words).decode(errors="ignore") if texts else None)
        names = [n for n in batch.schema.names if n not in ("packed", "sha", "got", "_d", "_t")]
        yield pa.RecordBatch.from_arrays(
            [batch.column(n) for n in names]
            + [pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(shas, pa.string()), pa.array(kept, pa.string())],
            names=[*names, "n_removed", "n_spans", "kept_sha256", "kept_text"],
        )


def remove(docs: DataFrame, rule: Rule, engine: Engine, texts: bool = False, id_column: str = "doc_id") -> DataFrame:
    """One row a document: its id, size, n_removed, n_spans, kept_sha256.

    With ``texts`` also kept_text, and ``row``, a struct of the document's other columns.
    """
    others = [docs[c].alias(c) for c in docs.columns if c not in (id_column, "text")] if texts else []
    row = F.struct(*others) if others else F.lit(None).cast("struct<none: int>")
    low = F.lit(-(2**63)).cast("long")  # a null id comes before all others
    slim = docs.select(
        F.col(id_column).alias("id"), row.alias("row"), F.coalesce(F.col(id_column).cast("long"), low).alias("_d"),
        F.xxhash64("text").alias("_t"), "text",
    )
    own = ", ".join(f"{c} {slim.schema[c].dataType.simpleString()}" for c in ("id", "row"))
    key = "_d long, _t long"
    every = slim.select("_d", "_t", "text")
    anchored = lambda df: df.mapInArrow(lambda b: _anchored(b, rule), f"{key}, value long, first int, end int")
    looked = anchored(every.where(F.pmod(F.xxhash64("_d", F.lit(7)), F.lit(LOOK)) == 0))
    often = looked.agg(F.expr("approx_top_k(value, 1000, 20000)").alias("top"), F.count("*").alias("n")).head()
    hot = [(r["item"], True) for r in often["top"] or [] if r["count"] > max(1000 // LOOK, HOT * often["n"])]
    known = docs.sparkSession.createDataFrame(hot, "value long, hot boolean")  # at most 1000 rows
    marked = anchored(every).join(F.broadcast(known), "value", "left") if hot else anchored(every).withColumn("hot", F.lit(None).cast("boolean"))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("_d", "first"), F.lit(1024))).otherwise(0)
    same = Window.partitionBy("value", "salt")
    marked = marked.withColumn("salt", salt).select(
        "_d", "_t", "first", "end", "value", "hot", F.min("_d").over(same).alias("least"),
        (F.max("_d").over(same) if rule.earlier else F.count("*").over(same)).alias("more"),
    )
    again = F.col("more") > (F.col("least") if rule.earlier else F.lit(1))
    repeated = marked.where(F.coalesce("hot", again)).select(
        "_d", "_t", F.struct("first", "end", F.when(F.col("hot"), F.col("value")).otherwise(F.col("least")).alias("g")).alias("f")
    )
    found = repeated.groupBy("_d", "_t").agg(F.collect_list("f").alias("found"))  # no longer than the document
    packed = slim.mapInArrow(_packed, f"{own}, {key}, packed binary")
    shape = "array<struct<g: long, start: int, windows: int, mark: binary, content: binary>>"
    cut = keep(packed.join(found, ["_d", "_t"], "left").mapInArrow(
        lambda b: _cut(b, rule, texts), f"{key}, {own}, size long, sha string, packed binary, pieces {shape}"
    ))
    single = cut.where("sha is null").select("_d", "_t", F.explode("pieces").alias("p"))
    distinct = keep(
        single.select("_d", "p.*").groupBy("g", "mark").agg(
            F.min("_d").alias("d"), F.count("*").alias("copies"), F.first("windows").alias("windows"), F.first("content").alias("content")
        )
    )
    sizes = distinct.groupBy("g").agg(F.sum(F.col("windows") + rule.length).alias("n")).where(F.col("n") > rule.block)
    sizes = sizes.select("g", F.ceil(F.col("n") / rule.block).alias("blocks"))
    dealt = distinct.join(sizes, "g", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)).cast("long"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("mark"), F.col("blocks")))
    ordered = dealt.repartition("g", "block").sortWithinPartitions("g", "block", "d", "mark")
    done = keep(ordered.mapInArrow(
        lambda b: _worked(b, rule, engine),
        "g long, mark binary, d long, copies long, spans array<int>, h1 array<long>, h2 array<long>, at array<int>",
    ))
    # Across blocks: windows by hash.
    open_ = done.where(F.size("at") > 0).select("g", "mark", "d", F.explode(F.arrays_zip("h1", "h2", "at")).alias("w")).select("g", "mark", "d", "w.*")
    settled = open_.groupBy("h1", "h2").agg(F.min("d").alias("least"), F.count("*").alias("n")).where("n > 1")
    met = open_.join(settled, ["h1", "h2"])
    met = met.where(F.col("least") < F.col("d")) if rule.earlier else met
    late = met.groupBy("g", "mark").agg(F.flatten(F.collect_list(F.array(F.col("at"), F.col("at") + 1))).alias("late"))
    result = done.select("g", "mark", "d", "copies", "spans").join(late, ["g", "mark"], "left")
    result = result.withColumn("spans", F.concat("spans", F.coalesce("late", F.array().cast("array<int>"))))
    whole = (F.col("_d") > F.col("d")) if rule.earlier else (F.col("copies") > 1)
    places = single.select("_d", "_t", "p.g", "p.mark", "p.start", "p.windows").join(result, ["g", "mark"])
    spans = F.when(whole, F.array(F.lit(0), F.col("windows"))).otherwise(F.col("spans"))
    gone = places.select("_d", "_t", F.struct("start", spans.alias("spans")).alias("p")).where(F.size("p.spans") > 0)
    gone = gone.groupBy("_d", "_t").agg(F.collect_list("p").alias("got"))
    fields = f"{own}, size long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
    columns = ["id", "row", "_d", "_t", "size", "sha", "packed"]
    shape = "array<struct<start: int, spans: array<int>>>"
    touched = cut.where("sha is null").select(columns).join(gone, ["_d", "_t"], "left").select(*columns, F.col("got").cast(shape))
    clean = cut.where("sha is not null").select(*columns, F.lit(None).cast(shape).alias("got"))
    result = touched.unionByName(clean).mapInArrow(lambda b: _final(b, rule, texts), fields)
    result = result.withColumnRenamed("id", id_column)
    return result if texts else result.drop("row", "kept_text")
