"""Suffix-array dedup by merging Burrows-Wheeler transforms.

:mod:`repeats` brings the candidate pieces together.  A shard is the sorted order of its suffixes; its
Burrows-Wheeler transform is the byte before each.  Two shards are merged without sorting suffixes anew: both
orders stay, and only their interleave is refined.  At depth h each suffix has a rank among the strings of h bytes
of both shards.  The rank at depth 2h is that of the pair (rank at h here, rank at h further on); along either
shard's order these pairs already ascend, so one pass over two sorted lists gives the next interleave.  A round
doubles the depth, so that six rounds reach 400 bytes.  At the last depth equal ranks are common prefixes of
``length`` bytes, and ranks of two suffixes or more the repeated intervals.

Strings end with their piece: beyond it is an end mark that is less than all bytes.

Defined cases: a null or empty text, or one shorter than a window, loses nothing; a string that starts twice in
one document is repeated; repeated rows repeat each other; an empty table gives an empty result.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from usagelake.llm.common import table
from usagelake.llm.repeats import Rule, remove

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: 400 bytes; of 184 neighbouring 32-byte grams one is the anchor, so a window holds two.
RULE = Rule(words=False, length=400, gram=32, run=184, earlier=False, block=4_000_000)
#: Bytes of a shard.
SHARD = 1 << 20
#: Bytes that fit one number with an end mark.
FIRST = 7


class Shard:
    """Pieces with their suffixes in order of the first ``depth`` bytes."""

    def __init__(self, text: np.ndarray, ends: np.ndarray, order: np.ndarray):
        self.text, self.ends, self.order = text, ends, order

    @property
    def transform(self) -> np.ndarray:
        """The Burrows-Wheeler transform: the byte before each suffix in order."""
        return self.text[self.order - 1]


def _first(text: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    n = len(text)
    key, places = np.zeros(n, np.uint64), np.arange(n)
    wide = np.r_[text.astype(np.uint64) + np.uint64(1), np.zeros(depth, np.uint64)]
    for k in range(depth):
        key = key << np.uint64(9) | np.where(places + k < ends, wide[k : k + n], np.uint64(0))
    return key


def _steps(depth: int) -> list[int]:
    out, at = [], min(FIRST, depth)
    while at < depth:
        step = min(at, depth - at)
        out.append(step)
        at += step
    return out


def _pair(rank: np.ndarray, ends: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    further = at + step
    inside = further < ends[at]
    tail = np.where(inside, rank[np.where(inside, further, 0)], 0)
    return rank[at].astype(np.uint64) << np.uint64(32) | tail.astype(np.uint64)


def _dense(ordered: np.ndarray) -> np.ndarray:
    """Ranks from 1 of values that ascend."""
    return np.cumsum(np.r_[1, ordered[1:] != ordered[:-1]])


def sort(parts: list[bytes], depth: int) -> Shard:
    """The shard of some pieces."""
    text = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts])
    ends = np.repeat(np.cumsum(sizes), sizes)
    key = _first(text, ends, min(FIRST, depth))
    order = np.argsort(key, kind="stable")
    places = np.arange(len(text))
    for step in _steps(depth):
        rank = np.empty(len(text), np.int64)
        rank[order] = _dense(key[order])
        key = _pair(rank, ends, places, step)
        order = np.argsort(key, kind="stable")
    return Shard(text, ends, order)


def merge(a: Shard, b: Shard, depth: int) -> tuple[Shard, np.ndarray]:
    """Both shards as one, and the rank at ``depth`` of each suffix in order."""
    keys = [_first(s.text, s.ends, min(FIRST, depth))[s.order] for s in (a, b)]
    for step in _steps(depth):
        both = np.sort(np.concatenate(keys), kind="stable")  # two runs that ascend: one pass
        names = both[np.r_[True, both[1:] != both[:-1]]]
        refined = []
        for s, key in zip((a, b), keys):
            rank = np.empty(len(s.text), np.int64)
            rank[s.order] = np.searchsorted(names, key) + 1
            refined.append(_pair(rank, s.ends, s.order, step))
        keys = refined
    joined = np.concatenate(keys)
    interleave = np.argsort(joined, kind="stable")
    order = np.concatenate([a.order, b.order + len(a.text)])[interleave]
    both = Shard(np.concatenate([a.text, b.text]), np.concatenate([a.ends, b.ends + len(a.text)]), order)
    return both, _dense(joined[interleave])


def repeated(parts: list[bytes], depth: int = RULE.length, shard: int = SHARD) -> tuple[np.ndarray, np.ndarray]:
    """For each place of the joined pieces: does its string of ``depth`` bytes start twice; is it the first such."""
    shards, held, size = [], [], 0
    for part in parts:
        held.append(part)
        size += len(part)
        if size >= shard:
            shards.append(sort(held, depth))
            held, size = [], 0
    if held:
        shards.append(sort(held, depth))
    ranks = None
    while len(shards) > 1:
        merged = [merge(x, y, depth) for x, y in zip(shards[::2], shards[1::2])]
        ranks = merged[0][1]
        shards = [m[0] for m in merged] + shards[len(merged) * 2 :]
    last = shards[0]
    if ranks is None:
        # One shard: its ranks by the same refinement, against no other.
        ranks = merge(last, Shard(last.text[:0], last.ends[:0], last.order[:0]), depth)[1]
    full = last.order + depth <= last.ends[last.order]  # shorter strings are no windows
    counts = np.bincount(ranks[full], minlength=ranks[-1] + 1 if len(ranks) else 1)
    twice, first = np.zeros(len(last.text), bool), np.zeros(len(last.text), bool)
    twice[last.order[full]] = counts[ranks[full]] > 1
    head = last.order[full][np.r_[True, np.diff(ranks[full]) > 0]] if full.any() else last.order[:0]
    first[head] = True
    return twice, first


def engine(blocks: list[list[tuple]]) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """Blocks are worked together: equal windows are in one block, or in blocks that are settled later."""
    parts = [row[1] for rows in blocks for row in rows]
    if not parts:
        return [[] for _ in blocks]
    twice, first = repeated(parts)
    out, at = [], 0
    for rows in blocks:
        done = []
        for _, content, n, copies in rows:
            gone = twice[at : at + n].copy()
            if copies > 1:
                gone[:] = True
            # One of equal windows stands for all of them in other blocks.
            done.append((gone, first[at : at + n] | ~gone))
            at += len(content)
        out.append(done)
    return out


def dedup(docs: DataFrame, texts: bool = False, id_column: str = "doc_id") -> DataFrame:
    """One row a document: its id, size in bytes, n_removed, n_spans, kept_sha256, and kept_text if ``texts``."""
    return remove(docs, RULE, engine, texts, id_column)


def op9_merged_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = dedup(table(spark, sf_dir, "documents"))
    return got.selectExpr("doc_id", "size AS n_bytes", "n_removed", "n_spans", "kept_sha256")
