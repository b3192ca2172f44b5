"""Word and window hashes that workers compute with numpy, and runs of equal keys.

Equal input gives equal hashes in every process.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: An odd multiplier for polynomials modulo 2**64.
BASE = 0x9E3779B97F4A7C15
#: Words that a task remembers.
REMEMBERED = 1_000_000


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered up to a bound; forgetting costs time, not results."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = got = xxhash.xxh3_64_intdigest(word)
        return got

    def of(self, words: Sequence[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """One hash for each run of ``n`` neighbours, in order; none if there are fewer than ``n``."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    # Runs of powers of two by doubling, put together by the binary digits of n.
    power, run, done, out = 1, hashes, 0, None
    scale = BASE
    total = len(hashes) - n + 1
    while True:
        if n & power:
            part = run[done : done + total]
            out = part.copy() if out is None else out * np.uint64(scale) + part
            done += power
        if done == n:
            return mixed(out)
        run = run[:-power] * np.uint64(scale) + run[power:]
        scale = scale * scale % 2**64
        power *= 2


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every bit of the input over all bits of the output (one to one)."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """The set of ``n``-word shingles, sorted; a shorter text that has a word is one shingle of all its words."""
    return np.unique(windows(hashes, min(n, len(hashes)))) if len(hashes) else np.empty(0, np.uint64)


def groups(batches: Iterable, keys: list[str]) -> Iterator[dict[str, list]]:
    """Columns of each run of equal keys of a sorted partition, also where it spans batches."""
    held, now = None, None
    for batch in batches:
        columns = {n: batch.column(n).to_pylist() for n in batch.schema.names}
        marks = list(zip(*(columns[k] for k in keys)))
        start = 0
        for at in range(1, len(marks) + 1):
            if at < len(marks) and marks[at] == marks[start]:
                continue
            part = {n: c[start:at] for n, c in columns.items()}
            if held is not None and now == marks[start]:
                for n, c in part.items():
                    held[n] += c
            else:
                if held is not None:
                    yield held
                held, now = part, marks[start]
            start = at
    if held is not None:
        yield held
