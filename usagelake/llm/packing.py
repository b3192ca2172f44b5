"""Packing documents into training sequences: shortest pack first over the histogram of lengths.

1. Tasks tokenise documents and cut them every ``size`` ids: full pieces and one rest per document.  Only the
   place, length and checksum of a piece go on; ids and texts never move.
2. The histogram of piece lengths has at most ``size`` rows whatever the corpus, and goes to the driver.  There
   lengths are placed longest first.  All packs of equal content are one counted pattern; a length goes to the
   emptiest pattern it fits, which splits where counts differ, and opens a new one where it fits nowhere.
3. Patterns are joined back to pieces by (length, rank among the pieces of that length): an interval of ranks
   fills one slot of one pattern.  There are no more intervals than lengths times slots, so they are broadcast.

Ranks of a length that holds a third of all pieces are dealt to buckets (:func:`common.dealt_rank`).

Defined cases: a null or empty text is the one id of the end mark; repeated rows are documents of their own
(equal pieces, different places); an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
import sys
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelake.llm.common import dealt_rank, keep, table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SIZE = 2048
END = 1
TOKENIZER = "byte_bpe_50k"
PIECES = "start long, length long, ids_crc32 long, doc_tokens long"
#: Words whose ids a task remembers.
REMEMBERED = 400_000


def tokenizer_path(name: str = f"{TOKENIZER}.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Ids(dict):
    """Ids of a stretch between blanks, as little-endian 32-bit bytes; the least recent half is forgotten when full."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.code = tiktoken.Encoding(
            "bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary

    def __missing__(self, part: str) -> bytes:
        import array

        ids = array.array("I", self.code(part))
        if sys.byteorder == "big":
            ids.byteswap()
        if len(self) >= REMEMBERED:
            for old in list(self)[: REMEMBERED // 2]:
                del self[old]
        self[part] = got = ids.tobytes()
        return got


#: No token holds the start of " x" in its middle when x is a letter, digit or mark, so a text may be cut there.
_ODD = re.compile(r" (?![\w!-~])")
_CUT = re.compile(r" (?=[\w!-~])")


def ids_of(text: str, known: _Ids) -> bytes:
    parts = _CUT.split(text) if _ODD.search(text) else text.split(" ")
    return b"".join([known[parts[0]], *map(known.__getitem__, map(" ".__add__, parts[1:]))])


def _pieces(batches: Iterable, path: str, size: int, end: int) -> Iterator:
    import pyarrow as pa

    known, close = None, end.to_bytes(4, "little")
    names = [part.split()[0] for part in PIECES.split(", ")]
    for batch in batches:
        known = known or _Ids(path)
        at, rows = [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            raw = memoryview(ids_of(text or "", known) + close)
            n = len(raw) // 4
            for start in range(0, n, size):
                part = raw[4 * start : 4 * (start + size)]
                at.append(i)
                rows.append((start, len(part) // 4, zlib.crc32(part), n))
        others = [n for n in batch.schema.names if n != "text"]
        columns = zip(*rows) if rows else [[]] * len(names)
        index = pa.array(at, pa.int64())
        arrays = [batch.column(n).take(index) for n in others] + [pa.array(c, pa.int64()) for c in columns]
        yield pa.RecordBatch.from_arrays(arrays, names=others + names)


def pieces(docs: DataFrame, keys: Sequence[str], path: str, size: int = SIZE, end: int = END) -> DataFrame:
    """``keys`` and, for each piece of a document, start, length, ids_crc32 and doc_tokens."""
    slim = docs.select(*keys, "text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name != "text")
    return slim.mapInArrow(lambda batches: _pieces(batches, path, size, end), f"{fields}, {PIECES}")


def patterns(histogram: dict[int, int], size: int = SIZE) -> list[tuple[list[int], int]]:
    """(lengths in order, number of sequences) of each pattern, by shortest pack first."""
    room: dict[int, list[tuple[tuple, int]]] = defaultdict(list)  # free ids -> (pattern as nested pairs, count)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        fits = [r for r in range(size, length - 1, -1) if room.get(r)]
        put: list[tuple[int, tuple, int]] = []
        while left:
            while fits and not room[fits[0]]:
                fits.pop(0)
            if not fits:
                # No open pack takes it.  Packs filled in this turn come first, the emptiest of them too.
                again = [p for p in put if p[0] >= length]
                if not again:
                    put.append((size - length, ((), length), left))
                    break
                put = [p for p in put if p[0] < length]
                for free, pattern, count in again:
                    room[free].append((pattern, count))
                fits = sorted({p[0] for p in again}, reverse=True)
                continue
            free = fits[0]
            pattern, count = room[free].pop()
            used = min(count, left)
            if used < count:
                room[free].append((pattern, count - used))
            put.append((free - length, (pattern, length), used))
            left -= used
        for free, pattern, count in put:
            room[free].append((pattern, count))
    out = []
    for group in room.values():
        for pattern, count in group:
            lengths = []
            while pattern:
                pattern, length = pattern
                lengths.append(length)
            out.append((lengths[::-1], count))
    return out


def slots(found: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, sequence of the first rank, offset) of each slot of each pattern."""
    taken: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for lengths, count in found:
        offset = 0
        for length in lengths:
            rows.append((length, taken[length], taken[length] + count, sequence, offset))
            taken[length] += count
            offset += length
        sequence += count
    return rows


def pack(
    docs: DataFrame, keys: Sequence[str] = ("doc_id",), path: str | None = None, size: int = SIZE, end: int = END
) -> DataFrame:
    """One row a piece: ``keys``, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    cut = keep(pieces(docs, keys, path or tokenizer_path(), size, end))
    counts = cut.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most ``size`` rows
    plan = slots(patterns({r["length"]: r["n"] for r in counts}, size))
    where = spark.createDataFrame(plan, "_length long, _from long, _to long, _sequence long, offset long")
    ranked = dealt_rank(cut, ["length"], [*keys, "start", "ids_crc32"], "_rank")
    here = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    return ranked.join(F.broadcast(where), here).select(
        *keys, "start", "length", "ids_crc32", "doc_tokens",
        (F.col("_sequence") + F.col("_rank") - F.col("_from")).alias("sequence_id"), "offset",
    )


def op1_shortest_pack_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
