"""Best partners at crowded instants, compared in Arrow batches.

Spark puts the signatures of one group and instant side by side (callers bound how many that may be); a task walks
over its instants and compares each one's probes with its members by small integer codes, some probes at a time.
Nothing of a pair leaves the task: a probe gets one row, or the names of the sets its partners are filed under.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Pairs that are compared at once.
PAIRS = 1 << 20

BEST = "sig binary, lo string, hi string, matches int, same_model boolean"
MEMBERS = "b_sig binary"
SETS = "sig binary, b_sig binary, set_id string"


class Instant:
    """The probes and members of one instant, as codes."""

    def __init__(self, rows: dict[str, list], fields: tuple[str, ...]) -> None:
        member = np.array(rows["member"], dtype=bool)
        self.p, self.m = np.flatnonzero(~member), np.flatnonzero(member)
        self.rows, self.fields = rows, fields
        self.codes = []
        for place, name in enumerate(fields):
            codes = _codes(rows[name])
            mine, theirs = codes[self.p], codes[self.m]
            if (mine >= 0).any() and (theirs >= 0).any():
                # Missing values are equal to nothing.
                self.codes.append((place, mine, np.where(theirs < 0, -2, theirs)))
        models = _codes([m or None for m in rows["model"]])
        self.p_model, self.m_model = models[self.p], models[self.m]
        # Members in the order of their least and greatest ids.
        for name in ("lo", "hi"):
            order = sorted(range(len(self.m)), key=lambda i: rows[name][self.m[i]], reverse=name == "hi")
            setattr(self, name, np.array(order, dtype=np.int64))

    def compared(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Probes, their best scores (-1: none), and which members are best for each."""
        step = max(1, PAIRS // max(1, len(self.m)))
        wanted = self.rows["want"]
        for start in range(0, len(self.p) if len(self.m) else 0, step):
            at = slice(start, min(start + step, len(self.p)))
            equal = np.zeros((at.stop - at.start, len(self.m)), dtype=np.int8)
            for _, mine, theirs in self.codes:
                equal += mine[at, None] == theirs[None, :]
            model = self.p_model[at, None]
            same = (model == self.m_model[None, :]) & (model >= 0)
            blank = (model < 0) | (self.m_model[None, :] < 0)
            score = np.where(same | (blank & (equal > 0)), equal * 2 + same, -1)
            want = [wanted[i] for i in self.p[at]]
            best = score.max(axis=1) if want[0] is None else np.array(want, dtype=np.int64)
            yield at, best, (score == best[:, None]) & (best[:, None] >= 0)

    def set_id(self, probe: int, mask: int, label: str) -> str:
        values = ["" if not mask >> k & 1 else str(self.rows[f][probe]) for k, f in enumerate(self.fields)]
        return "|".join(["f:", self.rows["_group"][probe], str(self.rows["at"][probe]), str(mask), *values, label])


def _codes(values: list) -> np.ndarray:
    """Equal numbers for equal values, -1 for missing ones."""
    known: dict = {}
    return np.array([-1 if v is None else known.setdefault(v, len(known)) for v in values], dtype=np.int32)


def _best(now: Instant) -> Iterator[tuple]:
    sigs, los, his = (now.rows[n] for n in ("sig", "lo", "hi"))
    for at, best, chosen in now.compared():
        first, last = chosen[:, now.lo].argmax(axis=1), chosen[:, now.hi].argmax(axis=1)
        for i in np.flatnonzero(best >= 0):
            yield (sigs[now.p[at.start + i]], los[now.m[now.lo[first[i]]]], his[now.m[now.hi[last[i]]]],
                   int(best[i]) // 2, bool(best[i] % 2))


def _members(now: Instant) -> Iterator[tuple]:
    met = np.zeros(len(now.m), dtype=bool)
    for _, _, chosen in now.compared():
        met |= chosen.any(axis=0)
    for i in np.flatnonzero(met):
        yield (now.rows["sig"][now.m[i]],)


def _sets(now: Instant) -> Iterator[tuple]:
    """Each probe with its sets, and each set once with its members."""
    spelled: set[str] = set()
    for at, _, chosen in now.compared():
        for i in range(len(chosen)):
            probe, j = now.p[at.start + i], np.flatnonzero(chosen[i])
            mask = np.zeros(len(j), dtype=np.int64)
            for place, mine, theirs in now.codes:
                mask |= (mine[at.start + i] == theirs[j]).astype(np.int64) << place
            model = now.p_model[at.start + i]
            named = "any" if model < 0 else "=" + now.rows["model"][probe]
            blank = (model >= 0) & (now.m_model[j] < 0)
            for value in sorted(set(zip(mask.tolist(), blank.tolist()))):
                name = now.set_id(probe, value[0], "blank" if value[1] else named)
                yield now.rows["sig"][probe], None, name
                if name not in spelled:
                    spelled.add(name)
                    for k in j[(mask == value[0]) & (blank == value[1])]:
                        yield None, now.rows["sig"][now.m[k]], name


KINDS: dict[str, tuple[Callable, str]] = {"best": (_best, BEST), "members": (_members, MEMBERS), "sets": (_sets, SETS)}


def by_instant(kind: str, fields: tuple[str, ...]) -> Callable:
    """For rows sorted by (group, instant): what ``kind`` says of each instant."""
    answer, shape = KINDS[kind]
    names = [f.split()[0] for f in shape.split(", ")]

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        types = {"binary": pa.binary(), "string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
        kinds = [types[f.split()[1]] for f in shape.split(", ")]
        out: list[tuple] = []

        def made() -> pa.RecordBatch:
            columns = zip(*out) if out else [()] * len(names)
            batch = pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)
            out.clear()
            return batch

        held: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            at, group = batch.column("at").to_pylist(), batch.column("_group").to_pylist()
            start = 0
            for i in range(len(at)):
                first = (held[-1]["at"][-1], held[-1]["_group"][-1]) if not i and held else (at[i - 1], group[i - 1]) if i else None
                if first is not None and first != (at[i], group[i]):
                    if i > start:
                        held.append(batch.slice(start, i - start).to_pydict())
                    out.extend(answer(Instant(_joined(held), fields)))
                    held, start = [], i
                    if len(out) > 20_000:
                        yield made()
            held.append(batch.slice(start).to_pydict())
        if held:
            out.extend(answer(Instant(_joined(held), fields)))
        yield made()

    return run


def _joined(parts: list[dict[str, list]]) -> dict[str, list]:
    if len(parts) == 1:
        return parts[0]
    return {name: [v for part in parts for v in part[name]] for name in parts[0]}
