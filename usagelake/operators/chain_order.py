"""The sequential rule of chains, for groups of calls that share no lineage with others.

Python because each decision depends on all before it.  A task walks over rows sorted by group and time and holds the
last calls of one group's chains only; a context is compared with live ones filed under one of its own hashes.
"""

from __future__ import annotations

import sys
from collections import defaultdict
from collections.abc import Iterable, Iterator

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LABELS = "n long, parent long, torn boolean"


class Live:
    """The last calls of a group's chains, found by what they offer."""

    def __init__(self) -> None:
        self.calls: dict[int, dict] = {}
        self.by_key: dict[tuple[str, str], set[int]] = defaultdict(set)

    def _keys(self, call: dict) -> Iterator[tuple[str, str]]:
        if call["response_id"]:
            yield "id", call["response_id"]
        for t in call["tool_offers"] or ():
            if t:
                yield "tool", t
        if call["filed"] is not None:
            yield "hash", call["filed"]

    def put(self, call: dict) -> None:
        call["held"] = set(call["lineage"])
        self.calls[call["n"]] = call
        for key in self._keys(call):
            self.by_key[key].add(call["n"])

    def drop(self, n: int) -> None:
        for key in self._keys(self.calls.pop(n)):
            self.by_key[key].discard(n)

    def leading_to(self, call: dict) -> set[int]:
        """At most two of the live calls that ``call`` could continue: two are already too many."""
        found: set[int] = set()
        asked = [("tool", t) for t in call["tool_asks"] or () if t] + [("hash", h) for h in call["lineage"]]
        if call["previous_response_id"]:
            asked.insert(0, ("id", call["previous_response_id"]))
        have = set(call["lineage"])
        for key in asked:
            for n in self.by_key.get(key, ()):
                last = self.calls[n]
                if n in found or (last["model"] and call["model"] and last["model"] != call["model"]):
                    continue
                if key[0] == "hash" and not last["held"] < have:
                    continue
                found.add(n)
                if len(found) > 1:
                    return found
        return found


def in_order(batches: Iterable) -> Iterator:
    """Labels of calls from rows sorted by (root, n)."""
    import pyarrow as pa

    group, live = None, Live()
    for batch in batches:
        rows = []
        for call in batch.to_pylist():
            if call["comp"] != group:
                group, live = call["comp"], Live()
            found = live.leading_to(call)
            parent = next(iter(found)) if len(found) == 1 else None
            rows.append((call["n"], parent, len(found) > 1))
            if parent is not None:
                live.drop(parent)
            if parent is not None or (not found and call["start_shape"]):
                live.put(call)
        kinds = pa.int64(), pa.int64(), pa.bool_()
        columns = zip(*rows) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["n", "parent", "torn"])
