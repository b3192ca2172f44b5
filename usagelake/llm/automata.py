"""Substring dedup by suffix automata.

The reference of a document are all documents of smaller doc_id.  A corpus of any size has no automaton that can
be broadcast, so :mod:`repeats` first brings together what can match: the candidate pieces of documents that
share anchors.  Each such shard has an automaton over the words of its earlier documents; pieces are streamed
through it in doc_id order.  The matching statistic at a word is the longest suffix ending there that the
references contain; where it reaches the threshold, a window ends.  New text then joins the automaton.

Defined cases: a null or empty text, or one with fewer words than a window, loses nothing; documents of equal
doc_id are no reference to each other; a null doc_id counts as smaller than all others; repeated rows give equal
rows; an empty table gives an empty result.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from usagelake.llm.common import table
from usagelake.llm.repeats import Rule, remove, runs_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Thirteen words; of 7 neighbouring 7-word grams one is the anchor.
RULE = Rule(words=True, length=13, gram=7, run=7, earlier=True, block=150_000)


class Automaton:
    """The suffix automaton of several sequences."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state of the strings that q holds and that are no longer than p's with c."""
        if self.length[p] + 1 == self.length[q]:
            return q
        twin = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = twin
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        return twin

    def add(self, sequence: list[int]) -> None:
        last = 0
        for c in sequence:
            q = self.next[last].get(c)
            if q is not None:
                last = self._split(last, c, q)
                continue
            new = self._state(self.length[last] + 1, 0, {})
            p = last
            while p != -1 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p != -1:
                self.link[new] = self._split(p, c, self.next[p][c])
            last = new

    def statistics(self, sequence: list[int]) -> list[int]:
        """At each place the length of the longest suffix ending there that some added sequence contains."""
        state = size = 0
        out = []
        for c in sequence:
            while state and c not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            to = self.next[state].get(c)
            if to is None:
                size = 0
            else:
                state, size = to, size + 1
            out.append(size)
        return out


def shard(rows: list[tuple], length: int = RULE.length) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each piece (d, content, windows, copies), in order of d: windows that a smaller d has; the others."""
    if len(rows) == 1:
        return [(np.zeros(rows[0][2], bool), np.ones(rows[0][2], bool))]
    names: dict[bytes, int] = {}
    known, out, at = Automaton(), [], 0
    while at < len(rows):
        last = at
        while last < len(rows) and rows[last][0] == rows[at][0]:
            last += 1
        fresh = []
        for _, content, n, _ in rows[at:last]:
            ids = [names.setdefault(w, len(names)) for w in content.split()]
            gone = np.array(known.statistics(ids)[length - 1 :]) >= length
            out.append((gone, ~gone))
            new = runs_of(~gone)
            fresh += [ids[a : b - 1 + length] for a, b in zip(new[::2], new[1::2])]
        for part in fresh:
            known.add(part)
        at = last
    return out


def engine(blocks: list[list[tuple]]) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    return [shard(rows) for rows in blocks]


def dedup(docs: DataFrame, texts: bool = False, id_column: str = "doc_id") -> DataFrame:
    """One row a document: its id, size, n_removed, n_spans, kept_sha256, and kept_text if ``texts``."""
    return remove(docs, RULE, engine, texts, id_column)


def op4_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = dedup(table(spark, sf_dir, "documents"))
    return got.selectExpr("doc_id", "size AS n_words", "n_removed", "kept_sha256", "n_spans")


ORACLE = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), starts AS (
  SELECT doc_id, s, array_to_string(words[s:s + 12], ' ') AS seq
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS s FROM w WHERE len(words) >= 13)
), least AS (
  SELECT seq, min(doc_id) AS least FROM starts GROUP BY seq HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS pos
  FROM starts JOIN least USING (seq) WHERE least < doc_id
), removed AS (
  SELECT doc_id, list(pos ORDER BY pos) AS pos FROM gone GROUP BY doc_id
), kept AS (
  SELECT w.doc_id, words, coalesce(pos, []) AS pos FROM w LEFT JOIN removed USING (doc_id)
)
SELECT doc_id, len(words)::BIGINT AS n_words, len(pos)::BIGINT AS n_removed,
  sha256(array_to_string(list_filter(words, lambda x, i: NOT list_contains(pos, i)), ' ')) AS kept_sha256,
  len(list_filter(pos, lambda x: NOT list_contains(pos, x - 1)))::BIGINT AS n_spans
FROM kept
"""
