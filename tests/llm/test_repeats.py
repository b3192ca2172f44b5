"""Substring dedup over words and bytes against brute force."""

import hashlib
import random
from collections import Counter, defaultdict
from dataclasses import replace

import numpy as np
import pytest

from usagelake.llm import automata, repeats, transforms


def _frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, d string")


def _words(rows, n):
    least = {}
    for doc, text in rows:
        words = (text or "").encode().split()
        for s in range(len(words) - n + 1):
            key, d = tuple(words[s : s + n]), -(2**63) if doc is None else doc
            least[key] = min(least.get(key, d), d)
    out = []
    for doc, text in rows:
        words, gone = (text or "").encode().split(), set()
        d = -(2**63) if doc is None else doc
        for s in range(len(words) - n + 1):
            if least[tuple(words[s : s + n])] < d:
                gone.update(range(s, s + n))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((doc, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def _bytes(rows, n):
    seen = Counter()
    for _, text in rows:
        raw = (text or "").encode()
        seen.update(raw[s : s + n] for s in range(len(raw) - n + 1))
    out = []
    for doc, text in rows:
        raw, gone = (text or "").encode(), set()
        for s in range(len(raw) - n + 1):
            if seen[raw[s : s + n]] > 1:
                gone.update(range(s, s + n))
        kept = bytes(c for k, c in enumerate(raw) if k not in gone)
        out.append((doc, len(raw), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def _made(seed, alphabet, sizes, glue):
    rng = random.Random(seed)
    stock = [[rng.choice(alphabet) for _ in range(rng.randint(1, 60))] for _ in range(12)]
    rows = []
    for doc in range(80):
        parts = []
        for _ in range(rng.randint(0, 5)):
            part = rng.choice(stock) if rng.random() < 0.4 else [rng.choice(alphabet) for _ in range(rng.randint(1, sizes))]
            cut = rng.randint(0, len(part))
            parts += part[cut:] if rng.random() < 0.5 else part
        rows.append((doc if doc % 17 else None, glue.join(parts)))
    return rows + [(3, None), (200, ""), (5, rows[5][1]), rows[7], rows[7], (201, glue.join(["x"] * 700))]


def _got(frame):
    return sorted(((r[0], r["size"], r.n_removed, r.kept_sha256) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("block", [150_000, 60])
def test_words(spark, block):
    rule = replace(automata.RULE, block=block)
    rows = _made(1, [f"w{k}" for k in range(40)], 50, " ")
    got = repeats.remove(_frame(spark, [(*r, "x") for r in rows]), rule, automata.engine)
    assert _got(got) == sorted(_words(rows, 13), key=repr)


@pytest.mark.parametrize("block", [4_000_000, 300])
def test_bytes(spark, monkeypatch, block):
    rule = repeats.Rule(words=False, length=20, gram=5, run=7, earlier=False, block=block)
    rows = _made(2, "abé ", 60, "")

    def engine(blocks):
        out = []
        for rows in blocks:
            if not rows:
                out.append([])
                continue
            twice, first = transforms.repeated([r[1] for r in rows], 20, 64)
            done, at = [], 0
            for _, content, n, copies in rows:
                gone = twice[at : at + n] | (copies > 1)
                done.append((gone, first[at : at + n] | ~gone))
                at += len(content)
            out.append(done)
        return out

    got = repeats.remove(_frame(spark, [(*r, "x") for r in rows]), rule, engine)
    assert _got(got) == sorted(_bytes(rows, 20), key=repr)


def test_bytes_as_registered(spark):
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdef ") for _ in range(900))
    noise = lambda: "".join(rng.choice("abcdefghij ") for _ in range(rng.randint(0, 700)))
    rows = [(k, noise() + (passage[k : k + 500] if k % 3 else "") + noise()) for k in range(40)]
    assert _got(transforms.dedup(_frame(spark, [(*r, "x") for r in rows]))) == sorted(_bytes(rows, 400), key=repr)


def test_texts_keep_their_layout(spark):
    shared = " ".join(f"s{k}" for k in range(13))
    rows = [(1, f"a\n{shared}\nb"), (2, f"c  d\n{shared} \n e\n"), (3, "plain  text\n")]
    got = {r.doc_id: r.kept_text for r in automata.dedup(_frame(spark, [(*r, "x") for r in rows]), texts=True).collect()}
    assert got == {1: rows[0][1], 2: "c  d\ne\n", 3: rows[2][1]}


def test_empty(spark):
    empty = _frame(spark, [])
    assert automata.dedup(empty).collect() == [] and transforms.dedup(empty).collect() == []


def test_transform_of_merged_shards_is_that_of_the_whole():
    rng = random.Random(3)
    parts = [bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randint(1, 50))) for _ in range(9)]
    whole = transforms.sort(parts, 400)
    merged, _ = transforms.merge(transforms.sort(parts[:4], 400), transforms.sort(parts[4:], 400), 400)
    text = b"".join(parts)
    ends = np.repeat(np.cumsum([len(p) for p in parts]), [len(p) for p in parts])
    assert [text[p : ends[p]] for p in merged.order] == sorted(text[p : ends[p]] for p in range(len(text)))
    assert bytes(merged.transform) == bytes(whole.transform)


def test_automaton_statistics():
    rng = random.Random(9)
    known, stock = automata.Automaton(), []
    for _ in range(5):
        part = [rng.randint(0, 3) for _ in range(30)]
        known.add(part)
        stock.append(part)
    inside = {tuple(p[a:b]) for p in stock for a in range(30) for b in range(a, 31)}
    query = [rng.randint(0, 4) for _ in range(60)]
    want = [max(n for n in range(k + 2) if tuple(query[k + 1 - n : k + 1]) in inside) for k in range(60)]
    assert known.statistics(query) == want


def test_anchors_of_equal_windows_agree():
    rng = np.random.RandomState(1)
    text = rng.randint(0, 3, 500).astype(np.uint64)
    rule = repeats.Rule(True, 13, 7, 7, True, 1)
    inner = defaultdict(set)
    for at in (0, 17, 100):
        value, first, end = repeats.anchors(text[at : at + 200], rule)
        for v, a, b in zip(value, first, end):
            for run in range(a, b):
                inner[run + at].add(int(v))
    assert all(len(v) == 1 for run, v in inner.items())
