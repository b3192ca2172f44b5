"""Classifier, hard negatives and collocations against brute force, held-out rows and awkward tables."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from usagelake.llm import classifier, common, negatives, phrases
from usagelake.llm.hashing import WordHashes

EXTRA = ", size string, rank int, label_ string, row string, _id int, score string, h long, grp int"
MORE = ("z", 1, "q", "r", 2, "s", 3, 4)


def _frame(spark, rows, schema, parts=3):
    return common.keep(spark.createDataFrame(rows, schema).repartition(parts))


# ------------------------------------------------------------------------- classifier

def _documents():
    rng = random.Random(3)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    rows, labels = [], []
    for k in range(400):
        good = k % 3 > 0
        if good:
            text = "\n".join(prose(rng.randint(8, 40)) for _ in range(rng.randint(1, 5)))
        else:
            text = " ".join(rng.choice((w + "$$$", w.upper() + "!!", f"{w} {w} {w}", w + " |")) for w in prose(rng.randint(10, 80)).split())
        rows.append((k, text))
        labels.append((k, int(good), 0))
    rows += [(None, "a b c"), (1000, None), (1001, ""), (1002, " \n\t"), (1003, "x" * 3_000_000), (1004, prose(300_000)), rows[1], rows[1]]
    # Contradicting, missing and foreign labels count nothing.
    labels += [(2, 0, 0), (4, None, 0), (5, 7, 0), (None, 0, 0), (99999, 1, 0), (7, 1, 0)]
    return rows, labels


def test_scores_of_held_out_rows(spark):
    rows, labels = _documents()
    docs = _frame(spark, [r + MORE for r in rows], "doc_id long, text string" + EXTRA)
    marks = _frame(spark, labels, "doc_id long, quality int, toxic int")
    run = lambda d, m: classifier.classify(d, m, "quality", ~classifier.held_out(), 48)
    got = run(docs, marks).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 400 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 60
    assert sum((r.score >= 0.7) == (r.doc_id % 3 > 0) for r in held) >= 0.97 * len(held)
    assert len({r.score for r in got if r.doc_id == 1}) == 1
    # However the rows are dealt, the scores are the same.
    again = run(docs.repartition(7), marks.repartition(5)).collect()
    assert sorted((str(r.doc_id), r.score) for r in again) == sorted((str(r.doc_id), r.score) for r in got)
    # Labels of held-out rows are never read.
    lies = marks.withColumn("quality", F.when(classifier.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted((str(r.doc_id), r.score) for r in run(docs, lies).collect()) == sorted((str(r.doc_id), r.score) for r in got)


def test_few_labels_and_empty_tables(spark):
    docs = _frame(spark, [(k, f"some words {k}") for k in range(9)], "doc_id long, text string")
    schema = "doc_id long, quality int"
    run = lambda d, m: [r.score for r in classifier.classify(d, m, "quality", F.lit(True), 16).collect()]
    assert run(docs, spark.createDataFrame([], schema)) == [0.5] * 9
    assert run(docs, spark.createDataFrame([(1, 1), (2, 1)], schema)) == [1.0] * 9
    assert run(docs, spark.createDataFrame([(1, 0)], schema)) == [0.0] * 9
    assert run(docs.limit(0), spark.createDataFrame([(1, 0)], schema)) == []


def test_equations_are_the_sums_of_the_features(spark):
    rng = np.random.default_rng(1)
    stats = rng.integers(0, 3000, (90, len(classifier.STATISTICS)))
    fold, label = rng.integers(0, classifier.FOLDS, 90), rng.integers(0, 2, 90)
    rows = _frame(spark, [(int(f), int(y), [int(v) for v in s]) for f, y, s in zip(fold, label, stats)], "fold int, label int, stats array<int>")
    scale = classifier.scaled(rows)
    np.testing.assert_allclose(scale.mean, stats.mean(0))
    got = classifier.normal_equations(rows, scale, 12)
    for k, width in enumerate(classifier.WIDTHS):
        z = classifier.features(stats.astype(float), scale, width, 12) / classifier.GRAIN
        for f in range(classifier.FOLDS):
            own = z[fold == f]
            np.testing.assert_array_equal(got[k, f], np.column_stack([own.T @ own, own.T @ label[fold == f]]))


def test_features_approximate_the_kernel():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((40, len(classifier.STATISTICS)))
    scale = classifier.Scale(np.zeros(x.shape[1]), np.ones(x.shape[1]))
    z = classifier.features(x, scale, 1.0, 20_000)[:, :-1] / classifier.GRAIN
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / (2 * x.shape[1]))
    assert np.abs(2 * z @ z.T / 20_000 - kernel).max() < 0.05


@pytest.mark.parametrize("seed", range(4))
def test_calibration_is_the_best_rising_fit(seed):
    rng = random.Random(seed)
    bins = [(k, n := rng.randint(1, 5), rng.randint(0, n)) for k in range(0, 60, rng.randint(1, 4))]
    edges, values = classifier.pooled(bins)
    assert all(a < b for a, b in zip(edges, edges[1:])) and all(a <= b for a, b in zip(values, values[1:]))
    at = np.interp([(k + 0.5) * 3 / classifier.BINS - 1 for k, _, _ in bins], edges, values)
    # Least squares over rising fits: for each bin the greatest of least means over the stretches around it.
    mean = lambda i, j: sum(b[2] for b in bins[i : j + 1]) / sum(b[1] for b in bins[i : j + 1])
    want = [max(min(mean(i, j) for j in range(k, len(bins))) for i in range(k + 1)) for k in range(len(bins))]
    np.testing.assert_allclose(at, want)


def test_statistics_of_junk_stand_out():
    at = dict(zip(classifier.STATISTICS, itertools.count()))
    plain = classifier.statistics("A plain line of words.\nAnother one, as plain.", WordHashes())
    assert plain[at["worst_symbols"]] == plain[at["worst_stutter"]] == plain[at["wordless"]] == 0
    junk = classifier.statistics("so so so | BUY!! NOW!! $$$ ###", WordHashes())
    assert all(junk[at[name]] > 0 for name in ("worst_symbols", "worst_shouted", "worst_bars", "worst_stutter", "wordless"))
    assert not classifier.statistics("", WordHashes()).any() and not classifier.statistics(" \n "[:2], WordHashes()).any()


# --------------------------------------------------------------------- hard negatives

def _vectors(seed, n=700, dim=12):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(4)]
    rows = []
    for k in range(n):
        c = rng.choice(centres)
        rows.append((k, rng.randint(0, 3), [float(round(8 * (x + rng.gauss(0, 0.7)))) for x in c]))
    # A third of all rows has one vector; ties; zeros; other lengths; rows that take no part.
    rows += [(n + k, k % 3, rows[5][2]) for k in range(n // 2)]
    rows += [(5000 + k, k % 2, [0.0] * dim) for k in range(101)] + [(6000 + k, k % 2, [1.0, 2.0]) for k in range(0, 300, 50)]
    rows += [(6400, 1, []), (6401, 1, []), (6402, 0, []), (None, 1, rows[7][2]), (None, 2, rows[7][2])]
    bad = [(7000, None, rows[0][2]), (7100, 1, None), (7200, 1, [None] * dim), (7300, 1, [math.nan] * dim), (7400, 1, [math.inf] * dim)]
    return rows, bad


def _negatives(rows, step, positives, most):
    out = []
    last = lambda i: (i is None, i)
    rows = [(i, l, [int(x) for x in v]) for i, l, v in rows]
    for p, (i, label, v) in enumerate(rows):
        if i is None or i % step:
            continue
        scored = [(-sum(map(int.__mul__, v, w)), last(j), m) for q, (j, m, w) in enumerate(rows) if q != p and len(w) == len(v)]
        for s, j, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            fit = sorted(x for x in scored if x[2] != label and -30 * s <= -100 * x[0] <= -90 * s)
            out += [(i, j[1], rank + 1, x[1][1], -s, -x[0]) for rank, x in enumerate(fit[:most])]
    return Counter(out)


@pytest.mark.parametrize("block", [40, 4096])
def test_negatives(spark, block):
    rows, bad = _vectors(block)
    full = _frame(spark, [(*r, *MORE) for r in rows + bad], "vec_id long, label int, vector array<double>" + EXTRA, 4)
    got = negatives.mine(negatives.rows_of(full, "vec_id", F.col("label"), F.col("vector")), negatives.percent_window, 50, block=block)
    assert Counter(map(tuple, got.collect())) == _negatives(rows, 50, 5, 10)
    nothing = negatives.mine(negatives.rows_of(full.limit(0), "vec_id", F.col("label"), F.col("vector")), negatives.percent_window)
    assert nothing.collect() == []


def test_bounds_hold_every_score():
    rng = np.random.default_rng(4)
    for scale in (1, 300):
        v = np.rint(rng.standard_normal((200, 6)) * scale).astype(np.int64)
        v[:3], v[3:6] = 0, v[6:9]
        norms = np.sqrt((v.astype(float) ** 2).sum(1))
        ref = v[10:20] / np.maximum(norms[10:20], 1)[:, None]
        ref /= np.maximum(np.linalg.norm(ref, axis=1), 1e-9)[:, None]
        angles = negatives._angles(v, norms, ref)
        scores = v @ v.T
        for size in (1, 7):
            for at in range(0, 200, size):
                t = slice(at, at + size)
                down, up = negatives.bounds(angles, norms, angles[t].min(0), angles[t].max(0), norms[t].min(), norms[t].max())
                assert (scores[:, t] >= down[:, None]).all() and (scores[:, t] <= up[:, None]).all()
        # A row in the direction of a reference is bounded closely.
        down, up = negatives.bounds(angles, norms, angles[10], angles[10], norms[10], norms[10])
        assert (up - down <= 2 * (norms * norms[10] * negatives.SLACK + 1) + 1e-6 * norms * norms[10]).all()


def test_tiles_are_skipped_where_data_are_clustered(monkeypatch):
    rng = np.random.default_rng(5)
    m = np.rint(np.concatenate([rng.normal(c, 2, (600, 8)) for c in (np.eye(8)[0] * 200, np.eye(8)[3] * 200)])).astype(np.int64)
    norms = np.sqrt((m.astype(float) ** 2).sum(1))
    angles = negatives._angles(m, norms, np.eye(8))
    rows = negatives.Rows(np.arange(1200), np.zeros(1200, bool), np.zeros(1200, np.int64), m, angles, norms, np.arange(1200))
    seen = []
    real = negatives._product
    monkeypatch.setattr(negatives, "_product", lambda a, b: seen.append(len(a) * len(b)) or real(a, b))
    monkeypatch.setattr(negatives, "TILE", 100)
    anchors = rows.take(slice(0, 50))
    best = negatives.best_positives(anchors, np.full(50, negatives.NONE), rows, 5)
    want = [sorted((-int(m[a] @ m[b]), b) for b in range(1200) if a != b)[:5] for a in range(50)]
    assert [(-s, i) for s, i in zip(*best.settle()[1:3])] == [x for w in want for x in w]
    assert sum(seen) < 0.6 * 50 * 1200


def test_large_components_are_exact():
    a = np.array([[2**30, 3], [-(2**31), 7]], np.int64)
    assert negatives._product(a, a).tolist() == [[2**60 + 9, -(2**61) + 21], [-(2**61) + 21, 2**62 + 49]]


# ----------------------------------------------------------------------- collocations

def _texts():
    rng = random.Random(6)
    words = ["of", "The", "é", "New", "YORK", "a.b", "ÄÖ", "x y", "-"] + [f"w{k}" for k in range(12)]
    rows = []
    for k in range(120):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", " ", ". ", "\n", ",", "\x0b", "\r\n"]) for _ in range(rng.randint(0, 90)))
        rows.append((k, text, ["en", None, "de", "und"][k % 4]))
    rows += [(200 + k, "New York City hall of The New York City", "en") for k in range(30)]  # a common passage
    rows += [(300, None, "en"), (301, "", None), (302, " \t.,", "xx"), (303, "rare " * 9, "yy"), (304, "of the " * 9000, "de"), rows[3], rows[3], (None, "of the", "en")]
    return rows


def _collocations(rows, least=10, inside=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in found.items()):
                continue
            cuts = [(1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            s, k = min(cuts)
            rows.append((-s, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, r[2].decode(), -r[1], r[3], r[4], n[lang], -r[0]) for i, r in enumerate(sorted(rows)[:top])]
    return Counter(out)


@pytest.mark.parametrize("budget, stretch", [(phrases.BUDGET, phrases.STRETCH), (40, 700), (400, 3000)])
def test_collocations(spark, monkeypatch, budget, stretch):
    monkeypatch.setattr(phrases, "STRETCH", stretch)
    rows = _texts()
    docs = _frame(spark, [(*r, *MORE) for r in rows], "doc_id long, text string, lang string" + EXTRA)
    assert Counter(map(tuple, phrases.collocations(docs, budget=budget).collect())) == _collocations(rows)


def test_limits_of_collocations(spark):
    rows = _texts()
    docs = _frame(spark, rows, "doc_id long, text string, lang string")
    assert Counter(map(tuple, phrases.collocations(docs, 3, 80, 7).collect())) == _collocations(rows, 3, 80, 7)
    assert phrases.collocations(docs.limit(0)).collect() == []
    assert phrases.collocations(docs.where("doc_id = 302")).collect() == []


def test_buckets_fill_groups_to_the_budget(spark):
    rng = random.Random(8)
    rows = [(rng.getrandbits(62) - 2**61, rng.randint(1, 60)) for _ in range(900)] + [(3, 500)]
    group = phrases._grouped(spark.createDataFrame(rows, "h long, n long"), 64, 1000)
    weight, each = Counter(), Counter()
    for h, n in rows:
        weight[int(group[h % 64])] += n
        each[h % 64] += n
    assert (np.diff(group) >= 0).all() and (np.diff(group) <= 1).all()
    assert all(w <= 1000 or max(v for k, v in each.items() if group[k] == g) > 1000 for g, w in weight.items())
    assert len(weight) <= 2 * sum(weight.values()) / 1000 + 1


def test_exact_scores_past_64_bits(spark):
    a = 3_000_000_019
    row = spark.range(1).select(phrases._score(F.lit(a), F.lit(a + 7), F.lit(a + 11)).alias("s")).head()
    assert row.s == 1_000_000 * a * a // ((a + 7) * (a + 11))
