"""Main text of web pages by a linear-chain conditional random field over the leaf blocks of the DOM.

A leaf block is a run of text between block-level tags.  Its features are the tags and the class and id names of
its ancestors and some facts of its text: length, links, punctuation, telling words.  The field scores each
block, and each step between neighbours, apart for neighbours of one parent and of two; Viterbi's path
tells main text from the rest.

It is trained by gradient ascent on the likelihood of labelled pages: a bounded sample of ``SAMPLE`` pages that
mark their main text themselves (``article`` or ``main``), and ``LAYOUTS`` other layouts of each, in which the same
blocks stand in other containers and among other furniture, so that no single tag is what is learnt.  Where fewer
pages mark their main text, unmarked ones fill the sample: of these the prose is set in such layouts, and their own
layout teaches nothing.

Pages are independent rows: no shuffle, and the model is a few thousand numbers.

Defined cases: a null or empty page has an empty text; broken markup is read as browsers do, roughly: unclosed
paragraphs end where the next begins, stray end tags mean nothing, and an unfinished tag is dropped; repeated rows
get equal texts; an empty table gives an empty result; a table without any marked page is learnt from layouts alone.
Text of ``math``, ``object`` and ``noscript`` is text like other; a formula does not end its sentence, nor does what
stands for an ``object`` or, in a paragraph, for a script.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
import sys
from collections.abc import Iterable, Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelake.llm.common import table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE = 200
LAYOUTS = 5
ROUNDS = 10
RATE = 0.3
DECAY = 1e-3
PROSE = 12

#: Elements of HTML whose text is no text of the page.
RAW = frozenset("script style template textarea select option svg iframe annotation annotation-xml title head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym area audio b bdi bdo big br canvas cite code data del dfn em embed font i img ins kbd label link map "
    "mark meta object param picture q rp rt ruby s samp small source span strike strong sub sup time track tt u var video wbr "
    "math maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle "
    "msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
#: Elements that hold a block; the next such one in the same container has the same parent.
LEAVES = frozenset("p li h1 h2 h3 h4 h5 h6 dt dd td th pre blockquote figcaption caption label legend summary".split())
#: Elements, and parts of class and id names, that commonly hold furniture.
FURNITURE_TAGS = frozenset("nav aside form footer header dialog menu button fieldset".split())
FURNITURE_NAMES = frozenset(
    "ad ads advert advertisement alert banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer "
    "discussion dialog footer form header login masthead menu message modal nav navbar navigation newsletter notice notification "
    "popup promo related recommended reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe "
    "teaser toolbar tracking warning widget".split()
)
#: An open element that a new one of these closes.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
}
_TAG = re.compile(
    r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|</?[a-zA-Z][^>]*$",
    re.S,
)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[a-z]+")


class Block:
    __slots__ = ("text", "path", "names", "parent", "linked")

    def __init__(self, text, path, names, parent, linked):
        self.text, self.path, self.names, self.parent, self.linked = text, path, names, parent, linked


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple, int]] = []  # tag, parts of class and id names, number of the block element or 0
    parts: list[str] = []
    at = number = links = linked = 0

    def flush():
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                held = [s for s in stack if s[2]]
                out.append(Block(
                    text, tuple(s[0] for s in held), frozenset(n for s in held for n in s[1]),
                    held[-2][2] if len(held) > 1 and held[-1][0] in LEAVES else held[-1][2] if held else 0, linked / max(len(text), 1),
                ))
            parts.clear()
        linked = 0

    def in_leaf(held):
        return any(s[0] in LEAVES for s in held)

    def put(raw):
        nonlocal linked
        text = entities.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if links:
            linked += len(text.strip())

    end = len(page)
    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            put(page[at:])
            break
        if m.start() > at:
            put(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag = tag.lower()
        closing, attributes = (m[1], m[3]) if m[2] else (m[4], m[6])
        if closing:
            if tag == "p" and not any(s[0] == "p" for s in stack):
                flush()
                continue
            inline = tag in INLINE or tag == "noscript" and (tag, (), 0) in stack and in_leaf(stack[: stack.index((tag, (), 0))])
            if not inline:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    for gone in stack[k:]:
                        links -= gone[0] == "a"
                    del stack[k:]
                    break
                if inline and stack[k][2]:
                    break
            continue
        if tag in RAW and not attributes.endswith("/"):
            if tag == "head":  # ends with its end tag or with the body
                stop = re.compile(r"</head\s*>|(?=<body[\s>])", re.I).search(page, at)
            else:
                stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if tag not in ("svg", "annotation", "annotation-xml", "option", "select", "iframe"):
                flush()
            at = stop.end() if stop else end
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag == "noscript" and not in_leaf(stack):
            flush()
        if tag in INLINE or tag == "noscript":  # what stands for a script belongs where the script does
            if tag not in VOID:
                stack.append((tag, (), 0))
                links += tag == "a"
            continue
        flush()
        if tag in VOID:
            continue
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == "p" or stack[k][0] in CLOSES.get(tag, ()):
                for gone in stack[k:]:
                    links -= gone[0] == "a"
                del stack[k:]
                break
            if stack[k][2] and stack[k][0] != "p":
                break
        number += 1
        words = set()
        if attributes:
            for a, b, c in _NAMES.findall(attributes):
                words.update(_PART.findall((a or b or c).lower()))
        stack.append((tag, tuple(words), number))
    flush()
    return out


#: Words that tell furniture; a fixed list of common English web terms.
TELLING = frozenset(
    "cookie cookies subscribe newsletter copyright privacy terms login register share tweet comment comments reply "
    "advertisement sponsored related menu search sitemap rights reserved contact sign follow enable javascript".split()
)


def features(found: list[Block]) -> list[list[str]]:
    out, n = [], len(found)
    for k, b in enumerate(found):
        own = b.path[-1] if b.path else ""
        words = b.text.split()
        size = len(words)
        f = ["1", f"own={own}", f"size={min(size.bit_length(), 8)}", f"link={int(b.linked * 4 + 0.5)}"]
        f += [f"in={t}" for t in set(b.path)]
        f += [f"name={t}" for t in b.names]
        if FURNITURE_TAGS.intersection(b.path):
            f.append("furniture")
        if not FURNITURE_NAMES.isdisjoint(b.names):
            f.append("furniture name")
        f.append(f"stop={b.text[-1] in '.!?\"' if b.text else False}")
        f.append(f"place={'first' if k == 0 else 'last' if k == n - 1 else 'in'}")
        if b.text[0] in "©&|•›»":
            f.append("mark")
        if size < 40:
            f += [f"word={w}" for w in TELLING.intersection(w.strip(".,:;!?").lower() for w in words)]
        out.append(f)
    return out


def steps(found: list[Block]) -> list[int]:
    """For each block but the first: 1 if it has the parent of the one before, else 0."""
    return [int(a.parent == b.parent) for a, b in zip(found, found[1:])]


class Field:
    """Weights of the label 1 by feature, and of steps [kind][before][after]."""

    def __init__(self):
        self.weight: dict[str, float] = {}
        self.step = [[[0.0, 0.0], [0.0, 0.0]], [[0.0, 0.0], [0.0, 0.0]]]

    def unary(self, rows: list[list[str]]) -> list[float]:
        get = self.weight.get
        return [sum(get(f, 0.0) for f in row) for row in rows]

    def viterbi(self, rows: list[list[str]], kinds: list[int]) -> list[int]:
        """The most probable labels."""
        if not rows:
            return []
        u = self.unary(rows)
        best, back = [0.0, u[0]], []
        for t, kind in enumerate(kinds, 1):
            s = self.step[kind]
            from_ = [int(best[1] + s[1][y] > best[0] + s[0][y]) for y in (0, 1)]
            best = [best[from_[y]] + s[from_[y]][y] + (u[t] if y else 0.0) for y in (0, 1)]
            back.append(from_)
        labels = [int(best[1] > best[0])]
        for from_ in reversed(back):
            labels.append(from_[labels[-1]])
        return labels[::-1]

    def marginals(self, rows, kinds):
        """P(label 1) of each block, and P(before, after) of each step."""
        def add(a, b):
            m = max(a, b)
            return m + math.log1p(math.exp(-abs(a - b)))

        u, n = self.unary(rows), len(rows)
        ahead = [[0.0, u[0]]]
        for t, kind in enumerate(kinds, 1):
            s, a = self.step[kind], ahead[-1]
            ahead.append([add(a[0] + s[0][y], a[1] + s[1][y]) + (u[t] if y else 0.0) for y in (0, 1)])
        behind = [[0.0, 0.0]]
        for t in range(n - 1, 0, -1):
            s, b = self.step[kinds[t - 1]], behind[-1]
            behind.append([add(s[y][0] + b[0], s[y][1] + u[t] + b[1]) for y in (0, 1)])
        behind.reverse()
        z = add(*ahead[-1])
        ones = [math.exp(ahead[t][1] + behind[t][1] - z) for t in range(n)]
        pairs = []
        for t, kind in enumerate(kinds, 1):
            s = self.step[kind]
            pairs.append([[math.exp(min(0.0, ahead[t - 1][x] + s[x][y] + (u[t] if y else 0.0) + behind[t][y] - z)) for y in (0, 1)] for x in (0, 1)])
        return ones, pairs

    def fit(self, pages: list[tuple[list[list[str]], list[int], list[int]]], rounds: int = ROUNDS, seed: int = 7) -> None:
        """Stochastic gradient ascent with a step per weight that shrinks with its past gradients."""
        past: dict[str, float] = {}
        past_step = [[[1e-8] * 2 for _ in (0, 1)] for _ in (0, 1)]
        rng, order = random.Random(seed), list(range(len(pages)))
        for _ in range(rounds):
            rng.shuffle(order)
            for k in order:
                rows, kinds, labels = pages[k]
                if not rows:
                    continue
                ones, pairs = self.marginals(rows, kinds)
                slope: dict[str, float] = {}
                for row, p, y in zip(rows, ones, labels):
                    if abs(y - p) > 1e-4:
                        for f in row:
                            slope[f] = slope.get(f, 0.0) + y - p
                for f, g in slope.items():
                    g -= DECAY * self.weight.get(f, 0.0)
                    past[f] = past.get(f, 1e-8) + g * g
                    self.weight[f] = self.weight.get(f, 0.0) + RATE * g / math.sqrt(past[f])
                for kind, pair, x, y in zip(kinds, pairs, labels, labels[1:]):
                    for a in (0, 1):
                        for b in (0, 1):
                            g = float(a == x and b == y) - pair[a][b]
                            past_step[kind][a][b] += g * g
                            self.step[kind][a][b] += RATE * g / math.sqrt(past_step[kind][a][b])


#: Containers that never hold main text, inside an article too.
ASIDE = frozenset("nav aside form footer".split())
MAIN_NAMES = (("article", ""), ("main", ""), ("div", ""), ("div", "content"), ("div", "post-body"), ("div", "entry-content"), ("section", "article-text"), ("div", "story"), ("td", "main-content"), ("article", "post"))
#: Furniture: tag, class or id name, tag of its blocks.
FURNITURE = (
    ("noscript", "", ""), ("nav", "", "li"), ("nav", "menu", "li"), ("div", "menu", "li"), ("ul", "breadcrumb", "li"), ("header", "", "p"), ("header", "site-header", "div"),
    ("div", "header", "p"), ("aside", "", "p"), ("aside", "sidebar", "li"), ("div", "sidebar", "p"), ("div", "related", "li"), ("div", "ad", "p"), ("div", "ad", ""),
    ("div", "ads banner", "p"), ("div", "advert", "p"), ("div", "sponsored promo", "p"), ("div", "cookie-notice", "p"), ("div", "cookie banner", ""),
    ("div", "notice", "p"), ("div", "alert consent", "p"), ("form", "", "p"), ("form", "search", "label"), ("form", "newsletter subscribe", "p"), ("div", "share social", "li"),
    ("div", "comments", "p"), ("section", "comments", "p"), ("div", "comment", "p"), ("ul", "comment-list", "li"), ("div", "footer", "p"), ("footer", "", "p"), ("footer", "site-footer", ""),
)
FRONT = 21  # of FURNITURE, those that may stand before the main text


def labelled(page: str) -> tuple[list[Block], list[int]]:
    """A page's blocks and labels by its own article or main element."""
    found = blocks(page)
    main = [bool({"article", "main"} & set(b.path)) and not ASIDE & set(b.path) and "comments" not in b.names for b in found]
    return found, [int(x) for x in main]


def prose(found: list[Block]) -> list[int]:
    """Labels by a rule for pages that mark nothing: blocks of ``PROSE`` words outside furniture, else the longest one."""
    free = [not FURNITURE_TAGS.intersection(b.path) and FURNITURE_NAMES.isdisjoint(b.names) and b.linked < 0.5 for b in found]
    long = [int(ok and len(b.text.split()) >= PROSE) for b, ok in zip(found, free)]
    if found and not any(long):
        best = max(range(len(found)), key=lambda k: (free[k], len(found[k].text), -k))
        long[best] = 1
    return long


def layout(main: list[tuple[str, str]], other: list[str], rng: random.Random) -> tuple[str, list[int]]:
    """Another page of the same main blocks (tag, text), and its blocks' labels."""
    labels: list[int] = []
    esc = entities.escape

    def furniture(choices):
        tag, name, inner = rng.choice(choices)
        rows = []
        for _ in range(rng.randint(1, 4) if inner else 1):
            text = rng.choice(other) if rng.random() < 0.7 or "comment" not in name else rng.choice(main)[1]
            if inner == "li" and "comment" not in name:
                text = " ".join(text.split()[: rng.randint(1, 4)])
            if inner == "li" and rng.random() < 0.8 and "comment" not in name:
                rows.append(f'<li><a href="/x">{esc(text)}</a></li>')
            else:
                rows.append(f"<{inner}>{esc(text)}</{inner}>" if inner else esc(text))
            labels.append(0)
        body = "".join(rows)
        if inner == "li" and tag != "ul":
            body = f"<ul>{body}</ul>"
        mark = f' {rng.choice(("class", "class", "id"))}="{name}"' if name else ""
        return f"<{tag}{mark}>{body}</{tag}>"

    out = ["<html><body>"]
    out += [furniture(FURNITURE[:FRONT]) for _ in range(rng.randint(0, 4))]
    tag, name = rng.choice(MAIN_NAMES)
    out.append(("<table><tr>" if tag == "td" else "") + f"<{tag}" + (f' class="{name}"' if name else "") + ">")
    for kind, text in main:
        if rng.random() < 0.08:
            out.append(furniture([f for f in FURNITURE[8:FRONT]]))
        kind = rng.choice(("p", "p", "p", "p", "li", "blockquote", "h2")) if kind not in ("h1",) else kind
        labels.append(1)
        out.append(f"<ul><li>{esc(text)}</li></ul>" if kind == "li" else f"<{kind}>{esc(text)}</{kind}>")
    if rng.random() < 0.3:
        out.append(furniture([f for f in FURNITURE if "comment" in f[1] or "share" in f[1]]))
    out.append(f"</{tag}>" + ("</tr></table>" if tag == "td" else ""))
    out += [furniture(FURNITURE) for _ in range(rng.randint(0, 4))]
    out.append("</body></html>")
    return "".join(out), labels


def train(pages: list[str], layouts: int = LAYOUTS, seed: int = 11) -> Field:
    rng, examples, mains = random.Random(seed), [], []
    pool = ["Home", "About us", "Contact", "All rights reserved.", "We use cookies.", "Subscribe to our newsletter.", "Advertisement", "Please enable JavaScript."]
    for page in pages:
        found, labels = labelled(page)
        if not any(labels):
            labels = prose(found)
        else:
            examples.append((features(found), steps(found), labels))
        if found:
            mains.append([(b.path[-1] if b.path else "p", b.text) for b, y in zip(found, labels) if y][:40])
            pool += [b.text[:300] for b, y in zip(found, labels) if not y][:4]
    for main in mains:
        for _ in range(layouts if main else 0):
            page, labels = layout(main, pool, rng)
            found = blocks(page)
            if len(found) == len(labels):
                examples.append((features(found), steps(found), labels))
    field = Field()
    field.fit(examples)
    return field


def main_text(page: str, field: Field) -> str:
    found = blocks(page)
    labels = field.viterbi(features(found), steps(found))
    return "\n\n".join(b.text for b, y in zip(found, labels) if y)


def sample(pages: DataFrame, id_column: str, most: int = SAMPLE) -> list[str]:
    """At most ``most`` pages, those that mark their main text first, chosen by the hash of their ids."""
    spare = ~F.lower("html").rlike("<(article|main)[ >]")
    key, whole = F.xxhash64(id_column), F.xxhash64(id_column, "html")
    slim = pages.where("html <> ''").select(spare.alias("_s"), key.alias("_h"), F.col(id_column).alias("_i"), whole.alias("_w"))
    ids = {r["_w"] for r in slim.orderBy("_s", "_h", "_i", "_w").limit(most).collect()}
    chosen = pages.select(key.alias("_h"), whole.alias("_w"), "html").where(F.col("_w").isin(list(ids)))
    rows = chosen.groupBy("_h", "_w").agg(F.min("html").alias("html")).collect() if ids else []
    return [r["html"] for r in sorted(rows, key=lambda r: (r["_h"], r["_w"]))]


def extract(pages: DataFrame, id_column: str = "page_id", field: Field | None = None) -> DataFrame:
    """One row a page: its id, url, text, n_chars."""
    field = field or train(sample(pages, id_column))
    model = pages.sparkSession.sparkContext.broadcast((field.weight, field.step))
    slim = pages.select(id_column, "url", "html")
    kind = slim.schema[id_column].dataType.simpleString()

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        own = Field()
        own.weight, own.step = model.value
        for batch in batches:
            texts = [main_text(h, own) if h else "" for h in batch.column("html").to_pylist()]
            names = [n for n in batch.schema.names if n != "html"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names] + [pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                names=[*names, "text", "n_chars"],
            )

    return slim.mapInArrow(run, f"`{id_column}` {kind}, url string, text string, n_chars long")


def op7_random_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
