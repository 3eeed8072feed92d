"""HTML extraction by maximum-scoring subsequence.

A page becomes a sequence of words and tags.  Words score by the elements they stand in,
tags cost.  The weights are learned from pages that declare their article by an ``article``
or ``main`` element: its inside and outside label the words, and so the block elements,
class names, ids and roles around them.  The declaration itself is a label only; a page is
scored alike with and without it.  Before anything is learned, or where the pages do not
speak, a prior on element and class names decides, which counts of words outvote.

One linear scan finds the contiguous region of the highest total.  Within it, elements
whose weight says that they hold no article text - menus, asides, forms, adverts, reader
comments - are left out, and the rest is joined block by block.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator, Mapping
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgflow.llm.common import table

#: Pages that the weights are learned from: those with the smallest hashes of their ids.
MOST_LABELLED = 2_000
#: Words that a prior counts for, and the weight from which on down an element's text is left out.
PRIOR, LEFT_OUT = 20, -0.5

# Names of HTML elements, by what they mean for text, and ARIA roles.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark",
    "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img",
}
NO_TEXT = RAW | {"head", "nav", "footer", "aside", "form", "button", "select", "option", "menu", "dialog", "svg", "canvas", "object", "audio", "video", "map", "label", "fieldset"}
BLOCKS = {
    "article", "main", "section", "div", "p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "ul", "ol", "li", "dl", "dt", "dd",
    "table", "tr", "td", "th", "figure", "figcaption", "header", "body", "html", "center", "address", "details", "summary", "hgroup",
}
#: Elements that hold running text; before anything is learned, they cost little.
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "ul", "ol", "li", "dl", "dt", "dd", "table", "tr", "td", "th", "figure", "figcaption", "br"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
#: Parts of class names and ids that are no article text by the prior.
NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner",
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "sidebars", "aside", "footer", "masthead", "topbar",
    "header", "comment", "comments", "commentlist", "disqus", "replies", "respond", "discussion", "cookie", "cookies", "consent", "gdpr",
    "notice", "notices", "notification", "alert", "newsletter", "subscribe", "subscription", "signup", "login", "related", "recommended",
    "share", "sharing", "social", "popup", "modal", "overlay", "widget", "widgets", "toolbar", "pagination", "pager", "copyright", "legal",
    "disclaimer", "search", "form", "kommentare", "commentaires", "comentarios",
}

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)""",
    re.S,
)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def markers(name: str, attrs: str) -> list[str]:
    """What an element says of its text: its name, if that tells anything, the parts of its class names and id, its role, that it is hidden."""
    out = [f"t:{name}"] if name in NO_TEXT or name == "header" else []
    if name in ("html", "body", "article", "main"):
        return out
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            for one in value.split():
                parts = [x.lower() for x in _PART.findall(one)]
                if parts and parts[0] not in ("has", "no", "with", "without", "is"):
                    out += [f"c:{x}" for x in parts]
        elif key == "role":
            out.append(f"r:{value.lower()}")
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            out.append("hidden")
    return out


class Element:
    """An element with the one around it, so that a token names all that it stands in by one reference.

    own are its markers, block the innermost block element, holder whether an article is declared inside it.
    """

    __slots__ = ("block", "holder", "lowest", "number", "own", "parent")

    def __init__(self, number: int, parent: Element | None, own: list[str], block: str):
        self.number, self.parent, self.own, self.block = number, parent, own, block
        self.holder, self.lowest = False, None


class Token(NamedTuple):
    """A piece of text with its references decoded, or a tag by name.

    link is whether it stands in a link, within the innermost element around, inside whether an article is declared there.
    """

    text: bool
    value: str
    link: bool
    within: Element | None
    inside: bool

    @property
    def block(self) -> str:
        return self.within.block if self.within else "body"


def tokens(page: str) -> tuple[list[Token], list[Element]]:
    """The tokens of a page in order, and its elements in the order of their beginnings.  The work is linear in the page."""
    out: list[Token] = []
    stack: list[tuple[str, Element]] = []
    elements: list[Element] = []
    opened: Counter = Counter()  # elements on the stack by name
    declared, links, pos = 0, False, 0
    within: Element | None = None

    def text(chunk: str) -> None:
        if chunk:
            out.append(Token(True, html.unescape(chunk), links, within, declared > 0))

    def leave() -> str:
        name = stack.pop()[0]
        opened[name] -= 1
        return name

    while pos < len(page):
        m = _TAG.search(page, pos)
        if m is None:
            text(page[pos:])
            break
        text(page[pos : m.start()])
        pos = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                text(html.escape(m[0][9:-3]))
            continue
        end = (m["end"] or m["end2"]) == "/"
        attrs = m["attrs"] or m["attrs2"] or ""
        out.append(Token(False, name, links, within, declared > 0))
        if not end and name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, pos)
            pos = close.end() if close else len(page)
            continue
        if name == "a":
            links = not end
        if name in VOID:
            continue
        if end:
            if opened[name]:
                while (popped := leave()) != name:
                    declared -= popped in ("article", "main")
                declared -= name in ("article", "main")
        else:
            if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
                leave()
            own = markers(name, attrs)
            if name in INLINE and not own:
                continue  # inline elements that say nothing are often left open
            parent = stack[-1][1] if stack else None
            if name in ("article", "main"):
                declared += 1
                at = parent
                while at and not at.holder:
                    at.holder, at = True, at.parent
            elements.append(Element(len(elements), parent, own, name if name in BLOCKS else parent.block if parent else "body"))
            stack.append((name, elements[-1]))
            opened[name] += 1
        within = stack[-1][1] if stack else None
    return out, elements


def _prior(feature: str) -> float | None:
    """The share of words in article text that is taken for granted; None for what has to be learned."""
    kind, _, name = feature.partition(":")
    if kind == "b":
        return 0.9
    if kind == "a":
        return 0.4
    if kind == "t" or kind == "hidden":
        return 0.02
    return 0.05 if kind == "r" and name in ROLES or kind == "c" and name in NAMES else None


class Weights:
    """What a word adds and a tag costs, from counts of words (in article text, elsewhere) for each feature.

    Features are b: and a: with a block element, for words in it outside and inside of
    links, and the markers of elements.  Tags have the prefix 'tag:'.
    """

    def __init__(self, counts: Mapping[str, tuple[int, int]] | None = None):
        self.counts, self.known = dict(counts or {}), {}
        share = lambda t: (n := self.counts.get(f"tag:{t}", (0, 0))) and (n[0] + PRIOR * (0.95 if t in PROSE or t in INLINE else 0.6)) / (n[0] + n[1] + PRIOR)
        self.tag = {t: -0.02 - 0.3 * (1 - share(t)) for t in BLOCKS | INLINE | NO_TEXT | VOID}

    def __getitem__(self, feature: str) -> float:
        """From -1, elsewhere, to 1, in article text; 1 for what is neither known nor learned, so that it decides nothing."""
        if (w := self.known.get(feature)) is None:
            (yes, no), prior = self.counts.get(feature, (0, 0)), _prior(feature)
            w = 1.0 if prior is None and yes + no < PRIOR else 2 * (yes + PRIOR * (0.5 if prior is None else prior)) / (yes + no + PRIOR) - 1
            self.known[feature] = w
        return w

    def of_elements(self, token: Token) -> float:
        """The lowest weight of the elements around a token; each element remembers it, for one Weights a page."""
        at, path = token.within, []
        while at and at.lowest is None:
            path.append(at)
            at = at.parent
        low = at.lowest if at else 1.0
        for e in reversed(path):
            low = e.lowest = min([low, *(self[x] for x in e.own)])
        return low

    def left_out(self, token: Token) -> bool:
        return self.of_elements(token) < LEFT_OUT or self[f"b:{token.block}"] < LEFT_OUT

    def scores(self, seq: list[Token]) -> list[float]:
        """A tenth of a point off for each word that is left out anyway, so that an advert does not part an article."""
        out = []
        for t in seq:
            if not t.text:
                out.append(self.tag.get(t.value, -0.3))
            elif self.left_out(t):
                out.append(-0.1 * len(t.value.split()))
            else:
                out.append(min(self.of_elements(t), self[f"{'a' if t.link else 'b'}:{t.block}"]) * len(t.value.split()))
        return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous part with the highest positive total; the first and longest of equals."""
    best, at, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total < 0:
            total, start = 0.0, i
        total += s
        if total > best or total == best > 0 and start == at[0]:
            best, at = total, (start, i + 1)
    return at


def extract(page: str | None, weights: Weights) -> str:
    """The main text of one page: its blocks, each with single spaces, joined by one space; empty if there is none."""
    seq, _ = tokens(page or "")
    a, b = best_region(weights.scores(seq))
    blocks, held = [], []
    for t in seq[a:b]:
        if t.text:
            if not weights.left_out(t):
                held.append(t.value)
        elif t.value == "br":
            held.append(" ")
        elif t.value not in INLINE:
            blocks.append(" ".join("".join(held).split()))
            held = []
    blocks.append(" ".join("".join(held).split()))
    return " ".join(x for x in blocks if x)


def observed(page: str) -> Counter:
    """(feature, inside) to words, or tags, of a page that declares its article; of another, nothing.

    Elements that hold the article itself say nothing, and a block element answers only for
    words that no marker with a prior explains.
    """
    seq, elements = tokens(page)
    out: Counter = Counter()
    if not any(t.inside for t in seq):
        return out
    explained = [False] * len(elements)  # whether a marker around has a prior
    fresh: list[list[str]] = []  # markers of an element that none around it has
    around, path = Counter(), []
    for e in elements:
        while path and path[-1] is not e.parent:
            around.subtract(fresh[path.pop().number])
        own = [] if e.holder else list(dict.fromkeys(e.own))
        explained[e.number] = (explained[e.parent.number] if e.parent else False) or any(_prior(x) is not None for x in own)
        fresh.append([x for x in own if not around[x]])
        around.update(fresh[-1])
        path.append(e)
    words = [[0, 0] for _ in elements]  # outside and inside of the article, in an element and all elements inside it
    for t in seq:
        if not t.text:
            out[f"tag:{t.value}", t.inside] += 1
            continue
        n = len(t.value.split())
        if t.within:
            words[t.within.number][t.inside] += n
        if not (t.within and explained[t.within.number]):
            out[f"{'a' if t.link else 'b'}:{t.block}", t.inside] += n
    for e in reversed(elements):
        for inside, n in enumerate(words[e.number]):
            for x in fresh[e.number] if n else ():
                out[x, bool(inside)] += n
            if e.parent:
                words[e.parent.number][inside] += n
    return out


def learn(pages: DataFrame, most: int = MOST_LABELLED, html_col: str = "html") -> Weights:
    """Weights from at most ``most`` pages, of which those that declare an article count.

    Every feature that as many words as a prior speak of is learned, whatever its length; there are as many as these
    pages have.  Of rows that repeat a page_id the smallest text counts, so reruns learn the same.
    """

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            total: Counter = Counter()
            for page in pdf["page"]:
                total += observed(page or "")
            yield pd.DataFrame([(f, n if i else 0, 0 if i else n) for (f, i), n in total.items()], columns=["feature", "yes", "no"]).astype({"yes": "int64", "no": "int64"})

    numbered = pages.select("page_id", F.xxhash64("page_id").alias("h"))
    sample = numbered.orderBy("h", "page_id").limit(most).select("page_id").distinct()
    rows = pages.select("page_id", F.col(html_col).alias("page")).join(F.broadcast(sample), "page_id").groupBy("page_id").agg(F.min("page").alias("page"))
    sums = rows.mapInPandas(counted, "feature string, yes long, no long").groupBy("feature").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    kept = sums.where(F.col("yes") + F.col("no") >= PRIOR)
    return Weights({r.feature: (r.yes, r.no) for r in kept.collect()})


def text_column(weights: Weights, page: Column) -> Column:
    @F.pandas_udf("string")
    def text(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in pages:
            yield pd.Series([extract(x, weights) for x in p])

    return text(page)


def extract_pages(pages: DataFrame, weights: Weights, html_col: str = "html") -> DataFrame:
    """Adds text and n_chars (code points) to every row, instead of columns of those names.

    A null or empty page, and one without article text, has an empty text; very long pages
    are taken whole; rows that repeat a page come out once each, and equal pages alike.  An
    empty table gives an empty one.
    """
    kept = [c for c in pages.columns if c not in ("text", "n_chars")]
    return pages.select(*kept, text_column(weights, F.col(html_col)).alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract_pages(pages, learn(pages)).select("page_id", "url", "text", "n_chars")
