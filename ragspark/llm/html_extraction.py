"""Main text of web pages: boosted trees over block nodes, decoded from the root down."""

from __future__ import annotations

import html as markup
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragspark.llm import dom
from ragspark.llm.gbt import Trees, fit_trees
from ragspark.llm.tables import first_by_hash

#: bounds of training: pages read, their bytes in all, and pages composed anew of their texts for each of them
SAMPLE_PAGES = 300
SAMPLE_BYTES = 64 << 20
COMPOSED = 4
#: how often a page of the sample counts beside a composed one
REAL = 8
#: lines in a row of a text that a composed page may hold
COMPOSED_LINES = 120
#: what a node costs whose children are decided apart
SPLIT = 0.4
#: folds of training pages between which the ratios of attribute words are told apart
FOLDS = 5
TREES = 90

# ---- pages for training

_CLASSES = {
    "menu": ["nav", "navbar", "main-menu", "menu", "breadcrumbs", "site-navigation", "pagination", "toc"],
    "header": ["header", "site-header", "masthead", "top-bar", "page-header", "branding"],
    "footer": ["footer", "site-footer", "bottom", "copyright", "legal", "colophon"],
    "sidebar": ["sidebar", "widget", "related-posts", "aside", "recommended", "right-rail", "popular", "tagcloud"],
    "advert": ["ad", "ads", "advert", "sponsored", "promo", "ad-banner", "adsbox"],
    "notice": ["notice", "cookie-banner", "alert", "consent", "popup", "cookie-notice", "warning", "gdpr"],
    "form": ["search-form", "newsletter", "subscribe", "login", "contact-form", "signup"],
    "comment": ["comments", "comment", "comment-list", "replies", "reader-comments", "discussion"],
    "social": ["share", "social-links", "follow-us", "sharing"],
}
_TAGS = {
    "menu": ["nav", "nav", "div", "ul"], "header": ["header", "header", "div"], "footer": ["footer", "footer", "div"],
    "sidebar": ["aside", "aside", "div", "section"], "advert": ["div", "div", "aside", "section", "p"],
    "notice": ["div", "section", "p", "aside"], "form": ["form", "form", "div"], "comment": ["section", "div", "ol", "ul", "article"],
    "social": ["div", "ul", "p"],
}
_MAIN = ["content", "post", "entry-content", "article-body", "story", "main-content", "post-content", "text", ""]


def _words(rng: random.Random, texts: list[str], low: int, high: int) -> str:
    words = rng.choice(texts).split() or ["a"]
    k, n = rng.randrange(len(words)), rng.randint(low, high)
    return markup.escape(" ".join((words[k:] + words)[:n]))


def _element(rng: random.Random, tag: str, name: str, body: str, y: str | None = None, named: float = 0.85) -> str:
    attrs = f' {rng.choice(["class", "class", "id"])}="{name}"' if name and rng.random() < named else ""
    return f"<{tag}{attrs}{f' {dom.MARK}={y}' if y else ''}>{body}</{tag}>"


class Names:
    """How a page names its elements: by the lists above, by words of its own that tell nothing, or not at all."""

    def __init__(self, rng: random.Random, classes: dict[str, list[str]] | None = None):
        self.rng, self.classes = rng, classes or _CLASSES
        self.style = "known" if classes else rng.choice(["known", "known", "known", "strange", "none"])
        self.own: dict[str, str] = {}

    def of(self, kind: str) -> str:
        if self.style == "none":
            return ""
        if self.style == "known":
            return self.rng.choice(self.classes[kind] if kind in self.classes else _MAIN)
        if kind not in self.own:
            self.own[kind] = "".join(self.rng.choice("bcdfghjklmnprstvwz") + self.rng.choice("aeiou") for _ in range(self.rng.randint(1, 4)))
        return self.own[kind]


def _boilerplate(rng: random.Random, kind: str, texts: list[str], names: Names) -> str:
    tag = rng.choice(_TAGS[kind])
    link = lambda: f'<a href="/{rng.randrange(999)}">{_words(rng, texts, 1, 4)}</a>'
    item = "li" if tag in ("ol", "ul") or rng.random() < 0.4 else rng.choice(["p", "div"])
    if kind in ("menu", "social"):
        body = "".join(f"<li>{link()}</li>" for _ in range(rng.randint(3, 9))) if item == "li" else " | ".join(link() for _ in range(rng.randint(2, 8)))
        body = f"<ul>{body}</ul>" if item == "li" and tag not in ("ol", "ul") else body
    elif kind == "sidebar":
        body = f"<h3>{_words(rng, texts, 1, 4)}</h3>" + "".join(
            f"<{item}>{link() if rng.random() < 0.6 else _words(rng, texts, 5, 40)}</{item}>" for _ in range(rng.randint(1, 6))
        )
    elif kind == "form":
        body = f"<label>{_words(rng, texts, 1, 6)}</label><input name=q><p>{_words(rng, texts, 2, 15)}</p><button>{_words(rng, texts, 1, 2)}</button>"
    elif kind == "comment":
        body = (f"<h3>{_words(rng, texts, 1, 3)}</h3>" if tag not in ("ol", "ul") else "") + "".join(
            _element(rng, "li" if tag in ("ol", "ul") else rng.choice(["div", "article", "p"]), names.of("comment"), f"<p>{_words(rng, texts, 4, 60)}</p>", named=0.5)
            for _ in range(rng.randint(1, 5))
        )
    elif kind == "header":
        body = f"<h2>{link()}</h2>" + rng.choice(["", f"<p>{_words(rng, texts, 2, 10)}</p>", _boilerplate(rng, "menu", texts, names)])
    else:
        body = rng.choice(["", "<p>"]) + _words(rng, texts, 3, 45) + rng.choice(["", " " + link()])
        body = "&copy; " + body if kind == "footer" else body
    own = tag in ("nav", "header", "footer", "aside", "form")
    return _element(rng, tag, names.of(kind), body, "0", 0.5 if own else 1.0)


def composed_page(rng: random.Random, texts: list[str], classes: dict[str, list[str]] | None = None) -> str:
    """A page around one of the texts, of random layout; elements are marked as main text or not.

    Three in five pages name elements by the lists above, the others by words that tell nothing, or not at all;
    with classes, all take these.
    """
    names = Names(rng, classes)
    lines = [x for x in rng.choice(texts).split("\n") if x.strip()] or ["a"]
    start = rng.randrange(max(1, len(lines) - COMPOSED_LINES + 1))
    lines = lines[start : start + (COMPOSED_LINES if rng.random() < 0.85 else rng.randint(1, 3))]
    blocks = []
    if rng.random() < 0.8:
        blocks.append(f"<h1>{_words(rng, texts, 2, 9)}</h1>")
    for line in lines:
        tag = rng.choice(["p", "p", "p", "p", "div", "blockquote", "h2", "pre"]) if len(line) > 30 else rng.choice(["p", "p", "h2", "h3", "li"])
        body = markup.escape(line)
        if rng.random() < 0.15:
            body = f'<a href="/x">{body[:20]}</a>{body[20:]}' if "&" not in body[:24] else body
        blocks.append(f"<ul><li>{body}</li></ul>" if tag == "li" else f"<{tag}>{body}</{tag}>")
    for _ in range(rng.choice([0, 0, 1, 2])):  # what stands amid the article
        kind = rng.choice(["advert", "advert", "social", "form", "notice", "sidebar"])
        blocks.insert(rng.randint(0, len(blocks)), _boilerplate(rng, kind, texts, names))
    if rng.random() < 0.25:
        blocks.append(_boilerplate(rng, "comment", texts, names))
    tag = rng.choice(["article", "article", "main", "div", "div", "section"])
    main = _element(rng, tag, names.of("main"), "".join(blocks), "1", 0.9 if tag == "div" else 0.6)
    for _ in range(rng.choice([0, 0, 1, 2])):
        main = _element(rng, rng.choice(["div", "div", "main", "section"]), rng.choice(["wrapper", "container", "row", "page", "main", ""]), main)
    before = [_boilerplate(rng, k, texts, names) for k in ("notice", "header", "menu", "form", "advert") if rng.random() < 0.5]
    after = [_boilerplate(rng, k, texts, names) for k in ("sidebar", "social", "comment", "sidebar", "advert", "form", "notice") if rng.random() < 0.35]
    if rng.random() < 0.3 and after:
        before.append(after.pop())
    rng.shuffle(before), rng.shuffle(after)
    foot = _boilerplate(rng, "footer", texts, names) if rng.random() < 0.85 else ""
    return f"<html><head><title>x</title></head><body>{''.join(before)}{main}{''.join(after)}{foot}</body></html>"


def _labels(order: list[dom.Node], mark: dict[int, str | None]) -> np.ndarray:
    """1 for nodes whose text is mostly main text, by the nearest mark at or above each."""
    state, inside = np.zeros(len(order)), {}
    held = np.zeros(len(order))
    for node in order:
        inside[node.number] = mark.get(node.number) or (inside[node.parent.number] if node.parent else "0")
        held[node.number] = node.own * (inside[node.number] == "1")
    for node in reversed(order):
        state[node.number] = held[node.number] * 2 > node.chars if node.chars else inside[node.number] == "1"
        if node.parent is not None:
            held[node.parent.number] += held[node.number]
    return state


@dataclass
class PageModel:
    """Trees over nodes, and the log-count ratio of each bucket of attribute words that they read."""

    ratios: np.ndarray
    trees: Trees

    def probabilities(self, orders: list[list[dom.Node]]) -> np.ndarray:
        return self.trees.probability(np.concatenate([dom.features(o, self.ratios) for o in orders]).astype(float))


def _counts(order: list[dom.Node], y: np.ndarray) -> np.ndarray:
    """Nodes of the page without and with main text that hold each bucket."""
    at = np.array([(int(y[n.number]), t) for n in order for t in n.tokens], np.int64).reshape(-1, 2)
    return np.bincount(at[:, 0] * dom.TOKENS + at[:, 1], minlength=2 * dom.TOKENS).reshape(2, -1).astype(float)


def _ratios(counts: np.ndarray) -> np.ndarray:
    """Smoothed towards 0, which is what an unknown word says."""
    n = counts.sum(axis=1, keepdims=True) + 1
    rates = (counts + n / n.sum()) / n
    return np.log(rates[1]) - np.log(rates[0])


def fit(orders: list[list[dom.Node]], labels: list[np.ndarray], weights: list[float] | None = None) -> PageModel:
    """Trees that see, for each page, ratios of the other folds' pages, as a page's own labels must not tell."""
    counts = np.zeros((FOLDS, 2, dom.TOKENS))
    weights = weights or [1.0] * len(orders)
    for k, (order, y, w) in enumerate(zip(orders, labels, weights)):
        counts[k % FOLDS] += w * _counts(order, y)
    others = [_ratios(counts.sum(axis=0) - c) for c in counts]
    x = np.concatenate([dom.features(o, others[k % FOLDS]) for k, o in enumerate(orders)])
    each = np.repeat(weights, [len(o) for o in orders])
    return PageModel(_ratios(counts.sum(axis=0)), fit_trees(x.astype(float), np.concatenate(labels), trees=TREES, weight=each))


def train(pages: DataFrame) -> PageModel:
    """Fit on a bounded sample of pages, the first SAMPLE_PAGES by a hash of their ids, SAMPLE_BYTES in all at most.

    Pages are taken whole; one that no longer fits makes room for the next. A page that has one <article> is labelled by it. The texts of the sample are also composed into new pages
    of many layouts, with other elements, names and kinds of boilerplate, whose labels are known. Without any
    text a fixed sentence takes its place.
    """
    sized = pages.where("page_id is not null and length(html) > 0").select("page_id", F.octet_length("html").alias("bytes"))
    ids, left = [], SAMPLE_BYTES
    for r in first_by_hash(sized, SAMPLE_PAGES, "page_id").collect():
        if r["bytes"] <= left:
            ids.append((r["page_id"],))
            left -= r["bytes"]
    chosen = pages.sparkSession.createDataFrame(sorted(set(ids)), f"page_id {pages.schema['page_id'].dataType.simpleString()}")
    fits = F.octet_length("html") <= SAMPLE_BYTES
    rows = pages.where(fits).select("page_id", "html").join(F.broadcast(chosen), "page_id")  # at most SAMPLE_PAGES ids
    parsed, y, texts = [], [], []
    for row in rows.orderBy("page_id", F.md5("html")).limit(SAMPLE_PAGES).collect():
        order = dom.parse(row["html"])
        articles = [n for n in order if n.tag == "article"]
        if len(articles) == 1:
            parsed.append(order)
            y.append(_labels(order, {articles[0].number: "1"}))
        # a page without one lends its words only
        found = "\n".join(kept_blocks(order, articles[0].number if len(articles) == 1 else 0))
        texts.append(found)
    texts = [t for t in texts if t.strip()] or ["This page holds a few words of text, and no more than that."]
    weights = [float(REAL)] * len(parsed) + [1.0] * (COMPOSED * SAMPLE_PAGES)
    rng = random.Random(7)
    for _ in range(COMPOSED * SAMPLE_PAGES):
        order = dom.parse(composed_page(rng, texts))
        parsed.append(order)
        y.append(_labels(order, {n.number: n.mark for n in order if n.mark}))
    return fit(parsed, y, weights)


# ---- decoding


def kept_blocks(order: list[dom.Node], top: int | None = None, keep: list[bool] | None = None) -> list[str]:
    """Texts of kept blocks in page order: all below node `top`, or the nodes of `keep`."""
    out: list[str] = []
    inside = [False] * len(order)
    for node in order:
        inside[node.number] = node.number == top or bool(node.parent and inside[node.parent.number])
    keep = inside if keep is None else keep
    stack: list[tuple[dom.Node, int]] = [(order[0], 0)]
    parts: list[str] = []

    def end() -> None:
        if text := dom.block_text(parts):
            out.append(text)
        parts.clear()

    while stack:
        node, k = stack.pop()
        while k < len(node.children) and isinstance(node.children[k], str):
            if keep[node.number]:
                parts.append(node.children[k])
            k += 1
        end()
        if k < len(node.children):
            stack += [(node, k + 1), (node.children[k], 0)]
    return out


def decode(order: list[dom.Node], p: np.ndarray) -> list[bool]:
    """Which nodes' own text is kept: the likeliest choice in which a subtree is kept whole, dropped whole, or split.

    A kept or dropped node settles all below it, so that no descendant contradicts it. A split node costs
    SPLIT, and its own text goes by its own probability.
    """
    p = np.clip(p, 1e-4, 1 - 1e-4)
    keep, drop = np.log(p), np.log(1 - p)
    own = np.array([n.own > 0 for n in order])
    split = np.where(own, np.maximum(keep, drop), 0) - SPLIT
    for node in reversed(order):
        if node.parent is not None:
            i, j = node.number, node.parent.number
            split[j] += max(keep[i], drop[i], split[i])
            keep[j] += keep[i]
            drop[j] += drop[i]
    out, state = [False] * len(order), [""] * len(order)
    for node in order:
        i, above = node.number, state[node.parent.number] if node.parent else "split"
        best = max(("keep", keep[i]), ("drop", drop[i]), ("split", split[i]), key=lambda v: v[1])[0]
        state[i] = above if above != "split" else best
        out[i] = p[i] > 0.5 if state[i] == "split" else state[i] == "keep"
    return out


def main_texts(pages: list[str | None], model: PageModel) -> list[str]:
    orders = [dom.parse(h) for h in pages]
    if not orders:
        return []
    p = model.probabilities(orders)
    out, at = [], 0
    for order in orders:
        out.append("\n".join(kept_blocks(order, keep=decode(order, p[at : at + len(order)]))))
        at += len(order)
    return out


def extracted(pages: DataFrame, html_col: str = "html", out: str = "text", model: PageModel | None = None) -> DataFrame:
    """pages with the main text of each whole page.

    Blocks in page order, one line each; white space in a block is one space. Null, empty and text-free
    pages give an empty text. Other columns stay. Equal pages give equal texts.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or train(pages))  # some fifty kilobytes

    @F.pandas_udf(T.StringType())
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            values = list(batch)
            yield pd.Series([t for k in range(0, len(values), 64) for t in main_texts(values[k : k + 64], shared.value)], dtype=str)

    return pages.withColumn(out, extract(F.col(html_col)))


def page_texts(pages: DataFrame) -> DataFrame:
    """Per row of pages: (page_id, url, text, n_chars), n_chars in code points."""
    found = extracted(pages.select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
