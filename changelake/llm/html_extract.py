"""Main text of web pages with a tree-structured graphical model.

Every block element and text block of a page is a binary variable: 1 if it is main content or holds
some, 0 if not. Features of a node give its own potential, and a table of four weights ties it to
its parent. Sum-product messages go up and then down the tree and give exact marginals; the text
blocks whose marginal is above one half are the main text. Weights are trained by exact likelihood
on labelled pages: sampled pages that mark their article, and arrangements of the same texts in
templates whose parts are known.
"""

from __future__ import annotations

import functools
import random
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelake.llm.common import prepare
from changelake.llm.dom import Page, parse

BUCKETS = 4096
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
LENGTHS = (15, 40, 80, 160, 400)
# Elements and names of page parts that the templates use; a fixed vocabulary of web design.
CONTENT = ("<article>", "<main>", '<div id="content">', '<div class="post-content">', '<section class="entry-content">',
           '<div class="article-body">', '<div class="story text">', '<main role="main">', '<div class="main">')
ASIDE = ("<nav>", "<header>", "<footer>", "<aside>", "<form>", "<menu>", "<dialog>", "<fieldset>", "<figcaption>",
         '<div class="nav">', '<div class="menu">', '<ul class="menu">', '<div id="header">', '<div class="footer">',
         '<div id="footer">', '<div class="sidebar">', '<div id="sidebar">', '<div class="widget">',
         '<div class="ad">', '<div class="ads">', '<div class="advert">', '<div class="advertisement">',
         '<div class="banner">', '<div class="sponsored">', '<div class="promo">', '<div class="cookie">',
         '<div class="cookie-notice">', '<div class="consent">', '<div class="notice">', '<div class="alert">',
         '<div class="popup">', '<div class="modal">', '<div class="newsletter">', '<div class="subscribe">',
         '<div class="share">', '<div class="social">', '<div class="related">', '<div class="recommended">',
         '<div class="breadcrumbs">', '<div class="breadcrumb">', '<div class="pagination">', '<div class="comments">',
         '<div id="comments">', '<section class="comments">', '<section id="comments">', '<ol class="comment-list">',
         '<div class="comment">', '<div class="replies">', '<div class="respond">', '<div class="search">',
         '<div class="login">', '<div class="copyright">', '<div class="legal">', '<div class="toolbar">',
         '<div role="navigation">', '<div role="banner">', '<div role="contentinfo">', '<div role="complementary">')


def bucket(name: str) -> int:
    return zlib.crc32(name.encode()) % BUCKETS


@functools.lru_cache(65_536)
def element_features(name: str, attributes: str) -> tuple[int, ...]:
    found = [f"tag {name}"]
    for values in NAMED.findall(attributes):
        found += [f"word {w}" for w in re.split(r"[^a-z]+", "".join(values).lower()) if w]
    return tuple(sorted({bucket(f) for f in found}))


@functools.lru_cache(65_536)
def text_features(parent: str, length: int, links: int, sentence: bool) -> tuple[int, ...]:
    return tuple(sorted({bucket(f) for f in (
        f"text in {parent}", f"length {length}", f"links {links}", f"sentence {sentence}",
        f"length {length} links {links}")}))


def node_features(page: Page) -> list[tuple[int, ...]]:
    out = []
    for node, name in enumerate(page.name):
        if name == "#text":
            text = page.text[node]
            length = sum(len(text) >= x for x in LENGTHS)
            links = min(3, 4 * page.linked[node] // max(1, len(text)))
            out.append(text_features(page.name[page.parent[node]], length, links, text[-1] in ".!?…。"))
        else:
            out.append(element_features(name, page.attributes[node]))
    return out


@dataclass
class Forest:
    """Several pages as one forest: nodes by depth, and their features."""

    parent: np.ndarray
    levels: list[np.ndarray]  # node numbers of each depth, roots first
    rows: np.ndarray  # node of each feature entry
    features: np.ndarray

    @staticmethod
    def of(pages: list[Page]) -> Forest:
        parent: list[int] = []
        lists: list[tuple[int, ...]] = []
        for page in pages:
            base = len(parent)
            parent += [p + base if p >= 0 else -1 for p in page.parent]
            lists += node_features(page)
        up = np.array(parent, np.int64)
        depth = np.zeros(len(up), np.int64)
        for node in range(len(up)):
            if up[node] >= 0:
                depth[node] = depth[parent[node]] + 1
        order = np.argsort(depth, kind="stable")
        levels = np.split(order, np.cumsum(np.bincount(depth))[:-1]) if len(up) else []
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        return Forest(up, levels, np.repeat(np.arange(len(up)), counts),
                      np.fromiter((f for x in lists for f in x), np.int64, int(counts.sum())))


def marginals(forest: Forest, weights: np.ndarray, ties: np.ndarray):
    """(log odds that nodes are 1, expected ties): messages upward, then downward.

    ``ties[p, c]`` is the weight of a parent in state p with a child in state c.
    """
    nodes = len(forest.parent)
    belief = np.zeros((nodes, 2))
    belief[:, 1] = np.bincount(forest.rows, weights[forest.features], nodes)
    up = np.zeros((nodes, 2))
    for level in forest.levels[:0:-1]:
        for p in (0, 1):
            up[level, p] = np.logaddexp(belief[level, 0] + ties[p, 0], belief[level, 1] + ties[p, 1])
        for p in (0, 1):
            belief[:, p] += np.bincount(forest.parent[level], up[level, p], nodes)
    expected = np.zeros((2, 2))
    for level in forest.levels[1:]:
        parent = forest.parent[level]
        rest = belief[parent] - up[level]  # what the parent believes without this child
        joint = rest[:, :, None] + ties[None] + belief[level][:, None, :]
        top = joint.max((1, 2), keepdims=True)
        share = np.exp(joint - top)
        expected += (share / share.sum((1, 2), keepdims=True)).sum(0)
        for c in (0, 1):
            belief[level, c] += np.logaddexp(rest[:, 0] + ties[0, c], rest[:, 1] + ties[1, c])
    return belief[:, 1] - belief[:, 0], expected


@dataclass
class TreeModel:
    weights: np.ndarray
    ties: np.ndarray

    def keep(self, pages: list[Page]) -> np.ndarray:
        forest = Forest.of(pages)
        return marginals(forest, self.weights, self.ties)[0] > 0


def fit(pages: list[Page], labels: list[list[int]], rounds: int = 400) -> TreeModel:
    """Maximum likelihood with a small penalty: observed less expected counts, by Adagrad."""
    forest, y = Forest.of(pages), np.array([x for page in labels for x in page], np.float64)
    weights, ties = np.zeros(BUCKETS), np.zeros((2, 2))
    if not len(y):
        return TreeModel(weights, ties)
    seen = np.bincount(forest.features, y[forest.rows], BUCKETS)
    child = np.flatnonzero(forest.parent >= 0)
    tied = np.zeros((2, 2))
    np.add.at(tied, (y[forest.parent[child]].astype(int), y[child].astype(int)), 1)
    fast, fast_ties = np.full(BUCKETS, 1e-3), np.full((2, 2), 1e-3)
    for _ in range(rounds):
        odds, expected = marginals(forest, weights, ties)
        chance = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        g = seen - np.bincount(forest.features, chance[forest.rows], BUCKETS) - 0.02 * weights
        g_ties = tied - expected - 0.02 * ties
        fast += g * g
        fast_ties += g_ties * g_ties
        weights = weights + 0.7 * g / np.sqrt(fast)
        ties = ties + 0.7 * g_ties / np.sqrt(fast_ties)
    return TreeModel(weights, ties)


# -- labelled pages

def article_labels(page: Page) -> list[int] | None:
    """1 for the parts of the one article that a page marks and for what holds it; None without one.

    Parts of it whose element is no part of an article's own text (aside, form, nav, ...) are 0.
    """
    articles = [n for n, name in enumerate(page.name) if name == "article"]
    if len(articles) != 1:
        return None
    labels = [0] * len(page.name)
    labels[articles[0]] = 1
    for node in range(articles[0] + 1, len(page.name)):
        apart = page.name[node] in ("aside", "nav", "form", "footer", "menu", "dialog", "button", "select") or any(
            w in ASIDE_WORDS for w in words_of(page.attributes[node]))
        labels[node] = int(labels[page.parent[node]] == 1 and page.parent[node] >= articles[0] and not apart)
    node = page.parent[articles[0]]
    while node >= 0:
        labels[node] = 1
        node = page.parent[node]
    return labels


def words_of(attributes: str) -> list[str]:
    return [w for values in NAMED.findall(attributes) for w in re.split(r"[^a-z]+", "".join(values).lower()) if w]


ASIDE_WORDS = frozenset(w for part in ASIDE for w in words_of(part))


def template_page(texts: list[str], rng: random.Random) -> tuple[Page, list[int]]:
    """One page that arranges ``texts`` in known parts, and its labels."""
    marks: list[tuple[str, int]] = []

    def put(html: str, label: int) -> None:
        marks.append((html, label))

    def phrase(least: int, most: int) -> str:
        words = rng.choice(texts).split() or ["x"]
        start = rng.randrange(len(words))
        return " ".join(words[start:start + rng.randint(least, most)])

    def aside() -> None:
        part = rng.choice(ASIDE)
        put(part, 0)
        for _ in range(rng.randint(1, 4)):
            kind = rng.randrange(5)
            if kind == 0:
                put(f"<ul><li><a href='/x'>{phrase(1, 3)}</a></li><li><a href='/y'>{phrase(1, 3)}</a></li></ul>", 0)
            elif kind == 1:
                put(f"<p>{phrase(3, 60)}.</p>", 0)
            elif kind == 2:
                put(f"<div>{phrase(2, 20)}</div>", 0)
            elif kind == 3:
                put(f"<{(h := rng.choice(('h2', 'h3', 'h4')))}>{phrase(1, 6)}</{h}><p>{phrase(5, 40)}.</p>", 0)
            else:
                put(f"{phrase(2, 25)}", 0)
        put(f"</{part[1:-1].split()[0]}>", 0)

    def content() -> None:
        part = rng.choice(CONTENT)
        put(part, 1)
        if rng.random() < 0.8:
            put(f"<h1>{phrase(3, 12)}</h1>", 1)
        for _ in range(rng.randint(1, 12)):
            kind = rng.randrange(12)
            if kind < 6:
                put(f"<p>{phrase(5, 150)}.</p>", 1)
            elif kind == 6:
                put(f"<p><b>{phrase(2, 80)}</b> {phrase(2, 20)}<br>", 1)
            elif kind == 7:
                put(f"<{(h := rng.choice(('h2', 'h3')))}>{phrase(1, 8)}</{h}>", 1)
            elif kind == 8:
                put(f"<ul><li>{phrase(3, 30)}</li><li>{phrase(3, 30)}.</li></ul>", 1)
            elif kind == 9:
                put(f"<blockquote><p>{phrase(5, 60)}</p></blockquote>", 1)
            elif kind == 10:
                put(f"<div><p>{phrase(5, 60)}.</p></div>", 1)
            else:
                put(f"<table><tr><td>{phrase(1, 9)}</td><td>{phrase(1, 9)}</td></tr></table>", 1)
            if rng.random() < 0.08:
                aside()
        if rng.random() < 0.15:
            aside()
        put(f"</{part[1:-1].split()[0]}>", 1)

    put(f"<html><head><title>{phrase(2, 9)}</title></head>", 0)
    put("<body>", 1)
    wrapped = rng.random() < 0.4
    if wrapped:
        put(rng.choice(('<div class="wrapper">', '<div id="page">', '<div class="container">')), 1)
    for _ in range(rng.randint(1, 4)):
        aside()
    content()
    for _ in range(rng.randint(1, 4)):
        aside()
    # The tree of the whole page, and each node's label by the part whose markup it starts in.
    html = "".join(h for h, _ in marks)
    page = parse(html)
    grown, labels = "", []
    for part, label in marks:
        grown += part
        count = len(parse(grown).name)
        labels += [label] * (count - len(labels))
    labels = labels[:len(page.name)] + [0] * (len(page.name) - len(labels))
    labels[0] = 1
    if len(labels) > 1:
        labels[1] = 1  # html holds the body
    return page, labels


def train(pages: DataFrame, marked: int = 60, templates: int = 400, seed: int = 5) -> TreeModel:
    """Trains on at most ``marked`` sampled pages that mark one article and as many templates.

    The sample is the pages with the smallest hashes among those up to 40,000 characters; extraction
    reads every page whole. With no such page the templates hold a filler text.
    """
    rows = (pages.select("html").where("html is not null and length(html) <= 40000")
            .orderBy(F.xxhash64("html"), "html").limit(marked).collect())
    trees = [parse(r["html"]) for r in rows]
    chosen, labels = [], []
    for tree in trees:
        found = article_labels(tree)
        if found:
            chosen.append(tree)
            labels.append(found)
    texts = [t for tree in trees for t in tree.text.values() if len(t) > 80] or ["some words of a plain text"]
    rng = random.Random(seed)
    for _ in range(templates):
        page, found = template_page(texts, rng)
        chosen.append(page)
        labels.append(found)
    return fit(chosen, labels)


def extract(pages: DataFrame, model: TreeModel) -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    ``text`` is its content blocks in page order, joined by an empty line: character references
    decoded, white space within a block made one space, ends trimmed; n_chars its code points. A
    null or empty page, or one without content, has an empty text and 0. Repeated rows give repeated
    rows; other columns are left out.
    """
    prepare(pages.sparkSession)

    def run(batches):
        for batch in batches:
            trees = [parse(h or "") for h in batch.column("html").to_pylist()]
            kept = model.keep(trees)
            out, base = [], 0
            for tree in trees:
                out.append("\n\n".join([t for node, t in tree.text.items() if kept[base + node]]))
                base += len(tree.name)
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()),
                 pa.array(list(map(len, out)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
