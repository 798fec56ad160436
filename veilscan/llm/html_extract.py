"""Main text of web pages by boosted trees over DOM nodes with hierarchical decoding.

Each block element is a node, and the page itself is the root, which holds text
that stands in no element. The trees see a node's tag, the words in its class, id
and role, its depth, its siblings and their text, and the density of text, links,
paragraphs and controls in its subtree, its parent's and the page, and give the
odds that its own text belongs to the article. The choices of a page are then decoded together:
going down from the root a node may enter the article once and leave it once
(outside, inside, left out), so that no descendant contradicts an ancestor; of
all such labellings the one with the greatest total log odds is taken, each node
counting by its text.

The model is trained on the driver on ``PAGES`` pages that ``html_pages`` makes
from a seed, a bound that does not depend on the input, and goes to the
executors with the function. The pages are of many layouts, with and without a
wrapper around the article: named, unnamed and nested divisions, bare paragraphs,
table cells, ``pre``, lines with breaks, fragments and plain text.

Defined cases: a null or empty page has an empty text, as has one in which no
node is taken; unclosed and stray tags are repaired; character references
without a semicolon are decoded; white space includes no-break spaces; rows with
equal or null ids are read alike. Other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted
from .common import pieces, tidy
from .html_tree import Tree, parse

#: Generated pages that the model is trained on.
PAGES = 1500
#: Rows of features at a time.
ROWS = 20_000
#: Tags and words that are features of their own.
TAGS = ("article", "main", "section", "div", "p", "h1", "h2", "h3", "ul", "ol", "li", "table", "td", "blockquote", "pre", "center", "figure", "figcaption", "nav", "header", "footer", "aside", "form", "fieldset", "dialog", "body", "html", "#root")
WORDS = {
    "content": "article body content entry main post story text prose".split(),
    "menu": "breadcrumb breadcrumbs menu nav navbar navigation pager pagination tabs toc toolbar skip".split(),
    "edge": "footer foot header head masthead copyright legal colophon bottom top".split(),
    "side": "aside sidebar side rail widget related recommended trending popular".split(),
    "advert": "ad ads advert advertisement banner promo promoted sponsor sponsored sponsorship".split(),
    "notice": "alert consent cookie cookies gdpr modal notice overlay paywall popup toast warning".split(),
    "reader": "comment comments discussion disqus replies reply respond reviews thread".split(),
    "form": "form login newsletter search signup subscribe subscription".split(),
    "meta": "author byline date meta share sharing social tags".split(),
}
_kinds = {w: i for i, k in enumerate(WORDS) for w in WORDS[k]}
_tags = {t: i for i, t in enumerate(TAGS)}
_content = list(WORDS).index("content")
TEXT_TAGS = frozenset(("p", "h1", "h2", "h3", "h4", "blockquote", "pre", "ul", "ol", "figure"))
#: Elements whose role their name fixes, as kinds of WORDS.
ROLES = {"nav": "menu", "menu": "menu", "header": "edge", "footer": "edge", "aside": "side", "form": "form", "dialog": "notice", "article": "content", "main": "content"}
_roles = {t: list(WORDS).index(k) for t, k in ROLES.items()}


class Nodes:
    """What is known of the nodes of one page: columns of numbers, from which rows of features are made some at a time."""

    def __init__(self, tree: Tree):
        n, parent = len(tree.tag), tree.parent
        own, linked, marks, before, seen = [0] * n, [0] * n, [0] * n, [-1] * n, 0
        for node, text, in_link in tree.pieces:
            size = len(text.strip()) if node >= 0 else 0
            if size:
                own[node] += size
                marks[node] += text.count(".") + text.count(",")
                linked[node] += size if in_link else 0
                if before[node] < 0:
                    before[node] = seen
                seen += size
        sums = [own[:], linked[:], marks[:], [1] * n, [int(t == "p") for t in tree.tag], tree.controls[:], tree.links[:]]
        children, index, alike, blocks = [0] * n, [0] * n, [0] * n, [0] * n
        last, left, right = [-1] * n, list(range(n)), list(range(n))
        like: dict[tuple[int, str], int] = {}
        for i in range(1, n):
            p = parent[i]
            index[i] = children[p]
            children[p] += 1
            blocks[p] += tree.tag[i] in TEXT_TAGS
            like[p, tree.tag[i]] = like.get((p, tree.tag[i]), 0) + 1
            if last[p] >= 0:
                left[i], right[last[p]] = last[p], i
            last[p] = i
        first = before[:]
        for i in range(n - 1, 0, -1):
            p = parent[i]
            for x in sums:
                x[p] += x[i]
            if first[i] >= 0 and (first[p] < 0 or first[i] < first[p]):
                first[p] = first[i]
            alike[i] = like[p, tree.tag[i]]
        self.n, self.up = n, np.array([0, *parent[1:]])
        self.own = np.array(own, np.float32)
        self.tags = np.array([_tags.get(t, -1) for t in tree.tag])
        mine = np.zeros((n, len(WORDS)), np.float32)
        for i in range(n):
            for kind in [_kinds.get(w) for w in tree.tokens[i]] + [_roles.get(tree.tag[i])]:
                if kind is not None:
                    mine[i, kind] += 1
        chain = np.zeros_like(mine)
        for i in range(1, n):
            chain[i] = np.maximum(chain[parent[i]], mine[parent[i]])
        self.mine, self.chain = mine, chain
        own_, linked_, marks_, before_, first_ = (np.array(x, np.float32) for x in (own, linked, marks, before, first))
        all_own, all_linked, all_marks, nodes, paragraphs, controls, links = (np.array(x, np.float32) for x in sums)
        children_, index_, alike_, blocks_, depth_ = (np.array(x, np.float32) for x in (children, index, alike, blocks, tree.depth))
        densest = float(first_[int(np.argmax(own_ - linked_))]) if n else 0.0
        share, text = all_own / max(1, seen), (own_ - linked_).max()
        density = all_linked / (all_own + 1)
        at = self.up
        self.numbers = [
            own_, all_own, linked_ / (own_ + 1), density, all_own / nodes, all_marks / (all_own + 1), marks_ / (own_ + 1), paragraphs, paragraphs / nodes, controls / nodes, controls, links, links / nodes,
            children_, blocks_ / (children_ + 1), index_ / (children_[at] + 1), alike_, depth_, first_ / (seen + 1), share, own_ / (text + 1), own_ / (all_own[at] + 1), (first_ - densest) / (seen + 1),
            blocks_[at] / (children_[at] + 1), children_[at], density[at], share[at], own_[at] / (all_own[at] + 1), own_[left], density[left], own_[right], density[right], controls[at] / nodes[at],
        ]
        whole = [seen, n, text, float(mine[:, _content].sum()), float(sum(t in ("article", "main") for t in tree.tag)), float(paragraphs[0]), float(density[0])]
        self.numbers += [np.full(n, x, np.float32) for x in whole]

    def rows(self, begin: int, end: int) -> np.ndarray:
        k, at = len(WORDS), len(TAGS)
        out = np.zeros((end - begin, at + 3 * k + len(self.numbers)), np.float32)
        tags = self.tags[begin:end]
        out[np.flatnonzero(tags >= 0), tags[tags >= 0]] = 1
        out[:, at : at + k], out[:, at + k : at + 2 * k], out[:, at + 2 * k : at + 3 * k] = self.mine[begin:end], self.chain[begin:end], self.mine[self.up[begin:end]]
        for j, x in enumerate(self.numbers):
            out[:, at + 3 * k + j] = x[begin:end]
        return out


def decode(parent: list[int], odds: np.ndarray, weight: np.ndarray) -> list[bool]:
    """The best labelling: outside, inside, left out, in this order from the root down. The root itself may be inside, as text may stand in no element."""
    n = len(parent)
    gain = (odds * weight).tolist()
    outside, inside, left = [0.0] * n, gain, [0.0] * n  # best sums of the subtree for each state of its root
    for i in range(n - 1, 0, -1):
        p = parent[i]
        outside[p] += max(outside[i], inside[i])
        inside[p] += max(inside[i], left[i])
        left[p] += left[i]
    state = [int(inside[0] > outside[0])] + [0] * (n - 1)
    for i in range(1, n):
        above = state[parent[i]]
        if above == 0:
            state[i] = int(inside[i] > outside[i])
        elif above == 1:
            state[i] = 1 if inside[i] >= left[i] else 2
        else:
            state[i] = 2
    return [s == 1 for s in state]


def text_of(tree: Tree, taken: list[bool]) -> str:
    return " ".join("".join(" " if node < 0 else text for node, text, _ in tree.pieces if node < 0 or taken[node]).split())


def extract(pages: list[str | None], model: Boosted) -> list[str]:
    """The main text of each page. Pages are scored together up to ``ROWS`` nodes, and a larger one in slices of as many, so the matrix is bounded."""
    out: list[str] = []
    held: list[tuple[Tree, Nodes]] = []

    def flush() -> None:
        cuts = [(nodes, at, min(at + ROWS, nodes.n)) for _, nodes in held for at in range(0, nodes.n, ROWS)]
        whole = np.concatenate([nodes.rows(a, b) for nodes, a, b in cuts]) if len(held) > 1 else None
        odds = model.score(whole) if whole is not None else np.concatenate([model.score(nodes.rows(a, b)) for nodes, a, b in cuts])
        at = 0
        for tree, nodes in held:
            out.append(text_of(tree, decode(tree.parent, np.clip(odds[at : at + nodes.n], -6, 6), np.log1p(nodes.own))))
            at += nodes.n
        held.clear()

    size = 0
    for html in pages:
        tree = parse(html)
        if held and size + len(tree.tag) > ROWS:
            flush()
            size = 0
        held.append((tree, Nodes(tree)))
        size += len(tree.tag)
    if held:
        flush()
    return out


#: Characters that a node counts for in training at least, so that short menus are told apart too.
SHORT = 30


def training_rows(seed: int, count: int, **how) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and weights of the nodes with text of generated pages."""
    from .html_pages import MARK, page

    rows, labels, weights = [], [], []
    for i in range(count):
        html, _ = page(seed + i, marked=True, **how)
        tree = parse(html)
        good = np.zeros(len(tree.tag), bool)
        for node, text, _ in tree.pieces:
            good[node] |= node >= 0 and MARK in text
        tree.pieces = [(node, text.replace(MARK, ""), in_link) for node, text, in_link in tree.pieces]
        nodes = Nodes(tree)
        keep = nodes.own > 0
        rows.append(nodes.rows(0, nodes.n)[keep])
        labels.append(good[keep])
        weights.append(np.log1p(np.maximum(nodes.own[keep], SHORT)))
    w = np.concatenate(weights)
    return np.concatenate(rows), np.concatenate(labels).astype(float), w / w.mean()


@functools.lru_cache(1)
def trained() -> Boosted:
    return Boosted(trees=80, depth=5, columns=0.4).fit(*training_rows(0, PAGES))


RESULT = "page_id long, url string, text string, n_chars long"


@tidy
def _extract(batches: Iterator[pa.RecordBatch], model: Boosted) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "html", 4 << 20):
        texts = extract(batch.column("html").to_pylist(), model)
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", model: Boosted | None = None) -> DataFrame:
    """Every row of ``pages``: page_id, url, the main text and its length."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return rows.mapInArrow(partial(_extract, model=model or trained()), RESULT)


def query(spark, sf_dir: str) -> DataFrame:
    """All ``pages``."""
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


#: The query without reading any HTML: the articles of ``pages`` are ``documents``, known by the number in the url, under a heading of their first line, cut after 60 characters of its escaped form.
SQL = r"""
WITH named AS (
  SELECT page_id, url, nullif(regexp_extract(url, '/(\d+)(?:[/.?#]|$)', 1), '')::BIGINT AS doc_id FROM pages
), headed AS (
  SELECT doc_id, text, substr(replace(replace(replace(replace(replace(string_split(text, chr(10))[1], '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;'), 1, 60) AS head FROM documents
), plain AS (
  SELECT doc_id, text, regexp_replace(replace(replace(regexp_replace(regexp_replace(head, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;?', '&', 'g') AS head FROM headed
), made AS (
  SELECT page_id, url, trim(regexp_replace(head || ' ' || text, '\s+', ' ', 'g')) AS text FROM named JOIN plain USING (doc_id)
)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM made
"""
