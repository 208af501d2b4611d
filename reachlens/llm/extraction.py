"""Main text of web pages by a tree-structured graphical model over the block tree.

Every node of a page's block tree (``dom``) is content or not. Unary potentials are linear in the node's features (names of elements and
classes, lengths, links, punctuation, place on the page, neighbours, the words of short texts); parent-child potentials, a table each for
elements with telling names, for other elements and for leaves, connect a node with its parent. Sum-product messages go up the tree and down again, which gives each
node's exact marginal; leaves whose marginal is at least THRESHOLD are the main text.

All weights are fitted together by the gradient of the labelled trees' likelihood, on labelled pages: a bounded sample of the table's own pages
with ``main`` or ``article`` elements, whose markup tells what is content (with names hidden in half the copies, so that the model doesn't rest on them), and layouts
filled with the sample's texts (``layouts``).

Defined results: a null or empty page has the empty text; so has one without main text; white space is Unicode's; pages of any length and depth are worked on
whole; each row stands for itself, so rows that repeat give equal results; only the id, url and html columns are read, so
further ones can't clash. Without pages to learn from, layouts are filled with made-up words. No rows give no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachlens.llm import dom, layouts, memo
from reachlens.llm.text import runs

#: Pages that the model is fitted on at most (those with the smallest hashes of their ids) and their bytes at most, layouts beside them, and steps.
SAMPLE, LONGEST, LAYOUTS, STEPS = 300, 1 << 14, 1_000, 180
THRESHOLD = 0.5
DIM = 1 << 15
#: In texts of at most so many words, words of the layouts' vocabulary are features.
SHORT = 8
#: A hashed feature of fewer labelled pages has no weight: names of single pages tell nothing.
LEAST_PAGES = 12
#: The kinds of nodes whose edges to their parents have a table of potentials each.
TELLING, PLAIN, LEAF = range(3)
#: Bytes of pages that are worked off together.
SLICE = 1 << 18

ATTRIBUTE = re.compile(r"""(?:^|[\s"'])(class|id|role|itemprop|aria-label|hidden|style|data-label)(?:\s*=\s*("[^"]*"?|'[^']*'?|[^\s"'>]+))?(?=[\s"'/]|$)""", re.IGNORECASE)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[^\W\d_]+")


@lru_cache(1 << 16)
def column(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % DIM


def named(tag: str, attrs: str) -> tuple[tuple[int, ...], tuple[int, ...], tuple[int, ...], str | None]:
    """An element's columns, those it gives its children, those it gives all below it up to the next telling element, and its label if it has one."""
    parts, label = [], None
    for key, value in ATTRIBUTE.findall(attrs) if attrs.strip(" /") else ():
        key, value = key.lower(), value.strip("\"'")
        if key == "data-label":
            label = value
        elif key == "hidden" or key == "style" and "none" in value:
            parts.append("hidden")
        elif key != "style":
            parts += [p.lower() for p in PART.findall(value)]
    own = {f"t={tag}", *(f"c={p}" for p in parts)}
    return (*(tuple(sorted(column(far + f) for f in own)) for far in ("", "p", "n")), label)


_named = lru_cache(1 << 12)(named)


def forget() -> None:
    column.cache_clear()
    _named.cache_clear()


memo.remembers("extraction", forget)


@lru_cache(1)
def offsets() -> dict[str, int]:
    """Columns of the features that have values in steps: chosen once, apart from the hashed ones' use of the same table."""
    return {name: DIM + 1024 * k for k, name in enumerate(("length", "links", "marks", "share", "place", "leaves", "before", "after", "cross", "end"))}


WIDTH = DIM + 1024 * 10


class Batch:
    """The trees of some pages as arrays: parent, level, leaf, page, and features as (row, column) pairs."""

    def __init__(self, trees: list[dom.Tree], plain: list[bool] | None = None) -> None:
        sizes = np.array([len(t.parent) for t in trees])
        start = np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.page = np.repeat(np.arange(len(trees)), sizes)
        parent = np.fromiter((p for t in trees for p in t.parent), np.int64, len(start))
        self.parent = np.where(parent < 0, -1, parent + start)
        self.level = np.fromiter((d for t in trees for d in t.depth), np.int64, len(start))
        self.text = [x for t in trees for x in t.text]
        self.leaf = np.fromiter((tag == "#text" for t in trees for tag in t.tag), bool, len(start))
        order = np.argsort(self.level, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(self.level[order])) + 1)
        self.labels = np.full(len(start), -1)
        self.kind = np.where(self.leaf, LEAF, PLAIN)
        self.rows, self.cols = self.features(trees, plain or [False] * len(trees))

    def features(self, trees: list[dom.Tree], plain: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        rows, cols, node = [], [], 0
        marks = np.zeros(len(self.parent))
        ends = np.zeros(len(self.parent), int)
        for tree, hide in zip(trees, plain, strict=True):
            given: list[tuple[int, ...]] = []
            far: list[tuple[int, ...]] = []
            for tag, attrs, text, parent in zip(tree.tag, tree.attrs, tree.text, tree.parent, strict=True):
                if text:
                    marks[node] = text.count(".") + text.count(",") + text.count("!") + text.count("?")
                    ends[node] = 1 + (text[-1] in ".!?:;\"”»…")
                    own, below, under = ((),) * 3
                    if text.count(" ") < SHORT:
                        own = [column("w=" + w) for w in {w.strip(".,:;!?|()").lower() for w in text.split(" ")} & layouts.VOCABULARY]
                else:
                    own, below, under, label = _named("div" if hide and tag in layouts.TELLING else tag, "" if hide else attrs) if len(attrs) < 512 else named(tag, "" if hide else attrs)
                    if label is not None:
                        self.labels[node] = int(label)
                    if len(own) > 1 or not hide and (tag in layouts.TELLING or tag in layouts.ASIDE):
                        self.kind[node] = TELLING
                above, over = (given[parent], far[parent]) if parent >= 0 else ((), ())
                given.append(below)
                far.append(under if self.kind[node] == TELLING else over)
                cols += own
                cols += above
                cols += over
                rows.append(len(own) + len(above) + len(over))
                node += 1
        hashed = np.repeat(np.arange(node), rows), np.array(cols, np.int64)
        stepped = self.stepped(trees, marks, ends)
        return np.concatenate([hashed[0], *(np.arange(node)[at] for at, _ in stepped)]), np.concatenate([hashed[1], *(values[at] for at, values in stepped)])

    def stepped(self, trees: list[dom.Tree], marks: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        chars = np.fromiter(map(len, self.text), np.int64, len(self.text)).astype(float)
        linked = np.fromiter((x for t in trees for x in t.linked), float, len(chars))
        leaves = self.leaf.astype(float)
        before = np.cumsum(chars) - chars
        first = before[np.searchsorted(self.page, np.arange(len(trees)))][self.page]
        for at in reversed(self.levels[1:]):
            for total in (chars, linked, marks, leaves):
                np.add.at(total, self.parent[at], total[at])
        whole = chars[np.searchsorted(self.page, np.arange(len(trees)))][self.page]
        log = lambda x: np.minimum(np.log2(x + 1), 15).astype(int)
        length, links = log(chars), np.digitize(linked / np.maximum(chars, 1), (0.001, 0.1, 0.3, 0.6, 0.9))
        near = {}
        (where,) = np.nonzero(self.leaf)
        for name, shift in (("before", 1), ("after", -1)):
            other = np.full(len(chars), 15)
            moved = np.roll(where, shift)
            inside = self.page[moved] == self.page[where]
            inside[0 if shift > 0 else -1 :][:1] = False
            other[where] = np.where(inside, np.minimum(length[moved], 14), 15)
            near[name] = other * 8 + links
        values = {
            "length": length, "links": links, "marks": np.digitize(marks / np.maximum(chars, 1), (0.002, 0.01, 0.02, 0.04)), "share": np.digitize(chars / np.maximum(whole, 1), (0.02, 0.1, 0.3, 0.6, 0.9)),
            "place": np.minimum(4 * (before - first) / np.maximum(whole, 1), 3).astype(int), "leaves": log(leaves), **near, "cross": length * 8 + links, "end": ends * 16 + length}
        every = np.ones(len(chars), bool)
        return [(self.leaf if name in ("before", "after", "end") else every, offsets()[name] + v + 512 * self.leaf) for name, v in values.items()]


class Model:
    """weights (WIDTH), pairs: [kind of the child][parent's state][child's state]."""

    def __init__(self, weights: np.ndarray, pairs: np.ndarray) -> None:
        self.weights, self.pairs = weights, pairs

    def unary(self, batch: Batch) -> np.ndarray:
        return np.bincount(batch.rows, self.weights[batch.cols], len(batch.parent))

    def messages(self, batch: Batch) -> tuple[np.ndarray, np.ndarray]:
        """Each node's marginal of being content, and the log beliefs of its edge to the parent (parent's state, own state)."""
        pair = self.pairs[batch.kind]
        inside = np.zeros((len(batch.parent), 2))
        inside[:, 1] = self.unary(batch)
        up = np.zeros_like(inside)
        for at in reversed(batch.levels[1:]):
            up[at] = np.logaddexp(*np.moveaxis(inside[at, None, :] + pair[at], 2, 0))
            np.add.at(inside, batch.parent[at], up[at])
        whole, edge = inside.copy(), np.zeros((len(inside), 2, 2))
        for at in batch.levels[1:]:
            around = whole[batch.parent[at]] - up[at]  # all that the parent knows but from this child
            edge[at] = around[:, :, None] + pair[at] + inside[at, None, :]
            whole[at] = np.logaddexp(edge[at, 0], edge[at, 1])
        return 1 / (1 + np.exp(np.clip(whole[:, 0] - whole[:, 1], -700, 700))), edge


def fit_trees(batch: Batch, labels: np.ndarray, steps: int = STEPS, rate: float = 0.1, l2: float = 0.02) -> Model:
    """The model that makes labelled trees likely: observed less expected features and edges, by Adam on the whole batch."""
    model = Model(np.zeros(WIDTH), np.zeros((3, 2, 2)))
    inner = batch.parent >= 0
    kind, n = batch.kind[inner], max(1, int(batch.page.max(initial=0)) + 1)
    seen = np.zeros((3, 2, 2))
    np.add.at(seen, (kind, labels[batch.parent[inner]], labels[inner]), 1)
    on_pages = np.unique(batch.cols * n + batch.page[batch.rows]) // n
    counts = np.append(np.bincount(on_pages, minlength=WIDTH) >= np.where(np.arange(WIDTH) < DIM, LEAST_PAGES, 1), np.ones(12, bool))
    params = np.zeros(WIDTH + 12)
    m, v = np.zeros_like(params), np.zeros_like(params)
    for t in range(1, steps + 1):
        marginal, edge = model.messages(batch)
        edge = np.exp(edge[inner] - edge[inner].max((1, 2), keepdims=True))
        edge /= edge.sum((1, 2), keepdims=True)
        expected = np.stack([edge[kind == k].sum(0) for k in range(3)])
        grad = counts * (np.append(np.bincount(batch.cols, (labels - marginal)[batch.rows], WIDTH), (seen - expected).ravel()) - l2 * params) / n
        m, v = 0.9 * m + 0.1 * grad, 0.98 * v + 0.02 * grad**2
        params += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.98**t)) + 1e-8)
        model = Model(params[:WIDTH], params[WIDTH:].reshape(3, 2, 2))
    return model


def by_markup(tree: dom.Tree) -> list[int] | None:
    """Labels of leaves that a page's own markup tells: inside main or article, outside of what these leave aside. None if it has neither."""
    if not any(tag in ("main", "article") for tag in tree.tag):
        return None
    state = []
    for tag, parent in zip(tree.tag, tree.parent, strict=True):
        above = state[parent] if parent >= 0 else 0
        state.append(-1 if above < 0 or tag in layouts.ASIDE else 1 if above or tag in ("main", "article") else 0)
    return [int(s > 0) for s in state]


def from_leaves(batch: Batch, leaf_labels: np.ndarray) -> np.ndarray:
    """Labels of all nodes: an inner node's is that of most of the text below it."""
    good = np.where(batch.leaf, np.fromiter(map(len, batch.text), float, len(batch.text)) * leaf_labels, 0)
    total = np.where(batch.leaf, np.fromiter(map(len, batch.text), float, len(batch.text)), 0)
    for at in reversed(batch.levels[1:]):
        np.add.at(good, batch.parent[at], good[at])
        np.add.at(total, batch.parent[at], total[at])
    return (good * 2 > total).astype(int)


def inherited(batch: Batch) -> np.ndarray:
    """Labels from the nearest labelled element above."""
    out = batch.labels.copy()
    for at in batch.levels[1:]:
        out[at] = np.where(out[at] < 0, out[batch.parent[at]], out[at])
    return np.maximum(out, 0)


def fit_pages(htmls: list[str], n_layouts: int = LAYOUTS, steps: int = STEPS, seed: int = 11) -> Model:
    """The model out of some pages and the layouts filled with their texts."""
    told = [(tree, own) for tree in map(dom.parse, htmls) if (own := by_markup(tree)) is not None]
    good = [x for tree, own in told for x, tag, y in zip(tree.text, tree.tag, own, strict=True) if tag == "#text" and y]
    rest = [x for tree, own in told for x, tag, y in zip(tree.text, tree.tag, own, strict=True) if tag == "#text" and not y]
    made = [dom.parse(x) for x in layouts.pages(n_layouts, good, rest, seed)]
    trees = [t for t, _ in told] * 2 + made
    batch = Batch(trees, [False] * len(told) + [True] * len(told) + [False] * len(made))
    leaf = np.concatenate([*(np.array(own) for _, own in told * 2), inherited(batch)[np.searchsorted(batch.page, 2 * len(told)) :]])
    return fit_trees(batch, from_leaves(batch, leaf), steps)


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> Model:
    """The model of a table of pages; at most SAMPLE of them, of at most LONGEST bytes each, come to the driver."""
    short = pages.select(F.col(id_col).alias("_id"), F.col(html_col).alias("_html")).filter(F.octet_length("_html") <= LONGEST)
    picked = short.orderBy(F.xxhash64(F.lit("sample"), "_id"), F.xxhash64("_html"), "_html").limit(SAMPLE).select("_html").toArrow()
    return fit_pages(picked["_html"].to_pylist())


def extracted(htmls: list[str], model: Model, threshold: float = THRESHOLD) -> list[list[str]]:
    """The blocks of main text of each page."""
    batch = Batch([dom.parse(x) for x in htmls])
    marginal, _ = model.messages(batch)
    out: list[list[str]] = [[] for _ in htmls]
    for k in np.flatnonzero(batch.leaf & (marginal >= threshold)):
        out[batch.page[k]].append(batch.text[k])
    return out


def main_text(pages: DataFrame, model: Model, with_blocks: bool = False, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of every page, its blocks joined by empty lines, and its number of code points. ``with_blocks`` adds the blocks."""
    weights, pairs = model.weights.astype(np.float32), model.pairs

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo.only("extraction")
        own = Model(weights.astype(float), pairs)
        for batch in batches:
            for a, b in runs(batch.column(2), SLICE):
                blocks = extracted([x or "" for x in batch.column(2).slice(a, b - a).to_pylist()], own)
                texts = ["\n\n".join(x) for x in blocks]
                made = [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), *([pa.array(blocks, pa.list_(pa.string()))] if with_blocks else [])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *made], ["page_id", "url", "text", "n_chars", *["blocks"] * with_blocks])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(id_col), F.col(url_col), F.col(html_col)).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long" + ", blocks array<string>" * with_blocks)
