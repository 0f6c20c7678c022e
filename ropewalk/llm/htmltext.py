"""Main text of web pages: boosted trees over DOM nodes, decoded as one consistent choice per page.

Every element that holds text and every run of inline text is a node (``dom``). Boosted trees (``boosting``) say for each
node whether all, none or some of its text belongs to the article, from text amount and density of its subtree, links,
punctuation, place in the page, depth, statistics of siblings, parent and page, and the log odds of its own and
its ancestors' tag and attribute tokens. Decoding then chooses one state for all nodes of a page at once: under a node that is kept all is
kept, under a node that is dropped all is dropped, and among these choices the one with the largest total log chance is found
by one pass up and one pass down the tree, so no descendant contradicts an ancestor.

The trees are fitted on ``PAGES`` generated pages (``layouts``; pages carry no labels), the same in every run, once per
driver; the fit does not depend on the table. Pages are judged one by one where they lie, so nothing is shuffled.

Defined results: a null or empty page, or one without an article, has the empty text; a page of any size and depth is one
tree in its task; cut pages end all their tags; equal pages have equal texts, and rows with the same id stay rows of their own;
``extract`` keeps the columns it is asked for, ``report`` ``page_id`` and ``url``, so clashing names do not arise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import boosting, layouts
from .dom import Page, parse

PAGES = 500      # generated pages of the fit
KEEP, DROP, SOME = 0, 1, 2
BATCH = 1 << 22  # characters of pages judged together
MARKS = ".,;:!?"


@dataclass
class Forest:
    """The text-bearing nodes of many pages, in page order."""

    tags: list[str]
    tokens: list[tuple[str, ...]]
    text: list[str]
    parent: np.ndarray   # -1 for the root of a page
    end: np.ndarray
    page: np.ndarray
    counts: np.ndarray   # per node, own: chars, words, linked, strong, marks, runs, images, controls, links


def forest(pages: list[Page]) -> Forest:
    tags, tokens, text, parent, end, page, counts = [], [], [], [], [], [], []
    for number, p in enumerate(pages):
        base = len(tags)
        tags += p.tags
        tokens += p.tokens
        text += p.text
        parent += [q + base if q >= 0 else -1 for q in p.parent]
        end += [e + base for e in p.end]
        page += [number] * len(p.tags)
        counts += [(len(t), t.count(" ") + 1, a, s, sum(map(t.count, MARKS)), 1, *x) if t else (0, 0, 0, 0, 0, 0, *x)
                   for t, a, s, x in zip(p.text, p.linked, p.strong, p.extras)]
    parent, end, page = np.array(parent, int), np.array(end, int), np.array(page, int)
    counts = np.array(counts, float).reshape(-1, 9)
    # drop nodes without text; their controls and images count for the nearest node that stays
    whole = np.concatenate([[0], np.cumsum(counts[:, 0])])
    kept = (whole[end] > whole[:-1]) | (parent < 0)
    up = np.arange(len(kept))
    while not kept[up].all():
        up = np.where(kept[up], up, parent[up])
    own = np.zeros_like(counts)
    np.add.at(own, up, counts)
    place = np.concatenate([[0], np.cumsum(kept)])
    index = np.flatnonzero(kept)
    parent = np.where(parent[index] >= 0, place[np.maximum(parent[index], 0)], -1)
    return Forest([tags[i] for i in index], [tokens[i] for i in index], [text[i] for i in index], parent, place[end[index]],
                  page[index], own[index])


def depths(parent: np.ndarray) -> np.ndarray:
    """Ancestors of each node; parents come before their children."""
    depth, up = np.zeros(len(parent), int), parent.copy()
    while (up >= 0).any():
        depth += up >= 0
        up = np.where(up >= 0, parent[up], -1)
    return depth


def token_set(tag: str, tokens: tuple[str, ...]) -> list[str]:
    """Tag, attribute words, and the beginnings of longer words."""
    return [tag, *tokens, *[t[:5] + "*" for t in tokens if len(t) > 5]]


@dataclass
class Odds:
    """Log odds of tokens: the node's text is article rather than not."""

    known: dict[str, float]

    def of(self, f: Forest, but: np.ndarray | None = None) -> np.ndarray:
        """Per node: largest, smallest and summed odds of its tokens, and the odds of its tag."""
        seen: dict[tuple[str, tuple[str, ...]], tuple[float, ...]] = {}
        out = np.zeros((len(f.tags), 4))
        for i, pair in enumerate(zip(f.tags, f.tokens)):
            row = seen.get(pair)
            if row is None:
                o = [self.known.get(t, 0.0) for t in token_set(*pair)]
                row = seen[pair] = (max(o), min(o), sum(o), o[0])
            out[i] = row
        return out


def token_odds(f: Forest, state: np.ndarray, folds: np.ndarray, fold: int) -> Odds:
    """Odds from the nodes outside ``fold``; mixed nodes say nothing."""
    count: dict[str, list[float]] = {}
    for i in np.flatnonzero((folds != fold) & (state != SOME)):
        for t in set(token_set(f.tags[i], f.tokens[i])):
            count.setdefault(t, [0.0, 0.0])[state[i]] += 1
    return Odds({t: float(np.log((k + 1) / (d + 1))) for t, (k, d) in count.items() if k + d >= 4})


def _carried(parent: np.ndarray, depth: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Largest, smallest and summed odds over all ancestors."""
    out = np.zeros((len(own), 3))
    for d in range(1, depth.max(initial=0) + 1):
        i = np.flatnonzero(depth == d)
        p = parent[i]
        out[i] = np.stack([np.maximum(out[p, 0], own[p, 0]), np.minimum(out[p, 1], own[p, 1]), out[p, 2] + own[p, 2]], 1)
    return out


def features(f: Forest, odds: np.ndarray) -> np.ndarray:
    n = len(f.tags)
    sums = np.concatenate([np.zeros((1, 9)), np.cumsum(f.counts, axis=0)])
    tree = sums[f.end] - sums[:-1]
    chars, words, linked, strong, marks, runs, images, controls, links = tree.T
    some, some_words = np.maximum(chars, 1), np.maximum(words, 1)
    depth = depths(f.parent)
    root = np.maximum(np.searchsorted(f.page, f.page, "left"), 0)
    up = np.where(f.parent >= 0, f.parent, root)
    over = np.where(f.parent[up] >= 0, f.parent[up], root)
    all_chars = np.maximum(chars[root], 1)
    before = sums[:-1, 0] - sums[root, 0]
    # siblings stand side by side when sorted by parent
    order = np.argsort(np.where(f.parent >= 0, f.parent, n + f.page), kind="stable")
    group = np.where(f.parent >= 0, f.parent, n + f.page)[order]
    first = np.searchsorted(group, group, "left")
    last = np.searchsorted(group, group, "right") - 1
    at, count = np.empty(n, int), np.empty(n, int)
    at[order] = np.arange(n) - first
    count[order] = last - first + 1
    before_sib, after_sib = np.full(n, -1), np.full(n, -1)
    before_sib[order[1:]] = np.where(first[1:] < np.arange(1, n), order[:-1], -1)
    after_sib[order[:-1]] = np.where(last[:-1] > np.arange(n - 1), order[1:], -1)
    _, kinds = np.unique(np.array(f.tags, dtype=object).astype(str), return_inverse=True)
    _, alike, size = np.unique(group[np.argsort(order)] * np.int64(kinds.max(initial=0) + 1) + kinds,
                               return_inverse=True, return_counts=True)
    children = np.bincount(f.parent[f.parent >= 0], minlength=n)

    def beside(values: np.ndarray, who: np.ndarray) -> np.ndarray:
        return np.where(who >= 0, values[who], -1)

    log_chars, dense, link_share = np.log1p(chars), chars / np.maximum(f.end - np.arange(n), 1), linked / some
    mark_share = marks / some_words
    has = {t: np.array([x == t for x in f.tags]) for t in ("article", "main", "h1", "p", "li", "#text")}
    inside = {t: (lambda c: c[f.end] - c[:-1])(np.concatenate([[0], np.cumsum(v)])) for t, v in has.items()}
    return np.column_stack([
        depth, has["#text"], log_chars, np.log1p(words), link_share, strong / some, mark_share, chars / some_words, dense,
        chars / all_chars, before / all_chars, (before + chars) / all_chars, children, at, count - at, count, size[alike] / count,
        size[alike], chars / np.maximum(chars[up], 1),
        beside(log_chars, before_sib), beside(link_share, before_sib), beside(mark_share, before_sib),
        beside(log_chars, after_sib), beside(link_share, after_sib), beside(mark_share, after_sib),
        link_share[up], log_chars[up], dense[up], mark_share[up], children[up], link_share[over], log_chars[over], dense[over],
        np.log1p(images), np.log1p(controls), np.log1p(links), runs, chars / np.maximum(runs, 1),
        inside["p"], inside["li"], inside["h1"], inside["article"], inside["main"], inside["h1"][root], inside["article"][root],
        inside["main"][root], np.log1p(chars[root]), odds, odds[up], beside(odds[:, 2], before_sib), beside(odds[:, 2], after_sib),
        _carried(f.parent, depth, odds)])


def decoded(f: Forest, log: np.ndarray) -> np.ndarray:
    """State of each node: the consistent choice with the largest total log chance per page."""
    n, depth = len(f.tags), depths(f.parent)
    sums = np.concatenate([np.zeros((1, 2)), np.cumsum(log[:, :2], axis=0)])
    value = np.empty((n, 3))
    value[:, :2] = sums[f.end] - sums[:-1]
    value[:, SOME] = np.where([t == "#text" for t in f.tags], -np.inf, log[:, SOME])
    for d in range(depth.max(initial=0), 0, -1):
        i = np.flatnonzero(depth == d)
        np.add.at(value[:, SOME], f.parent[i], value[i].max(axis=1))
    state = value.argmax(axis=1)
    for d in range(1, depth.max(initial=0) + 1):
        i = np.flatnonzero(depth == d)
        above = state[f.parent[i]]
        state[i] = np.where(above == SOME, state[i], above)
    return state


@dataclass
class Extractor:
    odds: Odds
    trees: boosting.Trees

    def states(self, f: Forest) -> np.ndarray:
        return decoded(f, self.trees.log_chances(features(f, self.odds.of(f))))

    def texts(self, pages: list[str | None]) -> list[str]:
        f = forest([parse(p) for p in pages])
        kept: list[list[str]] = [[] for _ in pages]
        for i in np.flatnonzero((self.states(f) == KEEP) & [bool(t) for t in f.text]):
            kept[f.page[i]].append(f.text[i])
        return ["\n\n".join(blocks) for blocks in kept]


def labelled(seeds: range) -> tuple[Forest, np.ndarray]:
    """Generated pages with the state of every node."""
    f = forest([parse(layouts.page(s)) for s in seeds])
    good = np.array([layouts.MARK in t for t in f.text])
    f.text = [t.replace(layouts.MARK, "") for t in f.text]
    f.counts[:, 0] -= good
    runs = np.array([bool(t) for t in f.text])
    sums = np.concatenate([np.zeros((1, 2)), np.cumsum(np.column_stack([runs & good, runs & ~good]), axis=0)])
    yes, no = (sums[f.end] - sums[:-1]).T
    return f, np.where(no == 0, KEEP, np.where(yes == 0, DROP, SOME))


@lru_cache(maxsize=2)
def fit(pages: int = PAGES) -> Extractor:
    """Token odds of one half of the pages describe the other half, so the trees do not trust them too much."""
    f, state = labelled(range(pages))
    folds = f.page % 2
    odds = np.zeros((len(f.tags), 4))
    for fold in range(2):
        odds[folds == fold] = token_odds(f, state, folds, fold).of(f)[folds == fold]
    return Extractor(token_odds(f, state, folds, 2), boosting.fit(features(f, odds), state, 3))


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` and ``text``: the blocks of the article in page order, parted by an empty line."""
    rows = pages.select(*keep, F.col(html).alias("_html"))
    shipped = pages.sparkSession.sparkContext.broadcast(fit())  # fixed size, whatever the table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, part, size = [], [], 0
            for html in batch.column("_html").to_pylist():
                part.append(html)
                size += len(html or "")
                if size >= BATCH:
                    texts += shipped.value.texts(part)
                    part, size = [], 0
            texts += shipped.value.texts(part) if part else []
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*keep, "text"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kinds}, text string")


def report(pages: DataFrame) -> DataFrame:
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return extract(rows).withColumn("n_chars", F.length("text").cast("long"))
