"""HTML extraction from flat text blocks by shallow features.

A page is cut into flat text blocks at block-level tags.  A block is described
by its words, its link density (share of words inside links) and the same of
the block before and the block after; a decision tree (Gini impurity, grown in
numpy) trained on a small labelled table tells content from boilerplate.  The
text of a page is its content blocks, one a line.  A page is read once from
beginning to end, in time proportional to its length however broken it is.

Defined results: null, empty or blank html, and html without text, gives the
empty text; broken tags, unclosed elements and stray ``<`` are read as far as
they go; scripts, styles, comments and the head are never text; html of any
length is read whole; repeated rows give repeated results; an empty table gives
an empty result.  Only ``page_id`` and ``html`` are read, whatever other columns
there are.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _spark
from .html_labels import TABLE

_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*)\b")
#: Elements whose content is never text; without an end they reach to the end of the page, but for the head.
_HIDDEN = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("script", "style", "noscript", "template", "title", "head")}
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())

#: Levels of the tree, and rows of the table that a leaf holds at least.
DEPTH, LEAF = 6, 2


def pieces(page: str) -> Iterator[tuple[str, str]]:
    """(tag, "") of each tag, its name in small letters and after a slash if it ends an element, and ("", text) of what lies between."""
    after: dict[str, tuple[int, int]] = {}  # where the next end of each kind lies, as far as it is known
    nowhere = (len(page) + 1, len(page) + 1)

    def next_end(kind: str, at: int) -> int:
        if after.get(kind, (-1, -1))[0] < at:
            if kind in _HIDDEN:
                m = _HIDDEN[kind].search(page, at)
                after[kind] = m.span() if m else nowhere
            else:
                k = page.find(kind, at)
                after[kind] = (k, k + len(kind)) if k >= 0 else nowhere
        return after[kind][1]

    at = 0
    while at < len(page):
        start = page.find("<", at)
        if start < 0:
            start = len(page)
        if start > at:
            yield "", page[at:start]
        if start == len(page):
            return
        at = start
        if page.startswith("<!--", at):
            at = min(next_end("-->", at + 4), len(page))
            yield "", " "
            continue
        end = next_end(">", at)
        m = _NAME.match(page, at)
        if end > len(page) or not m and page[at + 1 : at + 2] not in ("!", "?"):
            at += 2 if page.startswith("</", at) else 1  # a stray sign
            continue
        if not m:
            at = end
            yield "", " "
            continue
        name = m.group(1).lower()
        opens = page[at + 1] != "/"
        at = end
        if opens and name in _HIDDEN:
            close = next_end(name, at)
            if close <= len(page) or name != "head":
                at = min(close, len(page))
                yield "", " "
                continue
        yield (name if opens else f"/{name}"), ""


def plain(text: str) -> str:
    """text with its entities as characters; as it stands where a number is beyond all measure."""
    try:
        return entities.unescape(text)
    except ValueError:
        return text


def blocks(html: str | None) -> list[tuple[str, int, int]]:
    """(text, words, words in links) of the flat text blocks."""
    out: list[tuple[str, int, int]] = []
    text: list[str] = []
    words = linked = depth = 0
    for tag, raw in pieces(html or ""):
        if not tag:
            piece = plain(raw)
            n = len(piece.split())
            text.append(piece)
            words += n
            linked += n if depth else 0
        elif tag in ("a", "/a"):
            depth = max(0, depth + (1 if tag == "a" else -1))
        elif tag in ("br", "/br"):
            text.append(" ")
        elif tag.lstrip("/") not in _INLINE:
            if words:
                out.append((" ".join("".join(text).split()), words, linked))
            text, words, linked, depth = [], 0, 0, 0
    if words:
        out.append((" ".join("".join(text).split()), words, linked))
    return out


def features(found: list[tuple[str, int, int]]) -> np.ndarray:
    """Words and link density of the block before, the block and the block after, 0 beyond the page."""
    own = np.zeros((len(found) + 2, 2))
    for k, (_, n, linked) in enumerate(found):
        own[k + 1] = n, linked / max(1, n)
    return np.hstack([own[:-2], own[1:-1], own[2:]])


def grow(x: np.ndarray, y: np.ndarray, depth: int = DEPTH, leaf: int = LEAF) -> tuple:
    """A decision tree: (feature, threshold, tree below or at it, tree above it), or the label's share."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0) or len(y) < 2 * leaf:
        return (share,)
    best: tuple = (len(y) * share * (1 - share) - 1e-9,)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(y))
        cut = (v[1:] > v[:-1]) & (n >= leaf) & (len(y) - n >= leaf)
        if not cut.any():
            continue
        a, b = ones[:-1], ones[-1] - ones[:-1]
        cost = np.where(cut, a * (n - a) / n + b * (len(y) - n - b) / (len(y) - n), np.inf)
        k = int(np.argmin(cost))
        if cost[k] < best[0]:
            best = (float(cost[k]), f, float((v[k] + v[k + 1]) / 2))
    if len(best) == 1:
        return (share,)
    low = x[:, best[1]] <= best[2]
    return (best[1], best[2], grow(x[low], y[low], depth - 1, leaf), grow(x[~low], y[~low], depth - 1, leaf))


def classify(tree: tuple, x: np.ndarray) -> np.ndarray:
    """Whether each row is content."""
    if len(tree) == 1:
        return np.full(len(x), tree[0] >= 0.5)
    out = np.zeros(len(x), bool)
    low = x[:, tree[0]] <= tree[1]
    out[low] = classify(tree[2], x[low])
    out[~low] = classify(tree[3], x[~low])
    return out


@cache
def tree() -> tuple:
    """The tree of the labelled table."""
    table = np.array(TABLE, float)
    return grow(table[:, :6], table[:, 6])


def text_of(html: str | None) -> str:
    """The content of a page."""
    found = blocks(html)
    if not found:
        return ""
    return "\n".join(b[0] for b, good in zip(found, classify(tree(), features(found)), strict=True) if good)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [blocks(h) for h in b.column(1).to_pylist()]
        edge = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(int)
        good = classify(tree(), np.vstack([features(f) for f in found])) if edge[-1] else np.zeros(0, bool)
        texts = ["\n".join(x[0] for x, ok in zip(f, good[edge[k] : edge[k + 1]], strict=True) if ok) for k, f in enumerate(found)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["page_id", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, text) of every page."""
    _spark.session(pages)
    return pages.select("page_id", "html").mapInArrow(_run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, text string")
