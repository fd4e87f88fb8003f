"""Main text of HTML pages from flat text blocks and a decision tree.

A page is read as a flat sequence of text blocks, split at every block-level tag. A block's features are its number of
words and its link density (share of its words inside links), and those of the block before and the block after. A
decision tree, grown here by Gini impurity on the small labelled table TABLE, tells content from boilerplate; the text
of a page is its content blocks, one a line.

A tag ends at the first ">" outside quoted attribute values. Words are linked from "<a" to "</a", blocks in between
included; an "<a" that is never closed, or not before the next one, ends at the next block-level tag. Comments, scripts,
styles and head matter carry no text. An unclosed comment or script runs to the end of the page, an unclosed tag is text.

TABLE has 193 rows: 178 distinct ones are blocks of generated pages of the kind in the table `pages`, labelled by what the
page template put there, the others are made up after common page forms (link lists, cards, long articles). Accuracy on
those generated pages is so no held-out figure; tests/llm measures it on pages of other templates.

Null html: null text and no blocks; empty html: the empty text. Null ids pass through; repeated rows are extracted one by
one. Ties: a leaf with as many rows of either kind is content. A very long page is read in one pass and held with its
blocks. Other columns, whatever their names, are ignored. No rows: an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineloom.llm import shared

DEPTH, LEAF = 5, 3
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: A tag from "<" to ">"; quotes count after "=" only, and only if they are closed.
TAG = re.compile(r"""<(?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+>""")
SILENT = frozenset(("script", "style", "noscript", "template", "title", "svg", "iframe", "textarea", "select"))

#: words and link density (in percent) of the block before, of the block, of the block after; 1 for content.
TABLE = (
    (0, 0, 1, 100, 1, 100, 0), (1, 100, 1, 100, 1, 100, 0), (1, 100, 1, 100, 1, 100, 0), (1, 100, 1, 100, 1, 100, 0), (1, 100, 1, 100, 1, 100, 0), (1, 100, 1, 100, 8, 0, 0), (1, 100, 8, 0, 10, 0, 0), (8, 0, 10, 0, 51, 0, 1),
    (10, 0, 51, 0, 8, 0, 1), (51, 0, 8, 0, 11, 0, 1), (8, 0, 11, 0, 36, 0, 1), (11, 0, 36, 0, 32, 0, 1), (36, 0, 32, 0, 52, 0, 1), (32, 0, 52, 0, 25, 0, 1), (52, 0, 25, 0, 11, 0, 1), (25, 0, 11, 0, 0, 0, 0),
    (0, 0, 1, 100, 1, 100, 0), (1, 100, 1, 100, 1, 100, 0), (1, 100, 1, 100, 1, 100, 0), (1, 100, 1, 100, 1, 100, 0), (1, 100, 1, 100, 1, 100, 0), (1, 100, 1, 100, 8, 0, 0), (1, 100, 8, 0, 9, 0, 0), (8, 0, 9, 0, 12, 0, 1),
    (9, 0, 12, 0, 9, 0, 1), (12, 0, 9, 0, 39, 0, 1), (9, 0, 39, 0, 8, 0, 1), (39, 0, 8, 0, 20, 0, 1), (8, 0, 20, 0, 8, 0, 1), (20, 0, 8, 0, 8, 0, 1), (8, 0, 8, 0, 0, 0, 0), (0, 0, 1, 100, 1, 100, 0),
    (1, 100, 1, 100, 1, 100, 0), (1, 100, 1, 100, 1, 100, 0), (1, 100, 5, 0, 2, 0, 0), (5, 0, 2, 0, 2, 0, 1), (2, 0, 2, 0, 11, 0, 1), (2, 0, 11, 0, 0, 0, 0), (1, 100, 8, 0, 11, 0, 0), (8, 0, 11, 0, 17, 0, 1),
    (11, 0, 17, 0, 143, 0, 1), (17, 0, 143, 0, 31, 0, 1), (143, 0, 31, 0, 189, 0, 1), (31, 0, 189, 0, 43, 0, 1), (189, 0, 43, 0, 51, 0, 1), (43, 0, 51, 0, 22, 0, 1), (51, 0, 22, 0, 11, 0, 1), (22, 0, 11, 0, 0, 0, 0),
    (1, 100, 8, 0, 8, 0, 0), (8, 0, 8, 0, 8, 0, 1), (8, 0, 8, 0, 45, 0, 1), (8, 0, 45, 0, 1, 0, 1), (45, 0, 1, 0, 30, 0, 1), (1, 0, 30, 0, 37, 0, 1), (30, 0, 37, 0, 47, 0, 1), (37, 0, 47, 0, 2, 0, 1),
    (47, 0, 2, 0, 1, 0, 1), (2, 0, 1, 0, 15, 0, 1), (1, 0, 15, 0, 3, 0, 1), (15, 0, 3, 0, 8, 0, 1), (3, 0, 8, 0, 14, 0, 1), (8, 0, 14, 0, 0, 0, 0), (1, 100, 11, 0, 11, 0, 0), (11, 0, 11, 0, 65, 0, 1),
    (11, 0, 65, 0, 57, 0, 1), (65, 0, 57, 0, 5, 0, 1), (57, 0, 5, 0, 131, 0, 1), (5, 0, 131, 0, 21, 0, 1), (131, 0, 21, 0, 3, 0, 1), (21, 0, 3, 0, 82, 0, 1), (3, 0, 82, 0, 108, 0, 1), (82, 0, 108, 0, 29, 0, 1),
    (108, 0, 29, 0, 138, 0, 1), (29, 0, 138, 0, 31, 0, 1), (138, 0, 31, 0, 61, 0, 1), (31, 0, 61, 0, 38, 0, 1), (61, 0, 38, 0, 16, 0, 1), (38, 0, 16, 0, 55, 0, 1), (16, 0, 55, 0, 11, 0, 1), (55, 0, 11, 0, 28, 0, 1),
    (11, 0, 28, 0, 41, 0, 1), (28, 0, 41, 0, 1, 0, 1), (41, 0, 1, 0, 91, 0, 1), (1, 0, 91, 0, 39, 0, 1), (91, 0, 39, 0, 102, 0, 1), (39, 0, 102, 0, 64, 0, 1), (102, 0, 64, 0, 12, 0, 1), (64, 0, 12, 0, 0, 0, 0),
    (1, 100, 9, 0, 7, 0, 0), (9, 0, 7, 0, 968, 0, 1), (7, 0, 968, 0, 9, 0, 1), (968, 0, 9, 0, 7, 0, 1), (9, 0, 7, 0, 0, 0, 0), (1, 100, 4, 0, 6, 0, 0), (4, 0, 6, 0, 6, 0, 1), (6, 0, 6, 0, 10, 0, 1),
    (6, 0, 10, 0, 15, 0, 1), (10, 0, 15, 0, 0, 0, 0), (1, 100, 12, 0, 11, 0, 0), (12, 0, 11, 0, 149, 0, 1), (11, 0, 149, 0, 46, 0, 1), (149, 0, 46, 0, 1, 0, 1), (46, 0, 1, 0, 76, 0, 1), (1, 0, 76, 0, 9, 0, 1),
    (76, 0, 9, 0, 0, 0, 0), (1, 100, 6, 0, 8, 0, 0), (6, 0, 8, 0, 12, 0, 1), (8, 0, 12, 0, 8, 0, 1), (12, 0, 8, 0, 3, 0, 1), (8, 0, 3, 0, 38, 0, 1), (3, 0, 38, 0, 36, 0, 1), (38, 0, 36, 0, 28, 0, 1),
    (36, 0, 28, 0, 6, 0, 1), (28, 0, 6, 0, 25, 0, 1), (6, 0, 25, 0, 32, 0, 1), (25, 0, 32, 0, 13, 0, 1), (32, 0, 13, 0, 0, 0, 0), (1, 100, 10, 0, 4, 0, 0), (10, 0, 4, 0, 4, 0, 1), (4, 0, 4, 0, 47, 0, 1),
    (4, 0, 47, 0, 75, 0, 1), (47, 0, 75, 0, 43, 0, 1), (75, 0, 43, 0, 95, 0, 1), (43, 0, 95, 0, 11, 0, 1), (95, 0, 11, 0, 49, 0, 1), (11, 0, 49, 0, 178, 0, 1), (49, 0, 178, 0, 10, 0, 1), (178, 0, 10, 0, 0, 0, 0),
    (1, 100, 7, 0, 5, 0, 0), (7, 0, 5, 0, 5, 0, 1), (5, 0, 5, 0, 15, 0, 1), (5, 0, 15, 0, 0, 0, 0), (1, 100, 12, 0, 12, 0, 0), (12, 0, 12, 0, 184, 0, 1), (12, 0, 184, 0, 9, 0, 1), (184, 0, 9, 0, 10, 0, 1),
    (9, 0, 10, 0, 0, 0, 0), (1, 100, 7, 0, 11, 0, 0), (7, 0, 11, 0, 37, 0, 1), (11, 0, 37, 0, 17, 0, 1), (37, 0, 17, 0, 13, 0, 1), (17, 0, 13, 0, 24, 0, 1), (13, 0, 24, 0, 61, 0, 1), (24, 0, 61, 0, 22, 0, 1),
    (61, 0, 22, 0, 74, 0, 1), (22, 0, 74, 0, 61, 0, 1), (74, 0, 61, 0, 72, 0, 1), (61, 0, 72, 0, 120, 0, 1), (72, 0, 120, 0, 88, 0, 1), (120, 0, 88, 0, 19, 0, 1), (88, 0, 19, 0, 9, 0, 1), (19, 0, 9, 0, 20, 0, 1),
    (9, 0, 20, 0, 13, 0, 1), (20, 0, 13, 0, 0, 0, 0), (1, 100, 10, 0, 9, 0, 0), (10, 0, 9, 0, 9, 0, 1), (9, 0, 9, 0, 133, 0, 1), (9, 0, 133, 0, 4, 0, 1), (133, 0, 4, 0, 11, 0, 1), (4, 0, 11, 0, 29, 0, 1),
    (11, 0, 29, 0, 10, 0, 1), (29, 0, 10, 0, 14, 0, 1), (10, 0, 14, 0, 0, 0, 0), (1, 100, 11, 0, 5, 0, 0), (11, 0, 5, 0, 5, 0, 1), (5, 0, 5, 0, 30, 0, 1), (5, 0, 30, 0, 31, 0, 1), (30, 0, 31, 0, 31, 0, 1),
    (31, 0, 31, 0, 31, 0, 1), (31, 0, 31, 0, 31, 0, 1), (31, 0, 31, 0, 1, 0, 1), (31, 0, 1, 0, 9, 0, 1), (1, 0, 9, 0, 12, 0, 1), (9, 0, 12, 0, 0, 0, 0), (0, 0, 2, 100, 3, 100, 0), (3, 100, 2, 100, 2, 100, 0),
    (2, 100, 4, 80, 60, 0, 0), (80, 0, 5, 100, 4, 100, 0), (60, 0, 3, 100, 0, 0, 0), (120, 2, 90, 4, 70, 0, 1), (45, 0, 110, 3, 95, 5, 1), (70, 1, 40, 0, 6, 100, 1), (95, 0, 150, 2, 0, 0, 1), (6, 0, 80, 0, 90, 1, 1),
    (1, 100, 72, 0, 0, 0, 1), (0, 0, 90, 0, 0, 0, 1), (40, 0, 120, 2, 0, 0, 1), (2, 100, 85, 1, 0, 0, 1), (30, 0, 65, 0, 0, 0, 1), (0, 0, 80, 0, 60, 0, 1), (0, 0, 150, 3, 1, 100, 1),
)


_LINK = re.compile(r"<a[\s>]")


def blocks(page: str) -> list[tuple[str, int, int]]:
    """(text, words, words in links) of the text blocks of a page, in order."""
    out: list[tuple[str, int, int]] = []
    words: list[str] = []
    linked = at = 0
    link = ""  # inside a link: "closed" up to its end tag, "open" up to the next block
    shuts = opens = 0  # the next end and start of a link at or after the place last asked for
    low = page.lower() if page.isascii() else "".join(c.lower() if c.isascii() else c for c in page)
    ends: dict[str, bool] = {}

    def say(text: str) -> None:
        nonlocal linked
        got = entities.unescape(text).split() if "&" in text else text.split()
        words.extend(got)
        if link:
            linked += len(got)

    def close() -> None:
        nonlocal linked
        if words:
            out.append((" ".join(words), len(words), linked))
            words.clear()
            linked = 0

    while at < len(page):
        tag = page.find("<", at)
        if tag < 0:
            say(page[at:])
            break
        if tag > at:
            say(page[at:tag])
        head = page[tag + 1 : tag + 2]
        if page.startswith("<!--", tag):
            stop = page.find("-->", tag + 4)
            at = len(page) if stop < 0 else stop + 3
            continue
        found = TAG.match(page, tag) if head.isalpha() or head in ("/", "!", "?") else None
        if not found:
            if head.isalpha() or head in ("/", "!", "?"):  # no ">" follows: the rest is text
                say(page[tag:])
                break
            say("<")
            at = tag + 1
            continue
        stop = found.end() - 1
        at = stop + 1
        shut = head == "/"
        name = low[tag + 1 + shut : stop].split(None, 1)
        name = name[0].rstrip("/") if name else ""
        if name in SILENT and not shut and page[stop - 1] != "/":
            if ends.get(name, True):
                end = low.find(f"</{name}", at)
                ends[name] = end >= 0
            else:
                end = -1
            at = len(page) if end < 0 else page.find(">", end) + 1 or len(page)
            close()
        elif name == "a":
            if not shut:
                if shuts < at:
                    shuts = low.find("</a", at)
                    shuts = shuts if shuts >= 0 else len(page) + 1
                if opens < at:
                    m = _LINK.search(low, at)
                    opens = m.start() if m else len(page) + 2
            link = "" if shut else "closed" if shuts < min(opens, len(page)) else "open"
        elif name not in INLINE:
            close()
            link = "" if link == "open" else link
    close()
    return out


def features(found: list[tuple[str, int, int]]) -> np.ndarray:
    """(blocks, 6): words and link percent of the block before, the block, the block after; 0 where there is none."""
    own = np.array([(w, 100.0 * k / w) for _, w, k in found], float).reshape(-1, 2)
    none = np.zeros((1, 2))
    padded = np.concatenate((none, own, none))
    return np.concatenate((padded[:-2], own, padded[2:]), 1)


class Tree:
    """Binary decision tree on numbers; the best Gini split first, to DEPTH levels and LEAF rows a leaf."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = DEPTH, leaf: int = LEAF):
        self.value = float(y.mean()) if len(y) else 0.0
        self.feature, best = -1, self.value * (1 - self.value) * len(y) - 1e-9
        if depth == 0 or self.value in (0.0, 1.0):
            return
        for f in range(x.shape[1]):
            by = np.argsort(x[:, f], kind="stable")
            xs, left = x[by, f], np.cumsum(y[by])
            n = np.arange(1, len(y))
            a, b = left[:-1] / n, (left[-1] - left[:-1]) / (len(y) - n)
            cost = n * a * (1 - a) + (len(y) - n) * b * (1 - b)
            cost[(xs[1:] == xs[:-1]) | (n < leaf) | (len(y) - n < leaf)] = np.inf
            k = int(cost.argmin()) if len(cost) else 0
            if len(cost) and cost[k] < best:
                best, self.feature, self.cut = cost[k], f, (xs[k] + xs[k + 1]) / 2
        if self.feature >= 0:
            low = x[:, self.feature] <= self.cut
            self.low, self.high = Tree(x[low], y[low], depth - 1, leaf), Tree(x[~low], y[~low], depth - 1, leaf)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Share of content among the training rows of each row's leaf."""
        if self.feature < 0:
            return np.full(len(x), self.value)
        low, out = x[:, self.feature] <= self.cut, np.zeros(len(x))
        out[low], out[~low] = self.low.predict(x[low]), self.high.predict(x[~low])
        return out


_tree: list[Tree] = []


def tree() -> Tree:
    if not _tree:
        table = np.array(TABLE, float)
        _tree.append(Tree(table[:, :6], table[:, 6]))
    return _tree[0]


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_blocks, n_content) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grown = tree()
        for batch in batches:
            found = [blocks(x) if x is not None else None for x in batch.column("html").to_pylist()]
            rows = [features(f) for f in found if f]
            keep = iter((grown.predict(np.concatenate(rows)) >= 0.5).tolist() if rows else [])
            text, count, kept = [], [], []
            for f in found:
                own = [b[0] for b in f if next(keep)] if f else []
                text.append(None if f is None else "\n".join(own))
                count.append(len(f or ()))
                kept.append(len(own))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array(count, pa.int64()), pa.array(kept, pa.int64())], ["page_id", "url", "text", "n_blocks", "n_content"])

    pages = shared.small_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return pages.mapInArrow(shared.lean(run), "page_id long, url string, text string, n_blocks long, n_content long")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
