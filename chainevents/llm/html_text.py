"""Main text of web pages: flat text blocks, told apart by a decision tree.

A page is cut into flat blocks at block-level tags. A block knows its words, its link density (share of words inside
links), both for the blocks before and after it, whether it is a heading, and what encloses it: an article or main
element, or one that by its tag, role, class or id is page furniture. What stands around an article or main element is
layout, so furniture counts inside it only; an article within an article (a comment, say) belongs to the outer one. A
small decision tree, grown from the labelled blocks below, decides which blocks are main text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainevents.llm.common import in_pandas, query, table

# Elements by what they mean for text.
_SKIPPED = {"script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "math", "head", "title", "textarea", "select", "audio", "video"}
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg"}
_FURNITURE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "fieldset"}
_MAIN = {"article", "main"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_CLOSED_BY_BLOCK = {"p"} | _HEADINGS | _INLINE
#: What a class or id says of furniture, alone or joined to others; longer names (has-sidebar, no-header) tell of the layout.
_HINT = (
    r"(?:ad|ads|advert\w*|adsense|banner|promo\w*|sponsor\w*|sidebar\w*|side-?bar|menu\w*|nav\w*|navbar|breadcrumb\w*|header|masthead|footer|cookie\w*|consent|notice\w*|alert"
    r"|popup|modal|overlay|newsletter|subscribe|signup|login|share\w*|social|related|recommend\w*|comment\w*|disqus|reply|replies|respond|widget|toolbar|pager|pagination|legal|copyright|tags?)"
)
_HINTS = re.compile(rf"(?:(?:site|page|main|global|primary|secondary)[_-])?{_HINT}(?:[_-]{_HINT})*", re.I)
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert"}

_MARKUP = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_ATTRIBUTES = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?|\"[^\"]*\"|'[^']*'")
#: What may stand in a head; anything else ends it, whether </head> is there or not.
_IN_HEAD = {"head", "base", "basefont", "bgsound", "link", "meta", "title", "noscript", "noframes", "style", "script", "template"}

COLUMNS = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "heading", "in_main", "in_furniture")

# Labelled blocks (the columns above, then 1 for main text), from all kinds of place a block stands in.
LABELLED = [
    (60, 0.0, 45, 0.0, 80, 0.0, 0, 1, 0, 1), (1, 0.0, 30, 0.0, 50, 0.0, 0, 1, 0, 1), (1, 0.0, 1, 0.0, 1, 0.0, 0, 1, 0, 1),
    (9, 0.0, 12, 0.0, 40, 0.0, 1, 1, 0, 1), (4, 0.0, 0, 0.0, 0, 0.0, 1, 1, 0, 1), (120, 0.1, 8, 0.0, 0, 0.0, 0, 1, 0, 1),
    (25, 0.3, 60, 0.0, 50, 0.0, 0, 1, 0, 1), (3, 1.0, 60, 0.0, 50, 0.0, 0, 1, 0, 1), (2, 0.5, 40, 0.0, 7, 0.0, 0, 1, 0, 1),
    (300, 0.0, 9, 0.0, 4, 0.2, 0, 1, 0, 1), (14, 0.0, 6, 1.0, 90, 0.0, 0, 1, 0, 1), (5, 0.0, 200, 0.0, 9, 0.0, 0, 1, 0, 1),
    (50, 0.0, 40, 0.0, 3, 1.0, 0, 1, 0, 1), (7, 0.0, 2, 1.0, 2, 1.0, 0, 1, 0, 1), (12, 0.0, 3, 0.5, 3, 1.0, 1, 1, 0, 1),
    (1, 0.0, 0, 0.0, 0, 0.0, 0, 1, 0, 1), (2, 1.0, 3, 1.0, 2, 1.0, 0, 1, 0, 1), (40, 0.0, 30, 0.0, 3, 1.0, 0, 0, 0, 1),
    (25, 0.0, 3, 1.0, 2, 1.0, 0, 0, 0, 1), (70, 0.2, 0, 0.0, 0, 0.0, 0, 0, 0, 1), (6, 0.0, 60, 0.0, 50, 0.0, 0, 0, 0, 1),
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 0, 1, 0), (6, 1.0, 0, 0.0, 4, 1.0, 0, 0, 1, 0), (9, 0.0, 1, 1.0, 12, 0.0, 0, 0, 1, 0),
    (12, 0.1, 60, 0.0, 0, 0.0, 0, 0, 1, 0), (45, 0.0, 50, 0.0, 3, 0.0, 0, 0, 1, 0), (80, 0.0, 70, 0.0, 60, 0.0, 0, 0, 1, 0),
    (30, 0.0, 90, 0.0, 30, 0.0, 0, 1, 1, 0), (6, 0.5, 90, 0.0, 5, 0.8, 0, 1, 1, 0), (3, 0.0, 2, 1.0, 60, 0.0, 1, 0, 1, 0),
    (5, 0.0, 40, 0.0, 50, 0.0, 1, 1, 1, 0), (2, 1.0, 70, 0.0, 3, 1.0, 0, 1, 1, 0), (150, 0.0, 40, 0.0, 30, 0.0, 0, 1, 1, 0),
    (50, 0.0, 40, 0.0, 60, 0.0, 0, 0, 0, 1), (35, 0.05, 0, 0.0, 90, 0.0, 0, 0, 0, 1), (22, 0.1, 60, 0.0, 0, 0.0, 0, 0, 0, 1),
    (200, 0.0, 2, 1.0, 6, 0.0, 0, 0, 0, 1), (12, 0.0, 50, 0.0, 70, 0.0, 0, 0, 0, 1), (16, 0.0, 5, 0.0, 40, 0.1, 0, 0, 0, 1),
    (8, 0.0, 1, 1.0, 60, 0.0, 1, 0, 0, 1), (5, 0.0, 30, 0.0, 50, 0.0, 1, 0, 0, 1), (7, 0.0, 0, 0.0, 30, 0.0, 1, 0, 0, 1),
    (2, 1.0, 2, 1.0, 2, 1.0, 0, 0, 0, 0), (10, 0.9, 4, 1.0, 30, 0.0, 0, 0, 0, 0), (30, 0.8, 20, 0.7, 9, 1.0, 0, 0, 0, 0),
    (3, 0.0, 2, 1.0, 2, 1.0, 0, 0, 0, 0), (4, 0.0, 0, 0.0, 3, 1.0, 0, 0, 0, 0), (2, 0.0, 3, 0.5, 0, 0.0, 0, 0, 0, 0),
    (6, 0.6, 50, 0.0, 2, 1.0, 0, 0, 0, 0), (4, 1.0, 80, 0.0, 70, 0.0, 0, 0, 0, 0), (3, 0.0, 1, 0.0, 2, 0.5, 1, 0, 0, 0),
]


class Tree:
    """A decision tree over numeric columns: the split with the least Gini impurity, until leaves are pure."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, depth: int = 6):
        self.column, self.value = None, float(labels.mean() >= 0.5)
        if depth == 0 or len(set(labels.tolist())) < 2:
            return
        best = None
        for column in reversed(range(rows.shape[1])):
            points = np.unique(rows[:, column])
            for cut in (points[:-1] + points[1:]) / 2:
                left = rows[:, column] <= cut
                impurity = sum(m.sum() * labels[m].mean() * (1 - labels[m].mean()) for m in (left, ~left))
                if best is None or impurity < best[0] - 1e-9:
                    best = (impurity, column, cut, left)
        if best:
            _, self.column, self.cut, left = best
            self.low, self.high = Tree(rows[left], labels[left], depth - 1), Tree(rows[~left], labels[~left], depth - 1)

    def predict(self, rows: np.ndarray) -> np.ndarray:
        if self.column is None:
            return np.full(len(rows), self.value)
        left = rows[:, self.column] <= self.cut
        out = np.empty(len(rows))
        out[left], out[~left] = self.low.predict(rows[left]), self.high.predict(rows[~left])
        return out


def trained_tree() -> Tree:
    known = np.array(LABELLED, float)
    return Tree(known[:, :-1], known[:, -1])


def _is_furniture(tag: str, attributes: str) -> bool:
    if tag in _FURNITURE:
        return True
    if not attributes or tag in ("html", "body") or tag in _MAIN:
        return False
    for name, *values in _ATTRIBUTES.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name in ("class", "id") and any(_HINTS.fullmatch(x) for x in value.split()) or name == "role" and value.lower() in _ROLES:
            return True
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
    return False


def blocks(page: str) -> tuple[list[str], np.ndarray]:
    """Texts of the flat blocks of a page, and their COLUMNS."""
    out: list[tuple[str, int, int, bool, bool, bool]] = []
    pieces: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, main, furniture, skipped
    links = 0

    def opens() -> int:
        """Where in the stack the outermost article or else the innermost main element stands."""
        tags = [s[0] for s in stack if s[1]]
        if not tags:
            return 0
        wanted = "article" if "article" in tags else "main"
        places = [k for k, s in enumerate(stack) if s[0] == wanted]
        return places[0] if wanted == "article" else places[-1]

    def close_block() -> None:
        text = " ".join(html.unescape("".join(pieces)).split())
        if text:
            main, furniture = any(s[1] for s in stack), any(s[2] for s in stack[opens() :])
            words = text.count(" ") + 1
            inside = len(html.unescape("".join(linked)).split())
            out.append((text, words, min(words, inside), any(s[0] in _HEADINGS for s in stack), main, furniture))
        pieces.clear()
        linked.clear()

    at = 0
    while at < len(page):
        found = _MARKUP.search(page, at)
        text = page[at : found.start() if found else len(page)]
        if stack and stack[-1][0] == "head" and text.strip():
            stack.pop()
        if text and not any(s[3] for s in stack):
            pieces.append(text)
            if links:
                linked.append(text + " ")
        if not found:
            break
        at = found.end()
        if not found[2]:
            continue
        tag, closing = found[2].lower(), bool(found[1])
        if tag not in _INLINE:
            close_block()
        if closing:
            if any(s[0] == tag for s in stack):
                while stack:
                    last = stack.pop()[0]
                    links -= last == "a"
                    if last == tag:
                        break
            continue
        if stack and stack[-1][0] == "head" and tag not in _IN_HEAD:
            stack.pop()
        if tag in _VOID or found[3].endswith("/") and tag in _SKIPPED:
            continue
        if tag not in _INLINE:
            # a paragraph ends where the next block begins, and inline markup left open ends with it
            while stack and stack[-1][0] in _CLOSED_BY_BLOCK:
                links -= stack.pop()[0] == "a"
            if tag in ("li", "dt", "dd", "td", "th", "tr", "option") and stack and stack[-1][0] == tag:
                stack.pop()
        if tag in _RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        stack.append((tag, tag in _MAIN, _is_furniture(tag, found[3]), tag in _SKIPPED))
        links += tag == "a"
    close_block()
    n = len(out)
    words = np.array([0, *[b[1] for b in out], 0], float)
    density = np.array([0, *[b[2] / b[1] for b in out], 0], float)
    flags = np.array([b[3:] for b in out], float).reshape(n, 3)
    return [b[0] for b in out], np.column_stack([words[1:-1], density[1:-1], words[:-2], density[:-2], words[2:], density[2:], flags])


def main_text(page: str, tree: Tree) -> str:
    texts, rows = blocks(page)
    if not texts:
        return ""
    return " ".join(t for t, keep in zip(texts, tree.predict(rows), strict=True) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``.

    Null or empty html gives an empty text; null ids and urls and repeated rows stay as they are; other columns are
    ignored. An empty table gives an empty result.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = trained_tree()
        for batch in batches:
            text = [main_text(page, tree) for page in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64").to_numpy(object), "url": batch["url"], "text": text, "n_chars": [len(t) for t in text]})

    named = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    return in_pandas(named, rows, "page_id long, url string, text string, n_chars long")


@query()
def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
