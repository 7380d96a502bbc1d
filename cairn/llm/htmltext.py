"""Main text of web pages from flat text blocks.

A page is cut into blocks at block-level tags, without building a document
tree.  Each block has its word count and link density and those of its two
neighbours.  A decision tree over these six, trained on the blocks of a small
set of labelled pages, says which blocks are main text.  Of those, blocks go
that stand in a container which says that it holds something else, such as a
form, an aside or reader comments: words and links can't tell these.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import unused
from cairn.llm.labelled_pages import TRAINING, filled

#: Features of a block, in order.
FEATURES = ("words", "link_density", "prev_words", "prev_link_density", "next_words", "next_link_density", "article")
#: Values of the last one: beside the page's article elements, on a page that has none, inside of one.
BESIDE, NO_ARTICLE, INSIDE = 0.0, 1.0, 2.0

#: Elements whose content is no text of the page.
RAW = {"script", "style", "template", "svg", "textarea", "title", "iframe", "select"}
BLOCK = set(
    "address article aside blockquote body button caption dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = set("article aside blockquote button details dialog div dl fieldset figure footer form header label li main menu nav ol p section table td tr ul".split())
#: Containers that hold something else than main text, by their element or by a word of their class, id or role.
OTHER = {"nav", "footer", "aside", "form", "button", "dialog", "menu", "label", "fieldset"}
#: Elements that hold text themselves: no word of their class makes them something else.
TEXT = {"p", "li", "td", "blockquote"}
NAMES = re.compile(
    r"(?:^|\s)(?:(?:[\w-]+[_-])?(?:ads?|adverts?|advertisements?|banner|comments?|cookies?|consent|disqus|newsletter|popup|promo|promoted|repl(?:y|ies)|share|sharing|side-?bar|social|sponsored|subscribe)(?:[_-](?:area|bar|box|container|form|links?|list|section|thread|widget))?"
    r"|(?:related|notices?)(?:[_-](?:articles?|bar|box|content|links?|list|news|pages?|posts?|stories))?)(?=$|\s)",
    re.I,
)
TAG = re.compile(r"<(?:!--(?s:.*?)(?:--!?>|\Z)|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+(?:>|\Z)))")
NAMED = re.compile(r"""\b(?:class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)


def blocks(page: str) -> list[tuple[str, int, int, bool, bool]]:
    """(text, words, linked words, whether its container holds something else, whether it lies in an article) of every block with a word, in page order."""
    out: list[tuple[str, int, int, bool, bool]] = []
    stack: list[tuple[str, bool, bool]] = []  # open containers: tag, holds something else, is in an article
    pieces: list[tuple[str, bool]] = []
    head = link = False

    def flush() -> None:
        if pieces:
            text = " ".join(entities.unescape("".join(p for p, _ in pieces)).split())
            if text:
                linked = sum(len(entities.unescape(p).split()) for p, a in pieces if a)
                words = text.count(" ") + 1
                out.append((text, words, min(words, linked), bool(stack) and stack[-1][1], bool(stack) and stack[-1][2]))
            pieces.clear()

    at, end = 0, len(page)
    while at < end:
        m = TAG.search(page, at)
        stop = m.start() if m else end
        if stop > at and not head:
            pieces.append((page[at:stop], link))
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag, closes = m[2].lower(), bool(m[1])
        if tag in RAW and not closes:
            close = re.compile(rf"</{tag}\s*+(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if tag == "head":
            head = not closes
        elif tag == "body":
            head = False
        if tag == "a":
            link = not closes
        if tag == "br":
            pieces.append((" ", link))
        if tag not in BLOCK:
            continue
        flush()
        link = False
        if tag not in CONTAINER:
            continue
        if closes:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
        else:
            if tag == "p" and stack and stack[-1][0] == "p":
                stack.pop()  # a paragraph ends where the next begins
            _, other, article = stack[-1] if stack else ("", False, False)
            if tag == "main":
                other, article = False, True
            else:
                other = other or tag in OTHER or (tag == "header" and not article) or tag not in TEXT and any(NAMES.search(n[1] or n[2] or n[3] or "") for n in NAMED.finditer(m[3]))
                article = article or tag == "article"
            stack.append((tag, other, article))
    flush()
    return out


def features(found: list[tuple]) -> np.ndarray:
    """One row of FEATURES for each block; a missing neighbour has no words."""
    words = np.array([b[1] for b in found], float)
    inside = np.array([b[4] for b in found])
    article = np.where(inside, INSIDE, BESIDE) if inside.any() else np.full(len(found), NO_ARTICLE)
    density = np.array([b[2] / b[1] for b in found])
    pad = lambda x, back: np.concatenate([[0.0], x[:-1]]) if back else np.concatenate([x[1:], [0.0]])
    return np.stack([words, density, pad(words, True), pad(density, True), pad(words, False), pad(density, False), article], 1)


def labelled_table(pages: list[str]) -> np.ndarray:
    """FEATURES and a label, 1 for main text, of the blocks of labelled pages."""
    rows = []
    for page in pages:
        found = blocks(page)
        bare = [text.lstrip("§~") for text, *_ in found]
        linked = features([(t, len(t.split()), *b[2:]) for t, b in zip(bare, found)])
        rows += [[*x, float(b[0].startswith("§"))] for x, b in zip(linked, found) if not b[0].startswith("~")]
    return np.array(rows)


def train(table: np.ndarray, depth: int = 6, least: int = 4) -> list[tuple[int, float, int, int, int]]:
    """A decision tree by Gini impurity: nodes (feature or -1, threshold, left, right, label)."""
    nodes: list[tuple[int, float, int, int, int]] = []

    def grow(rows: np.ndarray, level: int) -> int:
        at = len(nodes)
        y = rows[:, -1]
        nodes.append((-1, 0.0, 0, 0, int(2 * y.sum() > len(y))))
        choice = (1e-12, -1, 0.0)
        if level < depth and 0 < y.sum() < len(y):
            whole = len(y) * (y.mean() * (1 - y.mean()))
            for f in range(rows.shape[1] - 1):
                values = np.unique(rows[:, f])
                for t in (values[1:] + values[:-1]) / 2:
                    left = rows[:, f] <= t
                    a, b = y[left], y[~left]
                    if min(len(a), len(b)) < least:
                        continue
                    gain = whole - len(a) * a.mean() * (1 - a.mean()) - len(b) * b.mean() * (1 - b.mean())
                    if gain > choice[0] + 1e-9:
                        choice = (gain, f, float(t))
        if choice[1] >= 0:
            left = rows[:, choice[1]] <= choice[2]
            a, b = grow(rows[left], level + 1), grow(rows[~left], level + 1)
            nodes[at] = (choice[1], choice[2], a, b, nodes[at][4])
        return at

    grow(table, 0)
    return nodes


def classify(nodes: list[tuple[int, float, int, int, int]], x: np.ndarray) -> np.ndarray:
    """Labels of the rows of x; all rows go down the tree together."""
    tree = np.array(nodes)
    at = np.zeros(len(x), int)
    while True:
        f = tree[at, 0].astype(int)
        inner = f >= 0
        if not inner.any():
            return tree[at, 4].astype(bool)
        goes_left = x[np.arange(len(x)), np.maximum(f, 0)] <= tree[at, 1]
        at = np.where(inner, np.where(goes_left, tree[at, 2], tree[at, 3]), at).astype(int)


def main_text(page: str | None, nodes: list[tuple[int, float, int, int, int]]) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    return "\n".join(b[0] for b, keep in zip(found, classify(nodes, features(found))) if keep and not b[3])


def extract(pages: DataFrame, html_col: str = "html", labelled: list[str] | None = None, depth: int = 6) -> DataFrame:
    """pages without the html column, with text and n_chars (code points).

    labelled: pages marked as in labelled_pages; the default are those.  Their
    table is small and the tree travels with the task.  Null and empty pages,
    and pages without main text, give an empty text; very long ones are read
    whole.  Repeated rows are extracted each; an empty table gives no rows.
    Columns of pages called text or n_chars are replaced; others may have any
    name.
    """
    nodes = train(labelled_table([filled(p) for p in (labelled or TRAINING)]), depth)
    keep = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    page = unused(pages.columns, "page")
    narrow = pages.select(*[f"`{c}`" for c in keep], F.col(html_col).alias(page))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), nodes) for h in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    return narrow.mapInArrow(run, T.StructType([*narrow.schema.fields[:-1], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))
