"""Main text of web pages: flat text blocks, classified by a small decision tree."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .common import map_batches, read

# Elements whose content is no text, elements that end a block, elements that hold others, and those of
# them that hold no article; words in class, id and role that say the same.
SILENT = ("script", "style", "noscript", "template", "textarea", "select", "svg", "math", "iframe", "object", "button", "title")
BREAKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
HOLDERS = frozenset("article aside body dialog div dl fieldset figure footer form head header html main menu nav ol search section table td tr ul".split())
OUTSIDE = frozenset("aside dialog footer form head header menu nav search".split())
HINT = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|header|masthead|footer|sidebar|side|aside|widget|ads?|advert|advertisement|advertising|banner|promo|sponsor|sponsored|cookie|cookies|consent|gdpr|notice|alert|popup|modal|overlay|comment|comments|disqus|replies|reply|share|sharing|social|related|recommended|breadcrumb|breadcrumbs|pagination|pager|subscribe|newsletter|login|signup|search|toolbar|copyright|complementary|contentinfo|dialog|tags|skip)(?:$|[\s_\d-])",
    re.IGNORECASE,
)
STORY = re.compile(r"(?:^|[\s_-])(?:article|story|post|entry|content|main)(?:$|[\s_-])", re.IGNORECASE)

#: Comments, silent elements (but no svg and math that close themselves), declarations, tags, text; a lone "<" is text.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?!(?:svg|math)(?=[\s/])(?>\"[^\"]*\"|'[^']*'|[^>\"'])*+(?<=/)>)(?P<silent>" + "|".join(SILENT) + r")(?=[\s/>])(?>\"[^\"]*\"|'[^']*'|[^>\"'])*+>.*?(?:</(?P=silent)\s*>|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<name>[a-z][a-z0-9:-]*+)(?P<rest>(?>\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<(?P<end2>/?)(?P<name2>[a-z][a-z0-9:-]*+)[^>]*>|[^<]+|<",
    re.IGNORECASE | re.DOTALL,
)
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
SPACES = re.compile(r"\s+")


@dataclass
class Block:
    text: str
    words: int
    links: float
    outside: bool
    story: bool
    heading: bool


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order, with word count, share of words in links, and where they stand."""
    out: list[Block] = []
    held: list[tuple[str, bool, bool]] = []
    parts: list[str] = []
    linked: list[str] = []
    in_link, heading = 0, False

    def close() -> None:
        nonlocal heading
        # the character references of a block are decoded once it is whole; non-breaking spaces are spaces
        text = SPACES.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            words = len(text.split())
            inside = len(html.unescape(" ".join(linked)).split())
            out.append(Block(text, words, min(1.0, inside / words), any(h[1] for h in held), any(h[2] for h in held), heading))
        parts.clear()
        linked.clear()
        heading = False

    for m in TOKEN.finditer(page):
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            token = m[0]
            if m["silent"]:
                parts.append(" ")
            elif not token.startswith("<") or token == "<":
                parts.append(token)
                if in_link:
                    linked.append(token)
            continue
        ends = bool(m["end"] or m["end2"])
        if name == "a":
            in_link = 0 if ends else 1
        elif name in ("br", "svg", "math"):
            parts.append(" ")
        if name not in BREAKS:
            continue
        close()
        if name[0] == "h" and name[1:].isdigit():
            heading = not ends
        if name not in HOLDERS:
            continue
        if ends:
            if any(h[0] == name for h in held):
                while held.pop()[0] != name:
                    pass
            continue
        if name == "body":  # ends a head that was not closed
            held = [h for h in held if h[0] != "head"]
        said = " ".join("".join(x) for x in ATTRIBUTE.findall(m["rest"] or ""))
        story = name in ("article", "main") or bool(STORY.search(said))
        # the header of an article is its own
        own = name == "header" and any(h[2] for h in held)
        held.append((name, (name in OUTSIDE and not own) or (bool(HINT.search(said)) and name not in ("article", "main", "body", "html")), story))
    close()
    return out


def measures(found: list[Block]) -> np.ndarray:
    """Rows of features: words and link density of the block, the one before and the one after; where it stands."""
    n = len(found)
    words = np.array([0, *[b.words for b in found], 0], float)
    links = np.array([0, *[b.links for b in found], 0], float)
    place = np.array([[b.outside, b.story, b.heading] for b in found], float).reshape(n, 3)
    return np.column_stack([words[1:-1], links[1:-1], words[:-2], links[:-2], words[2:], links[2:], place]) if n else np.zeros((0, 9))


# The labelled table. Words and link density of the block, of the one before, of the one after; in a
# container of other things, in an article, a heading; 1 if the block belongs to the article.
LABELLED = (
    # menus, lists of links, and single links around an article, with or without a container that says so
    (1, 1.0, 0, 0.0, 1, 1.0, 1, 0, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 0, 0), (2, 1.0, 1, 1.0, 9, 0.0, 1, 0, 0, 0), (2, 1.0, 0, 0.0, 2, 1.0, 0, 0, 0, 0),
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 0, 0, 0), (1, 1.0, 0, 0.0, 60, 0.0, 0, 0, 0, 0), (2, 1.0, 1, 1.0, 45, 0.0, 0, 0, 0, 0), (2, 1.0, 50, 0.0, 0, 0.0, 0, 0, 0, 0),
    (3, 1.0, 60, 0.0, 4, 1.0, 0, 0, 0, 0), (8, 0.9, 30, 0.0, 7, 1.0, 0, 0, 0, 0), (12, 0.8, 4, 1.0, 5, 1.0, 0, 0, 0, 0), (20, 0.7, 6, 1.0, 6, 1.0, 0, 0, 0, 0),
    (40, 1.0, 0, 0.0, 60, 0.0, 0, 0, 0, 0), (40, 1.0, 60, 0.0, 30, 0.0, 0, 0, 0, 0), (30, 0.9, 25, 0.0, 0, 0.0, 0, 0, 0, 0), (6, 1.0, 30, 0.0, 25, 0.1, 1, 1, 0, 0),
    (3, 1.0, 4, 0.0, 40, 0.0, 1, 1, 0, 0), (25, 0.8, 50, 0.0, 9, 0.0, 1, 1, 0, 0),
    # links within an article
    (6, 0.5, 40, 0.0, 35, 0.0, 0, 1, 0, 1), (3, 1.0, 40, 0.0, 35, 0.0, 0, 1, 0, 1), (9, 0.7, 30, 0.1, 50, 0.0, 0, 1, 0, 1), (2, 1.0, 25, 0.0, 0, 0.0, 0, 1, 0, 1),
    # adverts, notices, comments, footers: text without links, in their containers
    (9, 0.0, 1, 1.0, 12, 0.0, 1, 0, 0, 0), (14, 0.0, 40, 0.0, 0, 0.0, 1, 0, 0, 0), (30, 0.1, 60, 0.0, 20, 0.0, 1, 1, 0, 0), (25, 0.0, 18, 0.0, 30, 0.0, 1, 0, 0, 0),
    (60, 0.0, 3, 0.0, 50, 0.0, 1, 1, 0, 0), (4, 0.0, 2, 1.0, 6, 0.0, 1, 0, 1, 0), (7, 0.0, 30, 0.0, 40, 0.0, 1, 1, 0, 0), (3, 0.0, 0, 0.0, 30, 0.0, 1, 0, 0, 0),
    (12, 0.0, 2, 1.0, 8, 0.0, 1, 0, 0, 0), (50, 0.0, 60, 0.0, 45, 0.0, 1, 0, 0, 0), (2, 0.0, 9, 0.0, 50, 0.0, 1, 1, 1, 0), (18, 0.2, 70, 0.0, 0, 0.0, 1, 0, 0, 0),
    # article text
    (12, 0.0, 9, 0.0, 60, 0.0, 0, 1, 1, 1), (5, 0.0, 1, 1.0, 30, 0.0, 0, 1, 1, 1), (1, 0.0, 40, 0.0, 55, 0.0, 0, 1, 0, 1), (2, 0.0, 15, 0.0, 0, 0.0, 0, 1, 0, 1),
    (40, 0.0, 12, 0.0, 55, 0.0, 0, 1, 0, 1), (80, 0.05, 40, 0.0, 9, 0.0, 0, 1, 0, 1), (20, 0.2, 30, 0.0, 25, 0.0, 0, 1, 0, 1), (4, 0.0, 3, 0.0, 4, 0.0, 0, 1, 0, 1),
    (45, 0.0, 0, 0.0, 60, 0.0, 0, 0, 0, 1), (60, 0.0, 45, 0.0, 30, 0.0, 0, 0, 0, 1), (30, 0.1, 60, 0.0, 4, 0.0, 0, 0, 0, 1), (16, 0.0, 60, 0.0, 45, 0.0, 0, 0, 0, 1),
    (7, 0.0, 1, 1.0, 45, 0.0, 0, 0, 1, 1), (5, 0.0, 60, 0.0, 45, 0.0, 0, 0, 0, 1), (4, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1), (9, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1),
    (25, 0.0, 1, 1.0, 40, 0.0, 0, 0, 0, 1), (6, 0.0, 2, 1.0, 50, 0.0, 0, 0, 1, 1),
    (50, 0.0, 40, 0.0, 30, 0.2, 0, 1, 0, 1), (45, 0.05, 30, 0.0, 20, 0.4, 0, 1, 0, 1), (60, 0.0, 40, 0.0, 2, 1.0, 0, 1, 0, 1), (35, 0.0, 20, 0.0, 3, 1.0, 0, 0, 0, 1),
    (4, 0.0, 30, 0.0, 6, 0.5, 0, 1, 0, 1), (2, 0.0, 40, 0.0, 1, 1.0, 0, 1, 0, 1), (15, 0.1, 3, 1.0, 25, 0.3, 0, 1, 0, 1), (28, 0.0, 50, 0.2, 5, 1.0, 0, 0, 0, 1),
    (5, 0.0, 30, 0.0, 9, 1.0, 0, 1, 1, 1), (22, 0.0, 1, 1.0, 4, 1.0, 0, 0, 0, 1), (70, 0.1, 60, 0.1, 80, 0.1, 0, 1, 0, 1),
    # short remains between links, without a container
    (4, 0.0, 1, 1.0, 3, 1.0, 0, 0, 0, 0), (6, 0.0, 3, 1.0, 0, 0.0, 0, 0, 0, 0), (5, 0.4, 60, 0.0, 3, 1.0, 0, 0, 0, 0), (2, 0.0, 2, 1.0, 2, 1.0, 0, 0, 0, 0),
    (3, 0.0, 1, 1.0, 1, 1.0, 0, 0, 0, 0),
)

Tree = tuple | int
#: Measures of the text, which the first splits are made by, and those of the place, which only deeper ones may use.
TEXT, PLACE = (1, 5, 3, 0, 4, 2), (6, 7, 8)
#: Levels of the tree, those by text alone, and the fewest rows of a leaf.
DEPTH, BY_TEXT, LEAF = 7, 1, 2


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 0) -> Tree:
    """A classification tree: at each node the split of least Gini impurity, the first of equals; leaves of LEAF rows or more."""
    if depth == DEPTH or labels.min() == labels.max():
        return int(labels.mean() >= 0.5)
    best: tuple = (np.inf,)
    for k in TEXT if depth < BY_TEXT else TEXT + PLACE:
        values = np.unique(rows[:, k])
        for at in (values[1:] + values[:-1]) / 2:
            side = rows[:, k] > at
            if LEAF <= side.sum() <= len(side) - LEAF:
                cost = sum(len(s) * s.mean() * (1 - s.mean()) for s in (labels[side], labels[~side]))
                if cost < best[0] - 1e-12:
                    best = (cost, k, at)
    if len(best) == 1:
        return int(labels.mean() >= 0.5)
    _, k, at = best
    side = rows[:, k] > at
    return (k, at, grow(rows[~side], labels[~side], depth + 1), grow(rows[side], labels[side], depth + 1))


def decide(tree: Tree, rows: np.ndarray) -> np.ndarray:
    if isinstance(tree, int):
        return np.full(len(rows), tree, bool)
    k, at, low, high = tree
    return np.where(rows[:, k] > at, decide(high, rows), decide(low, rows))


def trained() -> Tree:
    table = np.array(LABELLED, float)
    return grow(table[:, :-1], table[:, -1])


def main_text(page: str | None, tree: Tree) -> str:
    found = blocks(page or "")
    kept = decide(tree, measures(found))
    return "\n\n".join(b.text for b, ok in zip(found, kept, strict=True) if ok)


def extract(pages: DataFrame) -> DataFrame:
    """One row for each row of ``pages`` (page_id, url, html): page_id, url, text, n_chars.

    The blocks that the tree takes for the article, in page order, joined by an empty line. A null or empty page, or
    one without an article, has the empty text. Markup may be broken: unknown and unclosed elements are passed over.
    Repeated rows are alike, rows without page_id too; an empty table gives an empty result; pages of any length are
    read whole; other columns are ignored.
    """
    tree = trained()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            texts = [main_text(p, tree) for p in pdf["html"].tolist()]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    rows = pages.select("page_id", "url", "html")
    return map_batches(rows, run, rows.select("page_id", "url").schema.add("text", "string").add("n_chars", "long"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
