"""Main text of web pages from flat text blocks and a decision tree.

A page is read once from left to right into flat blocks of text: what stands between two
block-level tags. A block is described by its words and link density, by those of the blocks
before and after it, and by what kind of element holds it. A decision tree, grown on a small
labelled table of blocks, says which blocks are main text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of HTML elements by their part in a page.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr picture q rp rt "
    "ruby s samp small source span strike strong sub sup time tt u var wbr".split()
)
RAW = frozenset("script style noscript template textarea iframe svg math object title select".split())
UNSEEN = frozenset("script style noscript template title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILER = frozenset("nav header footer aside form menu dialog button fieldset head figcaption".split())
CONTENT = frozenset("article main".split())
HINTS = (
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright "
    "disclaimer discussion disqus footer form header login masthead menu modal nav navbar navigation newsletter notice "
    "pagination pager popup promo promoted recommended related replies reply search share sharing sidebar signup "
    "skip social sponsor sponsored subscribe tags toolbar topbar widget"
).split()

_TAG = re.compile(r"<(?:!--|[!?]|(/?)([A-Za-z][^\s/>]*))")
_END = re.compile(r"""(?:[^"'>]|"[^"]*"|'[^']*')*>""")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[a-z]+")
_HINT_SET = frozenset(HINTS)


@dataclass
class Block:
    """A run of text between block-level tags."""

    text: str
    words: int
    linked: int
    tag: str
    boiler: bool
    content: bool

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


@dataclass
class _Reader:
    """Open elements that matter, and the text since the last border."""

    blocks: list[Block] = field(default_factory=list)
    #: Open block elements: name, and whether it opens boilerplate or content.
    stack: list[tuple[str, int, int]] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    link_parts: list[str] = field(default_factory=list)
    links: int = 0
    boiler: int = 0
    content: int = 0

    def text(self, raw: str) -> None:
        self.parts.append(raw)
        if self.links:
            self.link_parts.append(raw)

    def border(self) -> None:
        if not self.parts:
            return
        words = html.unescape("".join(self.parts)).split()
        if words:
            linked = len(html.unescape(" ".join(self.link_parts)).split()) if self.link_parts else 0
            tag = self.stack[-1][0] if self.stack else ""
            self.blocks.append(
                Block(" ".join(words), len(words), min(linked, len(words)), tag, self.boiler > 0, self.content > 0)
            )
        self.parts.clear()
        self.link_parts.clear()

    def open(self, name: str, attributes: str) -> None:
        if name == "a":
            self.links = 1
        if name in INLINE:
            if name == "br":
                self.text(" ")
            return
        self.border()
        self.links = 0
        if name in VOID:
            return
        if name == "p" or name == "li":  # an open one of its kind ends here
            if self.stack and self.stack[-1][0] == name:
                self._pop()
        boiler = name in BOILER or bool(attributes) and name not in ("html", "body") and _hinted(attributes)
        # A heading or header inside an article is part of it.
        if name == "header" and self.content:
            boiler = bool(attributes) and _hinted(attributes)
        self.stack.append((name, int(boiler), int(name in CONTENT)))
        self.boiler += boiler
        self.content += name in CONTENT

    def close(self, name: str) -> None:
        if name == "a":
            self.links = 0
        if name in INLINE:
            return
        self.border()
        if any(s[0] == name for s in self.stack):
            while self._pop() != name:
                pass

    def _pop(self) -> str:
        name, boiler, content = self.stack.pop()
        self.boiler -= boiler
        self.content -= content
        return name


def _hinted(attributes: str) -> bool:
    for found in _NAMES.findall(attributes):
        if not _HINT_SET.isdisjoint(_WORDS.findall("".join(found).lower())):
            return True
    return False


def read_blocks(page: str) -> list[Block]:
    """The text blocks of a page, in order. Unfinished tags and comments end the page."""
    reader, at, n = _Reader(), 0, len(page)
    while at < n:
        found = _TAG.search(page, at)
        if not found:
            reader.text(page[at:])
            break
        if found.start() > at:
            reader.text(page[at : found.start()])
        name = found[2]
        if name is None:
            comment = found[0] == "<!--"
            end = page.find("-->" if comment else ">", found.end())
            if end < 0:
                break
            at = end + (3 if comment else 1)
            continue
        end = _END.match(page, found.end())
        at = end.end() if end else page.find(">", found.end()) + 1
        if not at:
            break
        name = name.lower()
        if found[1]:
            reader.close(name)
        elif name in RAW:
            if name not in UNSEEN:
                reader.border()
            close = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
            if not close:
                break
            at = page.find(">", close.start()) + 1 or n
        else:
            reader.open(name, page[found.end() : at - 1])
    reader.border()
    return reader.blocks


#: What the tree sees of a block.
FEATURES = (
    "boiler", "content", "words", "density", "before_words", "before_density", "after_words", "after_density",
    "heading", "item", "page_has_content",
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ITEMS = frozenset("li dt dd td th option caption".split())


def describe(blocks: list[Block]) -> np.ndarray:
    """A row of ``FEATURES`` for each block; borders of the page count as empty neighbours."""
    n = len(blocks)
    words = np.array([b.words for b in blocks], float)
    density = np.array([b.density for b in blocks], float)
    out = np.zeros((n, len(FEATURES)))
    out[:, 0] = [b.boiler for b in blocks]
    out[:, 1] = [b.content for b in blocks]
    out[:, 2], out[:, 3] = words, density
    out[1:, 4], out[1:, 5] = words[:-1], density[:-1]
    out[:-1, 6], out[:-1, 7] = words[1:], density[1:]
    out[:, 8] = [b.tag in _HEADINGS for b in blocks]
    out[:, 9] = [b.tag in _ITEMS for b in blocks]
    out[:, 10] = out[:, 1].any() if n else 0
    return out


# --- the tree --------------------------------------------------------------------------------


def grow_tree(x: np.ndarray, y: np.ndarray, depth: int = 7, least: int = 2) -> list[tuple]:
    """A classification tree by Gini impurity: nodes ``(feature, threshold, left, right, label)``."""
    nodes: list[tuple] = []

    def grow(rows: np.ndarray, level: int) -> int:
        me = len(nodes)
        share = y[rows].mean()
        nodes.append((-1, 0.0, -1, -1, int(share >= 0.5)))
        if level == depth or share in (0, 1) or len(rows) < 2 * least:
            return me
        best = (2 * share * (1 - share) * len(rows) - 1e-9, -1, 0.0)
        for f in range(x.shape[1]):
            values = np.unique(x[rows, f])
            for t in (values[:-1] + values[1:]) / 2:
                left = x[rows, f] <= t
                a, b = y[rows[left]], y[rows[~left]]
                if min(len(a), len(b)) < least:
                    continue
                cost = sum(2 * s.mean() * (1 - s.mean()) * len(s) for s in (a, b))
                if cost < best[0]:
                    best = (cost, f, t)
        if best[1] >= 0:
            left = x[rows, best[1]] <= best[2]
            nodes[me] = (best[1], best[2], grow(rows[left], level + 1), grow(rows[~left], level + 1), nodes[me][4])
        return me

    grow(np.arange(len(x)), 0)
    return nodes


def apply_tree(nodes: list[tuple], x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), bool)
    todo = [(0, np.arange(len(x)))]
    while todo:
        k, rows = todo.pop()
        f, t, left, right, label = nodes[k]
        if f < 0:
            out[rows] = label
        elif len(rows):
            goes = x[rows, f] <= t
            todo += [(left, rows[goes]), (right, rows[~goes])]
    return out


#: The labelled table: pages as lines of label and HTML. ``+`` is main text, ``-`` is not, ``=``
#: has no text. ``{n}`` stands for n words, ``{an}`` for n linked ones.
LABELLED = (
    """
    =<nav><ul>
    -<li><a href="/">{1}</a></li>
    -<li><a href="/a">{1}</a></li>
    -<li><a href="/b">{2}</a></li>
    =</ul></nav><article>
    +<h1>{8}</h1>
    +<p>{60}</p>
    +<p>{3}</p>
    +<p>{1}</p>
    +<p>{45} {a2} {20}</p>
    -<div class="ad">{12}</div>
    +<p>{150}</p>
    =</article>
    -<footer>{12}</footer>
    """,
    """
    -<header>{4}</header>
    -<div class="menu">{a1} {a1} {a2} {a1}</div>
    =<main>
    +<h2>{5}</h2>
    +<p>{1}</p>
    +<p>{90}</p>
    =<ul>
    +<li>{9}</li>
    +<li>{14}</li>
    =</ul>
    +<p>{2}</p>
    -<form>{6}</form>
    +<p>{33}</p>
    =<section class="comments">
    -<h3>{2}</h3>
    -<p>{40}</p>
    -<p>{25}</p>
    =</section></main>
    -<aside>{30}</aside>
    -<footer>{a2} {a2} {3}</footer>
    """,
    """
    -<div>{a1} {a1} {a1}</div>
    -<div>{a2}</div>
    -<div>{a3}</div>
    +<h1>{7}</h1>
    +<div>{80}</div>
    +<div>{35} {a1}</div>
    +<p>{120}</p>
    +<p>{18}</p>
    +<p>{64}</p>
    -<div>{a4}</div>
    -<div>{a2} {1}</div>
    -<div>{3}</div>
    """,
    """
    -<div>{2}</div>
    -<div>{a5}</div>
    +<h2>{6}</h2>
    +<p>{70}</p>
    +<p>{11}</p>
    +<p>{95}</p>
    +<p>{28}</p>
    -<div class="cookie-notice">{24}</div>
    -<div id="sidebar"><p>{45}</p></div>
    -<div>{a3} {2}</div>
    -<div>{a2}</div>
    -<div>{4}</div>
    """,
    """
    -<div class="banner">{18}</div>
    =<article>
    +<h1>{12}</h1>
    +<p>{1}</p>
    +<p>{2}</p>
    +<blockquote>{30}</blockquote>
    +<p>{4}</p>
    +<p>{7} {a1}</p>
    =<div class="comment-list">
    -<p>{60}</p>
    -<p>{12}</p>
    =</div></article>
    -<div class="related">{a6}</div>
    -<p>{a2}</p>
    -<p>{40}</p>
    -<div>{8}</div>
    """,
    """
    -<ul><li>{a1}</li></ul>
    -<ul><li>{a2}</li></ul>
    -<ul><li>{a1}</li></ul>
    -<p>{3}</p>
    -<p>{a7}</p>
    +<h1>{9}</h1>
    +<p>{55}</p>
    +<p>{130}</p>
    +<p>{21}</p>
    +<p>{75}</p>
    -<table><tr><td>{a2}</td></tr></table>
    -<div>{a1} {a1}</div>
    -<div>{2}</div>
    """,
    """
    =<article>
    +<h1>{6}</h1>
    +<p>{a3}</p>
    +<p>{20}</p>
    +<p>{a6} {5}</p>
    +<p>{1}</p>
    =<ul>
    +<li>{a4}</li>
    +<li>{a2} {6}</li>
    =</ul>
    +<p>{2}</p>
    """,
    """
    -<nav>{15}</nav>
    =<main>
    +<p>{1}</p>
    +<p>{a2} {1}</p>
    +<p>{3}</p>
    +<p>{a5}</p>
    -<div class="newsletter">{22}</div>
    +<p>{4}</p>
    """,
    """
    +<h1>{4}</h1>
    +<p>{38}</p>
    +<p>{110}</p>
    +<p>{16}</p>
    +<p>{52}</p>
    """,
    """
    =<article>
    +<p>{1}</p>
    +<p>{2}</p>
    """,
    """
    =<article>
    +<p>{5}</p>
    +<p>{a2}</p>
    """,
    """
    =<main>
    +<p>{3}</p>
    """,
    """
    =<article>
    +<h1>{2}</h1>
    +<p>{1}</p>
    -<aside>{9}</aside>
    """,
    """
    =<article>
    +<p>{a4}</p>
    +<p>{4}</p>
    +<p>{6}</p>
    """,
    """
    +<p>{90}</p>
    """,
    """
    +<p>{60}</p>
    """,
    """
    -<p>{4}</p>
    """,
    """
    -<p>{2}</p>
    -<p>{3}</p>
    """,
)


def labelled_blocks() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of ``LABELLED``."""
    rows, labels = [], []
    for page in LABELLED:
        lines = [line.strip() for line in page.strip().splitlines()]
        fill = lambda m: ("<a href='#'>%s</a>" if m[1] else "%s") % " ".join(["word"] * int(m[2]))
        source = "".join(re.sub(r"\{(a?)(\d+)\}", fill, line[1:]) for line in lines)
        rows.append(describe(read_blocks(source)))
        labels += [line[0] == "+" for line in lines if line[0] != "="]
    x, y = np.concatenate(rows), np.array(labels, float)
    if len(x) != len(y):
        raise ValueError("each labelled line must make one block")
    return x, y


def main_text(page: str | None, tree: list[tuple]) -> str:
    """The main blocks in page order, joined by an empty line."""
    blocks = read_blocks(page or "")
    if not blocks:
        return ""
    return "\n\n".join(b.text for b, keep in zip(blocks, apply_tree(tree, describe(blocks)), strict=True) if keep)


def _extract(tree: list[tuple]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(page.as_py(), tree) for page in part.column("html")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    ["id", "url", "text", "n_chars"],
                )

    return run


def extract_main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """A row per page: id, url, text and n_chars (code points).

    Null and empty pages, and pages without main text, have an empty text. Every row gives a
    row, repeated rows and null ids too; an empty table gives none, and other columns are not
    looked at. Character references are decoded, white space in a block is one space, a line
    break is white space. Pages are read whole; memory follows the longest one.
    """
    tree = grow_tree(*labelled_blocks())
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").alias("html")
    )
    found = rows.mapInArrow(_extract(tree), "id long, url string, text string, n_chars long")
    return found.withColumnsRenamed({"id": id_col, "url": url_col})
