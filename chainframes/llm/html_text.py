"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut into flat blocks of text.  Each block is described by its number of
words and its link density, by those of its neighbours, and by what the containers
around it say of themselves.  A decision tree learned from a small table of
labelled layouts says which blocks are the article's.  A page is one row and needs
nothing of any other page, so extraction is a single pass without a shuffle.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# -- blocks ------------------------------------------------------------------

HEADINGS = frozenset(f"h{i}" for i in range(1, 7))
#: Tags that end a block of text; all others, unknown ones too, stand inside it.
LEAVES = HEADINGS | frozenset("p li dt dd tr td th pre hr caption figcaption legend summary address option blockquote".split())
CONTAINERS = frozenset(
    "html head body article aside center details dialog dir div dl fieldset figure footer form frameset header hgroup main menu nav ol optgroup search section table tbody tfoot thead ul".split()
)
#: Elements whose content is no text of the page.
DROPPED = "title noscript template iframe object svg math textarea select button audio video canvas map"
BOILER_TAGS = frozenset("nav footer aside form menu dialog search fieldset".split())
MAIN_TAGS = frozenset(("article", "main"))
#: An end tag of a plain container does not close any of these.
BARRIERS = BOILER_TAGS | MAIN_TAGS | {"header"}
#: Words in ``class``, ``id`` and ``role`` by which containers name their purpose.
BOILER_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert
    popup modal overlay newsletter subscribe subscription signup login sidebar sidenav widget widgets related recommended recommendations teaser share
    sharing social breadcrumb breadcrumbs crumbs menu menubar nav navbar navigation pagination pager footer copyright masthead comment comments reply
    replies discussion disqus respond toolbar search skip hidden contentinfo complementary""".split()
)
WEAK_WORDS = frozenset("header head top side bar".split())
MAIN_WORDS = frozenset("article content post entry story main articlebody".split())

_ATTRIBUTES = r"""(?:"[^"]*+"|'[^']*+'|[^'">])*+"""
_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)
    |<(script|style)\b{_ATTRIBUTES}>.*?(?:</\1\s*>|\Z)
    |<({"|".join(DROPPED.split())})\b{_ATTRIBUTES}>.*?</\2\s*>
    |<[!?][^>]*>
    |<(/?)([a-z][^\s/>]*)((?:{_ATTRIBUTES}(?=>))|[^>]*)>""",
    re.I | re.S | re.X,
)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_WORDS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*|[0-9]+")


def purpose(attributes: str) -> int:
    """-1 if a container's names or its being hidden speak of boilerplate, 1 if
    its names speak of the article, else 0."""
    if not attributes:
        return 0
    if "hidden" in attributes.lower() or "none" in attributes.lower():
        if _HIDDEN.search(attributes):
            return -1
    found = {w.lower() for m in _NAMED.finditer(attributes) for w in _WORDS.findall(m[1] or m[2] or m[3] or "")}
    if found & BOILER_WORDS:
        return -1
    return 1 if found & MAIN_WORDS else -1 if found & WEAK_WORDS else 0


@dataclass
class Block:
    text: str
    words: int
    linked: int
    near: int  # nearest container that says something: -1 boilerplate, 1 article
    tagged: bool  # inside a tag that never holds an article
    named: bool  # inside a container, in the article if there is one, that names itself boilerplate
    inside: bool  # inside an article
    heading: bool


@dataclass
class _Cutter:
    """One page's open containers and the block that is being read."""

    stack: list[tuple[str, int, bool, bool, bool]] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    links: int = 0
    leaf: tuple[str, int] = ("", 0)

    def end_block(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            _, near, tagged, named, inside = self.stack[-1] if self.stack else ("", 0, False, False, False)
            tag, own = self.leaf
            linked = min(len("".join(self.linked).split()), len(text.split()))
            self.blocks.append(Block(text, len(text.split()), linked, own or near, tagged, named or own < 0, inside, tag in HEADINGS))
        self.parts, self.linked = [], []

    def open(self, tag: str, attributes: str) -> None:
        if tag == "a":
            self.links += 1
        elif tag == "br":
            self.parts.append(" ")
        elif tag in LEAVES:
            self.end_block()
            self.leaf = (tag, purpose(attributes))
        elif tag in CONTAINERS:
            self.end_block()
            self.leaf, self.links = ("", 0), 0
            if tag in MAIN_TAGS:  # menus and page headers hold no article: one that is open was left open
                while self.stack and self.stack[-1][0] in ("nav", "header", "footer", "menu"):
                    self.stack.pop()
            _, near, tagged, named, inside = self.stack[-1] if self.stack else ("", 0, False, False, False)
            own = 0 if tag in ("html", "body") else purpose(attributes)
            if tag in MAIN_TAGS:
                own, inside, named = own or 1, True, False
            elif own > 0:
                inside, named = True, False
            bad = tag in BOILER_TAGS or (tag == "header" and not inside)
            own = -1 if bad else own
            self.stack.append((tag, own or near, tagged or bad, named or own < 0, inside))

    def close(self, tag: str) -> None:
        if tag == "a":
            self.links = max(0, self.links - 1)
        elif tag in LEAVES or tag in CONTAINERS:
            self.end_block()
            self.leaf = ("", 0)
            if tag in CONTAINERS:
                for at in range(len(self.stack) - 1, -1, -1):
                    if self.stack[at][0] == tag:
                        del self.stack[at:]
                        break
                    if self.stack[at][0] in BARRIERS and tag not in BARRIERS and tag not in ("html", "body"):
                        break

    def text(self, raw: str) -> None:
        decoded = html.unescape(raw)
        self.parts.append(decoded)
        if self.links:
            self.linked.append(decoded)


def blocks_of(page: str | None) -> list[Block]:
    """The text blocks of a page in order, white space folded, references decoded."""
    cutter, at = _Cutter(), 0
    page = page or ""
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            cutter.text(page[at : m.start()])
        at = m.end()
        if m[4]:
            tag = m[4].lower()
            (cutter.close if m[3] else lambda t, a=m[5]: cutter.open(t, a))(tag)
        elif m[2]:
            cutter.parts.append(" ")
    cutter.text(page[at:])
    cutter.end_block()
    return cutter.blocks


FEATURES = ("words", "link_density", "words_before", "density_before", "words_after", "density_after", "near", "tagged", "named", "inside", "page_has_article", "heading")


def features(blocks: list[Block]) -> np.ndarray:
    """One row per block; a page's first and last block have empty neighbours."""
    words = np.array([0, *[b.words for b in blocks], 0], float)
    density = np.array([0, *[b.linked / b.words for b in blocks], 0], float)
    article = any(b.inside for b in blocks)
    own = np.array([(b.near, b.tagged, b.named, b.inside, article, b.heading) for b in blocks], float).reshape(-1, 6)
    return np.column_stack([words[1:-1], density[1:-1], words[:-2], density[:-2], words[2:], density[2:], own])


# -- decision tree -----------------------------------------------------------


@dataclass(frozen=True)
class Tree:
    """A binary tree as arrays: at node ``i`` go to ``left[i]`` if the feature is
    below the limit, else to ``right[i]``; a leaf has feature -1."""

    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    keep: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        while len(rows := rows[self.feature[at[rows]] >= 0]):
            node = at[rows]
            below = x[rows, self.feature[node]] < self.limit[node]
            at[rows] = np.where(below, self.left[node], self.right[node])
        return self.keep[at]


def learn_tree(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 2) -> Tree:
    """A tree by Gini impurity; of equally good splits the first feature's."""
    nodes: list[list] = []

    def impurity(ones: np.ndarray, size: np.ndarray) -> np.ndarray:
        share = ones / np.maximum(size, 1)
        return size * 2 * share * (1 - share)

    def grow(rows: np.ndarray, left_depth: int) -> int:
        node, mine = len(nodes), y[rows]
        nodes.append([-1, 0.0, -1, -1, mine.mean() >= 0.5])
        best = (impurity(mine.sum(), len(rows)) - 1e-9, -1, 0.0)
        if left_depth and 0 < mine.sum() < len(mine):
            for f in range(x.shape[1]):
                order = np.argsort(x[rows, f], kind="stable")
                v, ones = x[rows[order], f], np.cumsum(mine[order])
                size = np.arange(1, len(v))
                cost = impurity(ones[:-1], size) + impurity(ones[-1] - ones[:-1], len(v) - size)
                cost[(v[1:] == v[:-1]) | (size < least) | (len(v) - size < least)] = np.inf
                if len(cost) and (i := int(np.argmin(cost))) >= 0 and cost[i] < best[0]:
                    best = (cost[i], f, (v[i] + v[i + 1]) / 2)
        if best[1] >= 0:
            below = x[rows, best[1]] < best[2]
            nodes[node][:2] = best[1], best[2]
            nodes[node][2] = grow(rows[below], left_depth - 1)
            nodes[node][3] = grow(rows[~below], left_depth - 1)
        return node

    grow(np.arange(len(x)), depth)
    feature, limit, left, right, keep = zip(*nodes, strict=True)
    return Tree(np.array(feature), np.array(limit), np.array(left), np.array(right), np.array(keep, bool))


# -- labelled layouts --------------------------------------------------------

#: Layouts of pages: ``{m9}`` is article text of nine words, ``{s9}`` text that is
#: none, ``{l9}`` the same as a link, ``{k9}`` article text with a link in it.
LAYOUTS = (
    "<nav><ul><li>{l1}<li>{l1}<li>{l2}</ul></nav><div class='ad'>{s9}</div><article><h1>{m6}</h1><p>{m30}<p>{m1}<p>{k20}</article><footer>{s7}</footer>",
    "<header><h1>{l3}</h1><p>{s12}</header><main><h1>{m8}</h1><p>{m25}</p><ul><li>{m4}<li>{k5}</ul><blockquote>{m12}</blockquote><aside>{s14}</aside><p>{m2}</p></main><footer><p>{s9}<p>{l2}</footer>",
    "<div id='header'>{l2}</div><div class='menu'>{l1} {l1} {l1}</div><div id='content'><h2>{m5}</h2><p>{m40}</p><p>{m3}</p><div class='comments'><p>{s25}</p><p>{s4}</p></div></div><div class='sidebar'><p>{s20}</p>{l4}</div><div id='footer'>{s12}</div>",
    "<div class='cookie-notice'><p>{s22}</p></div><div class='nav'>{l1}{l1}</div><div class='post'><h1>{m7}</h1><p>{m18}</p><table><tr><td>{m2}<td>{m1}</table><p>{m35}</p><div class='share'>{l1} {l1}</div></div><form><p>{s8}</p></form>",
    "<table><tr><td>{l1}<td>{l1}<td>{l2}</table><h1>{m6}</h1><p>{m28}</p><p>{m33}</p><p>{k45}</p><div>{s4}</div><div>{l3}</div>",
    "<div>{l2}</div><div>{l1}</div><div><p>{m24}</p><p>{k38}</p><p>{m16}</p><p>{m50}</p></div><div>{l4}</div><div>{s5}</div><div>{l1}</div>",
    "<p>{m20}</p><p>{m31}</p><p>{m14}</p><p>{m60}</p>",
    "<h1>{m5}</h1><p>{m45}<p>{m22}<p>{m33}<p>{l3}<p>{l2}<p>{l5}",
    "<div>{l2}</div><div>{l3}</div><h2>{m7}</h2><p>{m26}</p><p>{m19}</p><h2>{m4}</h2><p>{m41}</p><div>{s3}</div>",
    "<article><header><h1>{m6}</h1><p>{m5}</p></header><p>{m33}</p><figure><figcaption>{m7}</figcaption></figure><p>{m2}</p><section class='comments'><h3>{s2}</h3><p>{s30}</p></section><footer>{s6}</footer></article><aside><article><h3>{l6}</h3><p>{s18}</p></article></aside>",
    "<div role='banner'>{s4}</div><div role='main'><p>{m12}</p><p>{m1}</p><p>{l3}</p><pre>{m9}</pre></div><div role='complementary'><p>{s40}</p></div><p>{s15}</p>",
    "<section class='story'><p>{m3}</p><p>{m44}</p><p class='advert'>{s11}</p><p>{m8}</p></section><section class='related'><p>{s22}</p><p>{l7}</p></section><p>{s30}</p>",
    "<article><p>{m10}</p></article>",
    "<nav><p>{s20}</p><p>{s26}</p></nav><h1>{m6}</h1><p>{m30}</p><p>{m40}</p><aside><p>{s38}</p><p>{s22}</p></aside><footer><p>{s30}</p><p>{s14}</p><p>{s8}</p></footer>",
    "<div class='banner'>{s24}</div><p>{m33}</p><div class='ad'><p>{s40}</p></div><p>{m28}</p><p>{m45}</p><div class='comments'><p>{s31}</p><p>{s26}</p><p>{s12}</p></div>",
    "<main><p>{l3}</p></main><p>{s25}</p>",
    "<p>{s30}</p><article><h1>{m5}</h1><p>{m30}</p><p>{l4}</p></article><p>{s30}</p>",
    "<div>{s50}</div><div>{s12}</div><div>{s26}</div><main><p>{l2}</p><p>{m1}</p><p>{l5}</p></main><div>{s25}</div><div>{s40}</div><div>{s3}</div>",
    "<p>{s2}</p><div class='entry'><p>{l6}</p></div><p>{s18}</p><p>{s35}</p>",
    "<aside><article><p>{s20}</p><p>{s45}</p></article></aside><article><p>{m5}</p><p>{l4}</p><p>{m60}</p></article><aside><article><p>{s6}</p></article></aside><div>{s33}</div>",
    "<div class='article'><p>{l3}</p><p>{l2}</p><p>{m4}</p></div><div>{s28}</div><footer><article><p>{s31}</p></article></footer>",
)
#: Text lengths of the layouts are also taken at these multiples.
STRETCH = (1.0, 0.1, 0.3, 0.6, 1.7, 3.0)


def labelled_blocks() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of all blocks of the labelled layouts: some hundred rows."""

    def words(kind: str, n: int) -> str:
        main = "art" if kind in "mk" else "off"
        text = " ".join([main] * n)
        if kind == "k":
            return f"{main} <a href='x'>{main}</a> {text}"
        return f"<a href='x'>{text}</a>" if kind == "l" else text

    x, y = [], []
    for stretch in STRETCH:
        for layout in LAYOUTS:
            page = re.sub(r"\{([mslk])(\d+)\}", lambda m, s=stretch: words(m[1], max(1, round(int(m[2]) * s))), layout)
            found = blocks_of(page)
            x.append(features(found))
            y += [b.text.startswith("art") for b in found]
    links_in_main = np.array(y, bool)
    x = np.vstack(x)
    # a link that stands alone in an article is part of it
    links_in_main |= (x[:, FEATURES.index("inside")] == 1) & (x[:, FEATURES.index("tagged")] == 0) & (x[:, FEATURES.index("named")] == 0)
    return x, links_in_main


# -- pages -------------------------------------------------------------------


def extract_text(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """The main text of every page: ``page_id, url, text, n_chars``.

    ``pages`` has ``page_id, url, html``; further columns are not read, and null
    ids and urls come back as they are.  A null, empty or textless page, and one
    of boilerplate only, has an empty text.  Repeated rows are each extracted; an
    empty table gives no rows.  Pages are read whole, however long, one at a
    time.  White space within a block is one blank, blocks are joined by a line
    feed."""
    tree = tree or learn_tree(*labelled_blocks())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page in batch.column(2):
                blocks = blocks_of(page.as_py())
                kept = tree.predict(features(blocks)) if blocks else ()
                texts.append("\n".join(b.text for b, k in zip(blocks, kept, strict=True) if k))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", F.col("url").cast("string").alias("url"), "html").mapInArrow(rows, f"page_id {kind}, url string, text string, n_chars long")


def op12_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
