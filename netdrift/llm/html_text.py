"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is read once from left to right. Tags of block elements end a block, others do not (a line break is white space), so that
a page becomes a flat list of text blocks. Each block is told by its number of words and its link density (the share of
its words inside links), the same of the block before and the block after, whether it ends like a sentence, whether it is
a heading, and its place: 1 in an article or main element, -1 in an element of navigation, notices, forms and the like, or beside the
article of a page that has one, 0 else. A decision tree, grown by Gini impurity on the small labelled table below, keeps or drops the block.
Scripts, styles, markup, comments in markup and elements that are hidden have no blocks.

Defined cases: a null or empty page, or one without blocks that are kept, gives the empty text; broken markup (unclosed tags,
quotes or comments, stray signs) is read as far as it goes; repeated rows are rows each. The whole page is read.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, slices

#: Elements of HTML by what they mean for blocks.
INLINE = frozenset(
    "a abbr acronym audio b bdi bdo big br button canvas cite code data datalist del dfn em embed font i iframe img input ins kbd label map mark math nobr noscript object q rb rp rt ruby s samp script select "
    "small span strike strong style sub sup svg template textarea time tt u var video wbr".split()
)
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())  # their content is no markup
UNSEEN = frozenset("head script style noscript template textarea title iframe object embed svg math canvas audio video map select datalist option button".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ARTICLE = frozenset("article main".split())
AROUND = frozenset("nav aside footer header form menu dialog fieldset".split())
#: Words in class, id and role that mark what is not the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies copyright disclaimer "
    "discussion disqus footer header login masthead menu menubar modal nav navbar navigation newsletter notice notices pager pagination popup privacy promo promotion recommended related "
    "replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets warning alert".split()
)
ROLE_MAIN = frozenset(("main", "article"))

_TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|(!--)|([!?/]))")
_ATTRIBUTES = re.compile(r"""[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>""")
_NAMED = re.compile(r"""\b(class|id|role|style|aria-hidden|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_WORDS = re.compile(r"[a-z]+")
_HUMPS = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


@dataclass
class Block:
    """Text with white space as single blanks, and what the classifier is told of it."""

    text: str
    words: int
    linked: int
    around: bool
    heading: bool
    article: bool


def _marks(tag: str, attributes: str) -> tuple[bool, bool, bool]:
    """Whether an element's attributes mark it as around the article, as the article, and as hidden."""
    around = article = hidden = False
    if "=" in attributes or "hidden" in attributes.lower():
        for m in _NAMED.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id", "role"):
                words = _WORDS.findall(_HUMPS.sub(" ", value).lower())
                around = around or (not MARKS.isdisjoint(words) and tag not in ("body", "html", "main"))
                article = article or (name == "role" and not ROLE_MAIN.isdisjoint(words))
            elif name == "style":
                hidden = hidden or _HIDDEN.search(value) is not None
            else:
                hidden = hidden or (name == "hidden" and m[0].lower() == "hidden") or (name == "hidden" and value.lower() != "until-found") or value.lower() == "true"
    return around, article, hidden


class Reader:
    """Blocks of one page in order."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.has_article = False
        self.open: list[tuple[str, bool, bool, bool]] = []  # elements: name, around, article, unseen
        self.around = self.article = self.unseen = 0  # how many open elements are such
        self.links = self.headings = 0
        self.parts: list[str] = []
        self.words = self.linked = 0

    def read(self, page: str) -> list[Block]:
        at, broken = 0, False
        while (m := _TAG.search(page, at)) is not None:
            self.text(page[at : m.start()])
            if m[3]:
                end = page.find("-->", m.end() if not page.startswith(">", m.end()) else m.start() + 2)
                at = len(page) if end < 0 else end + 3
                continue
            inside = None if broken or m[4] else _ATTRIBUTES.match(page, m.end())
            broken = broken or (inside is None and not m[4])  # a quote that nothing closes: tags end at the next sign
            end = inside.end() if inside else page.find(">", m.end()) + 1
            if end == 0:
                at = len(page)
                break
            at = end
            if m[4]:
                continue
            tag, attributes = m[2].lower(), page[m.end() : end - 1]
            if m[1]:
                self.close(tag)
            else:
                self.start(tag, attributes)
                if tag in RAW:
                    ending = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(page, at)
                    at = ending.start() if ending else len(page)
        self.text(page[at:])
        self.flush()
        return self.blocks

    def text(self, raw: str) -> None:
        if raw and not self.unseen:
            text = html.unescape(raw) if "&" in raw else raw
            self.parts.append(text)
            if self.links:
                self.linked += len(text.split())

    def flush(self) -> None:
        if self.parts:
            words = "".join(self.parts).split()
            if words:
                self.blocks.append(Block(" ".join(words), len(words), min(self.linked, len(words)), self.around > 0, self.headings > 0, self.article > 0))
            self.parts, self.linked = [], 0

    def start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.parts.append(" ")
            return
        if tag not in INLINE:
            self.flush()
        if tag == "a":
            self.links = 1  # links do not nest
        if tag in EMPTY:
            return
        if tag in ("p", "li", "dt", "dd", "td", "th", "tr", "option"):  # elements whose end may be left out
            self._implied(tag)
        around, article, hidden = _marks(tag, attributes)
        # a header inside an article holds its headings, which stay
        around, article = around or tag in AROUND, article or tag in ARTICLE
        unseen = hidden or tag in UNSEEN
        if tag in INLINE and not (around or unseen):
            return
        self.open.append((tag, around, article and not around, unseen))
        self.around, self.article, self.unseen = self.around + around, self.article + (article and not around), self.unseen + unseen
        self.has_article = self.has_article or (article and not around)
        self.headings += tag in HEADINGS

    def _implied(self, tag: str) -> None:
        for name, *_ in reversed(self.open[-4:]):
            if name == tag:
                self._leave(tag)
                return
            if name not in ("p", "b", "i", "em", "strong", "span", "font"):
                return

    def _leave(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                for name, around, article, unseen in self.open[i:]:
                    self.around, self.article, self.unseen, self.headings = self.around - around, self.article - article, self.unseen - unseen, self.headings - (name in HEADINGS)
                del self.open[i:]
                return
            if i < len(self.open) - 400:  # a stray end tag deep in unclosed elements
                return

    def close(self, tag: str) -> None:
        if tag == "a":
            self.links = 0
        if tag not in INLINE:
            self.flush()
        self._leave(tag)


#: The labelled table: one line a page, one entry a block in page order: words, linked words, then letters for what it ends with or
#: where it stands (s: ends like a sentence, u: around the article by element or mark, h: heading, a: in the article), and = for a
#: block of the main text, - for one that is not.
LABELLED = """
1/1u- 1/1u- 2/2u- 9/0su- 8/0ha= 62/0sa= 1/0sa= 40/3sa= 2/0a= 12/0su-
3/3u- 2/2u- 5/0ha= 4/0a= 120/2sa= 3/3a= 77/0sa= 25/0su- 14/2u- 30/0su-
6/0ha= 2/0sa= 1/0a= 33/33a= 18/0a= 9/0sau- 44/0sau- 6/2u-
4/0h- 2/2- 1/1- 30/0s- 11/0ha= 50/0sa= 7/0a= 90/5sa= 3/3- 2/2- 16/0s- 5/0-
12/12- 55/0s- 10/0a= 3/0sa= 21/0sa= 60/0s- 8/8-
2/2au- 7/0ha= 1/1a= 48/4sa= 19/0sau- 5/0hau- 27/0sau- 70/0sa=
1/1- 1/1- 2/2- 7/0h= 45/2s= 60/0s= 52/1s= 3/3- 4/4- 8/2-
2/2- 3/3- 1/1- 6/0h= 30/0s= 4/0s= 85/6s= 41/0s= 9/9- 2/2- 11/1-
2/2- 1/1- 3/3- 2/1- 5/0h= 24/1s= 36/0s= 3/0s= 1/0s= 28/0s= 2/2- 2/2- 6/0-
4/4u- 2/2u- 8/0h= 66/3s= 20/0s= 35/0s= 18/1su- 5/0hu- 40/0su- 22/0su-
7/0h= 1/0s= 15/0s= 6/0s= 2/0s= 31/0s= 4/4- 4/0-
2/2- 2/2- 2/2- 2/2- 2/2- 3/0- 2/2- 2/2-
6/6- 5/5- 7/7- 4/4- 8/8- 12/3- 3/3-
1/1- 2/2- 12/0s= 14/0s= 9/0s= 3/3- 3/3- 5/1-
2/2u- 25/0s= 44/0s= 2/0s= 8/1= 16/0s= 3/1u- 6/0su-
3/3- 10/0h= 80/0s= 5/0h= 95/8s= 6/0h= 12/0= 14/1= 11/0= 70/2s= 3/3- 6/6- 4/0-
5/0u- 1/1u- 15/0su- 35/0su- 60/2su- 7/0hu- 90/0su- 3/3u-
9/9- 25/0s= 31/2s= 18/0s=
2/2- 5/0h= 40/0s= 22/1s= 9/0s=
30/0s= 12/0s= 3/0s=
40/3s=
16/0s= 21/5s=
2/2- 3/3- 20/0s= 2/0s= 35/0s=
1/0s= 50/0s= 3/0s=
6/0h= 4/0s=
3/0- 1/1- 1/1- 7/0h= 28/7s= 33/9s= 19/0s=
2/0- 4/4- 6/6- 28/0s= 5/2s= 40/11s= 62/0s= 7/7- 7/7-
8/0h= 22/0= 17/0= 29/0s=
6/0ha= 30/0sa= 2/2au- 3/3au- 1/1au- 2/2a= 1/1a= 40/4sa= 4/4a=
9/0ha= 2/2a= 14/0sa= 1/1a= 3/3au- 2/2au- 1/1- 25/0s- 31/0s- 5/0h-
5/0ha= 40/0sa= 1/0a=
2/2u- 3/0ha= 1/0a= 2/0a= 1/1a=
4/0ha= 60/0sa= 15/3sa=
1/0sa= 20/0sa= 2/2a= 3/0sa=
2/0ha= 1/1a= 3/0a=
1/0a= 4/4a= 30/2sa=
3/3a= 25/0sa= 6/6a= 1/0a=
9/0ha= 22/0a= 5/0ha= 17/17a= 1/0a= 100/0sa= 2/0sa= 6/6u-
""".strip().splitlines()
NAMES = ("words", "density", "words before", "density before", "words after", "density after", "sentence", "heading", "place")
#: Blocks of a leaf at least, and levels of the tree at most.
LEAST_LEAF, LEVELS = 2, 8
_ENTRY = re.compile(r"(\d+)/(\d+)([suha]*)([=-])")
_SENTENCE = re.compile(r"[.!?…:;。！？][\"'”’»)\]]*$")


def features(words: list[int], linked: list[int], flags: list[tuple[bool, bool, bool, bool]], has_article: bool) -> np.ndarray:
    """A row for each block, by NAMES; beyond a page's ends there are blocks of nothing. ``flags``: sentence, around, heading, in article."""
    n = np.array([0, *words, 0], float)
    density = np.array([0, *linked, 0], float) / np.maximum(n, 1)
    sentence, around, heading, article = np.array(flags, bool).reshape(len(words), 4).T
    place = np.where(around, -1.0, np.where(article, 1.0, -1.0 if has_article else 0.0))
    return np.column_stack([n[1:-1], density[1:-1], n[:-2], density[:-2], n[2:], density[2:], sentence, heading, place])


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of LABELLED."""
    rows, labels = [], []
    for line in LABELLED:
        found = [_ENTRY.fullmatch(e) for e in line.split()]
        flags = [tuple(c in m[3] for c in "suha") for m in found]
        rows.append(features([int(m[1]) for m in found], [int(m[2]) for m in found], flags, any(f[3] for f in flags)))
        labels += [m[4] == "=" for m in found]
    return np.vstack(rows), np.array(labels)


def grown(x: np.ndarray, y: np.ndarray, levels: int = LEVELS) -> tuple | bool:
    """A tree: (feature, threshold, tree of values up to it, tree of values above) or a label. Splits of least Gini impurity;
    ties go to the first feature and threshold."""
    if y.all() or not y.any() or not levels:
        return bool(y.mean() > 0.5)
    best = (y.mean() * (1 - y.mean()) * len(y) - 1e-12, None, None)
    for f in (8, 7, 6, 1, 0, 3, 5, 2, 4):  # where a block stands before how long it is
        values = np.unique(x[:, f])
        for threshold in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= threshold
            if min(low.sum(), (~low).sum()) < LEAST_LEAF:
                continue
            gini = sum(part.mean() * (1 - part.mean()) * len(part) for part in (y[low], y[~low]))
            if gini < best[0] - 1e-12:
                best = (gini, f, threshold)
    _, f, threshold = best
    if f is None:
        return bool(y.mean() > 0.5)
    low = x[:, f] <= threshold
    return f, float(threshold), grown(x[low], y[low], levels - 1), grown(x[~low], y[~low], levels - 1)


@functools.cache
def tree() -> tuple | bool:
    return grown(*labelled_table())


def classified(x: np.ndarray, node: tuple | bool) -> np.ndarray:
    """The tree's label of every row, node by node."""
    if isinstance(node, bool):
        return np.full(len(x), node)
    f, threshold, low, high = node
    out, under = np.empty(len(x), bool), x[:, f] <= threshold
    out[under], out[~under] = classified(x[under], low), classified(x[~under], high)
    return out


def blocks_of_page(page: str | None) -> tuple[list[Block], np.ndarray]:
    """The blocks of a page and whether each is main text."""
    reader = Reader()
    blocks = reader.read(page or "")
    flags = [(_SENTENCE.search(b.text[-8:]) is not None, b.around and not (b.heading and b.article and not b.linked), b.heading, b.article) for b in blocks]
    return blocks, classified(features([b.words for b in blocks], [b.linked for b in blocks], flags, reader.has_article), tree())


def main_text(page: str | None) -> str:
    blocks, keep = blocks_of_page(page)
    return "\n".join(b.text for b, k in zip(blocks, keep.tolist(), strict=True) if k)


def extract(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """``pages`` without the html and with text and n_chars, its code points."""
    arrow_batches(pages.sparkSession, 256)
    kept = [c for c in pages.columns if c != html_column and c not in ("text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in slices(batch.column(batch.num_columns - 1)):
                texts = [main_text(p) for p in part]
                columns = [batch.column(i).slice(at, len(part)) for i in range(len(kept))]
                at += len(part)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*kept, "text", "n_chars"])

    kinds = "".join(f"`{c}` {k}, " for c, k in pages.select(*kept).dtypes)
    return pages.select(*kept, F.col(html_column)).mapInArrow(run, f"{kinds}text string, n_chars bigint")
